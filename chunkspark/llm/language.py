"""Language of a text by script and stopword votes."""

from __future__ import annotations

import re

# Frequent function words per language, in no other language of the list where possible.
STOPWORDS = {
    "en": "the of and is are was were to that this these which with from it its as at by for on we not be has have under over after during in each our how why whether when most there",
    "de": "der die das den dem des ein eine einer und ist sind wird werden nicht auch als auf bei mit nach ohne unter wir dass ob wie im am zu zur zum von für es um dabei daher sowohl wurden nur",
    "fr": "le la les des du un une et est sont dans pour avec sur par que qui nous ne pas plus au aux ce cette on comme sans lors avant malgré après sous près à",
    "es": "el la los las del un una y es son en para con por que se no más al como este esta sin bajo tras hay entre muy a la vez lo",
    "it": "il lo gli della dei un una e è sono nel per con che non più al come questo questa senza tra",
    "pt": "o os as do da dos um uma e é são em no na para com por que se não mais ao como este esta sem",
    "nl": "de het een en is zijn was wordt niet ook als op bij met naar zonder onder wij dat van voor er om",
}
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)

_SCRIPTS = [
    ("th", re.compile("[฀-๿]")),
    ("ja", re.compile("[぀-ヿ]")),
    ("zh", re.compile("[一-鿿㐀-䶿]")),
    ("ko", re.compile("[가-힯]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("he", re.compile("[֐-׿]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
]
_NON_LATIN = re.compile("[Ͱ-῿぀-ヿ㐀-鿿가-힯]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_WORD = re.compile("[a-zß-ɏ]+")
#: One sign of an East Asian or Thai script says about as much as this many Latin letters.
_WEIGHT = {"zh": 2.5, "ja": 2.5}


def script_of(text: str) -> str:
    """``latin``, ``none`` (no letters), or the language that a non-Latin script of most letters stands for."""
    if text.isascii():
        return "latin" if _LATIN.search(text) else "none"
    others = len(_NON_LATIN.findall(text))
    if not others:
        return "latin" if _LATIN.search(text) else "none"
    latin = len(_LATIN.findall(text))
    counts = {lang: len(rx.findall(text)) for lang, rx in _SCRIPTS}
    if counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    best = max(counts, key=counts.get)
    if counts[best] * _WEIGHT.get(best, 1.0) >= latin and counts[best]:
        return best
    return "latin" if latin else best


def latin_votes(text: str) -> dict[str, int]:
    votes: dict[str, int] = {}
    for word in _WORD.findall(text.lower()):
        for lang in _VOTES.get(word, ()):
            votes[lang] = votes.get(lang, 0) + 1
    return votes


def detect(text: str, default: str = "en") -> str:
    """Language code of ``text``; ``default`` where no word votes, ``none`` without letters."""
    script = script_of(text)
    if script != "latin":
        return script
    votes = latin_votes(text)
    return max(votes, key=votes.get) if votes else default
