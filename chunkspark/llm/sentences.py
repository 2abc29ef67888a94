"""Sentence units (problem 4) by cascading segmentation rules.

A candidate is the end of a run of stops with the closing marks behind it. At each candidate the rules of the text's
language are tried in order, then the common ones; each rule is a pair of patterns (what stands before, what stands
after) with a verdict, and the first that matches decides. A candidate that no rule decides is no boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chunkspark.llm.language import detect

UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
LOWER = "a-zß-öø-ÿа-яёα-ωœ"
OPEN = "[\"'“„‘«¿¡(\\[]"
#: What can begin a sentence: a capital behind opening marks, or a term that is written small even there.
STARTS = rf"(?:{OPEN}\s*)*(?:[{UPPER}]|[a-z]+_[a-z0-9]|[a-z][A-Z]|(?:[a-z]\.){{2,}}|[^\W\d_A-Za-zÀ-ɏͰ-ϿЀ-ӿ])"

# Abbreviations that never end a sentence where more follows, by language.
ABBREVIATIONS = {
    "common": "Dr Prof Mr Mrs Ms St No Nos Nr Vol vol pp p vs cf Cf ca Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Fig Figs fig Tab Eq Eqs eq Sec Secs Ref Refs Ch Chap App Thm Prop Lem Def Cor Alg ed eds viz approx",
    "en": "e.g i.e et.seq resp esp",
    "de": "z.B z. B d.h u.a bzw Abb Gl Kap Bd Hr Fr Abs Anm Aufl evtl ggf vgl Vgl S z d u",
    "fr": "M MM Mme Mlle Me éd éq n° chap art p.ex env",
    "es": "Sr Sra Srta Dra núm pág págs p.ej ej Ud Uds cap art",
    "ru": "рис табл проф с стр См см ред гл форм т акад им ул",
    "ar": "د أ ص م",
    "hi": "डॉ प्रो श्री",
}
# Abbreviations that end a sentence only where a sentence can begin behind them.
CLOSING_ABBREVIATIONS = "etc al usw usf ff f Inc Ltd Co a.m p.m U.S"
# Words that open German sentences; behind a number with a point other nouns make it an ordinal.
GERMAN_STARTS = "Der Die Das Dem Den Des Ein Eine Einer Einem Wir Im In Ob Sowohl Dabei Daher Unter Nahe Mit Nach Ohne Bei Entlang Auf Trotz Ist Sind Wie Untersucht Zwar Es Er Sie Dr Am An Als Auch Aus Da Dann Denn Dies Diese Dieser Dieses Durch Für Gegen Hier Ingesamt Jede Jeder Jedes Kein Keine Man Nicht Nun Nur Oft Sobald So Um Von Vor Weil Wenn Zu Zur Zum Über"


def _abbreviations(lang: str) -> str:
    return "|".join(re.escape(a).replace(r"\.", r"\.\s?") for a in sorted(ABBREVIATIONS[lang].split(), key=len, reverse=True))


def _rules() -> dict[str, list[tuple[bool, str, str]]]:
    """(verdict, before, after) in the order in which they are tried. ``before`` ends at the candidate."""
    never = lambda lang: (False, rf"(?<![\wÀ-ӿ])(?:{_abbreviations(lang)})\.$", "")
    initial = (False, rf"(?:^|[\s(«“\"])(?:(?:Dr|Prof|Mr|Mrs|Ms|M|[{UPPER}])\.|by|and|with|of|und|von|mit|et|de|par|y|por|и|[^\s]*[,;.!?])\s+[{UPPER}]\.$|^[{UPPER}]\.$", rf"[{UPPER}]")
    named = (False, rf"(?<![{LOWER}]{{3}})\s[{UPPER}]\.$", rf"(?!(?:The|Our|In|Each|Because|It|We|To|If|A|Most|Neither|There|Although|These|This)\b)[{UPPER}]")
    common = [
        (False, r"", r"[,;:،–—-]"),
        never("common"),
        initial,
        (False, rf"(?<![\wÀ-ӿ])(?:{_abbreviations('en')})\.$", rf"(?!{OPEN})[^\s]"),
        (True, r"", STARTS),
        (True, r"[.!?…][^\w\s]*(?:\[[\d,\s–-]+\])?$", rf"(?:{OPEN}\s*)*\d"),
    ]
    return {
        "common": common,
        "en": [named],
        "de": [never("de"), (False, r"(?<![\w.,])\d{1,4}\.$", rf"(?!(?:{'|'.join(GERMAN_STARTS.split())})\b)[{UPPER}]")],
        "fr": [never("fr")],
        "es": [never("es")],
        "ru": [never("ru"), (True, r"[тг]\.(?:\s?[ед]\.)?$", rf"[{UPPER}]")],
        "ar": [never("ar"), (False, "[.!?؟][\"”»]$", r"[^\W\d_]"), (True, r"", r"[^,;]")],
        "hi": [never("hi"), (False, "[.!?।][\"”»]$", r"[^\W\d_]"), (True, "[।!?][^\\w\\s]*$", r"[^,;]")],
        "zh": [(False, "[”’」』》）)]$", "[的地之这這那是一，、；：]"), (True, r"", r"\S")],
        "ja": [(False, "[”’」』》）)]$", "[とがはをにのでもな、へ]"), (True, r"", r"\S")],
    }


@lru_cache(maxsize=None)
def _compiled(lang: str) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    """The cascade of a language: its own table, then the common one."""
    tables = _rules()
    own = tables.get(lang, [])
    return [(verdict, re.compile(before), re.compile(after)) for verdict, before, after in (own if lang in ("zh", "ja") else own + tables["common"])]


_CITATION = r"(?:\[\d+(?:[,\s–-]+\d+)*\]|[¹²³⁰-⁹]+)"
_CLOSE = r"(?:[)\]}\"'”’»“]|[\s  ]»)"
#: Stops of alphabetic scripts: behind them a blank, or a capital directly behind a word.
_ALPHABETIC = re.compile(
    rf"(?:[.!?…؟]+|।+)(?P<close>{_CLOSE}*){_CITATION}?(?=[\s]|$|(?<=[^\W\d_]{{2}}[.!?।])(?:{OPEN})?[{UPPER}]\s?[{LOWER}]|(?<=[^\W\d_][^\W\d_][.!?।؟])(?=[؀-ۿऀ-ॿ])|(?<=[\"”»)?!\]])[{UPPER}]\s?[{LOWER}]|(?<=\d\.)[{UPPER}]\s?[{LOWER}])"
)
_IDEOGRAPHIC = re.compile(rf"[。！？!?｡]+[”’」』》）)\"']*{_CITATION}?")
_THAI = re.compile(r"\s+")
_THAI_NO = re.compile(r"[0-9๐-๙A-Za-zÀ-ɏ]")
_HEADING = re.compile(r"\s*(?:#{1,6}\s+(?:\d+(?:\.\d+)*[.)]?\s+)?|\d+(?:\.\d+)*[.)]?\s+|[-*•◦–]\s+)")
_BLANK = re.compile(r"\s*")
#: Code points before a candidate that the rules look at: their longest patterns span two words, of which one is an
#: initial or an abbreviation; where the other one begins further back, the window's own start stands for its blank.
_WINDOW = 32


def sentence_ends(text: str, lang: str | None = None) -> list[int]:
    """End positions (code points from the start, blanks behind excluded) of the sentences of ``text``.

    The last one is the end of the text without its trailing blanks; a blank text has none.
    """
    last = len(text.rstrip())
    if not last:
        return []
    lang = lang or detect(text)
    skip = m.end() if (m := _HEADING.match(text)) else 0
    ends: list[int] = []
    if lang == "th":
        for m in _THAI.finditer(text, skip, last):
            if m.start() > skip and not _THAI_NO.match(text[m.start() - 1]) and not _THAI_NO.match(text[m.end()]):
                ends.append(m.start())
        return [*ends, last]
    rules = _compiled(lang)
    for m in (_IDEOGRAPHIC if lang in ("zh", "ja") else _ALPHABETIC).finditer(text, skip, last):
        end = m.end()
        if end >= last:
            break
        if lang not in ("zh", "ja") and '"' in m["close"] and text.count('"', 0, m.start()) % 2 == 0:
            end = m.start("close") + m["close"].index('"')  # the mark opens the next sentence
        after = _BLANK.match(text, end).end()
        before = text[max(0, end - _WINDOW) : end]
        for verdict, left, right in rules:
            if right.match(text, after) and left.search(before):
                if verdict:
                    ends.append(end)
                break
    return [*ends, last]


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.num_columns - 1).to_pylist()
        at, ends = [], []
        for i, t in enumerate(text):
            if t is not None:
                found = sentence_ends(t)
                ends.extend(found)
                at.extend([i] * len(found))
        index = pa.array(at, pa.int32())
        keys = [batch.column(j).take(index) for j in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(ends, pa.int32())], [*batch.schema.names[:-1], "end_pos"])


def sentence_units(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``(*keys, end_pos)``: one row per sentence of each row of ``df``.

    Rows with a null or blank text give none. Rows are handled one by one (repeated keys repeat their units); columns
    other than ``keys`` and ``text_col`` are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*keys, text_col).mapInArrow(_explode, f"{schema}, end_pos int")
