"""Text quality statistics per document (problem 8), and rules that tell natural prose from lists, tables and junk.

Every line is read on its own (row of a table, entry of a list, page chrome, or text); the text that is left is then
judged as a whole by its letters, its common words, its stops and its repetition: shares of duplicate lines and
paragraphs, and the characters covered by the dominant word n-gram. The kind of a document is what most of its
characters belong to.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkspark.llm.language import STOPWORDS

# Common words of further languages that are written with blanks.
COMMON = {
    "ru": "и в на не что при как также после для с по из от к о за это мы здесь но или если почему ли верно чем поскольку поэтому напротив вдоль без несмотря до",
    "ar": "في من على أن إن لا مع عند هذا هذه ليس لماذا كما إلى عن هل قرب دون لذلك بين هنا ما أو ثم",
    "hi": "है हैं में की को के का से और पर यह हम कि इसके लिए करता क्या यहाँ इसलिए गई बिना पास एक नहीं",
}
_COMMON = frozenset(w for words in (*STOPWORDS.values(), *COMMON.values()) for w in words.split())
# Labels of page chrome.
_CHROME = frozenset(["menu", "home", "search", "login", "log in", "sign in", "sign up", "subscribe", "share", "download", "terms", "privacy", "accept all cookies", "cookies", "next »", "« back", "top", "view pdf", "cite this", "loading…", "loading...", "read more", "contact", "about", "help", "follow us", "copyright", "skip to content", "previous", "next", "back", "0 items"])
_CHROME_ANY = re.compile("|".join(sorted((re.escape(c) for c in _CHROME), key=len, reverse=True)))

_BOX = re.compile(r"[│┃║┆|]")
_BORDER = re.compile(r"[\s─━═│┃║┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬|+:=-]+")
_LATEX = re.compile(r"\\(?:begin|end)\{(?:tabular|table|array)|\\(?:hline|toprule|midrule|bottomrule)|\\\\\s*$")
_NUMBER = re.compile(r"[-+±]?\d[\d.,:/%±e-]*%?|[-–—]|±|n/a|na|nan|yes|no|[—.]", re.IGNORECASE)
_BULLET = re.compile(r"(?:[-*•◦–—·▪▸►‣○●■□✓✔]|\[[ xX✓]?\]|[☐☑☒]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivx]{1,5}[.)]|\[\d{1,3}\])\s+(?=\S)")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*(?:\d+|[ivxl]+)\s*$|[․‥…]{2,}\s*\d+\s*$")
_CAPTION = re.compile(r"(?:fig|figure|abb|abbildung|tab|table|tabelle|plate|рис|табл|图|表|図|scheme|box)\.?\s*\d+(?:\.\d+)*\s*[.:]", re.IGNORECASE)
_REFERENCE = re.compile(r"\d+\s*\(\d+\)\s*[:,]\s*\d+|\b(?:1[89]|20)\d\d[a-z]?\)?\.?\s*$|\bdoi\b|arXiv:")
_AUTHORS = re.compile(r"(?:\[?\d+[\].]\s*)?(?:(?:[A-Z]\.\s?)+[A-Z][\w'-]+|[A-Z][\w'-]+,\s*[A-Z]\.)\s*(?:[.,;(]|and\b|&|et\b)")
_ENTRY = re.compile(r"[^.!?。:=–—]{1,60}\s*(?:=|:|–|—|->|→)\s*[^.!?。]{1,80}")
_STOP = re.compile(r"[.!?。！？।؟…][\"'”’»“)\]」』]*(?:\s*\[[\d,\s–-]+\])?\s*$")
_STOP_SIGNS = tuple(".!?。！？।؟…")
_STOPS = re.compile(r"[.!?؟।]+[\"'”’»“)\]]*(?=\s|$)|[。！？]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|&[a-z]{2,8};|\{[^{}]{0,80}:[^{}]{0,80};\}")
_MOJIBAKE = re.compile("[\u0080-\u009f¡-¿ÃÂÐÑ×ØÙÚ�€™œž‚„†‡ˆ‰‹](?=[\u0080-\u00ff€™œž‚„†‡ˆ‰‹�‘’“”–—•…])|�")
_MARKS = (r"[\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e4e]")
_SPACED_WORD = re.compile(r"[^\W\d_][\w\u0900-\u094f\u064b-\u065f'’-]*")
_BROKEN_WORD = re.compile(r"[^\W\d_][^\w\s'’.,;:!?)\]}\"”»“/‐–—\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u094f\u0e31-\u0e4e-]+[^\W\d_]|[^\W\d_][,;:!¦|~^°§¬`]+[^\W\d_]|[~^°§¬¦`\\]")
_UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_FUNCTION_CHARS = "[的是在和了与为而被更对从因此这はがをにとのでもいる\u0e01-\u0e3a\u0e40-\u0e4d]"
_SEPARATED = re.compile(r"\s*(?:[;|•·、،；]|\s/\s|,\s(?=\S))\s*")


# Classes of code points, as flags.
WORDLIKE, DIGIT, MARK, UNSPACED, FUNCTION, BLANK = (1 << i for i in range(6))


@lru_cache(maxsize=1)
def _flags() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    points = np.r_[0:0xD800, 0xE000 : sys.maxunicode + 1].astype("<u4")  # all but the surrogates
    everything = points.tobytes().decode("utf-32-le")
    for flag, one in ((WORDLIKE, r"[^\W_]"), (DIGIT, r"\d"), (MARK, _MARKS), (UNSPACED, _UNSPACED.pattern), (FUNCTION, _FUNCTION_CHARS)):
        for run in re.finditer(f"(?:{one})+", everything):
            table[points[run.start() : run.end()]] |= flag
    table[[c for c in range(0x3001) if chr(c).isspace()]] |= BLANK
    return table


_KINDS = np.arange(64)
#: Which combinations of flags count as a sign, a symbol, a letter, a mark, of a script without blanks, as a function sign.
_FITS = np.stack([_KINDS & BLANK == 0, _KINDS & (BLANK | WORDLIKE) == 0, _KINDS & (WORDLIKE | DIGIT) == WORDLIKE, _KINDS & MARK > 0, _KINDS & UNSPACED > 0, _KINDS & FUNCTION > 0]).astype(np.int64)


class Signs:
    """How many of the signs of a text, blanks left out, belong to each class."""

    def __init__(self, text: str) -> None:
        kinds = np.bincount(_flags()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=64)
        self.n, self.symbols, letters, marks, self.unspaced, self.function = (_FITS @ kinds).tolist()
        self.letters = letters + marks


#: A long line in which nothing hints at a row or an entry.
_PLAIN = re.compile(r"(?![-*•◦–—·\[(\d]|[A-Za-z][.)]|[A-Z][a-z]+\.? \d|Рис|Табл)(?!.*(?:\d\(\d|\.\s?\.\s?\.|[|│┃║\t&<>{}=]|  |;\S|,\S|\d[.)]*$|…\d))[^\W\d_].*")


_CLOSERS = "\"'”’»“)]」』"


def _ends(line: str) -> bool:
    """Whether a line ends in a stop: ``_STOP``, looked for at its end only."""
    s = line.rstrip()
    inner = s.rstrip(_CLOSERS)
    return inner[-1:] in _STOP_SIGNS or s[-1:] == "]" and bool(_STOP.search(line))


def _line_kind(line: str) -> str:
    """``table``, ``list``, ``junk``, ``rule``, ``short`` (a heading, or an entry among others) or ``text``."""
    s = line.strip()
    n = len(s)
    if n > 75 and _PLAIN.fullmatch(s):
        return "text"
    if n < 20 and s.lower() in _CHROME:
        return "junk"
    if _BORDER.fullmatch(s) and n > 2 and not any(c.isalnum() for c in s):
        return "table" if re.search(r"[│┃║┌┐└┘├┤┬┴┼╔╚|+]", s) else "rule"
    cells = [c.strip() for c in _BOX.split(s)]
    if len(cells) > 2:
        inner = [c for c in cells if c]
        if inner and sum(c.lower() in _CHROME for c in inner) * 2 > len(inner):
            return "junk"
        if len(cells) > 3 or s[0] in "│┃║|":
            if sum(len(c.split()) for c in inner) <= 4 * max(1, len(inner)):
                return "table"
    if s.count("\t") > 1 or line.count("\t") > 1:
        return "table"
    if _LATEX.search(s) and (s.count("&") > 0 or s.startswith("\\")) or s.count(" & ") > 1:
        return "table"
    if s.count('";"') > 1 or s.count('","') > 1:
        return "table"
    if s.count(",") > 1 and ", " not in s or s.count(";") > 1 and "; " not in s and not s.endswith(";"):
        parts = re.split("[,;]", s)
        if all(len(p.split()) <= 4 for p in parts) and len(parts) > 2:
            return "table"
    tokens = s.split()
    if "  " in s or not s.isprintable():  # other blanks are not printable
        wide = re.split(r"\s{2,}", s)
        if len(wide) > 2 and all(len(c.split()) <= 4 for c in wide):
            return "table"
    if len(tokens) > 2 and any(map(str.isdigit, s)) and len(set(tokens)) > 1 and sum(map(bool, map(_NUMBER.fullmatch, tokens))) >= 0.8 * len(tokens):
        return "table"
    if _LEADER.search(s):
        return "list"
    if _CAPTION.match(s) and len(tokens) <= 16:
        return "list"
    if n < 400 and _AUTHORS.match(s) and _REFERENCE.search(s):
        return "list"
    ends = _ends(s)
    bullet = _BULLET.match(s)
    if bullet and (len(tokens) <= 14 and n <= 110) and not (ends and len(tokens) > 8):
        return "list"
    if ("<" in s or "&" in s or "{" in s) and len(_TAG.findall(s)) * 12 > n:
        return "junk"
    if n <= 90 and not ends and _ENTRY.fullmatch(s) and len(tokens) <= 14:
        return "short"
    if not ends and (len(tokens) <= 7 and n <= 70) and not (_UNSPACED.search(s) and n > 34):
        return "short"
    return "text"


class Grams:
    """The words of a text by number, and the repetition of their n-grams."""

    def __init__(self, words: list[str]) -> None:
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.distinct = max(1, len(numbers))

    def dominant(self) -> float:
        """The largest share of the words' characters that one n-gram of 2 to 4 words covers; one that does not occur
        more than twice covers none."""
        at, best = self.at, 0
        code, size = at, self.sizes  # number of each n-gram, and the characters of each number
        for n in (2, 3, 4):
            if len(at) < 2 * n:
                break
            code = code[:-1] * self.distinct + at[n - 1 :]
            run = np.sort(code)
            if not (run[2:] == run[:-2]).any():
                break  # longer n-grams do not occur more often
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            times = np.diff(starts, append=len(run))
            many = times > 2
            rest, chars = run[starts[many]], 0
            for _ in range(n):
                rest, last = np.divmod(rest, self.distinct)
                chars = chars + size[last]
            best = max(best, int((times[many] * chars).max()))
            if n * self.distinct.bit_length() > 46:  # the next numbers would not fit: only these n-grams, renumbered
                return min(1.0, max(best, self._longer(n + 1)) / self._total())
        return min(1.0, best / self._total())

    def _total(self) -> int:
        return max(1, int(self.sizes[self.at].sum()))

    def _again(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first place, occurrences) of the n-grams that occur more than twice."""
        code = self.at
        for k in range(1, n):  # numbers of the k-grams anew before each step, so that they stay small
            code = np.unique(code, return_inverse=True)[1][:-1] * self.distinct + self.at[k:]
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        return first[times > 2], times[times > 2]

    def _longer(self, least: int) -> int:
        best, ends = 0, np.concatenate([[0], np.cumsum(self.sizes[self.at])])
        for n in range(least, 5):
            first, times = self._again(n)
            best = max(best, int((times * (ends[first + n] - ends[first])).max(initial=0)))
        return best

    def repeated(self, n: int = 8) -> float:
        """Share of the n-grams that occur more than twice: long passages again and again, on one line or on many.
        0 where it cannot be above a half."""
        most = len(self.at) - n + 1
        if len(self.at) < 3 * n:
            return 0.0
        times = np.bincount(self.at)
        if 2 * int(times[times > 2].sum()) <= most:
            return 0.0  # each of these n-grams begins with a word that occurs more than twice: they are at most half
        return int(self._again(n)[1].sum()) / most


def _text_kind(text: str, dense: str, words: list[str], signs: Signs, grams: Grams, coverage: float) -> str:
    """``prose``, ``list`` or ``junk`` for the lines that are no table, entry or chrome on their own."""
    n, letters = signs.n, signs.letters
    if not n:
        return "prose"
    if not dense.isascii() and (len(_MOJIBAKE.findall(dense)) > 0.04 * n or dense.count("�") > 0.02 * n):
        return "junk"
    if letters < 0.55 * n or len(set(dense)) < min(8, n / 4):
        return "junk"
    if signs.unspaced > 0.3 * n:
        stops, marks = len(_STOPS.findall(text)), signs.function
        pieces = [p for p in _SEPARATED.split(text.strip()) if p]
        chars = Counter(dense[i : i + 8] for i in range(0, max(1, n - 8)))
        if n > 80 and chars.most_common(1)[0][1] * 8 > 0.3 * n:
            return "junk"
        if len(pieces) >= 6 and n / len(pieces) <= 16 and stops * 8 < len(pieces):
            return "list"
        return "prose" if marks > 0.04 * n else "junk"
    if not words:
        return "junk"
    tokens = text.split()
    if max(map(len, tokens)) > 60 and sum(len(w) for w in tokens if len(w) > 40) > 0.5 * n:
        return "junk"
    if letters < 0.93 * n and (broken := len(_BROKEN_WORD.findall(text))) > 3 and broken > 0.08 * len(tokens):
        return "junk"
    common = sum(map(_COMMON.__contains__, words))
    if common < 0.25 * len(words) and len(_CHROME_ANY.findall(text.lower())) * 3 > len(words):
        return "junk"
    if len(words) >= 12:
        if coverage > 0.35 or grams.distinct < 12 and grams.distinct < 0.08 * len(words):
            return "junk"
        if grams.repeated() > 0.5:
            return "junk"
    stops = len(_STOPS.findall(text))
    if sum(map(text.count, ";|•·、,/")) >= max(5, 6 * stops):
        pieces = [p for p in _SEPARATED.split(text.strip()) if p]
        if len(pieces) >= 6 and len(words) / len(pieces) <= 6 and stops * 6 < len(pieces):
            return "list"
    if len(words) >= 8 and common < 0.08 * len(words):
        return "junk"
    return "prose"


#: Least share of the characters in lines of prose for a document of prose.
PROSE_SHARE = 0.6

FIELDS = ["n_words", "mean_word_length", "symbol_ratio", "stop_lines", "common_words", "duplicate_lines", "duplicate_paragraphs", "top_ngram", "prose", "lists", "tables", "junk", "kind"]


def statistics(text: str) -> dict[str, float | int | str]:
    """All statistics of one text; ``kind`` is ``prose``, ``list``, ``table``, ``junk``, or ``blank``."""
    lines = [x for x in text.splitlines() if x.strip()]
    words = _SPACED_WORD.findall(text.lower())
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    dense = "".join(text.split())
    signs, grams = Signs(text), Grams(words)
    out: dict = {
        "n_words": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_ratio": signs.symbols / signs.n if dense else 0.0,
        "stop_lines": sum(map(_ends, lines)) / len(lines) if lines else 0.0,
        "common_words": sum(map(_COMMON.__contains__, words)) / len(words) if words else 0.0,
        "duplicate_lines": 1 - len({x.strip() for x in lines}) / len(lines) if lines else 0.0,
        "duplicate_paragraphs": 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
        "top_ngram": grams.dominant(),
    }
    sizes = dict.fromkeys(("prose", "list", "table", "junk"), 0)
    if lines:
        kinds = [_line_kind(x) for x in lines]
        shorts = sum(k == "short" for k in kinds)
        plain = [x for x, k in zip(lines, kinds) if k == "text"]
        entries = shorts >= 4 and shorts * 2 > shorts + len(plain) - 1  # headings are few among lines of text
        if entries:  # narrow lines of text, if sentences end among them
            both = "\n".join(x for x, k in zip(lines, kinds) if k in ("short", "text"))
            entries = len(_STOPS.findall(both)) < 0.2 * (shorts + len(plain))
        rest = []
        for x, k in zip(lines, kinds):
            size = len(x.strip())
            if k == "text" or k == "short" and not entries:
                rest.append(x)
            elif k == "short":
                sizes["list"] += size
            elif k == "rule":
                sizes["junk"] += size if len(lines) < 3 else 0
            else:
                sizes[k] += size
        if rest:
            body, top = "\n".join(rest), out["top_ngram"]
            if len(rest) < len(lines):
                words_of, dense = _SPACED_WORD.findall(body.lower()), "".join(body.split())
                signs, grams = Signs(body), Grams(words_of)
                top = grams.dominant()
            else:
                words_of = words
            sizes[_text_kind(body, dense, words_of, signs, grams, top)] += sum(len(x.strip()) for x in rest)
        same = out["duplicate_lines"] > 0.6 and len(lines) > 4 or out["duplicate_paragraphs"] > 0.6 and len(paragraphs) > 2
        if same:  # the same few lines or paragraphs again and again
            sizes = {"prose": 0, "list": 0, "table": 0, "junk": max(1, sum(sizes.values()))}
        elif sizes["list"] > 0 and sizes["list"] >= sizes["table"] and len(words) > 30 and out["top_ngram"] > 0.5:
            sizes["junk"] += sizes["list"]
            sizes["list"] = 0
    total = sum(sizes.values())
    out |= {"prose": 0.0, "lists": 0.0, "tables": 0.0, "junk": 0.0, "kind": "blank"}
    if total:
        out |= {"prose": sizes["prose"] / total, "lists": sizes["list"] / total, "tables": sizes["table"] / total, "junk": sizes["junk"] / total}
        out["kind"] = "prose" if out["prose"] >= PROSE_SHARE else max(("table", "list", "junk"), key=sizes.get)
    elif lines:
        out |= {"junk": 1.0, "kind": "junk"}
    return out


_SCHEMA = "n_words int, mean_word_length double, symbol_ratio double, stop_lines double, common_words double, duplicate_lines double, duplicate_paragraphs double, top_ngram double, prose double, lists double, tables double, junk double, kind string"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), *[pa.float64()] * 11, pa.string()]
    for batch in batches:
        rows = [statistics(t) if t is not None else {} for t in batch.column(batch.num_columns - 1).to_pylist()]
        found = [pa.array([r.get(f) for r in rows], t) for f, t in zip(FIELDS, types)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], *FIELDS])


def text_statistics(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and the statistics of every row of ``df``.

    A null text has null statistics, a blank one zeros and the kind ``blank``. Repeated rows stay; other columns are
    ignored. One pass over the rows, no shuffle.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return df.select(*keys, text_col).mapInArrow(_measure, f"{schema}, {_SCHEMA}")
