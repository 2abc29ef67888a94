"""Repair of text from scanned pages (problem 1).

The work inside a document (its lines, page furniture, cut words) is done on the document's row in Arrow batches; all
that needs the corpus (words, skeletons, neighbours, shared headers) is counted and joined by Spark.

*Furniture*: lines with their digits masked, compared within the document and over the corpus, the title's own
beginning, page numbers by their place, and notices by their first words. *Broken words*: the part at the line end and
the part at the next body line's start, across page furniture, are one word if the corpus knows the joined form rather
than the compound. *Misread words*: all words of the corpus are grouped by their skeleton, the strokes that confusable
glyphs share; a rare form is read as the frequent form of its group that its left neighbour supports best. *Reflow*:
SQL windows over the body lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkspark.llm.count_table import cells, count_table, table_bits
from chunkspark.llm.language import STOPWORDS
from chunkspark.llm.token_count import ALONE, WORD, classes
from chunkspark.session import written

# Glyphs that stand for one another, and the strokes of glyphs that look like several others.
ALIKE = ("äàâáãåɑα" "éèêëe" "íìîïıl1t†|!" "öóòôõøοо0" "5ѕ" "9" "6" "ß", "aaaaaaaa" "ccccc" "iiiiiiiiiii" "ooooooooo" "ss" "g" "b" "b")
STROKES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fi"), ("ﬃ", "ffi"), ("ﬄ", "ffi"), ("m", "rri"), ("n", "ri"), ("ñ", "ri"), ("d", "ci"), ("h", "ii"), ("u", "ii"), ("ü", "ii"), ("û", "ii"), ("ù", "ii"), ("w", "vv"))
# Beginnings of notices that publishers put on each page.
NOTICES = ("preprint", "submitted", "draft of", "draft version", "manuscript", "under review", "not for circulation", "not for distribution", "accepted for", "accepted version", "confidential", "in press", "working paper", "author version", "eingereicht", "vorabdruck", "entwurf", "soumis à", "version soumise", "prépublication")
MARKS = "-‐‑­¬"
LEAST_RATIO = 10
LEAST_COUNT = 5
#: Documents that must share the ending of a header, and the share of its lines that stand apart from the text.
SHARED_BY = 3
APART = 0.5
#: Forms that a task counts before it passes them on, and code points whose words are looked at together.
MOST_COUNTED = 400_000
PORTION = 1 << 20

_TOKEN = r"[\p{L}\p{M}\p{N}†ɑ]+"
_STOPS = sorted({w for words in STOPWORDS.values() for w in words.split()})


def skeleton(text: Column) -> Column:
    """The strokes of the small letters of ``text``; forms that a scan can confuse have the same."""
    plain = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), STROKES[:5], F.lower(text))
    plain = F.translate(plain, *ALIKE)
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), STROKES[5:], plain)


class _Strokes(dict):
    """For str.translate: other characters stand for themselves; filled as they occur."""

    def __missing__(self, point: int) -> int:
        self[point] = point
        return point


_STROKES = _Strokes(str.maketrans(dict(zip(*ALIKE)) | dict(STROKES)))


def strokes(text: str) -> str:
    """``skeleton`` of one string."""
    return text.lower().translate(_STROKES)


# --- the lines of one document ---------------------------------------------------------------------------------------

_EDGE_NUMBER = re.compile(r"^\s*[0-9]+\s*(?:\||\s{2,})\s*|\s{2,}[0-9]+\s*$|\s*\|\s*[0-9]+\s*$")
_DIGIT = re.compile("[0-9]")
_OWN_NUMBER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])")
_PAGE_NUMBER = re.compile(r"[-–—]\s*[0-9lIoO]+\s*[-–—]|\[[0-9lI]+\]|[ivxl]{1,7}")
_PAGE_WORD = re.compile(rf"(?:{strokes('page')}|{strokes('seite')}|{strokes('p')}\.)\s*\S+(?:\s+(?:{strokes('of')}|{strokes('von')}|{strokes('sur')}|/)\s*\S+)?")
_SOME_NUMBER = re.compile(r"[0-9]|[lI]$|[lI] ")
_NOTICE = tuple(strokes(n) for n in NOTICES)


@lru_cache(maxsize=1024)
def _may_notice(c: str) -> bool:
    return strokes(c)[:1] in {n[0] for n in _NOTICE}


_NAME = r"[A-Z](?:[^\W_]|[†'’-])+"
_AUTHOR = re.compile(rf"(?:[0-9]+\s*\|?\s+)?(?:(?:[A-Z]\.\s?)+{_NAME}|{_NAME} (?:and|und|et|&) {_NAME}|{_NAME} et [aɑ][l1i]\.)(?:\s+[0-9]+)?")
_AND = (["and"], ["und"], ["et"], ["&"])
_CAPITAL = re.compile(r"(?:[0-9]+\s*\|?\s+)?")
_TAIL_LINE = regex.compile(r"(?:[0-9]+\s*\|\s*)?\p{Lu}[^.=]+[.,]\s*\p{L}\S*\s[0-9]+")
_TAIL = re.compile(r"\S+\s+\S+\s+#$")
_EDGED = re.compile(r"[0-9]+\s|.*\s[0-9]+$")
_PART = rf"{_TOKEN}(?:-{_TOKEN})*"
_LEFT = regex.compile(rf"({_PART})[{MARKS}]$")
_RIGHT = regex.compile(_PART)
_NO_RIGHT = regex.compile(r"\p{Lu}[^\p{Lu}]|[0-9]+$")
#: Headers and notices are shorter than this.
_SHORT = 90


def masked(s: str) -> str:
    """Skeleton with every number of its own masked; numbers at the edges and a bar beside them are left out."""
    return strokes(_OWN_NUMBER.sub("#", _EDGE_NUMBER.sub("", s).strip(" ")) if _DIGIT.search(s) else s)


def is_number(s: str, next_blank: bool) -> bool:
    """Whether a line is a page number, perhaps in words."""
    if len(s) > 40:
        return False
    if s.isdigit() and s.isascii():
        return len(s) < 5 and not next_blank
    return bool(_PAGE_NUMBER.fullmatch(s) or _SOME_NUMBER.search(s) and _PAGE_WORD.fullmatch(strokes(s)))


def numbered_tails(text: str) -> Iterator[tuple[int, str, bool]]:
    """(line number, its last words, whether it stands apart) of lines that end in a number as volumes of a journal do."""
    raw = text.replace("\r", "").replace("\0", " ").split("\n")
    clean = lambda i: raw[i].replace("\f", "").strip()
    for i, line in enumerate(raw):
        if not line or not (line[-1].isdigit() or line[-1].isspace()):
            continue
        s = clean(i)
        if s and s[-1].isdigit() and (s[0].isupper() or s[0].isdigit()) and _TAIL_LINE.fullmatch(s) and (m := _TAIL.search(masked(s))):
            apart = "\f" in line or i == 0 or not clean(i - 1) or i + 1 < len(raw) and not clean(i + 1)
            yield i + 1, m[0], apart or is_number(clean(i - 1), False)


class Page:
    """The lines of one document that are not blank, and what they are by themselves."""

    def __init__(self, text: str) -> None:
        raw = text.replace("\r", "").replace("\0", " ").split("\n")
        stripped = [x.strip() for x in (raw if "\f" not in text else text.replace("\r", "").replace("\0", " ").replace("\f", "").split("\n"))]
        self.no = [i + 1 for i, s in enumerate(stripped) if s]
        self.s = [s for s in stripped if s]
        self.ff = ["\f" in raw[n - 1] for n in self.no] if "\f" in text else [False] * len(self.no)
        self.after_blank = [n > 1 and not stripped[n - 2] for n in self.no]
        self.next_blank = [n < len(raw) and not stripped[n] for n in self.no]
        self._mask: dict[int, str] = {}
        self.number, self.notice, self.author = ([False] * len(self.no) for _ in range(3))
        self.leads = [False] * len(self.no)  # begins with a capital or a digit
        for i, s in enumerate(self.s):
            c = s[0]
            if is_number(s, self.next_blank[i]):
                self.number[i] = True
            if c.isupper() or c.isdigit():
                self.leads[i] = True
                if len(s) < _SHORT:
                    self.notice[i] = _may_notice(c) and strokes(s[:24]).startswith(_NOTICE) and s.count(" ") < 10
                    self.author[i] = (c.isdigit() or s[1:2] == "." or s.split(" ", 2)[1:2] in _AND) and bool(_AUTHOR.fullmatch(s))
        self.same = Counter(self.mask(i) for i, s in enumerate(self.s) if self.leads[i] and len(s) <= _SHORT)

    def mask(self, i: int) -> str:
        found = self._mask.get(i)
        if found is None:
            found = self._mask[i] = masked(self.s[i])
        return found

    def _repeats(self, i: int) -> bool:
        return self.same[self.mask(i)] > 1

    def furniture(self, journal: set[int]) -> list[bool]:
        """Whether each line is furniture; ``journal`` holds the numbers of lines with a header that documents share."""
        title = None
        for i in range(len(self.s) - 1):
            if self.number[i] or self.notice[i] or self.author[i] or self.no[i] in journal:
                continue
            mask = self.mask(i)
            if not self.mask(i + 1).startswith(mask) and not (self._repeats(i) and "#" in mask):
                title = i
                break
        of_title = self.mask(title) if title is not None else ""
        out = []
        for i, s in enumerate(self.s):
            is_it = self.number[i] or self.notice[i] or self.no[i] in journal
            if not is_it and self.author[i]:
                is_it = self.ff[i] or i == 0 or self.number[i - 1] or self.notice[i - 1] or self._repeats(i) or bool(_EDGED.match(s))
            if not is_it and i != title and self.leads[i]:
                if len(s) <= 75 and s[-1] not in ".!?:;," and "=" not in s and s[_CAPITAL.match(s).end() :][:1].isupper() and self._repeats(i):
                    is_it = " " in self.mask(i) and sum(map(str.isalpha, s)) >= 6
                if not is_it and of_title and len(s) <= len(of_title) + 16:
                    mask = self.mask(i)
                    is_it = len(mask) >= 6 and " " in mask and of_title.startswith(mask)
            out.append(is_it)
        return out


def cut_words(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, part, part) where a word may go on from the end of a line to the start of the next."""
    out = []
    for i in range(len(lines) - 1):
        if lines[i][-1] in MARKS and (left := _LEFT.search(lines[i].rsplit(None, 1)[-1])) and (right := _RIGHT.match(lines[i + 1].split(None, 1)[0])):
            if not _NO_RIGHT.match(right[0]) and any(c.isalpha() for c in left[1]):
                out.append((i, left[1].rsplit("-", 1)[-1], right[0].split("-", 1)[0]))
    return out


def _tail_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            for line_no, tail, apart in numbered_tails(text):
                at.append(i)
                rows.append((line_no, tail, int(apart)))
        no, tails, apart = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), pa.array(tails, pa.string()), pa.array(apart, pa.int32())], ["doc_id", "line_no", "tail", "apart"])


_BODY = "lines string, line_no array<int>, after_blank array<boolean>, furniture array<int>, cuts array<struct<at:int,line_no:int,next_no:int,own_mark:boolean,left_part:string,right_part:string>>"
_CUTS = pa.list_(pa.struct([("at", pa.int32()), ("line_no", pa.int32()), ("next_no", pa.int32()), ("own_mark", pa.bool_()), ("left_part", pa.string()), ("right_part", pa.string())]))


def _body_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, numbers, blanks, furniture, cuts = [], [], [], [], []
        for text, journal in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            page = Page(text)
            flags = page.furniture(set(journal or ()))
            body = [i for i, f in enumerate(flags) if not f]
            kept = [page.s[i] for i in body]
            lines.append("\n".join(kept))
            numbers.append([page.no[i] for i in body])
            blanks.append([page.after_blank[i] for i in body])
            furniture.append([page.no[i] for i, f in enumerate(flags) if f])
            no = numbers[-1]
            cuts.append([{"at": i, "line_no": no[i], "next_no": no[i + 1], "own_mark": kept[i][-1] == "-", "left_part": a, "right_part": b} for i, a, b in cut_words(kept)])
        columns = [pa.array(lines, pa.string()), pa.array(numbers, pa.list_(pa.int32())), pa.array(blanks, pa.list_(pa.bool_())), pa.array(furniture, pa.list_(pa.int32())), pa.array(cuts, _CUTS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lines", "line_no", "after_blank", "furniture", "cuts"])


# --- the words of the corpus -----------------------------------------------------------------------------------------

_LINE = "\0"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it can be in a word, else a blank."""
    table = np.arange(len(classes()), dtype="<u4")
    table[(classes() != WORD) & (classes() != ALONE)] = 32
    table[[ord(_LINE), ord("†")]] = ord(_LINE), ord("†")
    return table


_COMPOUND = re.compile(r"(?<![^\W\d_])(?<!-)[^\W\d_]+(?:-[^\W\d_]+)+")
_SCRIPTED = re.compile("[ﬀ-ﬆ†ɑ]")


def whole_words(lines: str, cuts: list[dict]) -> str:
    """The lines without the parts of cut words."""
    if not cuts:
        return lines
    out = lines.split("\n")
    for cut in cuts:
        out[cut["at"]] = out[cut["at"]][: -len(cut["left_part"]) - 1]
    for cut in cuts:  # a line of one word may be cut at both ends
        out[cut["at"] + 1] = out[cut["at"] + 1][len(cut["right_part"]) :]
    return "\n".join(out)


def _portions(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[list[int], list]]:
    """Row numbers and values of portions of a batch of about PORTION code points."""
    values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
    start = size = 0
    for i, lines in enumerate(values[0]):
        size += len(lines)
        if size > PORTION or i + 1 == len(values[0]):
            yield list(range(start, i + 1)), [v[start : i + 1] for v in values]
            start, size = i + 1, 0


def _words_of(lines: list[str], cuts: list[list[dict]]) -> list[str]:
    """The words of some documents, with _LINE behind each line."""
    text = "".join(f"{whole_words(x, c)}\n" for x, c in zip(lines, cuts))
    points = np.frombuffer(text.replace("\n", f" {_LINE} ").encode("utf-32-le", "surrogatepass"), "<u4")
    return _letters()[points].tobytes().decode("utf-32-le", "surrogatepass").split()


def form_of(word: str) -> str | None:
    """The form under which a word counts; null for what has no letter and for codes of capitals."""
    if word.isalpha():
        return None if len(word) < 6 and word.isupper() and len(word.lower()) == len(word) else word.lower()
    if not any(c.isalpha() for c in word) or regex.fullmatch(r"\p{Lu}{1,5}", word):
        return None
    return word.lower()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    pairs: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        forms: Counter[str] = Counter()
        for word, n in words.items():
            if word != _LINE and (form := form_of(word)) is not None:
                forms[form] += n
        kinds = pa.array([0] * len(forms) + [1] * len(pairs), pa.int32())
        return pa.RecordBatch.from_arrays([kinds, pa.array([*forms, *pairs], pa.string()), pa.array([*forms.values(), *pairs.values()], pa.int64())], ["kind", "word", "n"])

    for batch in batches:
        for _, (lines, cuts) in _portions(batch, ["lines", "cuts"]):
            words.update(_words_of(lines, cuts))
            for text in lines:
                if "-" in text:
                    for piece in [x for x in text.lower().split() if "-" in x]:
                        for compound in _COMPOUND.findall(piece):
                            parts = compound.split("-")
                            pairs.update(map("-".join, zip(parts, parts[1:])))
            if len(words) + len(pairs) > MOST_COUNTED:
                yield rows()
                words.clear()
                pairs.clear()
    yield rows()


class _WordHashes(dict):
    """Word -> hash of its form, odd where the word counts as a form itself, remembered by the Python worker."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.lower()) | 1
        self[word] = value = 0 if word == _LINE else value if form_of(word) is not None else value - 1
        return value


_HASHES = _WordHashes()


def _hashed(words: list[str]) -> np.ndarray:
    if len(_HASHES) > 2 * MOST_COUNTED:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _form_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) | 1 for w in batch.column(0).to_pylist()], np.uint64)


def _pair_hash(before: np.ndarray, form: np.ndarray) -> np.ndarray:
    h = (before | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + form
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _pair_key(before: Column, form: Column) -> Column:
    @F.arrow_udf("long")
    def run(before: pa.Array, form: pa.Array) -> pa.Array:
        a, b = (np.array([xxhash.xxh3_64_intdigest(w) | 1 for w in c.to_pylist()], np.uint64) for c in (before, form))
        return pa.array(_pair_hash(a, b).view(np.int64))

    return run(before, form)


def _rare_words(table, bits: int):
    """(doc_id, line_no, form, before, scripted) of the words that may be rare forms, and of those with glyphs that no
    word has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = table.value
        scripted: dict[str, bool] = {}
        for batch in batches:
            for rows, (lines, cuts, numbers) in _portions(batch, ["lines", "cuts", "line_no"]):
                words = _words_of(lines, cuts)
                h = _hashed(words)
                # A text without lines has one line break of its own here.
                line_no = np.array([n for x in numbers for n in (x or [0])], np.int32)
                doc = np.repeat(np.asarray(rows, np.int32), [max(1, len(x)) for x in numbers])
                line = np.cumsum(h == 0)
                hit = (h & np.uint64(1) == 1) & (rare[cells(h, bits)] > 0)
                odd = [i for i, w in enumerate(words) if not w.isascii() and (scripted[w] if w in scripted else scripted.setdefault(w, bool(_SCRIPTED.search(w))))]
                hit[odd] |= h[odd] & np.uint64(1) == 1
                at = np.flatnonzero(hit)
                forms = [words[i].lower() for i in at]
                before = [words[i - 1].lower() if i and words[i - 1] != _LINE else None for i in at]
                marks = np.zeros(len(words), bool)
                marks[odd] = True
                ids = batch.column(0).take(pa.array(doc[line[at]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(line_no[line[at]]), pa.array(forms, pa.string()), pa.array(before, pa.string()), pa.array(marks[at])], ["doc_id", "line_no", "form", "before", "scripted"])

    return run


def _pair_counts(table, bits: int):
    """(key, n): how often the wanted pairs of neighbours stand in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        for batch in batches:
            for _, (lines, cuts) in _portions(batch, ["lines", "cuts"]):
                h = _hashed(_words_of(lines, cuts))
                before, form = h[:-1], h[1:]
                keys = _pair_hash(before, form)[(before != 0) & (form & np.uint64(1) == 1)]
                keys, n = np.unique(keys[wanted[cells(keys, bits)] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "support"])

    return run


def repair(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(body, defects)`` of the scanned texts in ``df``.

    ``defects(doc_id, line_no, defect)`` names each damaged line (``hyphen``, ``misread``, ``furniture``);
    ``body(doc_id, line_no, s, fixed, glue, paragraph)`` holds the body lines with their words corrected, whether the
    next line continues the last word (``glue``: its text stands at the end already, or a compound's hyphen does), and
    the number of the paragraph. A document that occurs several times counts once; null ids and texts are left out,
    blank texts have no lines. Other columns are ignored.
    """
    kind = df.select(id_col).dtypes[0][1]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    bits = table_bits(docs, "text")
    spark = df.sparkSession

    # Headers that documents share: endings with a number, which stand apart from the text.
    tails = docs.mapInArrow(_tail_rows, f"doc_id {kind}, line_no int, tail string, apart int")
    per_doc = tails.groupBy("tail", "doc_id").agg(F.count("*").alias("n"), F.sum("apart").alias("apart"))
    shared = per_doc.groupBy("tail").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("apart").alias("apart")).where((F.col("docs") >= SHARED_BY) & (F.col("apart") >= APART * F.col("n")))
    journal = tails.join(shared.select("tail"), "tail").groupBy("doc_id").agg(F.collect_set("line_no").alias("journal"))
    body = written(docs.join(journal, "doc_id", "left").select("doc_id", "text", "journal").mapInArrow(_body_rows, f"doc_id {kind}, {_BODY}"))

    # Words of the corpus in their places; parts of cut words stay out.
    words = body.select("lines", "cuts").mapInArrow(_count_words, "kind int, word string, n long")
    words = words.groupBy("kind", "word").agg(F.sum("n").alias("n")).withColumn("sk", skeleton(F.col("word")))
    words = written(words)
    forms = words.where("kind = 0").select(F.col("word").alias("form"), "n", "sk")
    frequent = forms.where(F.col("n") >= LEAST_COUNT).where(~F.col("form").rlike(r"\d|[†ɑﬀ-ﬆ]"))
    frequent = frequent.select("sk", F.col("form").alias("read"), F.col("n").alias("n_read"))
    odd = F.col("form").rlike(r"[†ɑﬀ-ﬆ]|\p{L}\d+\p{L}|^\d+\p{L}{3,}|\p{L}{3,}\d+$")
    # Of a rare form, two further readings: a doubled i for an n, a six for an accented e.
    readings = F.array_distinct(F.array("sk", skeleton(F.replace("form", F.lit("ii"), F.lit("n"))), skeleton(F.replace("form", F.lit("6"), F.lit("e")))))
    read_as = forms.select("form", "n", F.explode(readings).alias("sk"))
    rare = read_as.join(frequent, "sk").where((F.col("form") != F.col("read")) & (F.col("n_read") >= LEAST_RATIO * F.col("n")) & ~F.col("form").isin(_STOPS) & ((F.length("form") > 2) | odd))
    rare = written(rare.select("form", "n", "read", "n_read").distinct())

    # The frequent form that the word before supports best, once for each rare form and neighbour.
    table = spark.sparkContext.broadcast(count_table(rare.select("form"), _form_hashes, bits))
    found = written(body.select("doc_id", "lines", "cuts", "line_no").mapInArrow(_rare_words(table, bits), f"doc_id {kind}, line_no int, form string, before string, scripted boolean"))
    choices = found.select("form", "before").distinct().join(rare, "form")
    choices = written(choices.withColumn("key", F.when(F.col("before").isNotNull(), _pair_key(F.coalesce("before", F.lit("")), F.col("read")))))
    wanted = count_table(choices.where("key is not null").select("key"), lambda batch: batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
    wanted = spark.sparkContext.broadcast(wanted)
    pairs = body.select("lines", "cuts").mapInArrow(_pair_counts(wanted, bits), "key long, support long").groupBy("key").agg(F.sum("support").alias("support"))
    choices = choices.join(pairs, "key", "left").withColumn("support", F.coalesce("support", F.lit(0)))
    best = choices.groupBy("form", "before").agg(F.max(F.struct("support", "n_read", "read")).alias("best"), F.max("n").alias("n"))
    best = best.select("form", "before", "n", "best.*").where((F.col("support") > 0) | odd | (F.col("n_read") >= 3 * LEAST_RATIO * F.col("n")))
    best = best.select("form", "before", "read", "support", "n_read")
    misread = found.alias("f").join(best.alias("b"), F.expr("f.form = b.form and f.before <=> b.before"), "left").where("read is not null or scripted")
    misread = misread.select("doc_id", "line_no", "f.form", F.coalesce("read", "f.form").alias("read"), "support", "n_read")
    misread = written(misread.groupBy("doc_id", "line_no", "form").agg(F.max_by("read", F.struct("support", "n_read")).alias("read"), F.first("read").alias("any")).select("doc_id", "line_no", "form", F.coalesce("read", "any").alias("read")))

    # Cut words: joined form or compound.
    compounds = words.where("kind = 1").groupBy(F.col("sk").alias("sk2")).agg(F.sum("n").alias("n_compound"))
    known = forms.groupBy("sk").agg(F.sum("n").alias("n_joined"), F.max_by("form", F.struct("n", "form")).alias("best"), F.max("n").alias("n_best"))
    cuts = body.select("doc_id", F.explode("cuts").alias("c")).select("doc_id", "c.*").drop("at")
    # Decided once for each pair of parts.
    each = cuts.select("own_mark", "left_part", "right_part").distinct()
    each = each.withColumn("joined", F.lower(F.concat("left_part", "right_part"))).withColumn("sk", skeleton(F.col("joined"))).withColumn("sk2", skeleton(F.lower(F.concat_ws("-", "left_part", "right_part"))))
    each = each.join(known, "sk", "left").join(compounds, "sk2", "left").fillna(0, ["n_joined", "n_compound", "n_best"])
    each = each.withColumn("broken", F.when(F.col("own_mark"), F.col("n_joined") >= F.col("n_compound")).otherwise((F.col("n_compound") == 0) | (F.col("n_joined") > 0)))
    wrong = F.coalesce((F.col("n_best") >= LEAST_COUNT) & (F.col("best") != F.col("joined")) & F.col("broken"), F.lit(False))
    each = each.withColumn("bad_left", wrong & ~F.startswith("best", F.lower("left_part"))).withColumn("bad_right", wrong & ~F.endswith("best", F.lower("right_part")))
    each = each.select("own_mark", "left_part", "right_part", "broken", "bad_left", "bad_right", F.when(wrong, F.col("best")).otherwise(F.col("joined")).alias("word"))
    cuts = written(cuts.join(each, ["own_mark", "left_part", "right_part"]))
    # A compound cut at its own hyphen may still have misread parts.
    halves = cuts.where("not broken").select("doc_id", F.explode(F.array(F.struct("line_no", F.lower("left_part").alias("form")), F.struct(F.col("next_no").alias("line_no"), F.lower("right_part").alias("form")))).alias("h")).select("doc_id", "h.*")
    halves = halves.join(rare.where((F.col("n_read") >= 3 * LEAST_RATIO * F.col("n")) | odd).select("form").distinct(), "form", "left_semi")

    defects = body.select("doc_id", F.explode("furniture").alias("line_no"), F.lit("furniture").alias("defect"))
    defects = defects.unionByName(cuts.where("broken").select("doc_id", "line_no", F.lit("hyphen").alias("defect")))
    for lines in (misread.select("doc_id", "line_no"), halves.select("doc_id", "line_no"), cuts.where("bad_left").select("doc_id", "line_no"), cuts.where("bad_right").select("doc_id", F.col("next_no").alias("line_no"))):
        defects = defects.unionByName(lines.withColumn("defect", F.lit("misread")))
    return _reflow(body, misread, cuts), defects.distinct()


def _initial(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def _reflow(body: DataFrame, misread: DataFrame, cuts: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = body.select("doc_id", F.explode(F.arrays_zip("line_no", "after_blank", F.split("lines", "\n").alias("s"))).alias("r")).select("doc_id", "r.*").where("line_no is not null")
    fixes = misread.where("form <> read").groupBy("doc_id", "line_no").agg(F.collect_list(F.struct("form", "read")).alias("fixes"))
    cut = cuts.select("doc_id", "line_no", "word", "left_part", "broken")
    lines = lines.join(fixes, ["doc_id", "line_no"], "left").join(cut, ["doc_id", "line_no"], "left")
    lines = lines.withColumn("continues", F.coalesce(F.lag("broken").over(w), F.lit(False)))
    whole = F.coalesce("broken", F.lit(False))
    text = F.when(whole, F.regexp_replace("s", rf"{_TOKEN}[{MARKS}]$", "")).when(F.col("broken").isNotNull(), F.regexp_replace("s", rf"[{MARKS}]$", "-")).otherwise(F.col("s"))
    text = F.when(F.col("continues"), F.regexp_replace(text, rf"^{_TOKEN}", "")).otherwise(text)

    def mend(t: Column, f: Column) -> Column:
        alone = lambda flags, form: F.concat(F.lit(rf"{flags}(?<![\p{{L}}\p{{N}}])\Q"), form, F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.regexp_replace(F.regexp_replace(t, alone("", _initial(f["form"])), _initial(f["read"])), alone("(?iU)", f["form"]), f["read"])

    text = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<form:string,read:string>>")), text, mend)
    word = F.when(F.col("left_part").rlike(r"^\p{Lu}"), _initial(F.col("word"))).otherwise(F.col("word"))
    lines = lines.withColumn("fixed", F.concat(text, F.when(whole, word).otherwise("")))
    # A paragraph begins behind a blank line, unless the text before it stops in mid-sentence (a page break).
    ended = F.lag(F.col("s").rlike(r"[.!?:\"”»]$") | ~F.col("s").rlike(r"\s")).over(w)
    glued = F.coalesce(F.lag(F.col("broken").isNotNull()).over(w), F.lit(False))
    starts = F.lag("line_no").over(w).isNull() | F.col("after_blank") & (F.coalesce(ended, F.lit(True)) | F.col("s").rlike(r"^[\p{Lu}\d]")) & ~glued
    return lines.withColumn("paragraph", F.sum(F.when(starts, 1).otherwise(0)).over(w)).select("doc_id", "line_no", "s", "fixed", F.col("broken").isNotNull().alias("glue"), "paragraph")


def paragraphs(body: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, text)``: the body lines as continuous text."""
    joined = body.groupBy("doc_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", F.concat("fixed", F.when(F.col("glue"), "").otherwise(" ")).alias("t")))).alias("parts"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["t"]), ""), r"\s+", " "))
    return joined.select("doc_id", "paragraph", text.alias("text"))
