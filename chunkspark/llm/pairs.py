"""Broken prompt and response pairs (problem 5).

Each pair gets the first defect that holds: ``empty``, ``refusal`` (an automaton of refusal phrases),
``other_language`` (scripts, then votes of stopwords), ``copy`` (the response is run through the suffix automaton of
its prompt; the longest matches tell how much of the prompt it repeats), ``truncated`` (a stack of open delimiters,
marks and words that cannot end a sentence). Whether a word can end one is learned from the corpus: the occurrences of
each ending are counted, and a response without a stop breaks off if too small a share of those of its ending stands
before a stop.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.language import _VOTES, script_of

# Placeholders for a missing answer.
PLACEHOLDERS = frozenset(["n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "tbd", "tba", "todo", "empty", "undefined", "unknown", "no summary", "(no summary)", "[empty]", "[no summary]", "<empty>", "(empty)", "no answer", "not available", "summary", "placeholder", "lorem ipsum"])

# Phrases by which a model declines or asks for the text. "A & B": both must occur, in this order.
REFUSALS = [
    "no summary can be given", "please supply more context", "i cannot provide", "i can't provide", "i cannot summar", "i can't summar", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to",
    "my guidelines do not allow", "i must decline", "i have to decline", "sorry & i can't", "sorry & i cannot", "sorry & i won't", "sorry & unable", "apologies & this request", "apologies & i can", "as a language model", "as an ai",
    "i won't be able to", "could you share the & again", "could you please provide", "please provide the text", "please share the text", "please paste", "i did not receive", "i didn't receive", "was not accessible to me",
    "unfortunately it is not possible for me", "unfortunately & i cannot", "thanks for the & but i", "thanks for the & could you", "thanks for the & please", "thanks for the & nothing", "falls outside what i may",
    "es tut mir leid", "tut mir leid", "leider bin ich nicht", "leider kann ich", "bitte senden sie den text", "bitte schicken sie", "als sprachmodell", "ich kann & nicht zusammenfassen", "kann ich keine zusammenfassung",
    "désolé, je ne", "désolée, je ne", "je suis désolé", "merci de fournir", "je ne peux pas résumer", "il m'est impossible", "en tant que modèle", "je ne suis pas en mesure", "veuillez fournir", "malheureusement, je ne",
    "lo siento, no puedo", "lo siento, pero", "no puedo resumir", "como modelo de lenguaje", "lamentablemente no estoy", "lamentablemente no puedo", "por favor, envíe", "no me es posible", "no he podido leerlo",
    "извините, я не могу", "к сожалению, выполнить", "к сожалению, я не", "пришлите, пожалуйста", "как языковая модель", "я не могу & изложить", "не вправе отвечать",
    "عذرا، لا أستطيع", "عذرًا، لا", "بصفتي نموذجا لغويا", "لا يمكنني", "أرجو إرسال النص", "يرجى إرسال", "أعتذر", "للأسف & لا",
    "क्षमा करें", "भाषा मॉडल होने के नाते", "कृपया & पाठ & भेज", "मैं यह अनुरोध पूरा नहीं", "माफ़ कीजिए", "खेद है",
    "抱歉，我", "对不起，我", "作为语言模型", "很遗憾，我", "我无法", "请重新发送", "请提供",
    "申し訳ありません", "申し訳ございません", "言語モデルとして", "恐れ入りますが", "要約できません", "お答えできません",
    "ขออภัย", "ในฐานะแบบจำลองภาษา", "ฉันไม่สามารถสรุป", "กรุณาส่งข้อความ", "โปรดส่ง", "เสียใจ",
    "i apologize", "i apologise", "i'm afraid i can", "i am afraid i can", "i do not have access", "i don't have access", "i cannot help", "i can't help", "i cannot assist", "i can't assist", "i must refuse", "please provide the passage", "could you share the text", "could you provide the",
    "ich bedaure", "ich bedauere", "ich kann das nicht zusammenfassen", "ich kann ihnen nicht", "bitte geben sie den text", "je regrette, je", "je ne peux pas répondre", "je ne peux pas vous aider", "je n'ai pas accès", "no tengo acceso", "no puedo ayudar", "no puedo responder",
    "не могу помочь", "я не могу выполнить", "у меня нет доступа", "لا أستطيع", "मैं & नहीं कर सकता", "मैं & नहीं कर सकती", "无法提供摘要", "我不能", "要約はできません", "お手伝いできません", "ไม่สามารถสรุปได้", "ฉันไม่สามารถ", "ผมไม่สามารถ",
]

LEAST_COPIED = 40
COPIED_SHARE = 0.85
#: Matches of the suffix automaton shorter than this (or than the prompt) don't count as copied.
LEAST_MATCH = 12

_QUOTED = re.compile(r"[(\[（][^)\]）]*[)\]）]|[\"“„«‘「『][^\"”“»’」』]*[\"”“»’」』]")
_CLOSED = re.compile(r"[.!?。！？؟।…][\"'”’»“)\]」』》）]*(?:\s*\[\d+\])?$")
_OPEN_END = re.compile(r"[,;:،、，；：(\[{（「『«“„/&+=–—-]$")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "»": "«", "”": "“"}
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_UNSPACED = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_MARKED = re.compile("[^\\s\"'“”«»().,;:!?।؟،\\[\\]{}]+")
_BLANKS = re.compile(r"\s+")


def _refusal_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    parts: dict[str, list[tuple[int, int]]] = {}
    for i, phrase in enumerate(REFUSALS):
        for k, part in enumerate(phrase.split(" & ")):
            parts.setdefault(part, []).append((i, k))
    for part, uses in parts.items():
        automaton.add_word(part, (len(part), uses))
    automaton.make_automaton()
    return automaton


_REFUSAL: list = []


def is_refusal(response: str) -> bool:
    """Whether some phrase occurs with all its parts in their order, in words of its own."""
    if not _REFUSAL:
        _REFUSAL.append(_refusal_automaton())
    text = response.lower().replace("’", "'")
    reached: dict[int, int] = {}
    for end, (size, uses) in _REFUSAL[0].iter(text):
        start = end - size + 1
        if start and text[start].isascii() and text[start - 1].isalnum() and text[start - 1].isascii():
            continue
        for i, k in uses:
            if reached.get(i, 0) == k:
                reached[i] = k + 1
                if k + 1 == REFUSALS[i].count(" & ") + 1:
                    return True
    return False


def visible(response: str | None) -> str:
    """``response`` without blanks around it and without invisible characters."""
    if response is None:
        return ""
    if not response.isascii():
        response = "".join(c for c in response if unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cn") or c in "\n\t\r‌‍")
    return response.strip().strip("‌‍")


def is_empty(response: str) -> bool:
    return response.casefold() in PLACEHOLDERS or not any(c.isalnum() for c in response)


def _votes(text: str) -> dict[str, int]:
    votes: dict[str, int] = {}
    for token in text.lower().split():
        for lang in _VOTES.get(token.strip(".,;:!?\"'()“”«»¿¡[]"), ()):
            votes[lang] = votes.get(lang, 0) + 1
    return votes


def other_language(prompt: str, response: str) -> bool:
    """Whether the response's language, its quotations left out, is known and not the prompt's, which is known too."""
    plain = _QUOTED.sub(" ", response)
    if not any(c.isalpha() for c in plain):
        return False
    raw = max(map(len, prompt.split()), default=0)
    a, b = script_of(prompt), script_of(plain)
    if a == "none" or b == "none":
        return False
    if a == "latin":
        tokens = prompt.split()
        if raw > 60 and sum(len(t) for t in tokens if len(t) > 40) > 0.5 * len(prompt) or len(_WORDS.findall(prompt)) and "=" in prompt and prompt.count("=") * 3 > len(tokens):
            return False  # a sequence or a row of values is in no language
    if a != b:
        return a != "latin" or bool(_votes(prompt)) or len(_WORDS.findall(prompt)) > 2
    if a != "latin":
        return False
    mine, theirs = _votes(prompt), _votes(plain)
    if not mine or not theirs:
        return False
    home = max(mine, key=mine.get)
    best = max(theirs, key=theirs.get)
    return best != home and theirs[best] > 2 * theirs.get(home, 0) and mine.get(best, 0) < mine[home] and theirs[best] >= 2


class SuffixAutomaton:
    """Of one prompt: all its substrings, each state with the end of its first occurrence."""

    def __init__(self, text: str) -> None:
        follow: list[dict[str, int]] = [{}]
        link, length, first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(text):
            state = len(follow)
            follow.append({})
            length.append(i + 1)
            first.append(i)
            link.append(0)
            p = last
            while p != -1 and c not in follow[p]:
                follow[p][c] = state
                p = link[p]
            if p != -1:
                q = follow[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p != -1 and follow[p].get(c) == q:
                        follow[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
        self.follow, self.link, self.length, self.first, self.size = follow, link, length, first, len(text)

    def coverage(self, response: str, least: int) -> float:
        """Share of the prompt inside maximal matches with ``response`` of at least ``least`` characters."""
        covered = bytearray(self.size)
        state = matched = 0

        def note() -> None:
            if matched >= least:
                end = self.first[state] + 1
                covered[end - matched : end] = b"\x01" * matched

        for c in response:
            if c not in self.follow[state]:
                note()
                while state != -1 and c not in self.follow[state]:
                    state = self.link[state]
                if state == -1:
                    state = matched = 0
                    continue
                matched = self.length[state]
            state = self.follow[state][c]
            matched += 1
        note()
        return sum(covered) / self.size if self.size else 0.0


def _may_cover(a: str, b: str, least: int) -> bool:
    """Whether substrings of ``least`` characters that ``b`` has too hold COPIED_SHARE of ``a``; where they don't, no
    coverage is as large. Ends as soon as too much of ``a`` is missed."""
    grams: set[str] = set()
    missed, reached, most = 0, 0, len(a) - COPIED_SHARE * len(a) + 1e-6
    for i in range(len(a)):
        gram = a[i : i + least]
        if len(gram) == least and (gram in grams if grams else gram in b):
            reached = i + least
        elif i >= reached:
            missed += 1
            if missed > most:
                return False
        if i == 200:  # a long text: look up instead of searching
            grams = {b[k : k + least] for k in range(len(b) - least + 1)}
    return True


def is_copy(prompt: str, response: str) -> bool:
    """Whether the response repeats all or nearly all of a prompt of LEAST_COPIED code points or more."""
    prompt = prompt.strip()
    if len(prompt) < LEAST_COPIED:
        return False
    a, b = _BLANKS.sub(" ", prompt).lower(), _BLANKS.sub(" ", response).lower()
    if len(b) < COPIED_SHARE * 0.9 * len(a):
        return False
    least = min(LEAST_MATCH, len(a))
    return a in b or _may_cover(a, b, least) and SuffixAutomaton(a).coverage(b, least) >= COPIED_SHARE


def _open_delimiters(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if c in "([{（「『«":
            stack.append(c)
        elif c == "“" or c == "„":
            if stack and stack[-1] == "„":
                stack.pop()
            else:
                stack.append("“" if c == "“" else "„")
        elif c in _PAIRS and stack and (stack[-1] == _PAIRS[c] or c == "”" and stack[-1] == "„"):
            stack.pop()
    return bool(stack) or text.count('"') % 2 == 1


def ending(text: str) -> str | None:
    """What must occur before a stop for ``text`` to be finished: its last word, the last two if that is a function
    word, the last signs in scripts without blanks; null for numbers and codes, which can end a sentence."""
    tail = text.rstrip("\"'”’»)]」』）").rstrip()
    if not tail:
        return None
    if _UNSPACED.match(tail[-1]):
        return tail[-3:]
    words = _MARKED.findall(tail[-120:])
    if not words or not words[-1] or not any(c.isalpha() for c in words[-1]):
        return None
    last = words[-1]
    if last.isascii() and last.isupper() or any(c.isdigit() for c in last):
        return None
    last = last.lower()
    return f"{words[-2].lower()} {last}" if last in _VOTES and len(words) > 1 else last


def defect(prompt: str, response: str | None) -> tuple[str | None, str | None]:
    """(defect, ending): the defect of a pair, or the ending that decides whether it is truncated."""
    seen = visible(response)
    if is_empty(seen):
        return "empty", None
    if is_refusal(seen):
        return "refusal", None
    if other_language(prompt, seen):
        return "other_language", None
    if is_copy(prompt, seen):
        return "copy", None
    if _BLANKS.sub(" ", prompt.strip()).lower() == _BLANKS.sub(" ", seen).lower():
        return None, None  # a short prompt is echoed
    if _CLOSED.search(seen):
        return None, None
    if _OPEN_END.search(seen) or _open_delimiters(seen):
        return "truncated", None
    return None, ending(seen)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.num_columns - 2
        at, defects, endings = [], [], []
        for i, (prompt, response) in enumerate(zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist())):
            if prompt is None or not prompt.strip():
                continue
            what, end = defect(prompt, response)
            if what or end:
                at.append(i)
                defects.append(what)
                endings.append(end)
        index = pa.array(at, pa.int32())
        columns = [batch.column(j).take(index) for j in range(keys)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(defects, pa.string()), pa.array(endings, pa.string())], [*batch.schema.names[:keys], "defect", "ending"])


#: An ending is one of finished sentences if this share of its occurrences, or more, stands before a stop.
STOP_SHARE = 0.01
#: Forget the counts of a task beyond so many endings; that only costs repeated rows.
MOST_COUNTED = 200_000

_FUNCTION_WORDS = frozenset(v for w in _VOTES for v in (w, w.capitalize(), w.upper()))
_STOPS = frozenset(".!?؟।")
_WORD_STOP = re.compile(_MARKED.pattern + "|[.!?؟।](?![a-z\\d])")
_SIGN_RUNS = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]{3,}")
_SIGN_STOP = re.compile("[\"'”’»)\\]」』]*[.!?。！？]")
_TEXT_END = re.compile("\\s*$")
_THAI_STOP = re.compile("\\s+(?![0-9๐-๙A-Za-zÀ-ɏ])")


class EndingCounts:
    """Occurrences of the possible endings of sentences in texts, and how many of them stand before a stop."""

    def __init__(self) -> None:
        self.total: Counter[str] = Counter()
        self.stops: Counter[str] = Counter()

    def add(self, text: str, whole: bool) -> None:
        """Count ``text``; in scripts without blanks the end of a ``whole`` text is as good as a stop."""
        tokens = _WORD_STOP.findall(text)
        self.total.update(tokens)
        special = [i for i, t in enumerate(tokens) if t in _FUNCTION_WORDS or t in _STOPS]
        for i in special:
            stop = tokens[i] in _STOPS
            i -= stop
            if i < 0 or tokens[i] in _STOPS:
                continue
            if tokens[i] not in _FUNCTION_WORDS:
                self.stops[tokens[i]] += 1
                continue
            before = i - 1
            while before >= 0 and tokens[before] in _STOPS:
                before -= 1
            if before >= 0:
                (self.stops if stop else self.total)[f"{tokens[before]} {tokens[i]}"] += 1
            elif stop:
                self.stops[tokens[i]] += 1
        if text.isascii():
            return
        for run in _SIGN_RUNS.finditer(text):
            signs = run[0]
            self.total.update([f"\0{signs[k : k + 3]}" for k in range(len(signs) - 2)])
            end = run.end()
            if _SIGN_STOP.match(text, end) or whole and _TEXT_END.match(text, end) or "\u0e00" <= signs[-1] <= "\u0e7f" and _THAI_STOP.match(text, end):
                self.stops[f"\0{signs[-3:]}"] += 1

    def rows(self) -> pa.RecordBatch:
        """``(ending, stops, total)`` as ``ending`` writes them; what it leaves out, such as codes in capitals, is left
        out here, which is why words are counted in their own case."""
        counts: dict[str, list[int]] = {}
        for raw, n in self.total.items():
            last = raw.rsplit(" ", 1)[-1]
            if raw[0] == "\0":
                end = raw[1:]
            elif last.isascii() and last.isupper() or not any(c.isalpha() for c in last) or any(c.isdigit() for c in last) or _UNSPACED.match(last[-1]):
                continue
            else:
                end = raw.lower()
            at = counts.setdefault(end, [0, 0])
            at[0] += self.stops.get(raw, 0)
            at[1] += n
        columns = [pa.array(counts.keys(), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, ["ending", "stops", "total"])


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = EndingCounts()
    for batch in batches:
        for k, column in enumerate(batch.columns):
            for text in column.to_pylist():
                if text:
                    counts.add(text, k == 0)
        if len(counts.total) > MOST_COUNTED:
            yield counts.rows()
            counts = EndingCounts()
    yield counts.rows()


def endings(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(ending, stops, total)``: the occurrences of each possible ending in all texts of ``columns`` (the first one
    holds whole texts), and how many of them stand before a stop."""
    counts = df.select(*columns).mapInArrow(_endings, "ending string, stops long, total long")
    return counts.groupBy("ending").agg(F.sum("stops").alias("stops"), F.sum("total").alias("total"))


def broken_pairs(df: DataFrame, keys: list[str], prompt_col: str, response_col: str) -> DataFrame:
    """``(*keys, defect)``: one row for each key of ``df`` with a defective response.

    Rows whose prompt is null or blank are left out; a null response is ``empty``. A key that occurs several times
    counts once (with different contents, which one is open). Other columns are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    judged = df.select(*keys, prompt_col, response_col).mapInArrow(_judge, f"{schema}, defect string, ending string")
    # Rows that need no look-up get a key of their own, so that they don't all meet in one partition.
    judged = judged.withColumn("ending", F.coalesce("ending", F.concat_ws("\u0000", F.lit(""), *keys)))
    known = endings(df, [prompt_col, response_col]).where(F.col("stops") >= STOP_SHARE * F.col("total")).select("ending", F.lit(True).alias("known"))
    found = judged.join(known, "ending", "left").withColumn("defect", F.coalesce("defect", F.when(F.col("known").isNull(), F.lit("truncated"))))
    return found.where("defect is not null").select(*keys, "defect").dropDuplicates(keys)
