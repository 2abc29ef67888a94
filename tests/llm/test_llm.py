"""Operators of the subpackage against brute force, and their edge cases."""

import itertools
import os
import random
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkspark.llm import count_table, mixing, near_dup, packing, pairs, quality, scan_repair, sentences, split_oversized
from chunkspark.llm.token_count import token_count
from chunkspark.llm.unicode_text import words


def shingle_set(text, k):
    w = [x.decode() if isinstance(x, bytes) else x for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[], ["x" + str(rng.random())], [other[at], "y"]])
            texts.append(other or ["z"])
    rows = [(f"c{i:03}", " ".join(t)) for i, t in enumerate(texts)] + [("c000", " ".join(texts[0])), ("n1", None), ("n2", ""), (None, "a b c")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("h", F.lit(1)).withColumn("token", F.lit(2))
    members, links = near_dup.near_duplicates(df, "id", "text", 0.65, 3, 10)
    got = {tuple(r) for r in near_dup.expand_pairs(members, links).collect()}
    known = {i: t for i, t in rows if i and t and len(words(t)) >= 10}
    sets = {i: shingle_set(t, 3) for i, t in known.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= 65 * len(sets[a] | sets[b])}
    assert got == want
    assert want
    degrees = near_dup.link_counts(members, links)
    assert degrees.count() == len({i for i, t in rows if i and t is not None})


def test_near_duplicates_of_nothing(spark):
    members, links = near_dup.near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert near_dup.expand_pairs(members, links).count() == 0


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if os.path.basename(f).startswith("shuffle_") and os.path.exists(f)}


def test_near_duplicates_free_the_index_and_name_paired_ids(spark):
    rng = random.Random(4)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(60)]
    texts = {f"t{i:03}": " ".join(sum(rng.sample(passages, 12), [])) for i in range(400)}
    texts |= {"u1": texts["t000"], "u2": texts["t001"] + " end", "short1": "a b", "short2": "a b", "lone": " ".join(f"x{i}" for i in range(80))}
    df = spark.createDataFrame([*texts.items(), ("t005", texts["t005"])], "id string, text string")
    rows = near_dup.index_rows(df.select(F.xxhash64("text").alias("h"), "text"), Fraction("0.65"), 3, 10, 16).count()
    assert rows > 4000
    before = shuffle_bytes(spark).keys()
    members, links = near_dup.near_duplicates(df, "id", "text", 0.65, 3, 10)
    for _ in range(50):  # removed in the background
        left = sum(n for f, n in shuffle_bytes(spark).items() if f not in before)
        if left < 16 * rows:
            break
        time.sleep(0.2)
    assert left < 16 * rows  # a row of the index has three random longs
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    paired = {r["id"] for r in members.where("paired").collect()}
    assert {"t000", "t001", "u1", "u2"} <= paired
    assert not {"lone", "short1", "short2"} & paired
    assert members.count() == len(texts)
    got = {tuple(r) for r in near_dup.expand_pairs(members, links).collect()}
    sets = {i: shingle_set(t, 3) for i, t in texts.items() if len(t.split()) >= 10}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= 65 * len(sets[a] | sets[b])}
    assert {("t000", "u1"), ("t001", "u2")} <= want == got
    assert links.where("a = b").count() == 1


def test_rows_of_a_hot_shingle_meet_once(monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 4)
    texts = [f"a b c d e f g h {i} {i + 1}" for i in range(20)]
    rows = near_dup.prefix_rows(texts, np.arange(20), np.full(1 << 16, 20, np.uint8), 3, 0, Fraction("0.5"))
    flags, cells = rows["m1"] & 3, {}
    assert len(rows["token"]) % 5 == 0
    for token, own, flag in zip(rows["token"].tolist(), rows["id"].tolist(), flags.tolist()):
        cells.setdefault(token, []).append((own, flag))
    met = [tuple(sorted((a[0], b[0]))) for rows_ in cells.values() for a, b in itertools.combinations(rows_, 2) if a[1] + b[1] in (1, 4)]
    shared = {s for s in shingle_set(texts[0], 3) if s in shingle_set(texts[1], 3)}
    assert len(cells) > 1
    assert all(0 < n <= len(shared) for n in np.unique(met, axis=0, return_counts=True)[1])
    assert len(set(met)) == 20 * 19 // 2


def test_index_rows_are_small():
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(90)) for i in range(2000)]
    ids = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, len(texts), np.int64)
    rows = near_dup.prefix_rows(texts, ids, np.full(1 << 16, 20, np.uint8), 3, 0, Fraction("0.65"))
    names = [c.split()[0] for c in near_dup.COLUMNS.split(", ")]
    assert list(rows) == names
    # As Spark shuffles them: length, null bits and the columns, in compressed blocks of 32 KB, to one of many tasks.
    mine = rows["token"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58) == 0
    table = np.zeros(int(mine.sum()), [("length", ">i4"), ("nulls", "<i8"), *((n, "<i8") for n in names)])
    table["length"] = table.itemsize - 4
    for n in names:
        table[n] = rows[n][mine]
    data, codec = table.tobytes(), pa.Codec("lz4_raw")
    size = sum(len(codec.compress(data[i : i + 32768])) for i in range(0, len(data), 32768))
    assert size / len(table) < 32


def test_index_rows_of_large_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BOXES", 1)
    words_ = [f"w{i}" for i in range(66_002)]
    texts = [" ".join(words_), " ".join(words_[:60_002]), " ".join(words_[:40_002])]  # 66000, 60000 and 40000 shingles
    t = Fraction("0.65")
    rows = near_dup.prefix_rows(texts, np.arange(3), np.full(1 << 16, 20, np.uint8), 3, 0, t)
    assert (rows["m2"] != 0).any()
    df = spark.createDataFrame(pa.table(rows))
    for chain in (0, 1, 2):
        assert {tuple(r) for r in near_dup.ring_pairs(df, t, chain).collect()} == {(0, 1), (1, 2)}


def test_count_codes():
    counts = np.array([0, 1, 128, 129, 1000, 10**7, 10**11])
    codes = count_table.encode_counts(counts)
    assert (count_table.decode_counts(codes) >= counts).all()
    assert codes[1] == 1


def test_counts_of_a_table(spark):
    df = spark.range(1000, numPartitions=20).select(F.xxhash64(F.col("id") % 10).alias("h"))
    table = count_table.count_table(df, lambda batch: batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), 16)
    assert sorted(table[table > 0].tolist()) == [100] * 10


def test_the_ring_prunes_and_loses_nothing(spark):
    rng = random.Random(8)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(40)]
    texts = {i: sum(rng.sample(passages, 10), []) for i in range(120)}  # all shingles are common, few texts similar
    for i in range(0, 120, 6):
        other = list(texts[i])
        for _ in range(4):
            other[rng.randrange(len(other))] = f"x{rng.random()}"
        texts[1000 + i] = other
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "h long, text string")
    t = Fraction("0.65")
    index = near_dup.index_rows(df, t, 3, 0, 16).persist()
    found = [{tuple(r) for r in near_dup.ring_pairs(index, t, chain).collect()} for chain in (0, 1, 2)]
    sets = {i: shingle_set(" ".join(x), 3) for i, x in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * 100 >= 65 * len(sets[a] | sets[b])}
    assert len(want) >= 20
    assert want <= found[2] < found[1] < found[0]
    assert len(found[2]) * 2 < len(found[0])
    index.unpersist()


def test_chains_of_a_ring():
    """Some start that is not empty has all its chains within the budgets, whenever the whole ring has."""
    rng = random.Random(9)
    for _ in range(500):
        loads = [rng.choice([0, 0, 2, 5, 9]) for _ in range(8)]
        far = [rng.randint(0, n) for n in loads]
        values = [165 * d - 35 * n for d, n in zip(far, loads)]
        if sum(loads) and sum(values) <= 0:
            assert any(loads[i] and all(sum((values + values)[i : i + m]) <= 0 for m in range(1, 9)) for i in range(8))


def test_pieces_cover_the_text():
    rng = random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "Long sentence ends. Then", "\n\n", "x" * rng.randint(1, 300), " "]) for _ in range(rng.randint(1, 60)))
        unit, parts = split_oversized.pieces(text, 120, 20)
        assert all(e - s <= 120 for s, e, _ in parts)
        assert not parts or parts[0][0] == 0 and parts[-1][1] == len(text)
        for (_, e, _), (s, _, _) in zip(parts, parts[1:]):
            assert s == e - 20
        assert unit == "whole" or len(text) > 120


def test_pieces_take_an_early_paragraph():
    early = "a b c " * 5 + "\n\n" + "x y z " * 30
    assert split_oversized.pieces(early, 100, 10)[1][0] == (0, 29, "paragraph")
    assert split_oversized.pieces(early, 100, 10, 50)[1][0][2] == "word"


@pytest.mark.parametrize(("text", "unit"), [("a" * 300, "char"), ("ab " * 100, "word"), ("One two three four. " * 20, "sentence"), (("x y. " * 10 + "\n\n") * 8, "paragraph"), ("short", "whole")])
def test_coarsest_unit(text, unit):
    assert split_oversized.pieces(text, 100, 10)[0] == unit


def test_split_table(spark):
    df = spark.createDataFrame([("d", "a b. " * 900), ("d", "a b. " * 900), ("e", None), ("f", ""), ("g", "x")], "k string, text string").withColumn("piece", F.lit(9))
    rows = split_oversized.split_oversized(df, ["k"], "text").collect()
    assert {r.k for r in rows} == {"d", "g"}
    assert len([r for r in rows if r.k == "d"]) == len({r.piece for r in rows if r.k == "d"}) > 1


def test_split_takes_one_version_of_a_key(spark):
    long, short = "a b. " * 900, "c d. "
    rows = [("d", 1, long), ("d", 2, long[:3000]), ("e", 1, long), ("e", 3, short), ("f", 2, long), ("f", 1, short), ("g", 1, short), ("g", 2, None)]
    df = spark.createDataFrame(rows, "k string, v int, text string").withColumn("pieces", F.lit(1))
    out = {}
    for r in split_oversized.split_oversized(df, ["k"], "text", version="v").collect():
        out.setdefault(r.k, []).append(r)
    assert max(r.stop for r in out["d"]) == 3000
    assert all(len(x) == x[0].pieces for x in out.values())
    assert [r.unit for r in out["e"]] == ["whole"]
    assert max(r.stop for r in out["f"]) == len(long)
    assert [r.stop for r in out["g"]] == [len(short)]
    again = split_oversized.split_oversized(df, ["k"], "text").collect()
    assert all(sum(r.k == k for r in again) == next(r.pieces for r in again if r.k == k) for k in "defg")


SENTENCES = [
    ("He met Dr. Smith at 3 p.m. today. Then (see Fig. 2) it ended.", ["He met Dr. Smith at 3 p.m. today.", "Then (see Fig. 2) it ended."]),
    ("Was it 3.5? \"Yes,\" she said. It was!", ["Was it 3.5?", "\"Yes,\" she said.", "It was!"]),
    ("It stops here.[3] Next one.", ["It stops here.[3]", "Next one."]),
    ("No blank here.The next one.", ["No blank here.", "The next one."]),
    ("Der 2. Lauf ist z. B. neu. Die Zahl ist 5.", ["Der 2. Lauf ist z. B. neu.", "Die Zahl ist 5."]),
    ("有人问：“真的稳定吗？”因此稳定。", ["有人问：“真的稳定吗？”", "因此稳定。"]),
    ("所谓“随机！”的说法。", ["所谓“随机！”的说法。"]),
    ("「本当か。」という問いが残る。次。", ["「本当か。」という問いが残る。", "次。"]),
    ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]),
    ("2. A heading with number", ["2. A heading with number"]),
    # Held-out wording in each language.
    ("The reading was approx. 4.5 kg. Nobody (not even Prof. Lee) noticed! Why not?", ["The reading was approx. 4.5 kg.", "Nobody (not even Prof. Lee) noticed!", "Why not?"]),
    ("See Sec. 3 and Eq. 7 for more. She asked, “Is it so?” and left.", ["See Sec. 3 and Eq. 7 for more.", "She asked, “Is it so?” and left."]),
    ("Das Ergebnis ist ca. 3,5 m lang. Es gilt vgl. Kap. 2 nur bedingt.", ["Das Ergebnis ist ca. 3,5 m lang.", "Es gilt vgl. Kap. 2 nur bedingt."]),
    ("M. Dupont arrive. Est-ce vrai ? Oui, cf. chap. 4.", ["M. Dupont arrive.", "Est-ce vrai ?", "Oui, cf. chap. 4."]),
    ("El Sr. Gil llegó tarde. ¿Por qué? ¡Nadie lo sabe!", ["El Sr. Gil llegó tarde.", "¿Por qué?", "¡Nadie lo sabe!"]),
    ("Это видно на рис. 2. Почему так? Ответ прост.", ["Это видно на рис. 2.", "Почему так?", "Ответ прост."]),
    ("هل هذا صحيح؟ نعم، هذا صحيح. شكرا.", ["هل هذا صحيح؟", "نعم، هذا صحيح.", "شكرا."]),
    ("क्या यह सही है? हाँ, डॉ. राव आए। वह गए।", ["क्या यह सही है?", "हाँ, डॉ. राव आए।", "वह गए।"]),
    ("这是对的吗？是的。温度为3.5度！好。", ["这是对的吗？", "是的。", "温度为3.5度！", "好。"]),
    ("これは本です。値は3.5です。本当ですか？", ["これは本です。", "値は3.5です。", "本当ですか？"]),
    ("นี่คือหนังสือ มันดีมาก", ["นี่คือหนังสือ", "มันดีมาก"]),
    ("", []),
    (" \n ", []),
]


@pytest.mark.parametrize(("text", "units"), SENTENCES)
def test_sentences(text, units):
    ends = sentences.sentence_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == units


def test_sentence_table(spark):
    df = spark.createDataFrame([("d", "A b. C d."), ("e", None), ("f", "  ")], "k string, text string").withColumn("end_pos", F.lit(1))
    assert {tuple(r) for r in sentences.sentence_units(df, ["k"], "text").collect()} == {("d", 4), ("d", 9)}


LONG = "The thermal plasma converges under mild assumptions, and the spectral theorem recovers."


@pytest.mark.parametrize(
    ("response", "defect"),
    [
        (None, "empty"), (" ​", "empty"), ("N/A", "empty"), ("…", "empty"), ("I'm sorry, but I can't summarise this passage.", "refusal"), ("Es tut mir leid, das geht nicht.", "refusal"),
        ("Sorry results for the plasma are traced to the theorem.", None), ("The authors cannot reject the view that plasma converges.", None), ("Ce passage explique comment le plasma thermique converge.", "other_language"),
        (LONG, "copy"), ("Key point: " + LONG.upper(), "copy"), ("Argues that the plasma,", "truncated"), ("Argues that the plasma (under", "truncated"), ("Argues that the plasma converges.", None),
    ],
)
def test_pair_defects(response, defect):
    assert pairs.defect(LONG, response)[0] == defect


@pytest.mark.parametrize(
    "response",
    [
        "I apologize, but I cannot help with this text.", "I'm afraid I can't do that.", "As an AI language model, I can't summarise this.", "I do not have access to the document.", "Unfortunately, I am unable to process it.",
        "Je regrette, je ne peux pas répondre.", "No tengo acceso al texto.", "Не могу помочь с этим запросом.", "无法提供摘要。", "申し訳ないのですが、要約はできません。", "ไม่สามารถสรุปได้", "لا أستطيع تلخيص هذا النص.", "मैं इसमें मदद नहीं कर सकता।",
    ],
)
def test_refusals_in_other_words(response):
    assert pairs.is_refusal(response)


@pytest.mark.parametrize("response", ["The authors apologise for the delay.", "Nodes cannot help each other.", "作者认为我们不能忽略噪声。", "Es wird bedauert, dass Daten fehlen."])
def test_no_refusals(response):
    assert not pairs.is_refusal(response)


def test_pairs_table(spark):
    rows = [("a", LONG, "Argues that the plasma recovers"), ("b", LONG, "Argues that the plas"), ("c", None, None), ("d", " ", "x"), ("e", LONG, None), ("e", LONG, None)]
    df = spark.createDataFrame(rows, "k string, text string, summary string").withColumn("defect", F.lit(1)).withColumn("ending", F.lit(1))
    assert {tuple(r) for r in pairs.broken_pairs(df, ["k"], "text", "summary").collect()} == {("b", "truncated"), ("e", "empty")}


def test_copy_with_other_blanks():
    parts = ["本节讨论低秩估计量与边界条件之间的关系并比较", "随机谱和分层算子在多阶段控制器中的不同稳定性"]
    assert pairs.is_copy("\n".join(parts), "".join(parts))
    assert pairs.is_copy(LONG.replace(" ", " " * 9), LONG)
    assert not pairs.is_copy("\n".join(parts), parts[0])


def test_copies_pass_the_filter():
    rng = random.Random(6)
    seen = set()
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(5, 300)))
        at = rng.randint(0, len(a))
        b = a[:at] + "c" + a[at + rng.randint(0, len(a) // 4) :]
        whole = pairs.SuffixAutomaton(a).coverage(b, 5) >= pairs.COPIED_SHARE
        assert pairs._may_cover(a, b, 5) or not whole
        seen.add(whole)
    assert len(seen) == 2


@pytest.mark.parametrize("times", [1, 20])
def test_endings_count_by_case_and_share(spark, times):
    texts = ["The plasma relates to the hierarchy HIE.", "The view is modular. " + "The modular plasma recovers. " * 300, "次に説明する。"]
    rows = [(f"t{i}-{n}", t, "はい。" if i == 2 else "Done.") for i, t in enumerate(texts) for n in range(times)]
    rows += [("code", LONG, "Relates to the hie"), ("rare", LONG, "Relates to the modular"), ("fine", LONG, "Relates to the hierarchy HIE"), ("good", LONG, "How the plasma recovers")]
    rows += [("ja", "この段落は理由を述べる。", "理由を説明する"), ("ja_cut", "この段落は理由を述べる。", "この段落は理由")]
    df = spark.createDataFrame(rows, "k string, text string, summary string")
    assert {tuple(r) for r in pairs.broken_pairs(df, ["k"], "text", "summary").collect()} == {("code", "truncated"), ("rare", "truncated"), ("ja_cut", "truncated")}


def test_suffix_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 25)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        automaton = pairs.SuffixAutomaton(a)
        assert automaton.coverage(a, 1) == 1.0
        if a in b:
            assert automaton.coverage(b, len(a)) == 1.0
        if not set(a) & set(b):
            assert automaton.coverage(b, 1) == 0.0


def test_plan_places_all_items():
    rng = random.Random(1)
    for capacity in (10, 64, 500):
        counts = {}
        for _ in range(400):
            s = rng.randint(1, capacity)
            counts[s] = counts.get(s, 0) + rng.randint(1, 9)
        lines = packing.plan(dict(counts), capacity)
        placed = {}
        for content, times in lines:
            assert sum(s * k for s, k in content) <= capacity
            for s, k in content:
                placed[s] = placed.get(s, 0) + k * times
        assert placed == counts


def test_pack(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)] + [(1000, 25), (None, 3), (1001, None)], "id int, n int").withColumn("capacity", F.lit(1))
    rows = packing.pack(df, "id", "n", spark.createDataFrame([(10,), (10,), (20,)], "capacity int")).collect()
    for capacity in (10, 20):
        mine = [r for r in rows if r.capacity == capacity]
        assert sum(r.size for r in mine) == sum(i % 7 for i in range(200)) + 25
        filled = {}
        for r in mine:
            filled[r.container] = filled.get(r.container, 0) + r["size"]
        assert max(filled.values()) <= capacity
        assert {r.id for r in mine if r.parts > 1} == {1000}
    assert packing.pack(df.limit(0), "id", "n", spark.createDataFrame([(10,)], "capacity int")).count() == 0


def test_products_of_the_tables(spark, folder):
    """Each item once in each kind of container, none over its capacity; copies within their caps, shares as reported."""
    from chunkspark.llm import queries

    sizes = {r.doc_id: r.tokens for r in queries._sizes(spark, folder).collect() if r.tokens}
    rows = queries.p6_containers(spark, folder).collect()
    capacities = {r.capacity for r in rows}
    assert capacities == {r.capacity for r in spark.read.parquet(f"{folder}/container.parquet").collect()}
    for capacity in capacities:
        placed, filled = {}, {}
        for r in (r for r in rows if r.capacity == capacity):
            placed[r.doc_id] = placed.get(r.doc_id, 0) + r["size"]
            filled[r.container] = filled.get(r.container, 0) + r["size"]
        assert placed == sizes
        assert max(filled.values()) <= capacity
        assert set(filled) == set(range(len(filled)))
        assert all(r.parts == 1 or sizes[r.doc_id] > capacity for r in rows if r.capacity == capacity)
    report = {(r.mix_id, r.source.strip().lower()): r for r in queries.p7_report(spark, folder).collect()}
    given = {}
    for r in queries.p7_copies(spark, folder).collect():
        assert r.copies <= report[r.mix_id, r.source].max_repeats
        given[r.mix_id, r.source] = given.get((r.mix_id, r.source), 0) + r.copies * r.tokens
    for key, r in report.items():
        assert r.actual == given.get(key, 0)
        assert abs(r.actual - r.wanted) <= max(sizes.values()) or not r.reachable


def test_pack_drops_no_capacity(spark):
    df = spark.createDataFrame([(1, 3)], "id int, n int")
    with pytest.raises(ValueError, match="capacities"):
        packing.pack(df, "id", "n", spark.range(5, 1006).withColumnRenamed("id", "capacity"))


def test_pivotal_keeps_the_sum():
    rng = random.Random(4)
    for p in (0.1, 0.5, 0.93):
        out = mixing.pivotal([p] * 101, rng)
        assert abs(sum(out) - 101 * p) < 1e-6
        assert sum(0 < x < 1 for x in out) <= 1


def test_mix_across_blocks(monkeypatch, spark):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, " A" if i % 2 else "b", 10) for i in range(200)] + [(900, None, 5), (901, "a", 0)], "id int, source string, n int")
    targets = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "B ", 0.6, 2), ("m", "none", 0.1, 3)], "mix_id string, source string, target_share double, max_repeats int")
    copies, report = mixing.mix(docs, "id", "source", "n", targets)
    rows = {r.source: r for r in report.collect()}
    assert not rows["none"].reachable
    assert rows["a"].reachable
    assert abs(rows["a"].actual - 600) <= 10
    assert abs(rows["B "].actual - 1200) <= 10
    assert copies.count() == len({r.id for r in copies.collect()})


@pytest.mark.parametrize(("text", "n"), [("a b-c", 4), ("你好 abc", 3), ("ไทย", 3), ("", 0), (None, 0), ("é́x 12.5", 4)])
def test_token_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(token_count("t")).first()[0] == n


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("We show that the plasma is stable. It is not clear why the theorem holds for all of the cases.", "prose"), ("- one thing\n- two things\n- three things", "list"), ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "table"), ("Home\nMenu\nShare\nDownload\nLogin", "junk"), ("=" * 80, "junk"), ("the plasma " * 50, "junk"), ("", "blank"), ("  \n", "blank"),
    ],
)
def test_quality(text, kind):
    assert quality.statistics(text)["kind"] == kind


@pytest.mark.parametrize("between", [" ", "\n\n"])
def test_long_repetition_is_junk(between):
    sentence = "We show that the low-rank plasma of every modular reactor is stable under mild assumptions on its boundary."
    assert quality.statistics(between.join([sentence] * 6))["kind"] == "junk"
    assert quality.statistics(sentence)["kind"] == "prose"


def test_quality_table(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "id int, text string").withColumn("kind", F.lit(0))
    assert quality.text_statistics(df, ["id"], "text").count() == 3


def test_scan_repair(spark):
    body = ["We measure the experiment and the analysis of the modern plasma.", "The experiment and the analysis of context-dependent plasma hold."] * 30
    page = ["Letters of Plasma, Vol. 3", "", "The plasma paper", "", *body, "the experi-", "", "- 1 -", "\x0cLetters of Plasma, Vol. 3", "ment of the plasrna is context-", "dependent.\r"]
    df = spark.createDataFrame([("d", "\n".join(page)), ("d", "\n".join(page)), ("e", None), (None, "x"), ("f", "")], "doc_id string, text string")
    fixed, defects = scan_repair.repair(df, "doc_id", "text")
    n = len(page)
    header, broken, number = 1, n - 5, n - 3
    want = {("d", header, "furniture"), ("d", broken, "hyphen"), ("d", number, "furniture"), ("d", n - 2, "furniture"), ("d", n - 1, "misread")}
    assert {tuple(r) for r in defects.collect()} == want
    text = scan_repair.paragraphs(fixed).orderBy("paragraph").collect()[-1].text
    assert "the experiment of the plasma is context-dependent." in text


def test_title_behind_furniture_and_shared_headers(spark):
    head = ["Letters of Plasma, Vol. {0}", "", "- 1 -", "", "[2]", "", "Preprint submitted to Plasma", "", "Smith et al.", "", "The plasma paper", ""]
    body = [line for w in ("one", "two", "six", "ten") for line in (f"We measure the plasma of {w}, see, Section 3", f"and the book. As in {w}, the rest holds")]
    texts = ["\n".join(head + body).format(i) for i in range(4)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)]
    got = {}
    for times in (1, 10):  # the same documents are judged alike in a larger corpus
        more = rows + [(f"e{k}-{i}", t) for k in range(times - 1) for i, t in rows]
        df = spark.createDataFrame(more, "doc_id string, text string").withColumn("line_no", F.lit(7))
        _, defects = scan_repair.repair(df, "doc_id", "text")
        got[times] = {tuple(r) for r in defects.where("doc_id like 'd%'").collect()}
    assert got[1] == got[10] == {(f"d{i}", n, "furniture") for i in range(4) for n in (1, 3, 5, 7, 9)}


def test_scan_repair_of_nothing(spark):
    fixed, defects = scan_repair.repair(spark.createDataFrame([(None, "x"), ("a", None), ("b", " \n\f\r\n")], "doc_id string, text string"), "doc_id", "text")
    assert (fixed.count(), defects.count(), scan_repair.paragraphs(fixed).count()) == (0, 0, 0)


def test_scan_repair_keeps_capitals(spark):
    lines = ["The plasma paper", ""] + ["We see the stable plasma. Modern plasma holds."] * 60 + ["Modcrn plasma holds. We see the stabIe plasma."]
    fixed, _ = scan_repair.repair(spark.createDataFrame([(5, "\n".join(lines))], "doc_id long, text string"), "doc_id", "text")
    assert fixed.where(F.col("line_no") == len(lines)).first().fixed == "Modern plasma holds. We see the stable plasma."


def test_scan_repair_reads_a_fourth_form(spark):
    forms = {"first": ("bar", 500), "second": ("bär", 400), "third": ("bàr", 300), "fourth": ("bâr", 200)}
    lines = ["The plasma paper", ""] + [f"We know that the {word} {form} of the plasma holds." for word, (form, n) in forms.items() for _ in range(n)]
    lines.append("We know that the fourth bár of the plasma holds.")
    df = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    fixed, defects = scan_repair.repair(df, "doc_id", "text")
    assert {tuple(r) for r in defects.collect()} == {("d", len(lines), "misread")}
    assert fixed.where(F.col("line_no") == len(lines)).first().fixed == "We know that the fourth bâr of the plasma holds."


def test_words_are_hashed_alike_wherever_they_stand():
    import numpy as np

    from chunkspark.llm import near_dup
    from chunkspark.llm.unicode_text import words

    texts = ["Low-rank ΟΔΟΣ, οδος; İ ı x_y 3.14", None, "", " \n", "été \U0001f600 हिन्दी 漢字", "ab ba a b aab", "long word " * 40_000 + "end", "x" * 300_000 + " low", "", "END low", None]
    want = [(i, w if isinstance(w, str) else w.decode()) for i, t in enumerate(texts) if t for w in words(t)]
    owner, h = near_dup.word_hashes(texts)
    assert owner.tolist() == [i for i, _ in want]
    assert len(set(h.tolist())) == len({w for _, w in want}) == len({(w, x) for (_, w), x in zip(want, h.tolist())})
    assert near_dup.shingles(texts, 3, 0)[2].tolist() == np.bincount(owner, minlength=len(texts)).tolist()
    assert [len(x) for x in near_dup.word_hashes([None, ""])] == [0, 0]
