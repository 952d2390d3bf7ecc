"""Decontamination, source divergence and filter interaction against plain versions, and on odd input."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.llm import buffers, decontamination, divergence, interaction, queries

LONG = "word " * 40_000 + "end"
ROWS = [
    (1, "The same text of a few words.", "en", "a", "x"),
    (2, "The same text of a few words.", "en", "a", "x"),
    (2, "The same text of a few words.", "en", "b", "x"),
    (3, None, None, None, None),
    (4, "", "en", "b", ""),
    (5, " \n\t ", "de", None, "y"),
    (None, "The same text of a few words.", "de", "a", "z"),
    (None, None, "de", "a", "z"),
    (6, LONG, "en", "c", "x"),
    (7, "ÄPFEL äpfel Äpfel und Nüsse # |", "de", "c", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- words of a buffer


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["ab cd", None, "ef", "", "gh1 É", "x" * 9, " ", "ñ"]
    for column in (pa.array(texts, pa.string()), pa.array(["zz", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
        w = buffers.words(column, decontamination.WORDS)
        found = [[w.low[a:b].tobytes().decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in itertools.pairwise(w.first)]
        assert found == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t)) for t in texts]
    assert len(buffers.words(pa.array([], pa.string()), divergence.TERMS).starts) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 9, 1, 1, 0, 2)])], ["t"])
    assert [b.num_rows for b in buffers.together([batch], "t", 4)] == [1, 1, 4]


def test_slices_are_equal_byte_for_byte(monkeypatch):
    monkeypatch.setattr(buffers, "SLICES", 3)
    data = np.frombuffer(b"abcabdabcabx", np.uint8)
    starts, sizes = np.array([0, 3, 6, 9, 0]), np.array([3, 3, 3, 2, 1])
    assert buffers.equal(data, starts, data, np.zeros(5, int), sizes).tolist() == [True, False, True, True, True]


# --- 11 decontamination


def plain_hits(text, items, window=10):
    """(words, hit words, spans, items) of a text, window by window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    words, hit, of = cut(text), set(), set()
    for name, item in items:
        w = cut(item)
        size = min(window, len(w))
        parts = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if parts and tuple(words[k : k + size]) in parts:
                hit |= set(range(k, k + size))
                of.add("" if name is None else str(name))
    edges = sorted(k for k in hit if k - 1 not in hit), sorted(k + 1 for k in hit if k + 1 not in hit)
    return len(words), len(hit), list(zip(*edges)), sorted(of)


def test_every_suffix_finds_its_longest_match():
    draw = random.Random(5)
    for alphabet, bits in ((2, 2), (3, 21), (60, 6), (2, 40)):
        text = np.array([draw.randint(0, alphabet) for _ in range(400)] + [0])
        asked = np.array([draw.randint(0, alphabet) for _ in range(200)] + [0])
        text[100:140] = text[200:240]
        asked[20:50] = text[205:235]
        array = decontamination.SuffixArray(text, bits, 60)
        starts, key = np.flatnonzero(asked), decontamination.packed(asked, bits)
        length, place = array.longest(key, starts)

        def common(a, b):
            n = 0
            while asked[a + n] and asked[a + n] == text[b + n]:
                n += 1
            return n

        for s, n, p in zip(starts, length, place):
            assert n == max(common(s, b) for b in range(400)) and common(s, p) >= n
        size = np.minimum(length, 5)
        some = size > 0
        low, high = array.ranges(key, starts[some], size[some])
        for s, n, a, b in zip(starts[some], size[some], low, high):
            assert sorted(array.at[a:b]) == [t for t in range(400) if common(s, t) >= n]


def test_windows_against_a_plain_search(spark):
    draw = random.Random(3)
    say = lambda n, kinds: " ".join(draw.choice("Abcdefgh"[:kinds]) + draw.choice(["", "1"]) for _ in range(n))
    items = [(k, say(draw.choice([0, 1, 2, 4, 5, 6, 9, 30]), 3)) for k in range(12)] + [(3, say(7, 3)), (None, say(6, 2)), (20, None)]
    texts = [(k, say(draw.choice([0, 1, 3, 5, 8, 40, 200]), 4)) for k in range(60)] + [(60, None), (60, None), (None, items[11][1])]
    frame, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for window, most in ((5, 1 << 20), (5, 6), (3, 9)):
        out = decontamination.mark(frame.withColumn("n", F.lit(1)), bench, window, most=most)
        assert out.columns == ["doc_id", "text", "n", "n_words", "n_hit", "items", "spans"]
        for r in out.collect():
            assert (r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) == plain_hits(r["text"], items, window)
    kept = decontamination.decontaminate(frame.withColumn("n_hit", F.lit("own")), bench, 5)
    assert kept.columns == ["doc_id", "text", "n_hit"] and {r["n_hit"] for r in kept.collect()} == {"own"}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in texts if not plain_hits(t, items, 5)[1])


def test_longest_matches_say_where(spark):
    frame = spark.createDataFrame([(7, "x y a b c d e z"), (3, "q a b c d"), (9, None), (None, "a b c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c d e f"), ("j", "nothing here"), ("k", None)], "item_id string, text string")
    out = {(r["item_id"], r["start"]): (r["length"], r["doc_id"], r["at"]) for r in decontamination.longest_matches(frame.repartition(4), bench, 3).collect()}
    assert set(out) == {("i", 0), ("i", 1), ("i", 2)} and out["i", 0][0] == 5 and out["i", 2][0] == 3
    texts = {7: "x y a b c d e z", 3: "q a b c d", None: "a b c d e"}
    for (_, start), (n, doc, at) in out.items():
        assert texts[doc].split()[at : at + n] == "a b c d e f".split()[start : start + n]


def test_decontamination_of_odd_rows(spark, docs, empty):
    bench = spark.createDataFrame([(1, "SAME text"), (2, "äpfel"), (3, "word " * 30), (4, "")], "item_id long, text string")
    out = decontamination.mark(docs, bench)
    assert out.columns == [*docs.columns, "n_words", "n_hit", "items", "spans"] and out.count() == len(ROWS)
    for r in out.collect():
        if r["doc_id"] != 6:
            assert (r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) == plain_hits(r["text"], [(1, "same text"), (2, "äpfel")])
        else:
            assert (r["n_words"], r["n_hit"], r["items"]) == (40_001, 40_000, ["3"])
    assert decontamination.mark(empty, bench).count() == 0 and decontamination.mark(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert decontamination.decontaminate(docs, bench).where("doc_id in (1, 2, 6, 7)").isEmpty()


def test_decontamination_query(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, _, of = plain_hits(texts[r["doc_id"]], items)
        assert tuple(r)[1:] == (n, hit, len(of), hashlib.sha256(",".join(of).encode()).hexdigest(), hit > 0)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    block = decontamination.Block.of([("i", "aa bb cc"), ("j", "bb")])
    low = block.hashes[:1].repeat(3)
    asked = buffers.words(pa.array(["aa bb zz dd cc bbb"]), decontamination.WORDS)
    # Every word of the text gets the hash of the block's first word: only that word is taken for it.
    blind = block._replace(hashing=lambda w: np.full(len(w.starts), low[0]))
    first = block.low[block.starts[0] : block.starts[0] + block.sizes[0]].tobytes().decode()
    assert blind.symbols_of(asked).tolist() == [int(w == first) for w in "aa bb zz dd cc bbb".split()]
    assert (block.symbols_of(asked) > 0).tolist() == [True, True, False, False, True, False]


# --- 12 divergence


def plain_divergence(rows, least=10):
    """Rows of (lang, source, part, item, value, rank), with whole numbers of any size."""
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
    groups, in_docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        groups[lang or "", source or ""].update(cut(text))
        in_docs[lang or ""].update(set(cut(text)))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), own in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p = shares(own)
        pairs = []
        for (x, other), theirs in groups.items():
            if x == lang and other != source:
                q = shares(theirs)
                pairs.append((-sum(f(p[t], q[t]) for t in kept), other))
        q = shares(sum((c for (x, _), c in groups.items() if x == lang), collections.Counter()))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        out += [(lang, source, "pair", i, -v, k) for k, (v, i) in enumerate(sorted(pairs, key=lambda r: (r[0], r[1].encode())), 1)]
        out += [(lang, source, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def test_divergence_against_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 40)  # several chunks a language
    draw = random.Random(1)
    say = lambda k: " ".join(draw.choice(["One", "two", "ÉTÉ", "été", "x", "yy", "zzz", f"w{draw.randint(0, 40)}v"]) for _ in range(k))
    rows = [(say(draw.choice([0, 1, 5, 60])), draw.choice(["en", "de", None]), draw.choice(["a", "b", "b", "c", None])) for _ in range(240)]
    rows += [("", "fr", "a"), (None, "fr", "b"), ("seul", "fr", "a"), ("alone " * 3, "it", "only"), (LONG, "en", "b")] + [("same tie", "tie", "a"), ("same tie", "tie", "b")] * 12
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumns({"term": F.lit(1), "n": F.lit("x"), "rank": F.lit(0)})
    out = divergence.audit(frame)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect())) == plain_divergence(rows)


def test_divergence_of_odd_rows(docs, empty):
    rows = [(t, lang, source) for _, t, lang, source, _ in ROWS]
    for least in (1, 10):
        assert sorted(map(tuple, divergence.audit(docs, least).collect())) == plain_divergence(rows, least)
    assert divergence.audit(empty).count() == 0


def test_divergence_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, queries.op12_source_divergence(spark, sf_dir).collect())) == plain_divergence(rows)


def test_terms_that_share_a_hash_are_told_apart():
    w = buffers.words(pa.array(["b aa b cc a aa", "cc a d b"]), divergence.TERMS)
    texts = [w.low[a:b].tobytes() for a, b in zip(w.starts, w.ends)]
    for hashes in (np.zeros(len(texts), np.uint64), np.arange(len(texts), dtype=np.uint64) * 0 + [len(t) for t in texts]):
        term, one = divergence.settled_groups(w, hashes.astype(np.uint64))
        assert [texts[k] for k in one[term]] == texts and len(set(term.tolist())) == len(set(texts)) == len(one)


def test_shares_are_exact_for_large_counts():
    draw = random.Random(2)
    n = [draw.randint(0, 10 ** draw.randint(1, 15)) for _ in range(300)]
    whole = [k + draw.randint(1, 10**15) for k in n]
    assert divergence.share(np.array(n), np.array(whole)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, whole)]


# --- 13 interaction


def plain_interaction(rows, labels):
    least, good, toxic = {}, collections.Counter(), collections.Counter()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= x == 1
    fails = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((source or "", {k for k, v in bad.items() if v}, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                left = [m for m in mine if not m[0] & set(order[:k])]
                gone = [m for m in left if c in m[0]]
                shapley[c] += len(gone)
                out[part, order, k + 1] = [len(left) - len(gone), len(gone), sum(c in m[0] for m in mine) - len(gone), sum(m[0] == {c} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for order, k in [key[1:] for key in out if key[0] == part]:
            out[part, order, k].append(shapley[order[k - 1]])
    return out


def test_interaction_against_each_order(spark, docs, empty):
    draw = random.Random(4)
    say = lambda: " ".join(draw.choice(["Aa", "BB", "#", "c", "dd", f"w{draw.randint(0, 90)}"]) for _ in range(draw.choice([0, 3, 55, 90])))
    texts = [say() for _ in range(12)]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *texts]), draw.choice(["a", "b", None, ""])) for _ in range(150)] + [(i, t, s) for i, t, _, s, _ in ROWS]
    labels = [(draw.choice([None, *range(60)]), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit(1), "mask": F.lit("x"), "step": F.lit(0)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(0))
    out = interaction.audit(frame.repartition(4), known)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r)[:3]: list(r)[3:] for r in out.collect()}
    assert len(got) == out.count() == 600 * len({s or "" for _, _, s in rows}) and got == plain_interaction(rows, labels)
    assert interaction.audit(empty, known).count() == 0
    assert interaction.audit(docs, known.limit(0)).where("good_lost + toxic_lost > 0").isEmpty()


def test_interaction_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op13_filter_interaction(spark, sf_dir).collect()}
    assert got == plain_interaction(docs, labels)


def test_outcomes_add_up():
    m = interaction.outcomes()
    mask = np.arange(32)
    for k in range(600):
        order, step = interaction.ORDERS[k // 5], k % 5
        before = sum(1 << "ABCDE".index(c) for c in order[:step])
        own = 1 << "ABCDE".index(order[step])
        assert (m["kept"][:, k] + m["removed"][:, k] == ((mask & before) == 0)).all() and (m["removed"][:, k] + m["redundant"][:, k] == ((mask & own) > 0)).all()
    # What an order removes at its five steps is what fails any filter.
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) == (mask > 0)[:, None]).all()
