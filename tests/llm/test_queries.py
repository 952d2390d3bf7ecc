"""The registered queries over their whole tables, and operators beside columns called like their own."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heddle.llm import language, mixing, packing, pii, queries, quality, tokens

from .test_operators import plain_components, plain_rule

COLUMNS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op10_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: (out.columns, out.collect()) for name, f in queries.queries().items() for out in [f(spark, sf_dir)]}


def test_columns_and_a_row_each(results, texts, spark, sf_dir):
    assert set(results) == set(COLUMNS) | {"op3_pii", "op11_decontamination", "op12_source_divergence", "op13_filter_interaction"}
    pages = {r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()}
    for name, wanted in COLUMNS.items():
        columns, rows = results[name]
        assert columns[: len(wanted)] == wanted
        ids = [r[0] for r in rows]
        assert set(ids) == (pages if wanted[0] == "page_id" else set(texts)) and (name == "op6_packing" or len(ids) == len(set(ids)))


def test_quality_and_exact_copies(results, texts):
    for r in results["op1_quality_rules"][1]:
        f = quality.Facts(texts[r["doc_id"]] or "")
        assert r["kept"] == (not f.base_failed and not any(x.rejects(f) for x in quality.RULES)) and r["n_words"] == f.n_words
    by = collections.defaultdict(list)
    for i, t in texts.items():
        by[t or ""].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    assert {tuple(r) for r in results["op4_exact_dedup"][1]} == want


def test_mix(results):
    by = collections.defaultdict(list)
    for r in results["op2_mixing"][1]:
        by[r["source_size"], r["target"]].append(r)
    for (source_size, target), rows in by.items():
        assert sum(r["size"] for r in rows) == source_size and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)


def test_personal_data_by_plain_patterns(results, texts):
    """Documents that hold an address, a token, an IPv4 address, a phone or a card by plain patterns change, others don't."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10
    plain = [r"[\w.]+@[\w.]+\.\w+", r"\b(?:token|password|secret|api_key)\b ?[=:] ?\"?\w{8,}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"\+\d+ \(\d+\) \d+-\d+", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"]
    for r in results["op3_pii"][1]:
        t = texts[r["doc_id"]] or ""
        found = [m for p in plain for m in re.findall(p, t)] + [m for m in re.findall(r"(?<!\d)\d{13,18}(?!\d)", t) if luhn(m) == 0]
        assert (r["n_entities"] > 0) == bool(found) == (r["text"] != t), (r["doc_id"], found)
        assert not any(m in r["text"] for m in found)


def test_language_by_an_exact_sum_over_paths(results, texts, spark, sf_dir):
    """Posteriors by logarithms, one word at a time, with the same model."""
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    for r in results["op5_language_id"][1][:60]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        w = language.words_of(texts[r["doc_id"]] or "")
        if not w:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        s = model.scores(w).astype(float)
        ahead, behind = [model.starts + s[0]], [np.zeros(len(model.labels))]
        for t in range(1, len(w)):
            ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.moves, axis=0) + s[t])
            behind.append(np.logaddexp.reduce(model.moves + (s[len(w) - t] + behind[-1])[None, :], axis=1))
        post = np.array(ahead) + np.array(behind[::-1])
        mean = np.exp(post - np.logaddexp.reduce(post, axis=1)[:, None]).mean(axis=0)
        assert r["lang_pred"] == model.labels[int(mean.argmax())] and r["score"] == pytest.approx(mean.max(), abs=1e-4)


def test_packing_near_copies_and_tokens(results, texts):
    lengths = collections.Counter()
    tok, word = tokens.tokenizer("byte_bpe_50k.json"), tokens.tokenizer("word_bpe_49k.json")
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    filled = collections.defaultdict(list)
    for r in results["op6_packing"][1]:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r["doc_tokens"] == len(ids[r["doc_id"]])
        lengths[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(lengths[i] == len(x) for i, x in ids.items())
    assert all(sum(n for _, n in sorted(p)[:k]) == at for p in filled.values() for k, (at, _) in enumerate(sorted(p))) and all(sum(n for _, n in p) <= 1024 for p in filled.values())
    parts = plain_components(list(texts.items()), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in results["op7_near_dedup"][1]} == parts
    for r in results["op10_token_counts"][1]:
        n = len(word.encode(texts[r["doc_id"]] or "", add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 2048)


def test_pages(results, spark, sf_dir):
    html = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in results["op8_html_extraction"][1]:
        assert r["n_chars"] == len(r["text"]) and r["url"] == html[r["page_id"]]["url"]
    for r in results["op9_url_filter"][1]:
        verdict, rule = plain_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


OPERATORS = {
    "mix": (lambda d: mixing.mix(d), ("size", "source_size", "target", "copies")),
    "replace_pii": (lambda d: pii.replace_pii(d, "k"), ("n_entities", "n_email", "n_name")),
    "identify": (lambda d: language.identify(d, language.fit([("the of and", "en"), ("der die das", "de")])), ("lang_pred", "score")),
    "count_tokens": (lambda d: tokens.count_tokens(d), ("n_bytes", "n_tokens", "over_limit")),
    "pack": (lambda d: packing.pack(d), ("start", "length", "ids", "prompt", "sequence_id")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_called_like_the_operators_own(spark, name):
    operator, names = OPERATORS[name]
    rows = [(1, "the of and a@b.io", "s"), (1, "the of and a@b.io", "s"), (2, None, None), (None, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(str, operator(docs).drop("sequence_id").collect()))
    clash = operator(docs.withColumns({c: F.lit("own") for c in names}))
    assert sorted(map(str, clash.select(*operator(docs).drop("sequence_id").columns).collect())) == plain
    assert operator(docs.withColumns({c: F.lit("own") for c in names}).limit(0)).isEmpty()


def test_equal_scores_give_the_first_label():
    model = language.Model(["a", "b"], language.np.zeros((language.BUCKETS + 1, 2), "float32"), {}, language.np.zeros(2), language.np.zeros((2, 2)))
    assert language.Labeller(model).predict(["some words", "", "123"]) == (["a", "und", "und"], [pytest.approx(0.5), 0.0, 0.0])


def test_packing_keeps_three_limits_at_once(spark):
    """Turns of conversations: what was asked bears no loss, and each limit binds somewhere."""
    rows = [(i, "question " * (i * 37 % 90), "answer " * (1 + i * 53 % 120)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, ask string, text string").coalesce(1)
    out = packing.pack(docs, tokens=256, segments=6, loss=160, prompt="ask").collect()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in out:
        for k, v in enumerate((r["length"], 1, r["loss_tokens"])):
            by[r["sequence_id"]][k] += v
    assert [max(v[k] for v in by.values()) for k in range(3)] == [256, 6, 160]
