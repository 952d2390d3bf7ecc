"""Source divergence audit: how far the words of a language's sources differ from each other, and which words set one apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import SLICES, Words, equal, table, together, words
from .common import tidied, written

#: Bytes of terms: letters, and all of characters beyond ASCII.
TERMS = table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Documents of a language that a term is in at least, terms reported for a group, the unit of shares, and what is added to
#: each count.
LEAST_DOCS, TOP, UNIT, ADDED = 10, 10, 1_000_000_000, 2
#: Bytes of texts that a task counts together, counts that it puts together before they leave, counts (a term in a source)
#: of a language that meet in a chunk, unless it has more pairs of sources, and numbers written out at a time there.
PIECE, MET, CHUNK, DENSE = 1 << 22, 1 << 19, 1 << 15, 1 << 20


def grouped(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, a word of each term): words are the same term if their bytes are. Slices are grouped by xxhash;
    each is compared with the first of its group, and those that differ are told apart by their bytes."""
    view, digest = memoryview(w.low), xxhash.xxh3_64_intdigest
    hashes = np.zeros(len(w.starts), np.uint64)
    for k in range(0, len(hashes), SLICES):
        hashes[k : k + SLICES] = [digest(view[a:b]) for a, b in zip(w.starts[k : k + SLICES].tolist(), w.ends[k : k + SLICES].tolist())]
    return settled_groups(w, hashes)


def settled_groups(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `grouped`, given the words' hashes."""
    _, one, term = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = w.ends - w.starts
    head = one[term]
    same = sizes == sizes[head]
    at = np.flatnonzero(same)
    same[at] = equal(w.low, w.starts[at], w.low, w.starts[head[at]], sizes[at])
    odd: dict[bytes, int] = {}
    added = []
    for k in np.flatnonzero(~same).tolist():
        key = w.low[w.starts[k] : w.ends[k]].tobytes()
        if key not in odd:
            odd[key] = len(one) + len(added)
            added.append(k)
        term[k] = odd[key]
    return term, np.concatenate([one, np.array(added, one.dtype)])


_COUNTS = ["lang", "source", "term", "n", "docs"]


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """The counts of a piece, by way of its CSR matrix of documents by terms, whose rows are summed by group."""
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = np.asarray(langs.indices, np.int64) * max(1, len(sources.dictionary)) + np.asarray(sources.indices, np.int64)
    groups, group = np.unique(group, return_inverse=True)
    w = words(text, TERMS)
    term, one = grouped(w)
    n_terms = max(1, len(one))
    # CSR of documents by terms: an entry for each document and term in it, with its count.
    entry, times = np.unique(w.text_of() * n_terms + term, return_counts=True)
    # Entries of a group and term lie together after a sort; reduceat sums them.
    cell = group[entry // n_terms] * n_terms + entry % n_terms
    order = np.argsort(cell)
    cell, times = cell[order], times[order]
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    at = cell[begin]
    n = np.add.reduceat(times, begin) if len(begin) else times
    sizes = (w.ends - w.starts)[one]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = w.low[np.repeat(w.starts[one] - ends[:-1], sizes) + np.arange(ends[-1])]
    names = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    made = groups[at // n_terms]
    parts = [langs.dictionary.take(pa.array(made // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(made % max(1, len(sources.dictionary)))), names.take(pa.array(at % n_terms)).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*parts, pa.array(n, pa.int64()), pa.array(np.diff(begin, append=len(cell)), pa.int64())], _COUNTS)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in the documents of a language and source, and documents that
    have it. What a task counts is put together there; a term's counts meet in one exchange by language and term, in which
    a frequent term has a row for each task and source."""
    kept = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[pa.RecordBatch] = []

        def summed() -> pa.Table:
            table = pa.Table.from_batches(met).group_by(_COUNTS[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return table.select([*_COUNTS[:3], "n_sum", "docs_sum"]).rename_columns(_COUNTS)

        for b in together(batches, "text", PIECE):
            met.append(_counted(*b.columns))
            if sum(m.num_rows for m in met) > MET:
                yield from summed().to_batches()
                met.clear()
        if met:
            yield from summed().to_batches()

    met = kept.mapInArrow(tidied(count), "lang string, source string, term string, n long, docs long")
    return met.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / whole), exactly: the quotient is made three digits at a time, so that no product leaves 64 bits
    while `whole` is below 9 * 10^15."""
    quotient, rest = n // whole, n % whole
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return 1 + quotient


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def _chunk(terms: pa.Table, totals: pa.Table) -> tuple[list, list]:
    """Of the kept terms of a chunk of a language, as rows of (term, per: sources and counts): the sums of distances between
    each two sources, (source, item, value), and each source's first TOP terms, (source, item, value).

    The lists are a CSR matrix of terms by sources. A stretch of its rows at a time is written out as shares."""
    sources = sorted(totals["source"].to_pylist())
    place = {s: k for k, s in enumerate(sources)}
    by = {r["source"]: r for r in totals.select(["source", "total"]).to_pylist()}
    v = totals["v"][0].as_py() if totals.num_rows else 0
    size = len(sources)
    whole = np.array([by[s]["total"] for s in sources], np.int64) + ADDED * v
    lang_whole = int(sum(by[s]["total"] for s in sources)) + ADDED * v
    sums, best = np.zeros((size, size), np.int64), [[] for _ in range(size)]
    if terms.num_rows:
        terms = terms.sort_by("term").combine_chunks()
        names, per = terms["term"].combine_chunks(), terms["per"].combine_chunks()
        ends = np.asarray(per.offsets, np.int64)
        of = per.values.field("source").dictionary_encode()
        places = np.array([place[s] for s in of.dictionary.to_pylist()], np.int64)
        column, n = places[np.asarray(of.indices, np.int64)], np.asarray(per.values.field("n"), np.int64)
        indptr = ends - ends[0]
        column, n = column[ends[0] : ends[-1]], n[ends[0] : ends[-1]]
        stretch = max(1, DENSE // size)
        for low in range(0, terms.num_rows, stretch):
            rows = np.diff(indptr[low : low + stretch + 1])
            part = slice(indptr[low], indptr[low] + rows.sum())
            dense = np.zeros((len(rows), size), np.int64)
            dense[np.repeat(np.arange(len(rows)), rows), column[part]] = n[part]
            p = share(dense + ADDED, whole)
            for a in range(size):
                sums[a] += distance(p[:, a, None], p).sum(axis=0)
            q = share(np.add.reduceat(n[part], indptr[low : low + len(rows)] - indptr[low]) + ADDED, np.int64(lang_whole))
            for a in range(size):
                above = np.flatnonzero((dense[:, a] > 0) & (p[:, a] > q))
                values = distance(p[above, a], q[above])
                # Names ascend, so a stable sort by value keeps ties in the order of their bytes.
                first = np.argsort(-values, kind="stable")[:TOP]
                best[a] = sorted(best[a] + [(-int(values[k]), low + int(above[k])) for k in first])[:TOP]
        top = [(sources[a], names[k].as_py(), -value) for a in range(size) for value, k in best[a]]
    else:
        top = []
    return [(sources[a], sources[b], int(sums[a, b])) for a in range(size) for b in range(size) if a != b], top


def audit(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each language and source that occurs, part `pair` has the other sources
    of the language, by distance over all kept terms, and part `term` the TOP terms that set the source apart from its
    language.

    `docs` has text, lang and source; nulls are read as empty, other columns play no part. A term is kept in a language if
    at least `least` rows of it hold it. Repeated rows count each. A group without terms has its distances; a language without
    kept terms has distances of 0 and no terms; one source alone has no pair. An empty table gives no rows.

    Terms of a language and source are counted map-side and summed, then a term's counts over its sources become a row of
    a CSR matrix. Languages with many counts are dealt by term over several tasks, whose sums of distances are added; a
    language's sources meet each chunk in a cogroup, so nothing is broadcast by hand."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    # Terms that are dropped go before the rest are gathered into rows; neither moves a row again.
    told = counts(docs).withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= least)
    kept = written(told.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("per")), "divergence-terms")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.size("per")).alias("nnz"))
    # A chunk sends a row for each pair of sources, so it has no fewer counts than there are pairs.
    pairs = groups.groupBy("lang").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("pairs"))
    of_lang = of_lang.join(pairs, "lang").withColumn("chunks", (1 + F.floor(F.col("nnz") / F.greatest(F.lit(CHUNK), F.col("pairs")))).cast("long"))
    of_lang = written(of_lang.select("lang", "v", "chunks"), "divergence-chunks")
    of_group = kept.select("lang", F.inline("per")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = totals.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("chunks") - 1, F.lit(0)))).alias("chunk"))
    dealt = kept.join(of_lang.select("lang", "chunks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), "term", "per")

    def compare(key: tuple, terms: pa.Table, totals: pa.Table) -> pa.Table:
        pairs, top = _chunk(terms, totals)
        rows = [(*r, "pair") for r in pairs] + [(*r, "term") for r in top]
        source, item, value, part = zip(*rows) if rows else ((), (), (), ())
        lang = pa.array([key[0].as_py()] * len(rows), pa.string())
        return pa.table([lang, pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

    made = dealt.groupBy("lang", "chunk").cogroup(totals.groupBy("lang", "chunk")).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP))
