"""Benchmark decontamination: suffix arrays over shards of the documents, searched for every suffix of the benchmark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .buffers import Words, equal, table, together, words
from .common import tidied, written

#: Bytes of words: digits, letters, and all of characters beyond ASCII.
WORDS = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words of a window; bytes of documents that make a shard; words of the benchmark that go to the tasks at a time.
WINDOW, SHARD, BLOCK = 10, 1 << 22, 1 << 20
#: Bits of a packed key.
BITS = 62


class Hashing(NamedTuple):
    """64-bit hashes of words: a random number for each byte, times a power of an odd number for its place."""

    of_byte: np.ndarray
    odd: int

    @classmethod
    def seeded(cls, seed: int) -> Hashing:
        draw = np.random.default_rng(seed)
        return cls(draw.integers(1, 1 << 63, 256, dtype=np.uint64), int(draw.integers(1 << 40, 1 << 62)) | 1)

    def __call__(self, w: Words) -> np.ndarray:
        """The hash of each word: differences of a running sum over all bytes, brought back to the word's start."""
        n = len(w.low)
        powers = np.full(n + 1, self.odd, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[w.low] * powers[:-1], out=sums[1:])
        powers[1:] = pow(self.odd, -1, 1 << 64)
        np.multiply.accumulate(powers, out=powers)
        return (sums[w.ends] - sums[w.starts]) * powers[w.starts]


def packed(symbols: np.ndarray, bits: int) -> np.ndarray:
    """At each place, the symbols from there on up to the first 0, as many as fit in BITS, packed so that keys order as the
    sequences do."""
    per = BITS // bits
    key = np.concatenate([symbols, [0]]).astype(np.int64)
    last = key.copy()
    for k in range(1, per):
        longer = (last << (bits * k)) | np.concatenate([key[1:], [0]])
        key = np.where(last > 0, longer, 0)
    return key[:-1]


def runs(symbols: np.ndarray) -> np.ndarray:
    """At each place, how many symbols come before the next 0."""
    n = len(symbols)
    zero = np.where(symbols == 0, np.arange(n), n)
    return np.minimum.accumulate(zero[::-1])[::-1] - np.arange(n)


class Block(NamedTuple):
    """A part of the benchmark: its words by hash, and its texts as symbols (the number of a word, from 1 on), each text
    followed by 0. Item k has the symbols first[k] to first[k + 1], the 0 included."""

    hashing: Hashing
    hashes: np.ndarray
    low: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    bits: int
    symbols: np.ndarray
    first: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str]]) -> Block:
        w = words(pa.array([t for _, t in items], pa.string()), WORDS)
        terms: dict[bytes, int] = {}
        number = np.fromiter((terms.setdefault(w.low[a:b].tobytes(), len(terms)) for a, b in zip(w.starts.tolist(), w.ends.tolist())), np.int64, len(w.starts))
        one = np.full(len(terms), -1, np.int64)
        one[number[::-1]] = np.arange(len(number))[::-1]
        for seed in range(64):
            hashing = Hashing.seeded(seed)
            hashes = hashing(w)[one]
            if len(np.unique(hashes)) == len(hashes):
                break
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        symbols = np.zeros(len(number) + len(items), np.int64)
        symbols[np.arange(len(number)) + w.text_of()] = rank[number]
        first = w.first + np.arange(len(w.first))
        at = w.starts[one][order]
        return cls(hashing, hashes[order], w.low, at, (w.ends - w.starts)[one][order], max(1, len(terms).bit_length()), symbols, first, [i for i, _ in items])

    def symbols_of(self, w: Words) -> np.ndarray:
        """The symbol of each word, 0 for a word that the block doesn't have. Words of one hash are compared by their bytes."""
        if not len(self.hashes) or not len(w.starts):
            return np.zeros(len(w.starts), np.int64)
        hashes = self.hashing(w)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        sizes = w.ends - w.starts
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
        hit = hit[equal(w.low, w.starts[hit], self.low, self.starts[at[hit]], sizes[hit])]
        out = np.zeros(len(hashes), np.int64)
        out[hit] = at[hit] + 1
        return out


class SuffixArray:
    """The suffixes of a sequence of symbols, each up to its next 0, in order; those that begin with 0 are left out. Suffixes
    are told apart up to `depth` symbols at least: first by packed keys, then by doubling the length that ranks stand for."""

    def __init__(self, symbols: np.ndarray, bits: int, depth: int):
        self.bits, self.per = bits, BITS // bits
        self.key = packed(symbols, bits)
        at = np.flatnonzero(symbols)
        key = self.key[at]
        order = np.argsort(key)
        self.at, key = at[order], key[order]
        self.first_keys = key
        run = runs(symbols)
        begins = np.diff(key, prepend=-1) != 0
        head = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
        rank = np.zeros(len(symbols) + 1, np.int64)
        rank[self.at] = head + 1
        known = self.per
        while known < depth:
            ends = np.append(begins[1:], True) if len(begins) else begins
            open_ = np.flatnonzero(~(begins & ends) & (run[self.at] >= known))
            if not len(open_):
                break
            at = self.at[open_]
            pair = rank[at] * (len(symbols) + 2) + rank[np.minimum(at + known, len(symbols))]
            order = np.argsort(pair)
            at, pair = at[order], pair[order]
            self.at[open_] = at
            new = np.diff(pair, prepend=-1) != 0
            begins[open_] |= new
            rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
            known *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, level: int, key: np.ndarray, above: bool) -> np.ndarray:
        """In each range of suffixes that agree before `level`, the first whose key there is at least `key`, or is above it."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            found = self.key[self.at[middle] + level * self.per]
            less = found <= key[open_] if above else found < key[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def _level(self, low, high, level: int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range whose keys at `level` are from `least` to `most`."""
        if level == 0:
            return np.searchsorted(self.first_keys, least), np.searchsorted(self.first_keys, most, "right")
        return self._bound(low, high, level, least, False), self._bound(low, high, level, most, True)

    def longest(self, key: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, place): the longest match of the suffixes that begin at `starts`, whose packed keys are key[starts], and a
        place where it begins, which has no meaning for a length of 0."""
        length, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        q = np.arange(len(starts)) if len(self.at) else np.zeros(0, np.int64)
        low, high, level = np.zeros(len(q), np.int64), np.full(len(q), len(self.at)), 0
        digit = (1 << self.bits) - 1
        while len(q):
            wanted = key[starts[q] + level * self.per]
            left, right = self._level(low, high, level, wanted, wanted)
            on = (right > left) & ((wanted & digit) > 0)
            for side in (left - 1, left):
                near = np.flatnonzero(~on & (side >= low) & (side < high))
                at = self.at[side[near]]
                there = self.key[at + level * self.per]
                common, same = np.zeros(len(near), np.int64), np.ones(len(near), np.bool_)
                for k in range(self.per - 1, -1, -1):
                    a = wanted[near] >> (k * self.bits)
                    same &= (a == there >> (k * self.bits)) & ((a & digit) > 0)
                    common += same
                better = level * self.per + common > length[q[near]]
                length[q[near[better]]] = level * self.per + common[better]
                place[q[near[better]]] = at[better]
            # Those that go on agree so far; what comes next may end them.
            length[q[on]] = (level + 1) * self.per
            place[q[on]] = self.at[left[on]]
            q, low, high, level = q[on], left[on], right[on], level + 1
        return length, place

    def ranges(self, key: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high): the suffixes that agree in the first `sizes` symbols with those at `starts`, of at least that length."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.at))
        for level in range(-(-int(sizes.max(initial=0)) // self.per)):
            q = np.flatnonzero(sizes > level * self.per)
            spare = self.bits * np.maximum(0, (level + 1) * self.per - sizes[q])
            least = key[starts[q] + level * self.per] >> spare << spare
            low[q], high[q] = self._level(low[q], high[q], level, least, least | ((1 << spare) - 1))
        return low, high


class Shard:
    """Documents of a task that are indexed together, seen by a block of the benchmark."""

    def __init__(self, w: Words, block: Block):
        n = len(w.first) - 1
        self.first = w.first + np.arange(n + 1)
        symbols = np.zeros(len(w.starts) + n + 1, np.int64)
        symbols[np.arange(len(w.starts)) + w.text_of()] = block.symbols_of(w)
        self.n_words, self.size = np.diff(w.first), len(symbols)
        self.suffixes = SuffixArray(symbols, block.bits, int(np.diff(block.first).max(initial=1)) - 1)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) of all numbers of the ranges [low, high)."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]


def windows(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, size): each suffix of an item that has a window at its start. An item of fewer words is one window."""
    sizes = np.diff(block.first) - 1
    whole = (sizes > 0) & (sizes < window)
    n = np.where(whole, 1, np.maximum(0, sizes - window + 1))
    item, place = _spread(np.zeros(len(n), np.int64), n)
    return item, block.first[item] + place, np.where(whole[item], sizes[item], window)


def found(shard: Shard, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit, text, item): whether each symbol of the shard lies in an occurrence of a window, and the pairs of a text and an
    item that has a window there. Suffixes whose longest match is shorter than their window have none."""
    item, start, size = windows(block, window)
    key = packed(block.symbols, block.bits)
    length, _ = shard.suffixes.longest(key, start)
    has = length >= size
    item, start, size = item[has], start[has], size[has]
    low, high = shard.suffixes.ranges(key, start, size)
    # Windows of equal words have one range; its places are gone through once.
    code, same = np.unique(low * (int(size.max(initial=0)) + 1) + size, return_inverse=True)
    one = np.zeros(len(code), np.int64)
    one[same] = np.arange(len(same))
    of, number = _spread(low[one], high[one])
    place = shard.suffixes.at[number]
    step = np.bincount(place, minlength=shard.size + 1) - np.bincount(place + size[one][of], minlength=shard.size + 1)
    hit = np.cumsum(step)[: shard.size] > 0
    pair = np.unique(shard.text_of(place) * max(1, len(code)) + of)
    text, of = pair // max(1, len(code)), pair % max(1, len(code))
    order = np.argsort(same, kind="stable")
    ends = np.searchsorted(same[order], np.arange(len(code) + 1))
    at, number = _spread(ends[of], ends[of + 1])
    pair = np.unique(text[at] * max(1, len(block.items)) + item[order][number])
    return hit, pair // max(1, len(block.items)), pair % max(1, len(block.items))


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[Block]:
    """The benchmark's items (item_id, text) in blocks of about `most` words; a null text has none, and a null item_id is empty."""
    part, n = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        part.append((r["i"], r["t"]))
        n += 1 + len(r["t"]) // 6
        if n >= most:
            yield Block.of(part)
            part, n = [], 0
    yield Block.of(part)


_ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, texts: bool = True, most: int = BLOCK) -> DataFrame:
    """`docs` (text, and what else it has; without the texts unless `texts`) with n_words, n_hit (words that lie in an
    occurrence of a window of an item), items (the item_id of each item that has such a window, as strings in order) and
    spans (begin and end of the stretches of hit words, in words).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty
    texts have no words. Repeated rows are marked alike; items of one item_id count as one, a null item_id as an empty one.
    No documents give no rows; no items hit nothing. Columns of `docs` with the new names are replaced.

    The texts of a task are cut into shards, whose words that the benchmark has are indexed by a suffix array; every suffix
    of the benchmark is searched there by bisection, all at a time. No shuffle. The benchmark goes out in blocks of `most`
    words; where there are several, what the blocks before have found is written between them."""
    names = [f.name for f in StructType.fromDDL(_ADDED).fields]
    docs = docs.drop(*names)
    parts, spark = blocks(items, most), docs.sparkSession
    block, marked = next(parts), docs
    while block is not None:
        then = next(parts, None)
        carried = texts or then is not None
        schema = StructType([*(f for f in docs.schema.fields if carried or f.name != "text"), *StructType.fromDDL(_ADDED).fields])
        marked = marked.mapInArrow(tidied(_marking(spark.sparkContext.broadcast(block), window, [f.name for f in docs.schema.fields if carried or f.name != "text"])), schema)
        marked = written(marked, "decontamination-marked") if then is not None else marked
        block = then
    return marked


def _marking(sent, window: int, columns: list[str]):
    """A task's function that adds what a block finds to what is known of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for b in together(batches, "text", SHARD):
            w = words(b.column(b.schema.get_field_index("text")), WORDS)
            shard = Shard(w, block)
            hit, text, item = found(shard, block, window)
            of: list[list[str]] = [[] for _ in range(b.num_rows)]
            for t, i in zip(text.tolist(), item.tolist()):
                of[t].append(block.items[i])
            if "spans" in b.schema.names:
                for row, (known, spans) in enumerate(zip(b.column(b.schema.get_field_index("items")).to_pylist(), b.column(b.schema.get_field_index("spans")).to_pylist())):
                    of[row] += known
                    for s in spans:
                        hit[shard.first[row] + s["begin"] : shard.first[row] + s["end"]] = True
            upto = np.concatenate([[0], np.cumsum(hit)])
            n_hit = upto[shard.first[1:]] - upto[shard.first[:-1]]
            edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            begin, end = edge[::2], edge[1::2]  # no stretch goes over the 0 between two texts
            row = shard.text_of(begin)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - shard.first[row]), pa.array(end - shard.first[row])], ["begin", "end"]))
            own = [pa.array(shard.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(set(x)) for x in of], pa.list_(pa.string())), spans]
            kept = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *own], [*columns, "n_words", "n_hit", "items", "spans"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows of which a window of an item is part; all columns stay. What is null, empty or repeated counts
    as in `mark`."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "items", "spans")}
    marked = mark(docs.withColumnsRenamed(own), items, window)
    return marked.where("n_hit = 0").select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def longest_matches(docs: DataFrame, items: DataFrame, least: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """(item_id, start, length, doc_id, at): for every suffix of an item, from word `start` on, the longest match in any
    document if it has `least` words, and where it is: the document with the smallest doc_id of those where a shard's search
    ended, and the word there. Texts of `docs` are whole; nulls count as in `mark`, a null doc_id comes last. A shard sends
    its best for each suffix, and those meet by suffix after a task's have been put together."""
    spark, kept = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id string, start long, length long, doc_id long, at long"

    def searching(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            key = packed(block.symbols, block.bits)
            starts = np.flatnonzero(block.symbols)
            item = np.searchsorted(block.first, starts, "right") - 1
            for b in together(batches, "text", SHARD):
                shard = Shard(words(b.column(1), WORDS), block)
                length, place = shard.suffixes.longest(key, starts)
                has = np.flatnonzero(length >= least)
                text = shard.text_of(place[has])
                own = [pa.array([block.items[i] for i in item[has].tolist()], pa.string()), pa.array(starts[has] - block.first[item[has]]), pa.array(length[has])]
                yield pa.RecordBatch.from_arrays([*own, b.column(0).take(pa.array(text)), pa.array(place[has] - shard.first[text])], ["item_id", "start", "length", "doc_id", "at"])

        return run

    made = None
    for block in blocks(items, most):
        part = kept.mapInArrow(tidied(searching(spark.sparkContext.broadcast(block))), schema)
        made = part if made is None else made.unionByName(part)
    first = F.struct((-F.col("length")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at"))
    best = made.groupBy("item_id", "start").agg(F.min(first).alias("b"))
    return best.select("item_id", "start", (-F.col("b.n")).alias("length"), "b.doc_id", "b.at")
