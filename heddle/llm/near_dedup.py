"""Near-duplicate documents: SetSketch registers in bands propose pairs, likelihood thins them, full sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, digest_of, parts, tidied, without, written
from .graph import components

#: Registers of a sketch, the base that spaces their values, the rate of their minima, and their largest value.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65535
#: Largest chance that a pair right at the threshold shares no band.
MISS = 1e-5
#: Standard deviations below the threshold at which an estimate still leads to a comparison of full sets.
MARGIN = 5.0
#: Rounds of stars at most; there is another one where the last has settled at least half of what was open.
ROUNDS = 4
#: When what is left of a bucket is compared block by block: nodes of a block of sketches, and shingles of a block of sets.
SKETCH_BLOCK, SET_BLOCK = 8192, 1 << 20
#: Pairs of full sets that a Python worker gets at a time.
WIDE = 512
#: Ids up to which a list of wanted documents is sent to every task; beyond, it is joined by shuffle.
MOST_SENT = 1_000_000
#: Distinct words whose hashes a worker remembers.
MOST_KNOWN = 250_000

_rng = np.random.default_rng(20_240_607)
_MULTIPLIERS = (_rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADDENDS = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MOST_KNOWN:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        key = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            key = (key ^ (key >> np.uint64(31))) * _MIX + h[k : k + len(key)]
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return np.unique(key ^ (key >> np.uint64(29)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: per register, the exponential minimum over the set of the elements' hashes,
    truncated to floor(1 - log_BASE(minimum)). The elementwise maximum of two sketches is that of the union."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 1 << 14):
        low = np.minimum(low, (x[None, k : k + (1 << 14)] * _MULTIPLIERS + _ADDENDS).min(axis=1))
    minimum = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, TOP).astype(np.uint16)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, registers of each): the longest bands of which a pair at the threshold shares one but for MISS."""
    for rows in range(16, 0, -1):
        if (1 - threshold**rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def band_keys(registers: np.ndarray, threshold: float) -> np.ndarray:
    """(documents, bands) keys of (documents, REGISTERS) sketches."""
    bands, rows = banding(threshold)
    part = registers[:, : bands * rows].astype(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), part.shape[:2])
    for k in range(rows):
        key = (key ^ (key >> np.uint64(31))) * _MIX + part[:, :, k]
    return ((key ^ (key >> np.uint64(30))) * _MIX).view(np.int64)


def likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets that makes the numbers of larger, smaller and equal registers likeliest,
    their sizes being known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def worth(j: np.ndarray) -> np.ndarray:
        up, down = chance(u - v * j), chance(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = worth(low + third) < worth(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def least_estimate(threshold: float) -> float:
    return threshold - MARGIN * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def signed(docs: DataFrame, size: int, digest: bool = False) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) of each row; node names the set, null for none. With `digest`, text_sha256 too."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in parts(batches):
            sets = [shingle(t) for t in b.column(1).to_pylist()]
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sketches = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sketches, pa.binary()), *b.columns[2:]], ["doc_id", "n_shingles", "node", "sketch", *b.schema.names[2:]])

    more = [digest_of(F.col("text")).alias("text_sha256")] if digest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(tidied(sign), "doc_id long, n_shingles long, node binary, sketch binary" + ", text_sha256 string" * digest)


def banded(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, node): a row per band of each class."""
    bands, _ = banding(threshold)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                p = b.slice(k, 2048)
                keys = band_keys(_registers(p.column(1)), threshold)
                nodes = p.column(0).take(pa.array(np.repeat(np.arange(p.num_rows), bands)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), nodes], ["key", "node"])

    return classes.select("node", "sketch").mapInArrow(tidied(cut), "key long, node binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with `estimate`, where it nears the threshold."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    least = least_estimate(threshold)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                p = b.slice(k, 4096)
                j = likelihood(_registers(p.column(4)), _registers(p.column(5)), np.asarray(p.column(2), float), np.asarray(p.column(3), float))
                keep = pa.array(j >= least)
                yield pa.RecordBatch.from_arrays([p.column(0).filter(keep), p.column(1).filter(keep), pa.array(j).filter(keep)], ["a", "b", "estimate"])

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(tidied(weigh), "a binary, b binary, estimate double")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the classes `wanted` (node, rep: the id of one of the documents): their texts are read again."""
    wanted = written(wanted, "near-wanted")
    ids = wanted.select(F.col("rep").alias("__id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= MOST_SENT else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text")
    texts = texts.join(ids, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                sets = [s.tobytes() for s in map(shingle, b.column(0).slice(k, 512).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    # Ids may repeat, so other texts than the wanted ones can come along, or the same one more than once.
    return written(texts.mapInArrow(tidied(take), "node binary, shingles binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    percent = round(threshold * 100)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_s, b_s = (b.column(k) for k in (2, 3))
            keep = []
            for k in range(b.num_rows):
                x, y = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (a_s, b_s))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(tidied(compare), "a binary, b binary")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of `labels` after `links` (a, b) between nodes."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    raised = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    more = components(raised).select(F.col("node").alias("c"), F.col("component").alias("d"))
    moved = labels.join(more, labels["component"] == more["c"], "left").select("node", F.coalesce("d", "component").alias("component"))
    new = more.select(F.col("c").alias("node"), F.col("d").alias("component")).join(labels.select("node"), "node", "left_anti")
    return written(moved.unionByName(new), "near-labels")


def _paired(members: DataFrame, weight: Column, block: int) -> DataFrame:
    """`members` (unit, node, and what else they have) with i, j and block: a unit is cut into blocks of a weight of about
    `block`, and each pair of blocks, a block with itself too, is a piece of work (unit, i, j) that both are sent to. So a
    unit is sent as often as it has blocks, which is once for all but the largest."""
    sizes = members.groupBy("unit").agg(F.greatest(F.ceil(F.sum(weight) / block), F.lit(1)).cast("int").alias("of"))
    x = members.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("node"), "of").cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return x.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("of", "other")


def _across(group: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row k of block i, the rows of block j in other components whose sketches make a link likely: (k, rows,
    estimates)."""
    least = least_estimate(threshold)
    s, n, block = _registers(group["sketch"]), np.asarray(group["n_shingles"], float), np.asarray(group["block"])
    _, component = np.unique(np.array(group["component"].to_pylist(), object), return_inverse=True)
    first, second = np.flatnonzero(block == group["i"][0].as_py()), np.flatnonzero(block == group["j"][0].as_py())
    second = second[np.argsort(n[second], kind="stable")]
    sizes = n[second]
    for k in first:
        low, high = np.searchsorted(sizes, threshold * n[k] - 1), np.searchsorted(sizes, n[k] / threshold + 1)
        near = second[low:high]
        near = near[(component[near] != component[k]) & (np.minimum(n[near], n[k]) >= threshold * np.maximum(n[near], n[k]))]
        # Registers that are equal bound the estimate, and the first few tell most pairs.
        near = near[(s[near, :32] == s[k, :32]).sum(axis=1) >= 32 * least - 16] if len(near) else near
        near = near[(s[near] == s[k]).mean(axis=1) >= least - 0.02] if len(near) else near
        for part in range(0, len(near), 8192):
            chosen = near[part : part + 8192]
            at = np.full(len(chosen), k)
            estimate = likelihood(s[at], s[chosen], n[at], n[chosen])
            likely = estimate >= least
            if likely.any():
                yield int(k), chosen[likely], estimate[likely]


def _open(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(unit, node, component) of those of `members` that a sketch of another component in their unit is likely linked with."""

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        hit = np.zeros(group.num_rows, bool)
        for k, near, _ in _across(group, threshold):
            hit[k] = hit[near] = True
        return group.select(["unit", "node", "component"]).filter(pa.array(hit))

    x = _paired(members, F.lit(1), SKETCH_BLOCK).join(classes.select("node", "n_shingles", "sketch"), "node")
    return x.groupBy("unit", "i", "j").applyInArrow(meet, "unit binary, node binary, component binary").distinct()


def _blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): confirmed links between components, of `members` (unit, node, component). Likely pairs of two blocks,
    the likeliest first, are confirmed on full sets unless links found before join them already. Every likely pair of
    a unit is looked at in this way, but only links that join components leave, fewer than the nodes of the blocks."""
    percent = round(threshold * 100)
    x = members.join(classes.select("node", "n_shingles", "sketch"), "node")
    x = _paired(x, F.col("n_shingles"), SET_BLOCK).join(sets, "node")

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = list(_across(group, threshold))
        a = np.concatenate([np.full(len(near), k) for k, near, _ in found] or [np.zeros(0, np.int64)])
        b = np.concatenate([near for _, near, _ in found] or [np.zeros(0, np.int64)])
        j = np.concatenate([e for _, _, e in found] or [np.zeros(0)])
        _, component = np.unique(np.array(group["component"].to_pylist(), object), return_inverse=True)
        above = list(range(component.max() + 1))

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = above[above[c]]
                c = above[c]
            return c

        shingles, links = group["shingles"], []
        for k in np.argsort(-j, kind="stable"):
            x, y = top(component[a[k]]), top(component[b[k]])
            if x != y:
                p, q = (np.frombuffer(shingles[int(i)].as_buffer(), np.uint64) for i in (a[k], b[k]))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    above[x] = y
                    links.append((a[k], b[k]))
        nodes = group["node"]
        side = lambda e: nodes.take(pa.array([int(x[e]) for x in links], pa.int64())).cast(pa.binary())
        return pa.table({"a": side(0), "b": side(1)})

    return x.groupBy("unit", "i", "j").applyInArrow(meet, "a binary, b binary")


def linked(classes: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, component) of the classes (node, rep, n_shingles, sketch) that are linked with another.

    Buckets of two or more classes are stars first: the member that meets most others in all its buckets, which is
    the copy nearest to the rest, is compared with each other one, and leaves. Buckets that still hold several components
    are stars again, around a member outside the last one's component, while that settles much. What is open then joins the
    unit of its last centre, where members are compared block by block: on sketches first, and those that a likely link to another
    component is left of on full sets. So no pair of a bucket is left out, and no bucket's pairs are all made."""
    rows = banded(classes, threshold)
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(rows.join(repeated, "key"), "near-buckets")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    wanted = classes.select("node", "rep").join(degree.select("node"), "node", "left_semi")
    sets = _sets(docs, wanted, size)
    # A bucket's centre so far is its unit, of component `centre`; there is none before the first round.
    left = members.select("key", "node").join(degree, "node").withColumns({"component": F.col("node"), "centre": F.lit(None).cast("binary")})
    labels, before = None, None
    for _ in range(ROUNDS):
        left = written(left, "near-open")
        rows = left.count()
        if not rows or (before and 2 * rows > before):
            break
        before = rows
        outside = F.coalesce(F.col("component") != F.col("centre"), F.lit(True))
        pivots = left.groupBy("key").agg(F.max(F.struct(outside.alias("o"), "degree", "node", "component")).alias("p"))
        pivots = written(pivots.select("key", F.col("p.node").alias("unit"), F.col("p.component").alias("centre")), "near-pivots")
        stars = left.drop("centre", "unit").join(pivots, "key").where(F.col("component") != F.col("centre"))
        stars = stars.select(F.col("node").alias("a"), F.col("unit").alias("b")).distinct()
        likely = written(_likely(stars, classes, threshold), "near-likely")
        with batches_of(docs.sparkSession, WIDE):
            links = written(_confirmed(likely, sets, threshold), "near-links")
        labels = written(components(links), "near-labels") if labels is None else _merged(labels, links)
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))  # noqa: B023, E731
        pivots = pivots.join(of("unit"), "unit", "left").select("key", "unit", F.coalesce("c_unit", "unit").alias("centre"))
        # A centre has met all members outside its component, so it takes its leave.
        own = left.select("key", "node", "degree").join(pivots, "key").where("node <> unit").join(of("node"), "node", "left")
        own = written(own.withColumn("component", F.coalesce("c_node", "node")).drop("c_node"), "near-own")
        still = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        left = own.join(still, "key", "left_semi")
    if labels is None:  # no two classes share a bucket
        return members.select("node", F.col("node").alias("component"))
    left = written(left.select("unit", "node", "component").distinct(), "near-open")
    if left.isEmpty():
        return labels
    # Units whose sets make one block are sent once anyway; of larger ones, sketches tell whose sets are needed.
    weight = classes.select("node", "n_shingles")
    large = left.join(weight, "node").groupBy("unit").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > SET_BLOCK).select("unit")
    large = written(large, "near-large")
    if not large.isEmpty():
        likely = written(_open(left.join(large, "unit", "left_semi"), classes, threshold), "near-likely")
        left = left.join(large, "unit", "left_anti").unionByName(likely)
    links = written(_blocks(left, classes, sets, threshold), "near-links")
    return labels if links.isEmpty() else _merged(labels, links)


def group_near(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct runs of `size` words of its text, A-Z lower-cased and cut at ASCII white space;
    fewer words make one run, and null or blank texts have an empty set, linked with nothing. Documents are
    linked where intersection / union of their sets reaches `threshold` (a whole number of hundredths); every link that
    is used has been confirmed on full sets, and a pair right at the threshold fails to be proposed with a chance of MISS.
    component_id is the least doc_id that a document reaches, itself included. Equal sets are one class from the
    start, so exact copies cost one comparison. Rows with the same doc_id and different texts are classes of their
    own; rows that are wholly equal share everything. A null doc_id has a null component_id unless it is linked to an
    id, and kept is true where component_id is the row's own. An empty table gives no rows."""
    return _judged(docs.select("doc_id", "text"), size, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, size: int, threshold: float, digest: bool = False) -> DataFrame:
    """The rows of group_near; with `digest`, also text_sha256 and group, which names the row's component even where
    components share an id or have none (null for an empty set)."""
    sigs = written(signed(docs, size, digest), "near-signed")
    classes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = written(classes, "near-classes")
    labels = linked(classes, docs, size, threshold)
    least = classes.select("node", "rep").join(labels, "node")
    smallest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = classes.select("node", "rep").join(labels, "node", "left").join(smallest, "component", "left")
    ids = ids.select("node", F.coalesce("component_id", "rep").alias("component_id"), *[F.coalesce("component", "node").alias("group")] * digest)
    more = ["text_sha256"] * digest
    rows = sigs.select("doc_id", "n_shingles", "node", *more)
    # Rows of an empty set have no class to meet, so they stay out of the join.
    alone = rows.where("node is null").withColumn("component_id", F.lit(None).cast("long"))
    alone = alone.withColumn("group", F.lit(None).cast("binary")) if digest else alone
    out = rows.where("node is not null").join(ids, "node").unionByName(alone)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *more, *["group"] * digest)


def drop_near(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near copies, the one with the least doc_id; all columns stay.
    Of rows that share that doc_id (or have none) the one with the least digest stays, and one row of it. Rows of an
    empty set are linked with nothing, so all stay. Each row goes or stays by its own verdict, which is joined back by
    doc_id and digest."""
    judged = written(_judged(docs.select("doc_id", "text"), size, threshold, digest=True).where("group is not null"), "near-judged")
    gone = judged.where(~F.col("kept")).select("doc_id", "text_sha256", F.lit(False).alias("once")).distinct()
    stay = judged.where("kept").groupBy("group").agg(F.min("text_sha256").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = judged.where("kept").join(stay, "group").groupBy("doc_id", "text_sha256").agg(F.first(F.col("text_sha256") == F.col("least")).alias("once"), F.count(F.lit(1)).alias("n"))
    return without(docs, F.col("text"), gone.unionByName(again.where("not once or n > 1").drop("n")))
