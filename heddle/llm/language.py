"""Language identification: a linear-chain conditional random field labels each word; a document is what most of it is."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UNPACKED, parts, tidied

#: Labelled documents that the field is fitted to, per language at most, by hash of the id, and in all (each language
#: has one at least). They are learnt whole, in stretches of so many words. Other documents play no part in fitting.
DOCS_PER_LANG, MOST_LABELLED, STRETCH = 160, 16_384, 240
#: Buckets of hashed features; words per language in the lexicon; rounds of fitting; penalty on squared weights.
BUCKETS, LEXICON, ROUNDS, PENALTY = 1 << 15, 300, 40, 1e-5
#: Distinct words whose scores a worker remembers.
MOST_KNOWN = 250_000
#: Documents put through forward-backward at a time, (word, label) scores that they may take with padding, and words
#: of the documents among which they are chosen by length.
LANES, CELLS, WAITING = 1024, 1 << 19, 1 << 21
#: Characters from which on a text is labelled by itself, its words in lanes of so many that are joined by transfer matrices.
LONG, LANE = 1 << 20, 2048
#: A labelled text of more characters is learnt from windows of it, so many and as long, that are spread evenly over it.
MOST_CHARACTERS, WINDOWS = 1 << 16, 8
#: What a text without letters gets.
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word number, value) of each feature of the words: affixes of one to four letters, and n-grams of
    one to three letters or word ends. A word's values are the inverse root of their number."""
    text = "".join([f"^{w}$" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    start, row = end - size, np.repeat(np.arange(len(words)), size)
    buckets, rows = [], []

    def add(key: np.ndarray, kind: int, of: np.ndarray) -> None:
        key = (key + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append(((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS)
        rows.append(of)

    key, last = np.zeros(len(code), np.uint64), end[row]
    for n in range(1, 6):
        key = key[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(1)
        if n <= 3:
            inside = np.flatnonzero(np.arange(len(key)) + n <= last[: len(key)])
            add(key[inside], n, row[inside])
        if n >= 2:
            long = np.flatnonzero(size >= n)
            add(key[start[long]], 100 + n, long)
            add(key[end[long] - n], 200 + n, long)
    bucket, of = np.concatenate(buckets), np.concatenate(rows)
    return bucket, of, (1 / np.sqrt(np.bincount(of, minlength=len(words))))[of]


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  #: (BUCKETS + 1, labels): a row per bucket, and a bias
    lexicon: dict[str, np.ndarray]  #: a frequent word's score for each label
    starts: np.ndarray  #: (labels,)
    moves: np.ndarray  #: (from, to)

    def scores(self, words: list[str]) -> np.ndarray:
        """(word, label) scores of words in a sequence, before transitions."""
        bucket, of, value = features(words)
        out = np.stack([np.bincount(of, self.weights[bucket, y] * value, len(words)) for y in range(len(self.labels))], axis=1) + self.weights[BUCKETS]
        for k, w in enumerate(words):
            if w in self.lexicon:
                out[k] += self.lexicon[w]
        return out.astype(np.float32)


#: Potentials below a step's largest by more than this count as if by this much; two of them still fit a double.
LEAST_POTENTIAL = -300.0


def _potentials(scores: np.ndarray) -> np.ndarray:
    """Scores relative to the largest of their step, as factors."""
    scores = scores.astype(np.float64)
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), LEAST_POTENTIAL))


def transfers(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log of what each label before a lane (lane, from, to) does to each label at its end, for lanes (time, lane, labels) of one
    length. Each row is rescaled at every step by itself, so that none is lost beside a larger one."""
    emit, move = _potentials(scores), np.exp(np.maximum(moves - moves.max(), LEAST_POTENTIAL))
    n, labels = emit.shape[1:]
    out, scale = np.broadcast_to(np.eye(labels), (n, labels, labels)), np.zeros((n, labels))
    for t in range(len(emit)):
        out = (out @ move) * emit[t][:, None, :]
        size = out.sum(axis=2)
        out = out / size[:, :, None]
        scale += np.log(size)
    with np.errstate(divide="ignore"):
        return np.log(out) + scale[:, :, None]


def lane_ends(logs: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(forward, backward) vectors at the ends of lanes that follow each other, given the forward vector at the end of the
    first and the transfers of the others."""

    def scaled(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max())
        return e / e.sum()

    ahead, behind = [first / first.sum()], [np.full(len(first), 1.0 / len(first))]
    with np.errstate(divide="ignore"):
        for log in logs:
            step = np.log(ahead[-1])[:, None] + log
            top = step.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            ahead.append(scaled(np.log(np.exp(step - safe).sum(axis=0)) + safe))
        for log in reversed(logs):
            step = log + np.log(behind[-1])[None, :]
            top = step.max(axis=1)
            safe = np.where(np.isfinite(top), top, 0.0)
            behind.append(scaled(np.log(np.exp(step - safe[:, None]).sum(axis=1)) + safe))
    return np.array(ahead), np.array(behind[::-1])


def mean_posterior(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, lane: int = LANE) -> np.ndarray:
    """The mean posterior over one long sequence (word, labels), as forward_backward gives it: lanes of it are worked through side
    by side, and what passes between them by transfer matrices. A step is one of `lane` in a group, not one of the text."""
    n, labels = scores.shape
    head, whole = scores[: 1 + (n - 1) % lane], 1 + (n - 1) % lane
    lanes = scores[whole:].reshape(-1, lane, labels)
    group = max(1, CELLS // (lane * labels))
    logs = [t for k in range(0, len(lanes), group) for t in transfers(lanes[k : k + group].swapaxes(0, 1), moves)]
    start = np.exp(np.maximum(starts - starts.max(), LEAST_POTENTIAL)) * _potentials(head[0])
    alone = start / start.sum()
    if len(head) > 1:
        with np.errstate(divide="ignore"):
            ahead, _ = lane_ends([transfers(head[1:, None], moves)[0]], alone)
        first = ahead[-1]
    else:
        first = alone
    ahead, behind = lane_ends(logs, first)
    post, _ = forward_backward(head[:, None], np.array([len(head)]), starts, moves, after=behind[:1])
    total = post.sum(axis=(0, 1))
    for k in range(0, len(lanes), group):
        part = lanes[k : k + group].swapaxes(0, 1)
        post, _ = forward_backward(part, np.full(part.shape[1], lane), starts, moves, before=ahead[k : k + part.shape[1]], after=behind[k + 1 : k + 1 + part.shape[1]])
        total += post.sum(axis=(0, 1))
    return total / n


def forward_backward(scores: np.ndarray, lengths: np.ndarray, starts: np.ndarray, moves: np.ndarray, expect: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Posteriors (time, lane, labels) of sequences, zero beyond their ends, and the expected moves (from, to) if
    asked for. `scores` is (time, lane, labels); `lengths` ascend, so the lanes that go on at a time are the last ones.
    Lanes may go on from the forward vectors `before` them, and end at the backward vectors `after` them. Works in probabilities that are rescaled at every step, in double precision, which holds potentials that differ by
    up to LEAST_POTENTIAL."""
    steps, n, labels = scores.shape
    emit = _potentials(scores)
    move = np.exp(np.maximum(moves - moves.max(), LEAST_POTENTIAL))
    back = np.ascontiguousarray(move.T)
    first = np.searchsorted(lengths, np.arange(steps), side="right")
    ahead, behind = np.zeros_like(emit), np.ones_like(emit)
    ahead[0] = (np.exp(np.maximum(starts - starts.max(), LEAST_POTENTIAL)) if before is None else before @ move) * emit[0]
    if after is not None:
        behind[lengths - 1, np.arange(n)] = after
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        lanes = slice(first[t], None)
        a = ahead[t, lanes]
        np.matmul(ahead[t - 1, lanes], move, out=a)
        a *= emit[t, lanes]
        a /= a.sum(axis=1, keepdims=True)
    for t in range(steps - 1, 0, -1):
        lanes = slice(first[t], None)
        b = behind[t - 1, lanes]
        np.matmul(emit[t, lanes] * behind[t, lanes], back, out=b)
        b /= b.sum(axis=1, keepdims=True)
    post = ahead * behind
    total = post.sum(axis=2, keepdims=True)
    np.divide(post, total, out=post, where=total > 0)
    post *= (np.arange(steps)[:, None] < lengths[None, :])[:, :, None]
    if not expect:
        return post, None
    went = emit[1:] * behind[1:]
    norm = ((ahead[:-1] @ move) * went).sum(axis=2, keepdims=True)
    live = (np.arange(1, steps)[:, None] < lengths[None, :])[:, :, None]
    left = np.divide(ahead[:-1], norm, out=np.zeros_like(went), where=live & (norm > 0))
    return post, (left.reshape(-1, labels).T @ went.reshape(-1, labels)) * move


def fit(rows: list[tuple[str, str]]) -> Model:
    """A field for (text, language) rows. Each word of a text bears its language; texts of different languages
    are chained by halves as well, so that moves between languages are learnt from switches, not only their absence.
    Full-batch ascent of the penalised likelihood with adaptive steps; no rows give a model without labels."""
    rng = np.random.default_rng(5)
    labels = sorted({lang for _, lang in rows})
    cut = []
    for text, lang in sorted(rows):
        w = words_of(text)
        if w:
            cut += [(w[at : at + STRETCH], labels.index(lang)) for at in range(0, len(w), STRETCH)]
    n_labels = len(labels)
    if not cut:
        return Model(labels if n_labels else [], np.zeros((BUCKETS + 1, n_labels)), {}, np.zeros(n_labels), np.zeros((n_labels, n_labels)))
    sequences = [(w, [y] * len(w)) for w, y in cut]
    for _ in range(len(rows)):  # switched text: phrases of a few texts in turn
        words, ys = [], []
        while len(words) < STRETCH // 2:
            w, y = cut[rng.integers(len(cut))]
            at, n = rng.integers(len(w)), rng.integers(3, 24)
            words += w[at : at + n]
            ys += [y] * len(w[at : at + n])
        sequences.append((words, ys))
    sequences.sort(key=lambda s: len(s[0]))
    distinct = sorted({w for ws, _ in sequences for w in ws})
    number = {w: k for k, w in enumerate(distinct)}
    column, row, value = features(distinct)
    frequent: dict[str, int] = {}
    for y in range(n_labels):
        seen = Counter(w for ws, own in cut if own == y for w in ws)
        frequent |= {w: 0 for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    frequent = {w: k for k, w in enumerate(sorted(frequent))}
    lexical = np.array([frequent.get(w, -1) for w in distinct])
    batches = []
    for k in range(0, len(sequences), LANES):
        part = sequences[k : k + LANES]
        lengths = np.array([len(w) for w, _ in part])
        words, gold = np.zeros((lengths.max(), len(part)), np.int64), np.full((lengths.max(), len(part)), -1)
        for i, (w, y) in enumerate(part):
            words[: len(w), i] = [number[x] for x in w]
            gold[: len(w), i] = y
        batches.append((words, gold, lengths))
    total = sum(int(b[2].sum()) for b in batches)
    params = {"w": np.zeros((BUCKETS + 1, n_labels)), "x": np.zeros((max(1, len(frequent)), n_labels)), "s": np.zeros(n_labels), "m": np.zeros((n_labels, n_labels))}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        score = np.stack([np.bincount(row, params["w"][column, y] * value, len(distinct)) for y in range(n_labels)], axis=1) + params["w"][BUCKETS]
        score[lexical >= 0] += params["x"][lexical[lexical >= 0]]
        by_word = np.zeros_like(score)
        grad = {k: -2 * PENALTY * total * v for k, v in params.items()}
        for words, gold, lengths in batches:
            post, moved = forward_backward(score[words], lengths, params["s"], params["m"], expect=True)
            inside = gold >= 0
            hit = -post[inside]
            hit[np.arange(len(hit)), gold[inside]] += 1
            for y in range(n_labels):
                by_word[:, y] += np.bincount(words[inside], hit[:, y], len(distinct))
            grad["s"] += np.bincount(gold[0], minlength=n_labels) - post[0].sum(axis=0)
            pairs = inside[1:]
            grad["m"] += np.bincount(gold[:-1][pairs] * n_labels + gold[1:][pairs], minlength=n_labels**2).reshape(n_labels, n_labels) - moved
        for y in range(n_labels):
            grad["w"][:BUCKETS, y] += np.bincount(column, by_word[row, y] * value, BUCKETS)
        grad["w"][BUCKETS] += by_word.sum(axis=0)
        np.add.at(grad["x"], lexical[lexical >= 0], by_word[lexical >= 0])
        for k, g in grad.items():
            g = g / total
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] += 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(labels, params["w"].astype(np.float32), {w: params["x"][k].astype(np.float32) for w, k in frequent.items()}, params["s"], params["m"])


class Labeller:
    """Predicts documents with a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.labels)), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' rows in self.scores."""
        number = self.number
        new = [w for w in set(words) if w not in number]
        if new:
            at = len(number)
            if at + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(len(self.scores), len(new)), self.scores.shape[1]), np.float32)])
            self.scores[at : at + len(new)] = self.model.scores(new)
            number.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(number.__getitem__, words), np.int32, len(words))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The label of the largest mean posterior over a text's words, and that mean."""
        pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []
        cells = 0

        def settle() -> None:
            for i, post in self.posteriors([x for _, x in waiting]):
                mean = post.mean(axis=0)
                best = int(np.argmax(mean))
                k = waiting[i][0]
                pred[k], score[k] = self.model.labels[best], float(min(1.0, max(0.0, mean[best])))
            waiting.clear()

        for k, text in enumerate(texts):
            if len(text) > LONG and self.model.labels:
                mean = self.mean_of(text)
                if mean is not None:
                    pred[k], score[k] = self.model.labels[int(np.argmax(mean))], float(min(1.0, max(0.0, mean.max())))
                continue
            words = words_of(text)
            if words and self.model.labels:
                waiting.append((k, self.numbers(words)))
                cells += len(words)
                if cells > WAITING or len(self.number) > MOST_KNOWN:
                    settle()
                    cells = 0
                    if len(self.number) > MOST_KNOWN:
                        self.number.clear()
        settle()
        return pred, score

    def mean_of(self, text: str) -> np.ndarray | None:
        """The mean posterior over the words of a text of any length, which are never all held as strings; None without words."""
        known, part = Labeller(self.model), []
        scores: list[np.ndarray] = []

        def take() -> None:
            if len(known.number) > MOST_KNOWN:
                known.number.clear()
            scores.append(known.scores[known.numbers(part)])
            part.clear()

        for found in _WORD.finditer(text.lower()):
            part.append(found[0])
            if len(part) == MOST_KNOWN:
                take()
        if part:
            take()
        return mean_posterior(np.concatenate(scores), self.model.starts, self.model.moves) if scores else None

    def posteriors(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(position, posteriors) of each sequence of word numbers, the shortest first."""
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and upto - at < LANES and (upto - at + 1) * len(sequences[order[upto]]) * len(self.model.labels) <= CELLS:
                upto += 1
            part = [sequences[k] for k in order[at:upto]]
            lengths = np.array([len(x) for x in part])
            words = np.zeros((lengths[-1], len(part)), np.int32)
            for i, x in enumerate(part):
                words[: len(x), i] = x
            post, _ = forward_backward(self.scores[words], lengths, self.model.starts, self.model.moves)
            for i, k in enumerate(order[at:upto]):
                yield k, post[: lengths[i], i]
            at = upto


def train(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, most_labelled: int = MOST_LABELLED) -> Model:
    """A field for `labelled` (doc_id, text, lang), from a bounded sample: of each language the texts whose id hashes lowest.

    Rows without text or language are left out; every language that is left is learnt, from `docs_per_lang` documents
    or an equal share of `most_labelled`. Documents of one hash come in order of their text. The sample alone reaches the
    driver, however many rows there are, and of a text at most MOST_CHARACTERS: a longer one is learnt from WINDOWS windows
    of equal length, the first at its begin and the last at its end."""
    size = MOST_CHARACTERS // WINDOWS
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.col("text").substr((k * (F.length("text") - size) / (WINDOWS - 1)).cast("int") + 1, F.lit(size))), " ")
    text = F.when(F.length("text") > MOST_CHARACTERS, spread).otherwise(F.col("text")).alias("text")
    rows = labelled.where("text is not null and lang is not null").select(text, "lang", F.xxhash64("doc_id").alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    docs_per_lang = max(1, min(docs_per_lang, most_labelled // max(1, len(counts))))
    # Hashes are even, so a share of their range holds the wanted texts and a few times as many in all.
    near = F.lit(False)
    for r in counts:
        near = near | ((F.col("lang") == r["lang"]) & (F.col("h") <= int(-(2**63) + min(1.0, 4 * docs_per_lang / r["n"]) * (2**64 - 1025))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    found = rows.where(near).withColumn("place", place).where(F.col("place") <= docs_per_lang).collect() if counts else []
    return fit([(x["text"], x["lang"]) for x in sorted(found, key=lambda x: (x["lang"], x["place"]))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (text, and what else it has) with lang_pred and score, from the text alone.

    Null texts and texts without letters are `und` with score 0; so is every text if the model has no labels. A
    text of any length is labelled whole. Repeated rows are predicted alike; an empty table gives no rows. Columns
    lang_pred and score of `docs` are replaced. No shuffle; the model, whose size is fixed, goes to every worker."""
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*sent.value))
        for b in parts(batches, 4 * UNPACKED):
            pred, score = labeller.predict([t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(tidied(label), schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
