"""Tokenizers on whole texts: ids, and counts by way of distinct pre-tokens."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts, tidied, written

#: Distinct pre-tokens that a worker puts together before it sends them on. Results don't depend on it.
MOST_MET = 300_000
#: Bytes of a worker that frequent pre-tokens take at most, and what each takes beside its own bytes.
MOST_SENT, OVERHEAD = 48_000_000, 100
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: A letter, and what is neither a letter nor a blank, in texts that LATIN doesn't find.
_L, _N = r"[^\W\d_]", r"(?:[^\w \n]|[\d_])"
#: Characters beyond those texts: in them, Python's letters are not those of the tokenizers' patterns.
LATIN = re.compile("[^\x00-\u024f]|[\u00b2\u00b3\u00b9\u00bc-\u00be]")
#: Places where no pre-token of the vocabulary's pattern goes on: after a letter before another character, before a
#: blank after another character, and before a letter unless an apostrophe stands there, which may begin a contraction.
FINE_WORDS = re.compile(rf"{_L}+|{_N}*'{_L}+|{_N}+")
WORDS = re.compile(r"[^ \t-\r]+")
#: Texts that hold other white space, or may hold a special token, are not cut so finely.
UNSAFE = re.compile(r"[^\S \n]|<\|")
#: Most texts have nothing but these characters (no apostrophe, tab or special token) and are cut by a plainer pattern.
_L1 = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
UNPLAIN = re.compile(rf"[^ \n!-&(-;=-~{_L1}]")
PLAIN_WORDS = re.compile(rf"[{_L1}]+|[^ \n{_L1}]+")


def words_of(text: str) -> list[str]:
    """Pieces of a text that word-level BPE, which drops white space and case, encodes alone as within it."""
    if UNPLAIN.search(text) is None:
        return PLAIN_WORDS.findall(text.lower())
    return WORDS.findall(text) if UNSAFE.search(text) or LATIN.search(text) else FINE_WORDS.findall(text.lower())


def tokenizer(name: str):
    """A tokenizer of the library tokenizers from the public vocabulary file `name`; one thread, as each task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name) if os.sep not in name else name)


def frequencies(text: str) -> Counter:
    """How often each pre-token occurs in a text. A pre-token here is a piece that ends where the pattern of a word-level
    vocabulary always ends one, so a text has as many tokens as its pieces have alone."""
    return Counter(words_of(text))


def _level(n: Column) -> Column:
    """A step of the logarithm of a frequency; there are at most 512."""
    return F.floor(8 * F.log2(n)).cast("int")


def pieces_of(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each distinct pre-token of all texts of `docs`: piece, n (how often it occurs), tokens. Each is encoded
    once, after the occurrences that a task has met have been put together there."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(met.keys(), pa.string()), pa.array(met.values(), pa.int64())], ["piece", "n"])

        for b in parts(batches):
            for text in b.column(0).to_pylist():
                met.update(words_of(text))
                if len(met) > MOST_MET:
                    yield rows()
                    met.clear()
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = cache(lambda: tokenizer(vocabulary))  # a task without rows needs none
        for b in parts(batches, 8192):
            encoded = tok().encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(len, encoded), pa.int64())], ["piece", "n", "tokens"])

    met = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(meet), "piece string, n long")
    return written(met.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(tidied(encode), "piece string, n long, tokens long"), "pieces")


def _least_sent(pieces: DataFrame, most: int) -> int:
    """The least level from which on all pre-tokens take at most `most` bytes of a worker."""
    sizes = pieces.groupBy(_level(F.col("n")).alias("level")).agg(F.sum(F.octet_length("piece") + OVERHEAD).alias("size")).collect()
    least, total = 1 << 10, 0
    for r in sorted(sizes, reverse=True):
        total += r["size"]
        if total > most:
            break
        least = r["level"]
    return least


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT, texts: bool = True, most: int = MOST_SENT) -> DataFrame:
    """`docs` (text, and what else it has; without the texts unless `texts`) with n_bytes, n_tokens and over_limit.

    Whole texts as the tokenizer gives them, without added special tokens; special strings within a text are
    handled as the library does by default. Null and empty texts have 0 of both. Repeated rows are counted
    alike; an empty table gives no rows. Columns n_bytes, n_tokens and over_limit of `docs` are replaced.

    The tokens of each distinct pre-token are counted once and joined to the frequencies of each document. The most
    frequent pre-tokens, `most` bytes of a worker at most, go to every task and are joined where a document is read; the
    others meet the frequencies in a shuffle, whose keys have no more rows than the least frequent of those sent has
    occurrences; where the most frequent alone take more than `most`, none is sent. Ids are never put together for a
    document. Pre-tokens and counts are written to the shared folder, with the texts if they stay."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    pieces = pieces_of(docs, vocabulary)
    least, level = _least_sent(pieces, most), _level(F.col("n"))
    table = pieces.where(level >= least).select("piece", "tokens").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(table["piece"].to_pylist(), table["tokens"].to_pylist())))
    kept = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("__text", F.coalesce("text", F.lit("")))
    kept = kept if texts else kept.drop("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens_of, row = sent.value, TaskContext.get().partitionId() << 40
        for b in parts(batches):
            sums, ends, rare, times = [], [0], [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                total = 0
                for piece, n in frequencies(text).items():
                    tokens = tokens_of.get(piece)
                    if tokens is None:
                        rare.append(piece)
                        times.append(n)
                    else:
                        total += n * tokens
                sums.append(total)
                ends.append(len(rare))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            open_ = pa.array(np.diff(ends) > 0)
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], ["piece", "n"])
            own = [rows, pa.array(sums, pa.int64()), open_, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], "__row", "__sum", "__open", "__rare"])

    added = StructType.fromDDL("__row long, __sum long, __open boolean, __rare array<struct<piece:string,n:long>>")
    schema = StructType([*kept.drop("__text").schema.fields, *added.fields])
    # Written before it is read, so that a row's number is the same for all that reads it.
    met = written(kept.mapInArrow(tidied(count), schema), "counted")
    pairs = met.where("__open").select("__row", F.inline("__rare"))
    rare = pieces.where(level < least).select("piece", "tokens")
    rest = pairs.join(rare, "piece").groupBy("__row").agg(F.sum(F.col("n") * F.col("tokens")).alias("__rest"))
    met = met.drop("__rare")
    out = met.where(~F.col("__open")).withColumn("n_tokens", F.col("__sum")).unionByName(met.where("__open").join(rest, "__row").withColumn("n_tokens", F.col("__sum") + F.col("__rest")).drop("__rest"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit).drop("__row", "__sum", "__open")


#: Fixed value: the pattern that byte-level vocabularies of this kind cut texts by.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space of this length and more makes tiktoken's pattern run out of stack far beyond it; the library takes any.
LONG_RUN = 50_000
BLANK_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens of a byte-level vocabulary by their bytes, if its ids are its merges' ranks and its settings are the
    plain ones, so that merging the pair of the lowest id until none is left gives the ids; else None."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    # The alphabet: printable bytes stand for themselves, the others for characters from 256 on in their order.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merges = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    return ranks if merges == sorted(merges) and len(ranks) == 256 + len(merges) else None


def encoder(name: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers, the ids that the library tokenizers
    gives with the public vocabulary file `name`. A byte-level vocabulary is applied by tiktoken, which needs a fraction
    of the time; texts that hold an added token or LONG_RUN blanks, and other vocabularies, go through the library itself."""
    import public_tokenizers

    path = public_tokenizers.path(name) if os.sep not in name else name
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special, ranks = [t["content"] for t in spec["added_tokens"]], byte_ranks(spec)
    del spec
    library = cache(lambda: tokenizer(name))  # most tasks never need it

    def slow(text: str) -> bytes:
        return np.array(library().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    if ranks is None:
        return slow
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> bytes:
        if any(s in text for s in special) or (len(text) > LONG_RUN and BLANK_RUN.search(text)):
            return slow(text)
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return ids
