"""Quality rules: base counts of each text, and a cascade of rules that stops at the first rejection."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, parts, tidied

#: Words of the stretches that distinct words are counted in, so that the share of them doesn't fall with length.
STRETCH = 1000
#: Words in a repeated window, and the shares of the base test.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 0.30
SYMBOLS = "#*$%&|<>"
#: Texts by which the cost and selectivity of each rule are estimated, by hash of the id.
SAMPLE = 512
_SPACE = " \t\n\v\f\r"


class Facts:
    """A text with its base counts; what a rule needs besides is computed when a rule asks for it."""

    def __init__(self, text: str):
        self.text = text
        self.words = text.encode("utf-8", "surrogatepass").split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, _SPACE))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        self.n_dup_lines = 0
        if "\n" in text:
            for line in text.split("\n"):
                if line.strip(_SPACE):
                    self.n_dup_lines += line in seen
                    seen.add(line)
        self.n_repeat_words = repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 100 * MOST_REPEATED * self.n_words


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal keys are compared word by word, so that no chance collision counts.
    a, b = order[1:][same], order[:-1][same]
    true = np.ones(len(a), bool)
    for k in range(window):
        true &= ids[a + k] == ids[b + k]
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([a[true], b[true]]))
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


class Rule(NamedTuple):
    """`rejects` tells from a text's facts whether the text goes. Texts have a word at least."""

    name: str
    rejects: Callable[[Facts], bool]


def _share(pattern: str) -> Callable[[Facts], float]:
    found = re.compile(pattern)
    return lambda f: len(found.findall(f.text)) / f.n_words


_marks = _share(r"[#*$%&]{2,}")
_shouts = _share(r"!{2,}")
_pipes = _share(r"\|")
_links = _share(r"https?://|www\.")


def _upper(f: Facts) -> float:
    letters = sum(map(str.isalpha, f.text))
    return sum(map(str.isupper, f.text)) / letters if letters else 0.0


def _letterless(f: Facts) -> float:
    return sum(not any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in f.words) / f.n_words


def _distinct(f: Facts) -> int:
    """Distinct words of each stretch of STRETCH words, summed over the whole text."""
    return sum(len(set(f.words[k : k + STRETCH])) for k in range(0, f.n_words, STRETCH))


#: The cascade's rules; each rejects by itself, so their order never changes a verdict.
RULES = (
    Rule("symbols", lambda f: f.n_symbols > 0.10 * f.n_words),
    Rule("mark_runs", lambda f: _marks(f) > 0.05),
    Rule("shouting", lambda f: _shouts(f) > 0.10),
    Rule("tables", lambda f: _pipes(f) > 0.10),
    Rule("upper_case", lambda f: _upper(f) > 0.50),
    Rule("word_length", lambda f: not 2.0 <= f.word_chars / f.n_words <= 14.0),
    Rule("duplicate_lines", lambda f: f.n_dup_lines > 0.60 * (f.text.count("\n") + 1)),
    Rule("stutter", lambda f: sum(map(bytes.__eq__, f.words, f.words[1:])) > 0.25 * f.n_words),
    Rule("few_distinct", lambda f: _distinct(f) < 0.15 * f.n_words),
    Rule("letterless", lambda f: _letterless(f) > 0.40),
    Rule("links", lambda f: _links(f) > 0.10),
)


class Estimate(NamedTuple):
    name: str
    cost: float  #: seconds a text
    rejected: float  #: share of the sample


def estimates(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """Cost and selectivity of each rule on sampled texts that pass the base test."""
    facts = [f for f in map(Facts, texts) if not f.base_failed]
    out = []
    for rule in rules:
        began = time.perf_counter()
        n = sum(map(rule.rejects, facts))
        out.append(Estimate(rule.name, (time.perf_counter() - began) / max(1, len(facts)), n / max(1, len(facts))))
    return out


def ordered(rules: tuple[Rule, ...], found: list[Estimate]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, the best first; those that rejected nothing come last, the cheapest first."""
    by = {e.name: e for e in found}
    return tuple(sorted(rules, key=lambda r: (-by[r.name].rejected / max(by[r.name].cost, 1e-9), by[r.name].cost)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """`docs` (doc_id, text, and what else it has) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and kept.

    Null text has no words and fails the base test, as does an empty one. kept is false where the base test
    fails or a rule rejects; a text's other rules are then skipped. The order of the rules is measured on
    `sample` texts, the ones whose id hashes lowest, and has no say in the verdict. Repeated rows get the same
    verdict; an empty table gives no rows. Columns of `docs` with the new names are replaced. No shuffle: each
    task judges its own rows, one text at a time."""
    names = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean"}
    docs = docs.drop(*names)
    drawn = docs.select("text", F.xxhash64("doc_id").alias("h")).where(lowest(F.col("h"), sample, docs.count()) & F.col("text").isNotNull())
    chain = ordered(rules, estimates([r["text"] for r in sorted(drawn.collect(), key=lambda r: r["h"])[:sample]], rules))
    order = [[r.name for r in rules].index(r.name) for r in chain]
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t in names.items()}).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [rules[k].rejects for k in order]
        for b in parts(batches):
            rows = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                f = Facts(text or "")
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, not f.base_failed and not any(r(f) for r in cascade)))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.bool_() if t == "boolean" else pa.int64()) for c, t in zip(columns, names.values()))], [*b.schema.names, *names])

    return docs.mapInArrow(tidied(judge), schema)
