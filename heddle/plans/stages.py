"""Stages of generated records: a pluggable generator, retries, attempts, and a runner that skips what is done."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import toolcall
from ..operators.joins import pending
from ..sources.rows import small_text
from ..sources.sinks import write_text

#: What a generator is: prompts and the seed of their batch in, one text for each out.
Generator = Callable[[list[str], int], list[str]]


#: Answers of the generator without a model.
STUB = ("I cannot answer that.", "Which one do you mean?", "Here it is.")


def stub(prompts: list[str], seed: int) -> list[str]:
    """A generator without a model: one of three answers, by a hash of the prompt and the seed."""
    return [STUB[hashlib.md5(f"{seed}|{p}".encode()).digest()[0] % 3] for p in prompts]


def generated(rows: DataFrame, generator: Generator, prompt: str, out: str, batch: int = 16, seed: int = 42, ordinal: str = "source_row_index") -> DataFrame:
    """`rows` with a generated text: batches of each partition go through the generator, one by one, seeded by the ordinal of
    their first row, so a lost task makes the same texts again."""
    schema = rows.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                at = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
                texts = generator([p or "" for p in at(prompt)], seed + int(at(ordinal)[0] or 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return rows.mapInArrow(run, schema)


#: What lies between the seeds of two rounds of attempts.
ROUND = 100_000
_CANDIDATE = "example_id string, attempt int, answer string, canonical string, class string, valid boolean, reason string, structural_kind string"


def generated_attempts(rows: DataFrame, generator: Generator, attempts: int = 6, seed: int = 42, wanted: int = 2, batch: int = 16) -> DataFrame:
    """(example_id, attempt, answer, canonical, class, valid, reason, structural_kind): answers to each prompt until `wanted` of
    their canonical forms differ, so a call that is only spelled otherwise is no other answer, or `attempts` are made.

    `rows` has example_id, source_row_index, prompt and maybe tools (JSON text), by which calls are judged. The prompts that
    come to a task together go through rounds: each round sends those that are still open to the generator in whole batches,
    under a seed of the round and of the first of the batch, so a lost task makes the same answers again. A prompt that
    is null is empty; repeated rows are prompts of their own."""
    tools = F.col("tools") if "tools" in rows.columns else F.lit("[]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluate = toolcall.evaluator()
        for b in batches:
            example, ordinal, prompt, spec = (c.to_pylist() for c in b.columns)
            seen: list[set[str]] = [set() for _ in example]
            out: list[tuple] = []
            for attempt in range(attempts):
                open_ = [k for k, forms in enumerate(seen) if len(forms) < wanted]
                for part in (open_[at : at + batch] for at in range(0, len(open_), batch)):
                    texts = generator([prompt[k] or "" for k in part], seed + attempt * ROUND + int(ordinal[part[0]] or 0) % ROUND)
                    for k, text in zip(part, texts, strict=True):
                        e = evaluate(text, spec[k])
                        seen[k].add(e["canonical"])
                        out.append((example[k], attempt, text, e["canonical"], e["class"], e["valid"], e["reason"], e["structural_kind"]))
            schema = [("example_id", pa.string()), ("attempt", pa.int32()), *((n, pa.string()) for n in ("answer", "canonical", "class")), ("valid", pa.bool_()), ("reason", pa.string()), ("structural_kind", pa.string())]
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])

    return rows.select(F.col("example_id").cast("string"), "source_row_index", "prompt", tools).mapInArrow(run, _CANDIDATE)


def reuses_original(critique: Column) -> Column:
    """Whether a readable critique found nothing to revise."""
    return F.coalesce(critique["valid"] & (critique["verdict"] == "NO_ISSUES"), F.lit(False))


def revised(rows: DataFrame, generator: Generator, prompt: str, original: Column, critique: Column, out: str = "revised_output_raw", seed: int = 42) -> DataFrame:
    """`rows` with a revision and revision_used_original_without_generation: only rows with issues go to the generator."""
    flag = "revision_used_original_without_generation"
    marked = rows.withColumn(flag, reuses_original(critique))
    same = marked.where(flag).withColumn(out, original)
    return same.unionByName(generated(marked.where(~F.col(flag)), generator, prompt, out, seed=seed))


def ensured(spark: SparkSession, path: str, make: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """The table at `path`, made first where it isn't there as a whole."""
    if not finished(spark, path):
        make(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def retried(rows: DataFrame, generator: Generator, prompt: str, out: str, valid: Column, seed: int = 42) -> DataFrame:
    """Two passes: rows whose first text isn't valid get another, under another seed. `attempts` tells how many it took."""
    first = generated(rows, generator, prompt, out, seed=seed).withColumn("__ok", F.coalesce(valid, F.lit(False)))
    good = first.where("__ok").drop("__ok").withColumn("attempts", F.lit(1))
    again = generated(first.where(~F.col("__ok")).drop("__ok", out), generator, prompt, out, seed=seed + 1).withColumn("attempts", F.lit(2))
    return good.unionByName(again)


#: Settings that are numbers with a fraction.
REAL = ("TEMPERATURE", "TOP_P", "LEARNING_RATE", "DEV_FRACTION")


@dataclass
class Options:
    """How a run goes. Dry runs list steps, smoke runs take a few rows; strict balance holds for full runs only."""

    dry: bool = False
    smoke: bool = False
    strict_balance: bool = True
    start: int = 0
    most: int | None = None
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.dry and self.smoke:
            raise ValueError("a run is dry or smoke, not both")
        self.strict_balance = self.strict_balance and not (self.smoke or self.start or self.most)

    @classmethod
    def parsed(cls, values: dict[str, str]) -> Options:
        """From settings as an environment or a command line holds them: 1, true, yes and on are true."""
        flag = lambda k, d: values.get(k, d).strip().lower() in ("1", "true", "yes", "on")
        whole = lambda k: int(values[k]) if values.get(k, "").strip() else None
        real = {k: float(v) for k, v in values.items() if k in REAL and v.strip()}
        return cls(flag("DRY_RUN", "0"), flag("SMOKE", "0"), flag("STRICT_BALANCE", "1"), whole("START_INDEX") or 0, whole("MAX_EXAMPLES"), real)


@dataclass
class Step:
    """A table and how it is made. `inputs` are the paths that it is read from, of earlier steps or from outside; `settings` are
    what else its rows depend on."""

    name: str
    path: str
    make: Callable[[SparkSession], DataFrame]
    inputs: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


#: The file beside a step's output that holds the fingerprint of what it was made from.
FINGERPRINT = "_FINGERPRINT"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _contents(spark: SparkSession, path: str) -> list:
    """What tells an input from another: an earlier step's fingerprint, or else each file's name, size and time."""
    if (stored := small_text(spark, f"{path}/{FINGERPRINT}")) is not None:
        return [path, stored]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return [path, None]
    found, listed = files.listFiles(at, True) if files.getFileStatus(at).isDirectory() else None, []
    if found is None:
        one = files.getFileStatus(at)
        return [path, [[one.getPath().getName(), one.getLen(), one.getModificationTime()]]]
    while found.hasNext():
        one = found.next()
        if not one.getPath().getName().startswith("."):
            listed.append([one.getPath().toString(), one.getLen(), one.getModificationTime()])
    return [path, sorted(listed)]


def fingerprint(spark: SparkSession, step: Step) -> str:
    """A digest of a step's name, settings and inputs."""
    told = json.dumps([step.name, step.settings, [_contents(spark, p) for p in step.inputs]], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a job's output is there as a whole."""
    return _exists(spark, f"{path}/_SUCCESS")


def run(spark: SparkSession, steps: list[Step], options: Options | None = None) -> list[tuple[str, str]]:
    """Makes each step's table unless it is there already, made from the same inputs with the same settings; (name, what
    happened) in order. Tables lie between steps, so what is lost in one is made again from the one before, and what depends
    on a changed one is made again, nothing else. A table without a fingerprint, as one made elsewhere, is made again if its
    step names inputs or settings. A dry run plans what it would make, and what would follow from that."""
    options = options or Options()
    log, stale = [], set()
    for step in steps:
        told = fingerprint(spark, step)
        tracked = bool(step.inputs or step.settings)
        fresh = finished(spark, step.path) and (not tracked or small_text(spark, f"{step.path}/{FINGERPRINT}") == told) and not stale & set(step.inputs)
        if fresh:
            log.append((step.name, "skipped"))
        elif options.dry:
            stale.add(step.path)
            log.append((step.name, "planned"))
        else:
            step.make(spark).write.mode("overwrite").parquet(step.path)
            if tracked:
                write_text(spark, told, f"{step.path}/{FINGERPRINT}")
            log.append((step.name, "made"))
    return log


def resumed(source: DataFrame, done: DataFrame | None, make: Callable[[DataFrame], DataFrame], key: str = "example_id", ordinal: str = "source_row_index") -> DataFrame:
    """Records of all source rows in source order: those that are done, and those made of the rest. Rows without
    an ordinal come in any order."""
    out = make(source) if done is None else done.unionByName(make(pending(source, done, key)))
    return out.orderBy(ordinal) if ordinal in out.columns else out
