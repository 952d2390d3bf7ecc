"""The catalog of decision-data queries; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls, judge, prompts
from ..functions import metadata as M
from ..functions import text as X
from ..functions import toolcall as C
from ..operators import encoding, joins, metrics, probe, records, report, sampling, summaries
from ..schemas import LABELS, OUTCOMES, PROBE_LABELS, RESPONSE_CLASSES
from . import fixtures as D
from . import stages

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED = 42
#: Run keys and settings whose names are inferred.
RUNS = (
    ("llama32_3b_4shot", "llama", "org/Llama-3.2-3B", "out/a", 4, "Unknown"),
    ("gemma3_4b_zeroshot", "", "org/gemma-3-4b", "out/b", 0, "Unknown"),
    ("llama32_3b_sft_zeroshot_eval", "llama", "x/y", "out/c", 0, "Post-Training"),
    ("gemma3_4b_dpo_zeroshot_eval", "gemma", "x/z", "out/d", 0, "Unknown"),
    ("llama_self_full_dpo_from_sft_model_eval", "", "m", "out/e", 0, "Unknown"),
    ("gemma_self_full_dpo_base_model_eval", "", "m", "out/f", 0, "CAI"),
    ("gemma_self_full_sft_model_eval", "", "m", "out/g", 0, "Unknown"),
    ("llama32_3b_probe_base", "llama", "m:1", "out/h", 0, "Unknown"),
    ("other_2shot", "mistral", "m", "out/i", 2, "Prompting"),
    ("plain", "", "", "", 3, "Unknown"),
)
#: How much later the ids of compared samples are than those of events.
SHIFT = 7
JUDGE_TEMPLATE = "{{CONSTITUTION}}\nTools: {{TOOLS}}\nRequest: {{USER_REQUEST}}\nResponse: {{ASSISTANT_RESPONSE}}\nA: {{RESPONSE_A}} B: {{RESPONSE_B}}\nCritique: {{CRITIQUE}}\n"
REVISED = "Which id do you mean?"
SPELLINGS = ('<TOOLCALL>{"name":"lookup","arguments":{"id":1}}</TOOLCALL>', '<TOOLCALL>{"name": "lookup",  "arguments": {"id": 1}}</TOOLCALL>')
TEMPLATE = "Rules: {{RULES}}\nRequest: {{REQUEST}}\nResponse: {{RESPONSE}}\n"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    CATALOG[f"q_{f.__name__}"] = f
    return f


# --- classification and counts


@query
def class_counts(spark, sf_dir):
    return report.counted(D.responses(spark, sf_dir).select(X.response_class(F.col("response")).alias("class")), "class")


@query
def class_flags_overview(spark, sf_dir):
    r = F.col("response")
    return report.overview(D.responses(spark, sf_dir), {"has_marker": X.has_marker(r), "refuses": X.refuses(r), "asks": X.asks(r)})


def _pairs(spark, sf_dir):
    return D.preference_pairs(spark, sf_dir).select("conv_id", X.response_class(F.col("chosen")).alias("chosen_class"), X.response_class(F.col("rejected")).alias("rejected_class"), "chosen", "rejected")


@query
def class_pair_breakdown(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("chosen_class", "rejected_class").agg(F.count(F.lit(1)).alias("n"))


@query
def flag_pair_breakdown(spark, sf_dir):
    x = D.responses(spark, sf_dir).select(X.has_marker(F.col("response")).alias("marker"), X.asks(F.col("response")).alias("asks"))
    return x.groupBy("marker", "asks").agg(F.count(F.lit(1)).alias("n"))


@query
def class_crosstab(spark, sf_dir):
    return report.crosstab(_pairs(spark, sf_dir), "chosen_class", "rejected_class", RESPONSE_CLASSES)


@query
def first_n_examples(spark, sf_dir):
    x = D.responses(spark, sf_dir).join(D.messages(spark, sf_dir), "conv_id").select("conv_id", X.response_class(F.col("response")).alias("class"), X.preview(F.col("messages")).alias("preview"))
    return records.first_of_each(x, "class", ["conv_id"], 3)


# --- message rows


@query
def last_assistant_turns(spark, sf_dir):
    x = D.messages(spark, sf_dir).where(records.ends_with_assistant(F.col("messages")))
    return x.select("conv_id", records.last(F.col("messages"))["content"].alias("answer"))


@query
def split_context_target(spark, sf_dir):
    x = D.messages(spark, sf_dir).where(records.ends_with_assistant(F.col("messages")))
    x = x.select("conv_id", records.context(F.col("messages")).alias("context"), records.last(F.col("messages"))["content"].alias("target"))
    again = records.with_answer(F.col("context"), F.col("target"))
    return x.select("conv_id", F.size("context").alias("n_context"), "target", F.size(again).alias("n_again"), records.last(again)["role"].alias("last_role"))


@query
def render_conversation(spark, sf_dir):
    return D.messages(spark, sf_dir).select("conv_id", X.conversation(records.without_answer(F.col("messages"))).alias("rendered"))


@query
def question_render(spark, sf_dir):
    m = F.col("messages")
    first = F.slice(m, 1, 1)
    return D.messages(spark, sf_dir).select("conv_id", X.question(records.without_answer(m)).alias("question"), X.question(first).alias("opening"))


def _labelled(spark, sf_dir):
    x = D.messages(spark, sf_dir).join(D.responses(spark, sf_dir), "conv_id")
    explicit = F.when(F.col("conv_id") % 3 == 0, "tool_call").when(F.col("conv_id") % 3 == 1, "direct")
    answer = F.when(records.ends_with_assistant(F.col("messages")), records.last(F.col("messages"))["content"])
    return x.withColumn("label", records.behavior_label(explicit, answer, F.col("response")))


@query
def label_audit(spark, sf_dir):
    return records.label_audit(_labelled(spark, sf_dir), F.col("label"))


@query
def record_pools(spark, sf_dir):
    x = D.messages(spark, sf_dir).join(D.responses(spark, sf_dir).withColumnRenamed("response", "chosen"), "conv_id").withColumn("tools", F.lit(D.TOOLS))
    pool = records.sft_pool(x).unionByName(records.preference_pool(x))
    return pool.groupBy("source_split", "behavior_class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("messages")).alias("n_messages"), F.sum(F.length(records.last(F.col("messages"))["content"])).alias("n_characters"))


def _training(spark, sf_dir, family):
    m = F.col("messages")
    x = D.messages(spark, sf_dir).where(records.ends_with_assistant(m) & (F.get(m, F.lit(0))["role"] == "user"))
    return x.select("conv_id", prompts.training_prompt(family, F.lit(D.TOOLS), records.context(m)).alias("prompt"), X.stripped(records.last(m)["content"]).alias("target"))


@query
def training_prompt_llama(spark, sf_dir):
    return _training(spark, sf_dir, "llama")


@query
def training_prompt_gemma(spark, sf_dir):
    return _training(spark, sf_dir, "gemma")


@query
def eval_prompt_fewshot(spark, sf_dir):
    q = F.get("messages", F.lit(0))["content"]
    x, shots = D.messages(spark, sf_dir), tuple(D.shots(spark, sf_dir))
    return x.select("conv_id", *(prompts.eval_prompt(f, q, F.lit(D.TOOLS), shots).alias(f) for f in ("llama", "gemma")))


@query
def template_render(spark, sf_dir):
    x = D.responses(spark, sf_dir).join(D.messages(spark, sf_dir), "conv_id")
    text = X.filled(TEMPLATE, RULES=F.lit("Call tools when they fit."), REQUEST=X.conversation(records.without_answer(F.col("messages"))), RESPONSE=X.stripped(F.col("response")))
    return x.select("conv_id", *[prompts.chat(f, text).alias(f) for f in ("llama", "gemma", "qwen", "phi")])


@query
def payload_extract(spark, sf_dir):
    r = F.col("response")
    return D.responses(spark, sf_dir).select("conv_id", X.payload(r).alias("payload"), X.payload(r, otherwise="null").alias("tagged"))


@query
def parse_critique(spark, sf_dir):
    x = D.judge_outputs(spark, sf_dir).withColumn("c", judge.critique(F.col("critique_text")))
    c = F.col("c")
    missing = F.array_join(judge.missing_fields(c), ",").alias("missing")
    text = F.when(c["valid"], c["critique"]).otherwise(judge.fallback_critique(F.array("critique_text"), F.array(c))).alias("effective")
    return x.select("conv_id", "c.valid", "c.verdict", "c.primary_issue", "c.critique", missing, text)


@query
def parse_preference(spark, sf_dir):
    return D.judge_outputs(spark, sf_dir).withColumn("p", judge.preference(F.col("preference_text"))).select("conv_id", "p.valid", "p.winner", "p.reason")


@query
def example_ids(spark, sf_dir):
    x = D.table(spark, sf_dir, "conversations")
    return x.select("conv_id", "turn", records.example_id(F.col("role"), F.col("conv_id") * 10 + F.col("turn")).alias("example_id"))


@query
def label_coalesce(spark, sf_dir):
    explicit = F.when(F.col("conv_id") % 3 == 0, "tool_call").when(F.col("conv_id") % 3 == 1, "").otherwise("unlisted")
    x = D.preference_pairs(spark, sf_dir).withColumn("explicit", explicit)
    return x.select("conv_id", records.behavior_label(F.col("explicit"), F.col("chosen"), F.col("rejected")).alias("label"), records.filled_or(F.col("explicit"), F.lit("none")).alias("plain"))


@query
def conflicting_keys(spark, sf_dir):
    x = D.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "source")
    return joins.conflicting(x, "key", "source")


@query
def without_conflicting_keys(spark, sf_dir):
    x = D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "source")
    return joins.without_conflicts(x, "key", "source").select("doc_id", "source")


# --- samples and splits


@query
def balanced_sample(spark, sf_dir):
    x = sampling.sample_each(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 50, SEED)
    return x.select("o_orderpriority", "o_orderkey", "place")


@query
def balanced_half_split(spark, sf_dir):
    x = sampling.balanced_halves(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", SEED)
    return x.select("o_orderpriority", "o_orderkey", "half")


@query
def balanced_cap(spark, sf_dir):
    x = D.eval_samples(spark, sf_dir).select("uuid", "gold")
    return sampling.balanced_cap(x, "gold", "uuid", PROBE_LABELS, 1000, SEED)


@query
def global_shuffle(spark, sf_dir):
    # A sample of each class, numbered, and the places that its rows take in a shuffle of all.
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = sampling.even_total(orders, "o_orderpriority")
    x = sampling.sample_each(orders, "o_orderpriority", "o_orderkey", n, SEED)
    classes = orders.select("o_orderpriority").distinct().withColumn("k", F.row_number().over(Window.orderBy("o_orderpriority")) - 1)
    x = x.join(F.broadcast(classes), "o_orderpriority").withColumn("ordinal", (F.col("k") * n + F.col("place") - 1).cast("long"))
    return sampling.shuffled(x.drop("place", "k"), "ordinal", n * classes.count(), SEED)


@query
def smoke_subset(spark, sf_dir):
    return sampling.leading(D.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 8)


@query
def stratified_dev_split(spark, sf_dir):
    return sampling.fraction_split(D.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 0.2, SEED, by="label")


@query
def train_eval_split(spark, sf_dir):
    return sampling.fraction_split(D.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, SEED)


# --- stages


@query
def stage_join_ordered(spark, sf_dir):
    # Some orders have no lines, so the checks, which want a row of each stage, are off.
    source = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), F.col("o_orderkey").alias("source_row_index"), "o_orderstatus")
    lines = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("example_id"))
    initial = lines.agg(F.max("l_linenumber").alias("n_lines"), F.count(F.lit(1)).alias("n_rows"))
    critique = lines.agg(F.min("l_partkey").alias("least_part"))
    return joins.stage_join(source, initial, critique, checked=False).select("example_id", "source_row_index", "o_orderstatus", "n_lines", "n_rows", "least_part")


def _stage_records(spark, sf_dir):
    """The source, and what three stages made of each of its rows: a response, a critique of it, and a revision."""
    of = lambda x: x.withColumnRenamed("conv_id", "example_id")
    source = of(D.messages(spark, sf_dir)).select("example_id", F.col("example_id").alias("source_row_index"), F.size("messages").alias("n_messages"))
    initial = of(D.responses(spark, sf_dir)).withColumn("initial_class", X.response_class(F.col("response")))
    critique = of(D.judge_outputs(spark, sf_dir)).select("example_id", judge.critique(F.col("critique_text")).alias("c"))
    revision = joins.stage_join(initial, critique, names=["critiques"]).select("example_id", F.when(stages.reuses_original(F.col("c")), F.col("response")).otherwise(REVISED).alias("revised"))
    return source, initial, critique.select("example_id", "c.valid", "c.verdict"), revision


@query
def stage_join_four(spark, sf_dir):
    source, *made = _stage_records(spark, sf_dir)
    return joins.stage_join(source, *made, names=["initial outputs", "critiques", "revisions"]).select("source_row_index", "n_messages", "initial_class", "valid", "verdict", "revised")


@query
def stage_join_three(spark, sf_dir):
    source, initial, critique, _ = _stage_records(spark, sf_dir)
    x = joins.stage_join(source, initial, critique, names=["initial outputs", "critiques"])
    return x.groupBy("initial_class", "verdict").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_messages").alias("n_messages"))


@query
def resume_anti(spark, sf_dir):
    done = D.table(spark, sf_dir, "labels").select("doc_id")
    return joins.pending(D.table(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id")


@query
def stage_summary(spark, sf_dir):
    x = D.judge_outputs(spark, sf_dir).withColumn("c", judge.critique(F.col("critique_text")))
    missing = F.array(judge.missing_fields(F.col("c")))
    fields = x.select(F.explode(F.flatten(missing)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    whole = x.agg(F.count(F.lit(1)).alias("n_records"), F.count_if("c.valid").alias("n_valid"), F.count_if(~F.col("c.valid")).alias("n_invalid"))
    wide = whole.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in ("n_records", "n_valid", "n_invalid")])))
    return wide.unionByName(fields.select(F.concat(F.lit("missing "), "field").alias("field"), "n"))


@query
def sft_export(spark, sf_dir):
    x = D.responses(spark, sf_dir).join(D.messages(spark, sf_dir), "conv_id")
    x = x.withColumns({"tools": F.lit(D.TOOLS), "source_split": F.lit("fixture"), "behavior_class": X.response_class(F.col("response"))})
    out = records.sft_export(x.withColumn("messages", records.without_answer(F.col("messages"))), X.stripped(F.col("response")))
    return out.select("tools", "source_split", "behavior_class", F.size("messages").alias("n_messages"), records.last(F.col("messages"))["content"].alias("answer"))


@query
def dpo_export(spark, sf_dir):
    x = D.preference_pairs(spark, sf_dir).join(D.judge_outputs(spark, sf_dir), "conv_id")
    a, b = X.stripped(F.col("chosen")), X.stripped(F.col("rejected"))
    routed = records.routed_preference(a, b, X.response_class(a), X.response_class(b), judge.preference(F.col("preference_text")))
    return x.select("conv_id", routed.alias("r")).select("conv_id", "r.*")


@query
def distinct_candidates(spark, sf_dir):
    x = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("example_id"), F.col("turn").alias("attempt"), F.col("text").alias("answer"))
    return records.distinct_candidates(x)


# --- metrics


def _cells(spark, sf_dir, pred):
    return metrics.cells(D.eval_samples(spark, sf_dir), "run_key", "gold", pred)


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_cells(spark, sf_dir, "pred_raw"), "run_key", LABELS)


@query
def accuracy_macro_f1(spark, sf_dir):
    return metrics.summary(_cells(spark, sf_dir, "pred_raw"), "run_key", LABELS)


@query
def accuracy_macro_f1_three(spark, sf_dir):
    return metrics.summary(_cells(spark, sf_dir, "pred_raw"), "run_key", PROBE_LABELS)


@query
def classification_report(spark, sf_dir):
    counted = _cells(spark, sf_dir, "pred_raw")
    labels = metrics.class_report(counted, "run_key", PROBE_LABELS).withColumnRenamed("label", "row")
    return labels.unionByName(metrics.report_totals(counted, "run_key", PROBE_LABELS))


@query
def one_vs_rest(spark, sf_dir):
    return metrics.one_vs_rest(_cells(spark, sf_dir, "pred_norm"), "run_key", LABELS)


def _long(spark, sf_dir):
    rows = F.array(F.struct(F.lit("raw").alias("scoring"), F.col("pred_raw").alias("pred")), F.struct(F.lit("normalized").alias("scoring"), F.col("pred_norm").alias("pred")))
    return D.eval_samples(spark, sf_dir).select("run_key", "gold", F.inline(rows)).withColumn("key", F.concat_ws("|", "run_key", "scoring"))


@query
def direct_rate(spark, sf_dir):
    x = _long(spark, sf_dir).groupBy("run_key", "scoring").agg(F.count(F.lit(1)).alias("n_examples"), F.count_if(F.col("pred") == "direct").alias("n_direct"))
    return x.withColumn("direct_rate", F.col("n_direct") / F.greatest("n_examples", F.lit(1)))


@query
def prediction_mix(spark, sf_dir):
    return metrics.shares(_long(spark, sf_dir), "key", F.col("pred"), LABELS)


@query
def norm_outcome(spark, sf_dir):
    return metrics.shares(D.eval_samples(spark, sf_dir), "run_key", metrics.outcome(F.col("gold"), F.col("pred_raw"), F.col("pred_norm")), OUTCOMES)


@query
def norm_delta(spark, sf_dir):
    x = metrics.summary(metrics.cells(_long(spark, sf_dir), "key", "gold", "pred"), "key", LABELS)
    x = x.withColumns({"run_key": F.substring_index("key", "|", 1), "scoring": F.substring_index("key", "|", -1)})
    accuracy = report.pivoted(x, ["run_key"], "scoring", ("raw", "normalized"), "accuracy", "key")
    direct = report.pivoted(direct_rate(spark, sf_dir), ["run_key"], "scoring", ("raw", "normalized"), "direct_rate", "scoring")
    direct = direct.select("run_key", F.col("raw").alias("direct_raw"), F.col("normalized").alias("direct_normalized"))
    out = accuracy.join(direct, "run_key", "left").na.fill(0.0)
    return out.withColumns({"accuracy_delta": F.col("normalized") - F.col("raw"), "direct_delta": F.col("direct_normalized") - F.col("direct_raw")})


def _compared(spark, sf_dir):
    # Samples of later ids: the first probes have none.
    return joins.compared(D.probe_preds(spark, sf_dir), D.eval_samples(spark, sf_dir).withColumn("uuid", F.col("uuid") + SHIFT))


@query
def agreement(spark, sf_dir):
    return metrics.agreement(_compared(spark, sf_dir).where("matched"), "run_key", "probe", "pred_norm", PROBE_LABELS)


@query
def join_audit(spark, sf_dir):
    return joins.audit(_compared(spark, sf_dir))


@query
def latest_sample(spark, sf_dir):
    x = D.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return joins.latest(x, "user_id", "event_id")


@query
def argmax_choice(spark, sf_dir):
    return metrics.best_choice(D.choice_scores(spark, sf_dir), "uuid", LABELS)


# --- reports


@query
def label_sets(spark, sf_dir):
    return report.value_sets(_long(spark, sf_dir), "key", "pred", PROBE_LABELS)


@query
def probe_layer_rank(spark, sf_dir):
    return report.selection(D.run_metrics(spark, sf_dir), "run_key", "position").drop("is_placeholder")


@query
def probe_layer_pivot(spark, sf_dir):
    x = D.run_metrics(spark, sf_dir)
    tags = ("middle", "layer_75pct", "last")
    wide = report.pivoted(x, ["run_key"], "layer_tag", tags, "accuracy", "position")
    best = report.best_layer(x, "run_key", "position").select("run_key", F.col("layer_tag").alias("best_layer"))
    pending = x.groupBy("run_key").agg(F.bool_and("is_placeholder").alias("is_pending"))
    return wide.withColumn("best_accuracy", F.greatest(*tags)).join(best, "run_key", "left").join(pending, "run_key")


@query
def best_hparam(spark, sf_dir):
    return report.best_parameter(D.run_metrics(spark, sf_dir), "run_key", "layer_tag", "macro_f1", "position")


def _runs(spark, sf_dir):
    """Runs made of events: a key for each kind of event and user, with one of the settings of RUNS by both."""
    e = D.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    settings = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("run_key", "family", "model", "output_dir", "shots", "source"))]) for r in RUNS])
    s = F.element_at(settings, (1 + (F.length("event_type") + F.col("user_id")) % len(RUNS)).cast("int"))
    return e.select(F.concat_ws("_", s["run_key"], F.col("event_type"), "user_id").alias("run_key"), s["family"].alias("family"), s["model"].alias("model"), F.concat(s["output_dir"], F.lit("/"), "user_id").alias("output_dir"), (s["shots"] + F.lit(0)).cast("int").alias("shots"), s["source"].alias("source"))


def _named(spark, sf_dir):
    c = F.col
    x = _runs(spark, sf_dir).withColumn("model_family", M.model_family(c("run_key"), c("family"), c("model"))).withColumn("run_group", M.run_group(c("run_key"), c("output_dir"), c("model"), c("source")))
    x = x.withColumn("variant_label", M.eval_variant(c("run_key"), c("output_dir"), c("model"), c("shots"), c("run_group")))
    return x.withColumns({"run_display": M.run_display(c("model_family"), c("run_group"), c("variant_label")), "short_display": M.short_display(c("model_family"), c("run_group"), c("variant_label"))})


@query
def sort_runs(spark, sf_dir):
    return report.with_ranks(_named(spark, sf_dir)).select("run_key", *[r for r in report.RANKS if r != "run_key"])


@query
def unique_displays(spark, sf_dir):
    x = D.run_metrics(spark, sf_dir).select("run_key", F.when(F.length("run_key") % 2 == 0, "even").otherwise(F.col("run_key")).alias("run_display")).distinct()
    return report.unique_displays(x)


@query
def placeholders(spark, sf_dir):
    x = D.run_metrics(spark, sf_dir)
    expected = x.select(F.explode(F.array("run_key", F.concat("run_key", F.lit("_next")))).alias("run_key"))
    made = report.placeholders(report.missing_keys(x, expected), ("raw", "normalized"), PROBE_LABELS)
    have = x.select("run_key", F.lit("raw").alias("scoring"), F.col("layer_tag").alias("label"), "accuracy", "macro_f1", "is_placeholder")
    return have.unionByName(made)


@query
def extrema_bold(spark, sf_dir):
    x = report.extrema(D.run_metrics(spark, sf_dir).select("run_key", "layer_tag", "accuracy", "macro_f1"), {"accuracy": "max", "macro_f1": "min"}, F.col("layer_tag") != "last")
    return x.select("run_key", "layer_tag", M.decimals(F.col("accuracy"), bold=F.col("accuracy_best")).alias("accuracy_cell"), M.decimals(F.col("macro_f1"), signed=True, bold=F.col("macro_f1_best")).alias("macro_f1_cell"))


@query
def run_metadata(spark, sf_dir):
    x = _named(spark, sf_dir)
    c = F.col
    x = x.withColumns({"setting": M.probe_setting(c("run_key"), F.lit(""), c("output_dir")), "probe_of": M.probe_source(c("run_key"), F.lit(""), c("output_dir"), c("model"), c("shots"))})
    return x.select("run_key", "model_family", "run_group", "variant_label", "run_display", "short_display", "setting", "probe_of", M.probe_display(c("model_family"), c("setting"), c("probe_of")).alias("probe_display"), M.model_slug(c("model")).alias("model_slug"))


@query
def latex_escape(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", X.latex(F.col("text")).alias("escaped"))


def _ids(spark, sf_dir):
    x = D.table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return x.select("doc_id", "source", F.slice("ids", 1, 5).alias("prompt"), F.slice("ids", 6, F.greatest(F.size("ids"), F.lit(1))).alias("target"))


def _sums(x, *more):
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v).cast("long").alias(f"sum_{c}")
    return x.select("doc_id", F.size("input_ids").alias("n"), *map(total, ("input_ids", "labels", "attention_mask")), *more)


@query
def token_encode(spark, sf_dir):
    x = _ids(spark, sf_dir)
    cut = encoding.truncation(F.size("prompt") + F.size("target") + 1, 256)
    return _sums(x.select("doc_id", encoding.encoded(F.col("prompt"), F.col("target"), 0, 256).alias("e"), cut.alias("c")).select("doc_id", "e.*", "c.*"), "truncated", "extracted_index")


@query
def pad_batch(spark, sf_dir):
    x = _ids(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), encoding.encoded(F.col("prompt"), F.col("target"), 0, 256).alias("e"))
    padded = encoding.padded(x.select("doc_id", "batch", "e.*"), "batch", 1)
    types = F.aggregate(encoding.zero_types(F.col("input_ids")), F.lit(0), lambda s, v: s + v + 1).cast("long")
    return _sums(padded, types.alias("n_zero_types"))


@query
def layer_specs(spark, sf_dir):
    x = D.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("n_layers"))
    return x.select("n_layers", F.inline(M.layers(F.col("n_layers"))))


# --- Python syntax, models, generation


@query
def toolcall_parse(spark, sf_dir):
    return calls.parsed_calls(D.responses(spark, sf_dir), "response", "c").select("conv_id", "c.name", "c.arguments", "c.canonical")


@query
def toolcall_validate(spark, sf_dir):
    x = D.responses(spark, sf_dir).withColumn("c", C.candidate(F.col("response"), F.lit(D.TOOLS)))
    return x.select("conv_id", "c.valid", "c.reason")


@query
def candidate_eval(spark, sf_dir):
    x = D.responses(spark, sf_dir).withColumn("c", C.candidate(F.col("response"), F.lit(D.TOOLS)))
    return x.select("conv_id", F.col("c.class").alias("class"), "c.score", "c.structural_kind")


@query
def toolcall_render(spark, sf_dir):
    return D.responses(spark, sf_dir).select("conv_id", C.rendered(F.col("response"), "llama").alias("llama"), C.rendered(F.col("response"), "gemma").alias("gemma"))


@query
def rejected_valid_drop(spark, sf_dir):
    x = _pairs(spark, sf_dir).withColumn("c", C.candidate(F.col("rejected"), F.lit(D.TOOLS)))
    bad = (F.col("chosen_class") == "request_for_info") & F.col("c.valid") & (F.col("c.score") == 2)
    return x.where(~bad).select("conv_id", "chosen_class", "rejected_class")


@query
def probe_fit_predict(spark, sf_dir):
    x = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("embedding").alias("features"), F.col("label").alias("label_id"))
    x = sampling.fraction_split(x, "example_id", 0.25, SEED, by="label_id").withColumnRenamed("split", "part")
    model, _, _ = probe.fit(x.where("part = 'train'").drop("part"))
    return probe.predict(model, x.where("part = 'eval'")).select("example_id", "label_id", "prediction", F.array_max("probabilities").alias("confidence"))


def _by_round(texts, seed):
    """The stub's texts by the round of the seed alone, so that they don't depend on how prompts are batched."""
    return stages.stub(texts, (seed - SEED) // stages.ROUND)


@query
def generate_stub_pairs(spark, sf_dir):
    x = D.responses(spark, sf_dir).select(F.col("conv_id").cast("string").alias("example_id"), F.col("conv_id").alias("source_row_index"), F.col("response").alias("prompt"))
    drawn = stages.generated_attempts(x, _by_round, attempts=6, seed=SEED)
    return records.distinct_candidates(drawn.select("example_id", "attempt", "answer"))


@query
def sampled_pairs(spark, sf_dir):
    # Two of the three answers are one call in two spellings.
    spelled = {t: t if k == 0 else SPELLINGS[k - 1] for k, t in enumerate(stages.STUB)}
    x = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("example_id"), F.col("o_orderkey").alias("source_row_index"), F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("prompt"), F.lit(D.TOOLS).alias("tools"))
    drawn = stages.generated_attempts(x, lambda texts, seed: [spelled[t] for t in _by_round(texts, seed)], attempts=6, seed=SEED)
    return records.response_pairs(drawn.select("example_id", "attempt", F.col("canonical").alias("answer"), "valid"), n_valid=F.col("valid"))


# --- calls of many tools, types and syntaxes


@query
def varied_calls(spark, sf_dir):
    x = calls.parsed_calls(D.varied_calls(spark, sf_dir), "text", "p").withColumn("c", C.candidate(F.col("text"), F.lit(D.VARIED_TOOLS)))
    return x.select("o_orderkey", "p.name", "p.arguments", "p.canonical", "c.valid", "c.reason", "c.structural_kind")


@query
def choice_conversion(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 4 == 0, "cannot_answer").otherwise("tool_call")
    convert = lambda family: C.converted_choice(label, F.col("text"), family).alias(family)
    return D.varied_calls(spark, sf_dir).select("o_orderkey", convert("llama"), convert("gemma"))


@query
def policy_prompts(spark, sf_dir):
    x = D.messages(spark, sf_dir).where(F.get("messages", F.lit(0))["role"] == "user")
    return x.select("conv_id", *(prompts.policy_prompt(f, F.lit(D.TOOLS), F.col("messages")).alias(f) for f in ("llama", "gemma")))


# --- keys, prompts and summaries of stages


def _requests(spark, sf_dir):
    return D.messages(spark, sf_dir).select("conv_id", F.size("messages").alias("n_messages"), records.request_key(F.col("messages"), F.expr(D.ROW_TOOLS)).alias("key"))


@query
def request_keys(spark, sf_dir):
    by = _requests(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("conv_id").alias("first"))
    return by.select(F.col("key.request").alias("request"), F.col("key.tools").alias("tools"), "n_rows", "first")


@query
def conflicting_requests(spark, sf_dir):
    x = _requests(spark, sf_dir).select(F.col("key.tools").alias("tools"), (F.col("n_messages") % 2).alias("label"))
    return joins.conflicting(x, "tools", "label")


def _judged(spark, sf_dir):
    x = D.preference_pairs(spark, sf_dir).join(D.messages(spark, sf_dir), "conv_id").join(D.judge_outputs(spark, sf_dir), "conv_id")
    return x.withColumns({"request": X.conversation(records.without_answer(F.col("messages"))), "rules": F.lit("Call tools when they fit.")})


@query
def judge_prompts(spark, sf_dir):
    c = F.col
    shared = (JUDGE_TEMPLATE, c("rules"), c("request"), F.lit(D.TOOLS))
    return _judged(spark, sf_dir).select(
        "conv_id",
        prompts.critique_prompt("llama", *shared, c("chosen")).alias("critique"),
        prompts.revision_prompt("gemma", *shared, c("chosen"), c("critique_text")).alias("revision"),
        prompts.preference_prompt("qwen", *shared, c("chosen"), c("rejected")).alias("preference"),
    )


@query
def tools_indented(spark, sf_dir):
    x = D.responses(spark, sf_dir)
    tools = F.array(F.struct(F.lit("lookup").alias("name"), F.col("conv_id").alias("id")))
    return x.select("conv_id", C.tools_text(tools, text=False).alias("shown"), C.tools_text(F.lit(D.TOOLS)).alias("passed"))


@query
def preference_examples(spark, sf_dir):
    m = F.col("messages")
    x = D.preference_pairs(spark, sf_dir).join(D.messages(spark, sf_dir), "conv_id").where(records.ends_with_assistant(m) & (F.get(m, F.lit(0))["role"] == "user"))
    e = prompts.preference_example("llama", F.lit(D.TOOLS), records.context(m), F.col("chosen"), F.col("rejected"))
    return x.select("conv_id", e.alias("e")).select("conv_id", "e.*")


def _evaluated(rows, text):
    return rows.withColumn("c", C.candidate(F.col(text), F.lit(D.TOOLS))).select("*", "c.class", "c.structural_kind", "c.valid", "c.reason")


@query
def initial_summary(spark, sf_dir):
    return summaries.initial_outputs(_evaluated(D.responses(spark, sf_dir), "response"))


@query
def critique_summary(spark, sf_dir):
    x = D.judge_outputs(spark, sf_dir).withColumn("c", judge.critique(F.col("critique_text")))
    valid, missing = F.col("c.valid"), judge.missing_fields(F.col("c"))
    tries = F.when(valid, 1).otherwise(2)
    return summaries.critiques(
        x.select(
            valid.alias("final_valid"),
            tries.alias("attempts"),
            (~valid).alias("fallback_used"),
            F.when(valid, 0).otherwise(2).alias("invalid_attempts"),
            F.when(valid, F.array().cast("array<array<string>>")).otherwise(F.array_repeat(missing, tries)).alias("missing_by_attempt"),
        )
    )


@query
def revision_summary(spark, sf_dir):
    x = D.responses(spark, sf_dir).join(D.judge_outputs(spark, sf_dir), "conv_id").withColumns({"source_row_index": F.col("conv_id"), "c": judge.critique(F.col("critique_text"))})
    out = stages.revised(x, lambda texts, seed: [REVISED] * len(texts), "critique_text", F.col("response"), F.col("c"))
    out = out.drop("c").withColumn("used_original", F.col("revision_used_original_without_generation"))
    return summaries.revisions(_evaluated(out, "revised_output_raw"))


def _response_pairs(spark, sf_dir):
    x = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("example_id"), F.col("turn").alias("attempt"), F.col("text").alias("answer"))
    return records.response_pairs(x)


@query
def response_pairs(spark, sf_dir):
    return _response_pairs(spark, sf_dir)


@query
def pair_summary(spark, sf_dir):
    x = _response_pairs(spark, sf_dir)
    return summaries.pairs(x.withColumns({"class_a": X.response_class(F.col("response_a")), "class_b": X.response_class(F.col("response_b"))}))


@query
def preference_summary(spark, sf_dir):
    return summaries.preferences(dpo_export(spark, sf_dir).withColumn("behavior_class", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")))


@query
def export_summary(spark, sf_dir):
    x = _evaluated(D.responses(spark, sf_dir), "response").withColumn("selected", X.stripped(F.col("response")))
    return summaries.exports(x.withColumn("behavior_class", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")))


@query
def revision_reuse(spark, sf_dir):
    x = D.judge_outputs(spark, sf_dir).withColumn("c", judge.critique(F.col("critique_text")))
    return x.select("conv_id", stages.reuses_original(F.col("c")).alias("reused"))


# --- more metrics and reports


@query
def restricted_metrics(spark, sf_dir):
    return metrics.restricted(joins.overlap(_compared(spark, sf_dir)), "run_key", "pred_norm", "probe", PROBE_LABELS)


@query
def last_sample_wins(spark, sf_dir):
    e = D.eval_samples(spark, sf_dir)
    twice = e.withColumn("at", F.lit(0)).unionByName(e.withColumns({"pred_norm": F.when(F.col("uuid") % 3 == 0, "direct").otherwise(F.col("pred_norm")), "at": F.lit(1)}))
    x = joins.compared(D.probe_preds(spark, sf_dir), twice, ordinal="at")
    return x.groupBy("run_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_norm") == "direct").alias("n_direct"))


@query
def macro_f1_delta(spark, sf_dir):
    x = metrics.summary(metrics.cells(_long(spark, sf_dir), "key", "gold", "pred"), "key", LABELS)
    x = x.withColumns({"run_key": F.substring_index("key", "|", 1), "scoring": F.substring_index("key", "|", -1)})
    wide = report.pivoted(x, ["run_key"], "scoring", ("raw", "normalized"), "macro_f1", "key")
    return wide.withColumn("macro_f1_delta", F.col("normalized") - F.col("raw")).select("run_key", "raw", "normalized", "macro_f1_delta", report.M.percent(F.col("normalized")).alias("percent"))


@query
def pending_panels(spark, sf_dir):
    made = D.run_metrics(spark, sf_dir)
    keys = made.select("run_key").distinct()
    # Runs below the mean accuracy of all are taken for those whose probes are still to come.
    missing = report.missing_keys(made.groupBy("run_key").agg(F.max("accuracy").alias("a")).where(F.col("a") >= made.agg(F.avg("accuracy")).scalar()).select("run_key"), keys)
    rows = report.pending_probes(missing, ("raw", "normalized"), PROBE_LABELS).unionByName(report.placeholders(keys, ("raw",), ("direct",)), allowMissingColumns=True)
    panels = keys.select(F.col("run_key").alias("run_display"), F.upper(F.substring("run_key", 1, 1)).alias("panel"))
    pending = rows.where(~records.real(F.col("is_probe_pending")) & records.scored(F.col("scoring"), "normalized", F.col("label"), PROBE_LABELS))
    return report.with_panels(pending.withColumn("run_display", F.col("run_key")), panels).select("run_key", "scoring", "label", "accuracy", "panel")


@query
def value_counts(spark, sf_dir):
    return report.value_counts(D.table(spark, sf_dir, "events"), "event_type")


@query
def smoke_total(spark, sf_dir):
    return sampling.smoke(D.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, classes=4)
