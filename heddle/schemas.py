"""Row schemas and label sets that the readers, operators and queries share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Answer labels in display order, the labels a probe tells apart, and classes of plain responses.
LABELS = ("direct", "tool_call", "request_for_info", "cannot_answer")
PROBE_LABELS = ("tool_call", "request_for_info", "cannot_answer")
RESPONSE_CLASSES = ("tool_call", "cannot_answer", "request_for_info", "other_plain_text")
OUTCOMES = ("stay_correct", "fixed", "broken", "stay_wrong")

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
SFT_ROW = T.StructType([T.StructField("tools", T.ArrayType(T.StringType())), T.StructField("messages", MESSAGES)])
PREFERENCE_ROW = T.StructType([*SFT_ROW, T.StructField("chosen_response", MESSAGE), T.StructField("rejected_response", MESSAGE)])
BALANCED_ROW = T.StructType([*SFT_ROW, T.StructField("source_split", T.StringType()), T.StructField("behavior_class", T.StringType())])
EVAL_SAMPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "gold", "pred_raw", "pred_norm")])
MCQ_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "source", "source_id", "question", "tools", "correct_answer")])
FEATURE_ROW = T.StructType(
    [
        T.StructField("example_id", T.StringType()),
        T.StructField("layer_tag", T.StringType()),
        T.StructField("transformer_layer", T.IntegerType()),
        T.StructField("hidden_state_index", T.IntegerType()),
        T.StructField("features", T.ArrayType(T.FloatType())),
        T.StructField("label_id", T.LongType()),
    ]
)
