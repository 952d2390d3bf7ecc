"""Columns that read a judge's written verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Issues that a critique may name, and the shapes of the judge's lines.
ISSUES = ("should_have_called_tool", "missing_required_information", "tools_insufficient", "invented_tool_or_arguments", "direct_answer_when_tool_required", "wrong_tool", "unsupported_arguments", "bad_tool_call_format")
VERDICT = r"(?i)Verdict:\s*(NO_ISSUES|ISSUES)"
ISSUE = r"(?i)Primary Issue:\s*([^\n]+)"
CRITIQUE = r"(?is)Critique:\s*(.+)"
WINNER = r"(?i)Winner:\s*([AB])"
REASON = r"(?is)Reason:\s*(.+)"


def _found(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def critique(text: Column) -> Column:
    """struct(valid, verdict, primary_issue, critique, raw_text)."""
    raw = stripped(F.coalesce(text, F.lit("None")))
    verdict, issue, body = F.upper(_found(raw, VERDICT)), stripped(_found(raw, ISSUE)), stripped(_found(raw, CRITIQUE))
    fits = F.when(verdict == "NO_ISSUES", issue == "none").when(verdict == "ISSUES", issue.isin(*ISSUES)).otherwise(F.lit(False))
    valid = F.coalesce(fits & issue.isNotNull() & body.isNotNull(), F.lit(False))
    return F.struct(valid.alias("valid"), verdict.alias("verdict"), issue.alias("primary_issue"), body.alias("critique"), raw.alias("raw_text"))


def preference(text: Column) -> Column:
    """struct(valid, winner, reason, raw_text)."""
    raw = stripped(F.coalesce(text, F.lit("None")))
    winner, reason = F.upper(_found(raw, WINNER)), stripped(_found(raw, REASON))
    valid = F.coalesce(winner.isin("A", "B") & (reason != ""), F.lit(False))
    return F.struct(valid.alias("valid"), winner.alias("winner"), reason.alias("reason"), raw.alias("raw_text"))


def missing_fields(c: Column) -> Column:
    """Names of the critique fields that are absent or don't fit."""
    no_verdict = ~F.coalesce(c["verdict"].isin("NO_ISSUES", "ISSUES"), F.lit(False))
    issue = c["primary_issue"].isNull() | F.coalesce((c["verdict"] == "NO_ISSUES") & (c["primary_issue"] != "none"), F.lit(False)) | F.coalesce((c["verdict"] == "ISSUES") & ~c["valid"], F.lit(False))
    no_body = F.coalesce(c["critique"], F.lit("")) == ""
    return F.array_compact(F.array(F.when(no_verdict, "Verdict"), F.when(issue, "Primary Issue"), F.when(no_body, "Critique")))


#: The sentences of a critique that stands in for one that could not be read.
FAILED, FIELDS = "Critique parsing failed.\n", "Missing or invalid fields: "
USE_SAID = ".\nUse the constitution and any useful critique content below to rewrite the response correctly."
USE_RULES = ".\nUse the constitution to rewrite the response correctly."
ALL_FIELDS = "Verdict, Primary Issue, Critique"


def fallback_critique(attempts: Column, parsed: Column) -> Column:
    """Text that stands in for a critique none of whose attempts could be read: the fields missing from invalid attempts
    and what the attempts said."""
    said = F.filter(F.transform(attempts, lambda t: stripped(F.coalesce(t, F.lit("")))), lambda t: t != "")
    fields = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parsed, lambda p: ~p["valid"]), missing_fields))))
    named = F.when(F.size(fields) > 0, F.array_join(fields, ", ")).otherwise("unknown")
    head = F.concat(F.lit(FAILED + FIELDS), named, F.lit(USE_SAID))
    tail = F.array_join(F.transform(said, lambda t, i: F.concat(F.lit("\nAttempt "), (i + 1).cast("string"), F.lit(" raw critique:\n"), t)), "")
    return F.when(F.size(said) == 0, FAILED + FIELDS + ALL_FIELDS + USE_RULES).otherwise(F.concat(head, tail))
