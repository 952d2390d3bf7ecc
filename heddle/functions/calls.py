"""Tool calls and tool specifications in JSON, read in the JVM. Calls that aren't plain JSON are left to the parser of toolcall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CLOSE, OPEN, PAYLOAD, stripped

#: A JSON string, and blanks outside of strings.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BLANKS = rf"(?s)({_STRING})|[ \t\r\n]++"
#: What is left of JSON without its strings and words, and numbers in it that might be spelled otherwise once they are read:
#: long ones, negative zeros, and fractions that are long or end in 0.
_BARE, _UNSURE = r"\A[\[\]{}:,0-9.\-]*+\z", r"[0-9]{16}|[0-9]{10}\.|-0(?![.0-9])|\.[0-9]{4}|\.[0-9]*0(?![0-9])"
_CALL = r'(?s)\A\{"name":"([^"\\\x00-\x1F]*+)","(?:arguments|parameters)":(\{.*\}|null)\}\z'


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compact(text: Column) -> Column:
    """A JSON text without blanks outside of strings."""
    return F.regexp_replace(text, _BLANKS, "$1")


def _certain(body: Column) -> Column:
    """Whether a compact text holds nothing that reading and writing JSON would spell otherwise."""
    rest = F.regexp_replace(body, rf"(?s){_STRING}|true|false|null", "")
    return ~body.rlike(r"\\[u/]") & _let(rest, lambda r: r.rlike(_BARE) & ~r.rlike(_UNSURE))


def _read(text: Column) -> Column:
    """A JSON value; null if the text isn't one, or holds a key twice."""
    return F.try_parse_json(text)


def _whole(body: Column) -> Column:
    """Whether a compact text of certain spelling is one JSON value and nothing else: written again with sorted keys it has as
    many characters."""
    return F.coalesce(F.length(F.to_json(_read(body))) == F.length(body), F.lit(False))


def native_call(text: Column) -> Column:
    """struct(name, arguments, canonical) of a single call in JSON, tagged or not, by itself or in a list: what toolcall.parse
    makes of it, worked out without Python. Null for all other texts, and for the few whose spelling Python might change
    (escapes by number, long numbers, fractions that end in 0, other keys than name and arguments or their order)."""
    body = compact(F.when(text.rlike(PAYLOAD), stripped(F.regexp_extract(text, PAYLOAD, 1))).otherwise(stripped(text)))
    one = _let(body, lambda b: F.when(b.rlike(r"(?s)\A\[\{.*\}\]\z"), F.substring(b, F.lit(2), F.length(b) - 2)).otherwise(b))

    def told(name: Column, given: Column) -> Column:
        arguments = F.when(given == "null", "{}").otherwise(given)
        canonical = F.concat(F.lit(f'{OPEN}{{"name":"'), name, F.lit('","arguments":'), arguments, F.lit(f"}}{CLOSE}"))
        return F.when(_whole(given), F.struct(name.alias("name"), arguments.alias("arguments"), canonical.alias("canonical")))

    call = lambda o: _let(F.regexp_extract(o, _CALL, 1), lambda name: _let(F.regexp_extract(o, _CALL, 2), lambda given: told(name, given)))
    return _let(one, lambda o: F.when(o.rlike(_CALL) & _certain(o), call(o)))


def parsed_calls(rows: DataFrame, text: str, out: str = "call") -> DataFrame:
    """`rows` with struct(name, arguments, canonical) of the call that each text makes. JSON is read in the JVM; Python gets
    the texts that this doesn't settle, and nulls for the others."""
    from .toolcall import parsed_call

    told = rows.withColumn("__native", native_call(F.col(text)))
    told = told.withColumn("__rest", parsed_call(F.when(F.col("__native").isNull(), F.col(text))))
    return told.withColumn(out, F.coalesce("__native", "__rest")).drop("__native", "__rest")


def tools_key(tools: Column) -> Column:
    """Tool specifications (JSON text of a list) in a form that doesn't depend on spacing, or on the order of tools or keys:
    an object of the tools by name, the last of a name. A tool may be a JSON text itself; entries without a name are left out,
    and what isn't a list gives an empty object. Numbers count by value, so 1.0 is 1; an object that holds a key twice isn't
    read."""
    items = F.try_variant_get(_read(tools), "$", "array<variant>")
    items = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", _read(F.try_variant_get(v, "$", "string"))).otherwise(v))
    named = F.transform(items, lambda v: F.struct(F.to_json(F.try_variant_get(v, "$.name", "variant")).alias("name"), F.to_json(v).alias("text")))
    named = F.filter(named, lambda x: x["name"].isNotNull())
    last = lambda a: F.filter(a, lambda x, k: ~F.exists(F.slice(a, k + 2, F.greatest(F.size(a), F.lit(1))), lambda y: y["name"] == x["name"]))
    shown = F.transform(F.array_sort(_let(named, last)), lambda x: F.concat(x["name"], F.lit(":"), x["text"]))
    return F.coalesce(F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")), F.lit("{}"))
