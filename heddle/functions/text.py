"""Columns that classify and reshape response text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, in a class that Java and RE2 read alike.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"
_EDGE = r"[^\p{L}\p{N}_]"


def worded(phrases: tuple[str, ...]) -> str:
    """A pattern that finds any of the phrases between word boundaries."""
    return rf"(^|{_EDGE})({'|'.join(phrases)})($|{_EDGE})"


#: Phrases of refusals and of requests for information.
REFUSALS = ("sorry", "apologies", "apologize", "apologise", "cannot", "can't", "unable")
REQUESTS = ("could you", "can you", "please provide", "please specify", "what is", "what's", "which", "to assist you better", "just to confirm", "do you have", "may i have")
#: How a tool call is tagged.
OPEN, CLOSE = "<TOOLCALL>", "</TOOLCALL>"
PAYLOAD = rf"(?s){OPEN}(.*?){CLOSE}"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def payload(c: Column, otherwise: str = "text") -> Column:
    """What stands in the first tagged call, stripped; without one, the stripped text or null."""
    rest = stripped(c) if otherwise == "text" else F.lit(None).cast("string")
    return F.when(c.rlike(PAYLOAD), stripped(F.regexp_extract(c, PAYLOAD, 1))).otherwise(rest)


def has_marker(c: Column) -> Column:
    """Whether a text is tagged as a call or its payload begins like JSON."""
    p = payload(c)
    return F.coalesce(c.contains(OPEN) | p.startswith("{") | p.startswith("["), F.lit(False))


def refuses(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(worded(REFUSALS)), F.lit(False))


def asks(c: Column) -> Column:
    """Whether a text asks for information. The text is lower-cased before the marker is looked for, so an upper-case
    tag doesn't count here."""
    low = stripped(F.lower(F.coalesce(c, F.lit(""))))
    return ~has_marker(low) & ~refuses(low) & (low.endswith("?") | low.rlike(worded(REQUESTS)))


def response_class(c: Column) -> Column:
    """tool_call, cannot_answer, request_for_info or other_plain_text, the first that holds."""
    return F.when(has_marker(c), "tool_call").when(refuses(c), "cannot_answer").when(asks(c), "request_for_info").otherwise("other_plain_text")


def preview(messages: Column, size: int = 240) -> Column:
    """role: content of each message on one line, cut to `size`."""
    each = F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit(": "), F.replace(F.coalesce(m["content"], F.lit("")), F.lit("\n"), F.lit(" "))))
    return F.left(F.array_join(each, " | "), F.lit(size))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1_000_000)))


def conversation(messages: Column) -> Column:
    """A line `Role: content` for each message."""
    role = lambda m: F.when(F.coalesce(m["role"], F.lit("")) == "", "Unknown").otherwise(capitalized(m["role"]))
    return F.array_join(F.transform(messages, lambda m: F.concat(role(m), F.lit(": "), stripped(F.coalesce(m["content"], F.lit(""))))), "\n")


def question(messages: Column) -> Column:
    """Messages as a question: the text of a single user's message, else a line `Role: content` for each, where a message
    without a role is a user's."""
    role = lambda m: capitalized(stripped(F.coalesce(m["role"], F.lit("user"))))
    content = lambda m: stripped(F.coalesce(m["content"], F.lit("")))
    lines = stripped(F.array_join(F.transform(messages, lambda m: F.concat(role(m), F.lit(": "), content(m))), "\n"))
    first = F.get(messages, F.lit(0))
    return F.when((F.size(messages) == 1) & (first["role"] == "user"), content(first)).otherwise(lines)


def filled(template: Column | str, **values: Column) -> Column:
    """A template with {{KEY}} replaced, one key after the other, so a value may itself hold a later key."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def latex(c: Column) -> Column:
    """LaTeX specials escaped, the backslash first; the braces that this adds are escaped once more."""
    out = F.replace(c, F.lit("\\"), F.lit("\\textbackslash{}"))
    for special in "_&%#${}":
        out = F.replace(out, F.lit(special), F.lit("\\" + special))
    return out


def slug(*parts: str | None) -> str:
    """A snapshot's folder name: non-empty parts, slashes doubled into underscores."""
    return "__".join(p.replace("/", "__") for p in parts if p)
