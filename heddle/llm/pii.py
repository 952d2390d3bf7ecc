"""Personal data and secrets replaced by keyed surrogates of the same type, gender, script and format, with DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest_of, written

#: Entities whose surrogate has been changed for a collision, up to which they go to every task as a literal map; more are
#: joined to the texts that hold them.
MOST_CHANGED = 10_000
#: Attempts after which collisions have to be settled. Every second one lengthens a surrogate by a letter or syllable, so
#: that there are more of them than entities after a few, whatever the corpus holds.
MOST_ATTEMPTS = 64

#: Given names by gender and script, titles by gender, and syllables of surnames by script.
GIVEN = {
    ("f", "latin"): ("Amelia", "Beatrice", "Charlotte", "Dorothea", "Eleanor", "Florence", "Gabriela", "Henriette", "Isabella", "Josephine", "Katharina", "Lorena", "Margaret", "Natalie", "Ophelia", "Patricia", "Rosalind", "Susanne", "Theresa", "Veronica"),
    ("m", "latin"): ("Alexander", "Benjamin", "Christopher", "Dominik", "Edward", "Frederick", "Gustavo", "Heinrich", "Ignacio", "Jonathan", "Konstantin", "Leonard", "Matthias", "Nicholas", "Olivier", "Philippe", "Raphael", "Sebastian", "Theodor", "Wilhelm"),
    ("f", "cyrillic"): ("Анастасия", "Валентина", "Вероника", "Екатерина", "Елизавета", "Людмила", "Маргарита", "Надежда", "Светлана", "Татьяна"),
    ("m", "cyrillic"): ("Александр", "Владимир", "Геннадий", "Дмитрий", "Константин", "Михаил", "Николай", "Станислав", "Тимофей", "Фёдор"),
}
#: More given names by which persons are found.
COMMON = {
    "f": "Aisha Alice Amanda Angela Anna Anne Barbara Birgit Carmen Carol Caroline Catherine Chloe Christine Claire Claudia Deborah Diana Elena Elizabeth Emily Emma Eva Fatima Hannah Helen Irene Jane Jennifer Jessica Julia Karen Kate Laura Lauren Linda Lisa Lucia Lucía Maria María Marie Mei Martina Mary Melissa Monica Nancy Nicole Olga Olivia Petra Priya Rachel Rebecca Rosa Ruth Sabine Sandra Sara Sarah Silvia Sofia Sofía Sophie Stephanie Susan Ursula Yuki".split(),
    "m": "Adam Ahmed Alan Albert Alex André Andreas Andrew Anthony Antonio Arthur Bernd Brian Carlos Charles Christian Daniel David Dennis Dieter Eric Fernando Francisco Frank Gary George Hans Henry Hiroshi Ivan Jack Jacob James Jan Javier Jeffrey John Jorge Jose José Joseph Juan Jürgen Karl Kevin Klaus Larry Louis Lucas Luis Manuel Mark Martin Matthew Michael Miguel Mohammed Oliver Oscar Patrick Paul Pedro Peter Pierre Rahul Richard Robert Roger Ryan Samuel Scott Stefan Stephen Steven Thomas Timothy Walter Wei Werner William Wolfgang".split(),
}
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "": ("Dr", "Doctor", "Doktor", "Prof", "Professor"),
}
SYLLABLES = {
    "latin": ("ba", "den", "cor", "fal", "gar", "hol", "jen", "kar", "lin", "mor", "nel", "pen", "quil", "ros", "sel", "tan", "ver", "wil", "yar", "zan", "bri", "cla", "dro", "stel"),
    "cyrillic": ("бар", "вел", "гор", "дан", "зор", "кал", "лин", "мор", "нов", "пет", "рад", "сол", "тар", "фед", "хор", "цар", "шев", "юр", "яр", "жел", "бел", "крас", "глад", "стар"),
}

#: A word of a name as a whole: inner capitals, apostrophes and hyphens belong to it, and no letter follows.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]?\p{Lu}[\p{Ll}\p{M}]+)*+(?![\p{L}\p{N}\p{M}])"
#: Words in lower case that stand within surnames, and initials.
_PARTICLE = r"(?:van|von|vom|zu|zur|de|del|della|di|da|do|dos|du|der|den|la|le|ten|ter|bin|ibn|al)"
_BETWEEN = rf"(?: \p{{Lu}}\.){{0,3}}(?: {_PARTICLE}\b){{0,3}} "
_TITLE = "|".join(sorted((t for titles in TITLES.values() for t in titles), key=len, reverse=True))
_TITLES = rf"(?:{_TITLE})\b\.?(?: (?:{_TITLE})\b\.?)?"
_FIRSTS = sorted({n for names in (*GIVEN.values(), *COMMON.values()) for n in names}, key=lambda n: (-len(n), n))
_FIRST = "|".join(_FIRSTS)
#: Names written in capitals.
_LOUD, _LOUD_NAME = "|".join(n.upper() for n in _FIRSTS if len(n) > 3 and n not in ("Frank", "Mark")), r"\p{Lu}{2,}(?:[-'’]\p{Lu}{2,})*+(?![\p{L}\p{N}\p{M}])"
#: No name begins within a word, or behind a hyphen or an apostrophe that joins it to one.
_START = r"(?=\p{Lu})(?<![\p{L}\p{N}\p{M}])(?<![\p{L}\p{N}\p{M}][-'’])"
#: The words before a secret. Its value runs to the closing quote, or else to white space or a quote, without the marks
#: that end a sentence; four letters or digits of it at least, as these are what a surrogate replaces.
_PREFIX = (
    r"(?i:(?<![\p{L}\p{N}_-])(?:[a-z0-9]{1,24}+[_-]){0,5}(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"(?:[_-](?:access[_-]?key|key|value|hash|prod|dev|test|[0-9]{1,3})){0,3}[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
    r"|\b(?:password|passphrase)\s{1,3}is:?\s{1,3}(?=[^\s]{0,64}[0-9])[\"']?)"
)
_SECRET = (
    r"(?:(?<=\")(?=(?:[^\"\r\n\p{L}0-9]*[\p{L}0-9]){4})[^\"\r\n]{8,}(?=\"|\z)|(?<=')(?=(?:[^'\r\n\p{L}0-9]*[\p{L}0-9]){4})[^'\r\n]{8,}(?='|\z)"
    r"|(?=(?:[^\s\"'\p{L}0-9]*[\p{L}0-9]){4})[^\s\"']{7,}[^\s\"'.,;:!?)\]}>])"
)
_BEARER = r"(?i:\bbearer)[ \t]{1,3}"
#: Words before a date of birth, and before a name.
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_BIRTH = r"(?i:\b(?:born(?: on)?|date of birth|birth date|birthday|dob|geboren(?: am)?|geburtsdatum|née? le|nacid[oa] el)\b:?\s{1,3})"
_CALLED = r"(?<=\b(?i:my name is|name is|name:|signed by|regards,|sincerely,|dear|attn:|attention:)\s{1,3})"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Words of streets that come before the name, as in French, Spanish and Italian.
_ROAD = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]alle|[Aa]venida|[Vv]ia|[Pp]iazza)"
_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Square)"
#: Types in order of precedence, each with its pattern.
TYPES = {
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\sA-Za-z0-9+/=:,-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "secret": rf"{_PREFIX}{_SECRET}|{_BEARER}(?=[A-Za-z._~+/=-]*\d)[A-Za-z0-9._~+/-]{{16,}}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[abeprs]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{35}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\b(?:sk|pk|rk)[-_](?:[A-Za-z]{2,8}[-_]){0,2}(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{20,}",
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,8}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    # All eight groups, or fewer around a double colon with a digit and a group of three letters or digits among them.
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9])(?=[0-9A-Fa-f]{{0,2}}(?::+[0-9A-Fa-f]{{0,2}})*[0-9A-Fa-f]{{3}})(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}\b|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?\b)",
    "birth": rf"{_BIRTH}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}[./]\d{{2}}[./]\d{{4}}|\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # With a right check digit, which `type_of` looks at.
    "card": r"(?<!\d)(?:\d{13,18}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    # Without a plus or parentheses: three, three and four digits, or a leading 0 and 8 to 12 digits in all, but no date.
    r"|(?<![\p{L}\d.,/-])(?:1[ .-])?[2-9]\d{2}(?: [2-9]\d{2} |-[2-9]\d{2}-|\.[2-9]\d{2}\.)\d{4}(?![.,/-]?\d)"
    # Ten digits in a row only behind a word for it.
    r"|(?=[2-9]\d{9}(?!\d))(?<=\b(?i:phone|tel|telephone|telefon|mobile|cell|fax|call|whatsapp)\b[^\p{L}\d\r\n]{0,4}(?:(?i:is|at|me at|us at)[ :]{1,3})?)[2-9]\d{2}[2-9]\d{6}(?![.,/-]?\d)"
    r"|(?<![\p{L}\d.,/-])(?!\d\d[ ./-]\d\d[ ./-]\d{4}(?!\d))(?=(?:[ ./-]?\d){8,12}(?![ .,/-]?\d))0[1-9]\d{0,3}[ ./-]\d{2,8}(?:[ .-]\d{2,8}){0,4}",
    "address": rf"(?<![\p{{L}}\d.,/-])\d{{1,5}} (?:\p{{Lu}}\p{{Ll}}+ ){{1,3}}{_STREET}\b|(?<![\p{{L}}\d.,/-])\d{{1,5}},? {_ROAD} (?:(?:de|du|des|del|della|di|la|le|les|los|las|dei) ){{0,3}}(?:[dl]['’])?{_NAME}(?: {_NAME}){{0,2}}|\b\p{{Lu}}\p{{Ll}}{{2,}}(?:straße|strasse|gasse|allee) \d{{1,4}}\b",
    "name": rf"{_START}(?:{_TITLES}{_BETWEEN}{_NAME}(?:{_BETWEEN}{_NAME})?|(?:{_FIRST})(?:-\p{{Lu}}\p{{Ll}}+)?(?: (?:{_FIRST}))?{_BETWEEN}{_NAME}(?:{_BETWEEN}(?!(?:{_TITLE})\b){_NAME}(?!:|\.?\s?\d))?|{_CALLED}{_NAME}{_BETWEEN}{_NAME}|(?:{_LOUD})(?: \p{{Lu}}\.){{0,2}} {_LOUD_NAME})",
}
ENTITY = "|".join(f"(?:{p})" for p in TYPES.values())
#: What no entity is without: texts that lack all of them are left alone at the cost of a plain scan.
CUE, NAME_CUE = "[0-9@=:]", rf"\b(?=\p{{Lu}})(?:{_TITLE}|{_FIRST}|{_LOUD})\b|(?i:name is|signed by|regards,|sincerely,|dear) \p{{Lu}}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщэюя"


def may_hold(text: Column) -> Column:
    """Whether a text has a cue of an entity."""
    return text.rlike(CUE) | text.rlike(NAME_CUE)


def type_of(e: Column) -> Column:
    """The first type whose pattern an entity fits as a whole; null for a number that looks like a card or an account, but
    whose check digits are wrong."""
    out = F.when(e.rlike(r"\A\d{10}\z"), "phone").otherwise("name")
    for kind, pattern in reversed(list(TYPES.items())):
        # What stands before a name is no longer there.
        out = F.when(e.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return _let(out, lambda k: F.when((k == "card") & (_luhn(_digits(e)) != 0), None).when((k == "iban") & (_mod97(e) != 1), None).otherwise(k))


def _let(value: Column, body) -> Column:
    """body(value), with `value` worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _keyed(key: str, turn: int, value: Column, below: Column) -> Column:
    """A keyed number from a string, below a power of ten of nine digits at most or another small bound."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{turn}|"), value).cast("binary"), 256)
    return F.conv(digest.substr(F.lit(1), F.lit(15)), 16, 10).cast("long") % below


#: Rounds of the permutations.
TURNS = 6


def permuted(digits: Column, key: str) -> Column:
    """A keyed permutation of the digit strings of each length up to 18: a Feistel network on the halves, to each of which
    keyed hashes of the other are added in turn. Different strings stay different, whatever else the corpus holds."""
    power = lambda x: F.pow(F.lit(10.0), F.length(x)).cast("long")
    padded = lambda n, x: F.lpad(n.cast("string"), F.length(x), "0")

    def turned(turn: int):
        def body(x: Column) -> Column:
            mine, other = ("l", "r") if turn % 2 == 0 else ("r", "l")
            new = (x[mine].cast("long") + _keyed(key, turn, x[other], power(x[mine]))) % power(x[mine])
            halves = {mine: F.when(x[mine] == "", "").otherwise(padded(new, x[mine])), other: x[other]}
            return F.struct(halves["l"].alias("l"), halves["r"].alias("r"))

        return body

    half = F.floor(F.length(digits) / 2).cast("int")
    state = F.struct(F.left(digits, half).alias("l"), digits.substr(half + 1, F.length(digits)).alias("r"))
    for turn in range(TURNS):
        state = _let(state, turned(turn))
    return _let(state, lambda x: F.concat(x["l"], x["r"]))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _refilled(e: Column, digits: Column) -> Column:
    """`e` with its digits replaced in order, all else as it stands."""
    at = lambda i: e.substr(i, F.lit(1))
    place = lambda i: F.length(_digits(e.substr(F.lit(1), i)))
    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(at(i).rlike("[0-9]"), d.substr(place(i), F.lit(1))).otherwise(at(i))), ""))


def _luhn(digits: Column) -> Column:
    digit = lambda turned, i: turned.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    once = lambda d: F.when(d > 9, d - 9).otherwise(d)
    return _let(F.reverse(digits), lambda turned: F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: s + once(digit(turned, i))) % 10)


def _mod97(e: Column) -> Column:
    """An account number modulo 97, with its first four signs moved to the end and letters as numbers from 10."""

    def rest(x: Column) -> Column:
        turned = F.split(F.concat(x.substr(F.lit(5), F.length(x)), F.left(x, F.lit(4))), "")
        worth = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(worth(c) > 9, 100).otherwise(10) + worth(c)) % 97)

    return _let(F.regexp_replace(e, " ", ""), rest)


def _card(e: Column, key: str) -> Column:
    """First digit kept, the check digit as right or wrong as before, the others permuted."""

    def checked(d: Column) -> Column:
        body = F.concat(F.left(d, F.lit(1)), permuted(d.substr(F.lit(2), F.length(d) - 2), key + "card"))
        return _let(body, lambda x: F.concat(x, F.pmod(_luhn(d) - _luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return _refilled(e, _let(_digits(e), checked))


def _phone(e: Column, key: str) -> Column:
    """Country code and the first digit after it kept, the others permuted."""
    country = F.length(_digits(F.regexp_extract(e, r"\A(\+\d{1,3})?", 0)))
    d = _digits(e)
    # Numbers written without separators have a country code of one digit or more; one is kept.
    kept = F.least(F.greatest(country, F.lit(0)), F.length(d) - 4) + 1
    return _refilled(e, F.concat(F.left(d, kept), permuted(d.substr(kept + 1, F.length(d) - kept), key + "phone")))


def _ssn(e: Column, key: str) -> Column:
    return _refilled(e, permuted(_digits(e), key + "ssn"))


def _ip(e: Column, key: str) -> Column:
    """First octet kept, the other 24 bits permuted, by halves as digits are."""
    parts = F.split(e, r"\.")
    n = parts[1].cast("long") * 65536 + parts[2].cast("long") * 256 + parts[3].cast("long")

    def turned(turn: int):
        def body(x: Column) -> Column:
            mine, other = ("l", "r") if turn % 2 == 0 else ("r", "l")
            new = (x[mine] + _keyed(key + "ip", turn, x[other].cast("string"), F.lit(4096))) % 4096
            return F.struct(*[(new if k == mine else x[k]).alias(k) for k in ("l", "r")])

        return body

    state = F.struct(F.floor(n / 4096).cast("long").alias("l"), (n % 4096).alias("r"))
    for turn in range(TURNS):
        state = _let(state, turned(turn))
    joined = lambda x: x["l"] * 4096 + x["r"]
    octets = lambda m: F.concat_ws(".", parts[0], F.floor(m / 65536).cast("string"), (F.floor(m / 256) % 256).cast("string"), (m % 256).cast("string"))
    return _let(_let(state, joined), octets)


def _birth(e: Column, key: str) -> Column:
    """All dates are moved by the same keyed number of days, in their own format; dates that there are not stay."""
    head = F.regexp_extract(e, rf"\A(?:{_BIRTH})", 0)
    moved = F.lit(400 + int(hashlib.sha256(f"{key}|birth".encode()).hexdigest(), 16) % 4000)

    def spelled(x: Column) -> Column:
        """A date with its month as a word, in the first of the formats that reads it."""
        told = F.lit(None).cast("string")
        for form in reversed(("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy")):
            read = F.try_to_timestamp(x, F.lit(form)).cast("date")
            told = F.coalesce(F.date_format(F.date_add(read, moved), form), told)
        return F.coalesce(told, F.lit("1 January 1970"))

    def shown(x: Column) -> Column:
        return F.when(x.rlike(_MONTH), spelled(x)).otherwise(numbers(x))

    def numbers(x: Column) -> Column:
        iso = x.rlike(r"\A\d{4}")
        point = x.substr(F.lit(3), F.lit(1))
        day = F.when(iso, x).otherwise(F.concat(x.substr(F.lit(7), F.lit(4)), F.lit("-"), x.substr(F.lit(4), F.lit(2)), F.lit("-"), x.substr(F.lit(1), F.lit(2))))
        new = F.date_add(F.coalesce(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date")), moved)
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), point, F.date_format(new, "MM"), point, F.date_format(new, "yyyy")))

    return F.concat(head, _let(e.substr(F.length(head) + 1, F.length(e)), shown))


def _digest(value: Column, key: str, attempt: Column) -> Column:
    """128 keyed bytes in hexadecimal."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(f"{key}{k}"), attempt.cast("string"), value).cast("binary"), 256) for k in range(4)])


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(digest.substr((i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choices: str | tuple, n: Column) -> Column:
    if isinstance(choices, str):
        return F.lit(choices).substr(n % len(choices) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), n % len(choices) + 1)


def _lettered(e: Column, digest: Column) -> Column:
    """Each letter or digit replaced by one of its kind, all else as it stands; what is hexadecimal stays so."""
    hexadecimal = e.rlike(r"\A[0-9a-f]+\z")

    def swap(c: Column, at: Column) -> Column:
        b = _byte(digest, at + 1)
        return (
            F.when(c.rlike("[0-9]"), _pick(_DIGITS, b))
            .when(hexadecimal, _pick("abcdef", b))
            .when(c.rlike("[a-z]"), _pick(_LOWER, b))
            .when(c.rlike("[A-Z]"), _pick(_UPPER, b))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(_CYRILLIC, b))).otherwise(_pick(_CYRILLIC, b)))
            .when(c.rlike(r"\p{Lu}"), _pick(_UPPER, b))
            .when(c.rlike(r"\p{L}"), _pick(_LOWER, b))
            .otherwise(c)
        )

    return F.when(F.length(e) == 0, "").otherwise(F.array_join(F.transform(F.split(e, ""), swap), ""))


def _growth(digest: Column, attempt: Column) -> Column:
    """A letter more for every two attempts."""
    more = F.floor(attempt / 2).cast("int")
    return F.when(more < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: _pick(_LOWER, _byte(digest, i + 70))), ""))


def _email(e: Column, key: str, attempt: Column) -> Column:
    """Everything but the last label and the punctuation replaced; case of letters doesn't tell addresses apart."""
    tail = F.regexp_extract(e, r"\.[^.]*\z", 0)
    return _let(_digest(F.lower(e), key + "email", attempt), lambda d: F.concat(_growth(d, attempt), _lettered(F.left(e, F.length(e) - F.length(tail)), d), tail))


def _secret(e: Column, key: str, attempt: Column) -> Column:
    head = F.regexp_extract(e, rf"\A(?:{_PREFIX}|{_BEARER})", 0)
    value = e.substr(F.length(head) + 1, F.length(e))
    return _let(F.struct(value.alias("v"), _digest(value, key + "secret", attempt).alias("d")), lambda x: F.concat(head, _lettered(x["v"], x["d"]), _growth(x["d"], attempt)))


def _pem(e: Column, key: str, attempt: Column) -> Column:
    """The lines that begin and end a key stay."""
    head, tail = F.regexp_extract(e, r"\A-----[A-Z ]+-----", 0), F.regexp_extract(e, r"-----[A-Z ]+-----\z", 0)
    body = e.substr(F.length(head) + 1, F.length(e) - F.length(head) - F.length(tail))
    return _let(_digest(e, key + "pem", attempt), lambda d: F.concat(head, _lettered(body, d), _growth(d, attempt), tail))


def _api_key(e: Column, key: str, attempt: Column) -> Column:
    return _let(_digest(e, key + "key", attempt), lambda d: F.concat(F.left(e, F.lit(4)), _lettered(e.substr(F.lit(5), F.length(e)), d), _growth(d, attempt)))


def _ip6(e: Column, key: str, attempt: Column) -> Column:
    """Groups keep their lengths and get other hexadecimal signs, the first of each not 0. An attempt more changes them all."""
    swap = lambda d: lambda c, at: F.when(c.rlike("[0-9A-Fa-f]"), _pick("123456789abcdef", _byte(d, at + 1))).otherwise(c)
    return _let(_digest(F.lower(e), key + "ip6", attempt), lambda d: F.array_join(F.transform(F.split(e, ""), swap(d)), ""))


def _iban(e: Column, key: str, attempt: Column) -> Column:
    """Country and spaces kept, the account replaced sign by sign, its check digits right."""

    def checked(x: Column) -> Column:
        body = F.concat(F.left(x["v"], F.lit(2)), F.lit("00"), _lettered(x["v"].substr(F.lit(5), F.length(x["v"])), x["d"]))
        return _let(body, lambda y: F.concat(F.left(y, F.lit(2)), F.lpad((98 - _mod97(y)).cast("string"), 2, "0"), y.substr(F.lit(5), F.length(y))))

    def spaced(y: Column) -> Column:
        at = lambda i: F.length(F.replace(e.substr(F.lit(1), i), F.lit(" "), F.lit("")))
        sign = lambda i: F.when(e.substr(i, F.lit(1)) == " ", " ").otherwise(y.substr(at(i), F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), sign), "")

    whole = _let(F.replace(e, F.lit(" "), F.lit("")), lambda v: F.struct(v.alias("v"), _digest(v, key + "iban", attempt).alias("d")))
    return _let(_let(whole, checked), spaced)


def _address(e: Column, key: str, attempt: Column) -> Column:
    """Letters and digits replaced; the word for a street, and the order of its parts, stay."""
    road = F.regexp_extract(e, rf"\A\d+,? {_ROAD} (?:\p{{Ll}}+ )*(?:[dl]['’])?", 0)
    behind = lambda d: F.concat(_lettered_digits(road, d), _lettered(e.substr(F.length(road) + 1, F.length(e)), d), _growth(d, attempt))
    kept = F.regexp_extract(e, rf"(?: {_STREET}|(?:straße|strasse|gasse|allee) \d+)\z", 0)
    before = lambda d: F.concat(_lettered(F.left(e, F.length(e) - F.length(kept)), d), _growth(d, attempt), F.when(kept.rlike("[0-9]"), _lettered_digits(kept, d)).otherwise(kept))
    return _let(_digest(e, key + "address", attempt), lambda d: F.when(road != "", behind(d)).otherwise(before(d)))


def _lettered_digits(e: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(e, ""), lambda c, at: F.when(c.rlike("[0-9]"), _pick(_DIGITS, _byte(digest, at + 60))).otherwise(c)), "")


def _gender(title: Column, first: Column) -> Column:
    """f or m by a title, or else by a given name; null where neither tells."""
    by_title = F.when(title.rlike(rf"\A(?:{'|'.join(TITLES['f'])})\b"), "f").when(title.rlike(rf"\A(?:{'|'.join(TITLES['m'])})\b"), "m")
    first = F.initcap(F.substring_index(first, "-", 1))
    named = {g: [*GIVEN[g, "latin"], *GIVEN[g, "cyrillic"], *COMMON[g]] for g in "fm"}
    return F.coalesce(by_title, F.when(first.isin(*named["f"]), "f").when(first.isin(*named["m"]), "m"))


def _parts(e: Column) -> Column:
    """struct(title, first, middle, last) of a name; the given name is empty where there is none, and a name that begins
    with initials or particles has them in the middle."""
    title = F.regexp_extract(e, rf"\A{_TITLES} ", 0)
    given = lambda w: (F.size(w) > 1) & ~w[0].rlike(rf"\A(?:\p{{Lu}}\.|{_PARTICLE})\z")

    def cut(x: Column) -> Column:
        w, n = x["w"], F.when(given(x["w"]), 2).otherwise(1)
        return F.struct(x["t"].alias("title"), F.when(given(w), w[0]).otherwise("").alias("first"), F.slice(w, n, F.greatest(F.size(w) - n, F.lit(0))).alias("middle"), F.element_at(w, -1).alias("last"))

    return _let(F.struct(title.alias("t"), F.split(e.substr(F.length(title) + 1, F.length(e)), " ").alias("w")), cut)


#: Syllables of a surname; more come with attempts.
WIDTH = 3


def _name(e: Column, key: str, attempt: Column) -> Column:
    """Title kept; a given name becomes another of its gender and script; a surname gets syllables of its script, and capitals
    if it has nothing else. Surnames are replaced by themselves, so that a person is the same with and without a given
    name. Particles stay; initials are moved on in the alphabet, by a number of places that the surname tells."""

    def chosen(x: Column, n: Column, gender: Column) -> Column:
        pick = lambda g: F.when(x["cyrillic"], _pick(GIVEN[g, "cyrillic"], n)).otherwise(_pick(GIVEN[g, "latin"], n))
        return F.when(gender == "f", pick("f")).otherwise(pick("m"))

    def given(x: Column) -> Column:
        gender = F.coalesce(_gender(x["title"], x["first"]), F.when(_byte(x["d"], F.lit(9)) % 2 == 0, "f").otherwise("m"))
        return F.when(x["first"] == "", "").otherwise(F.concat(chosen(x, _byte(x["d"], F.lit(3)), gender), F.lit(" ")))

    def middle(x: Column) -> Column:
        by = 1 + _byte(x["s"], F.lit(90)) % 25
        initial = lambda w: F.concat(F.chr((F.ascii(w) - 65 + by) % 26 + 65), F.lit("."))
        # A further given name becomes another, whatever its gender, by its letters.
        more = lambda w, k: chosen(x, _byte(_digest(w, key + "given", attempt), k), F.lit("f"))
        one = lambda w, k: F.when(w.rlike(r"\A[A-Z]\.\z"), initial(w)).when(w.rlike(rf"\A{_PARTICLE}\z"), w).otherwise(more(w, k))
        return F.when(F.size(x["middle"]) == 0, "").otherwise(F.concat(F.array_join(F.transform(x["middle"], one), " "), F.lit(" ")))

    def surname(x: Column) -> Column:
        at = lambda k: _byte(x["s"], k * 5) * 256 + _byte(x["s"], k * 5 + 1)
        syllable = lambda k: F.when(x["cyrillic"], _pick(SYLLABLES["cyrillic"], at(k))).otherwise(_pick(SYLLABLES["latin"], at(k)))
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + WIDTH), syllable), ""))

    def named(x: Column) -> Column:
        digests = F.struct(x["title"].alias("title"), x["first"].alias("first"), x["middle"].alias("middle"), e.rlike(r"\p{IsCyrillic}").alias("cyrillic"), _digest(F.initcap(x["first"]), key + "given", attempt).alias("d"), _digest(F.initcap(x["last"]), key + "surname", attempt).alias("s"))
        return _let(digests, lambda y: F.concat(y["title"], given(y), middle(y), surname(y)))

    return _let(_let(_parts(e), named), lambda out: F.when(e.rlike(r"\A[^\p{Ll}]+\z"), F.upper(out)).otherwise(out))


#: Types whose surrogates are hashed, and so may collide; the others' are permuted.
_HASHED = {"pem": _pem, "secret": _secret, "key": _api_key, "email": _email, "ip6": _ip6, "iban": _iban, "address": _address, "name": _name}
HASHED = tuple(_HASHED)


def hashed_surrogate(e: Column, kind: Column, key: str, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, make in _HASHED.items():
        out = F.when(kind == name, make(e, key, attempt)).otherwise(out)
    return out


def surrogate(e: Column, kind: Column, key: str, attempt: Column) -> Column:
    """What replaces an entity; itself where it has no type."""
    return (
        F.when(kind.isin(*HASHED), hashed_surrogate(e, kind, key, attempt))
        .when(kind == "ip", _ip(e, key))
        .when(kind == "birth", _birth(e, key))
        .when(kind == "ssn", _ssn(e, key))
        .when(kind == "card", _card(e, key))
        .when(kind == "phone", _phone(e, key))
        .otherwise(e)
    )


def canonical(e: Column, kind: Column) -> Column:
    """What makes two spellings one entity: case of addresses, separators of numbers, the words before a secret, and of a
    title its gender."""
    person = lambda x: F.concat_ws("|", F.coalesce(_gender(x["title"], x["first"]), F.lit("")), F.concat_ws(" ", F.nullif(x["first"], F.lit("")), x["middle"], x["last"]))
    return (
        F.when(kind.isin("ssn", "card", "phone"), _digits(e))
        .when(kind.isin("email", "ip6"), F.lower(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", F.regexp_replace(e, rf"\A(?:{_PREFIX}|{_BEARER})", ""))
        .when(kind == "name", _let(_parts(e), person))
        .otherwise(e)
    )


def entities(docs: DataFrame) -> DataFrame:
    """(kind, value, entity) of each distinct entity: its canonical value, and the least of its spellings."""
    found = docs.where(may_hold(F.col("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("entity"))
    found = found.groupBy("entity").agg(F.lit(1)).select("entity").withColumn("kind", type_of(F.col("entity"))).where("kind is not null")
    return found.withColumn("value", canonical(F.col("entity"), F.col("kind"))).groupBy("kind", "value").agg(F.min("entity").alias("entity"))


def changes(found: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the entities whose surrogate isn't the first: with these, no two entities have the same
    surrogate, and no surrogate is an entity of the corpus.

    Numbers are permuted and cannot collide with one another; one that maps onto another entity's value is no harm
    to distinctness, as that one moves on as well. The others are hashed: of those that meet, all but the one with the
    fewest attempts and the least value take the next attempt, until none meet; later attempts are longer, so none
    fights for a shape that is used up. Distinct entities are compared by their surrogates' groups, not in pairs, and
    an entity that has found its place is not worked out again."""
    hashed = written(found.where(F.col("kind").isin(*HASHED)).select("kind", "value", "entity"), "pii-hashed")
    taken = hashed.select("kind", F.col("value").alias("out"))
    out = lambda: canonical(hashed_surrogate(F.col("entity"), F.col("kind"), key, F.col("attempt")), F.col("kind"))
    settled = hashed.sparkSession.createDataFrame([], "kind string, value string, attempt int, out string")
    left = hashed.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        now = written(left.withColumn("out", out()), "pii-surrogates")
        # Groups of one surrogate are of any size where a shape is used up; only their least value is kept, map-side first.
        first = now.join(settled.select("kind", "out"), ["kind", "out"], "left_anti").join(taken, ["kind", "out"], "left_anti")
        first = first.groupBy("kind", "out").agg(F.min("value").alias("value"))
        won = written(first, "pii-won")
        settled = written(settled.unionByName(now.join(won, ["kind", "out", "value"]).select("kind", "value", "attempt", "out")), "pii-settled")
        left = written(now.join(won, ["kind", "value"], "left_anti").select("kind", "value", "entity", (F.col("attempt") + 1).alias("attempt")), "pii-left")
        if left.isEmpty():
            return settled.where("attempt > 0").select("kind", "value", "attempt")
    raise RuntimeError(f"surrogates still collide after {MOST_ATTEMPTS} attempts")


def _marked(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """`docs` with __attempts, a map from kind|value to the attempt of the text's changed entities (null: none). Changed
    entities are joined to the texts that hold them, by digest; a map is no larger than its text."""
    digest = digest_of(F.col("text"))
    held = docs.where(may_hold(F.col("text"))).select(digest.alias("__sha"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))).alias("e"))
    held = held.withColumn("kind", type_of(F.col("e"))).where("kind is not null").withColumn("value", canonical(F.col("e"), F.col("kind")))
    held = held.join(changed, ["kind", "value"]).select("__sha", F.concat_ws("|", "kind", "value").alias("k"), "attempt").distinct()
    maps = written(held.groupBy("__sha").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("__attempts")), "pii-maps")
    maps = F.broadcast(maps) if maps.count() <= MOST_CHANGED else maps
    return docs.withColumn("__sha", digest).join(maps, "__sha", "left").drop("__sha")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """`docs` (text, and what else it has) with entities in text replaced, and n_entities and n_<type> for each type.

    Equal entities, however spelled, get equal surrogates in all documents under one `key`, different ones
    different surrogates; text around them stays as it is. Numbers that look like cards or accounts but have wrong check
    digits are no entities. Null text stays null and has no entities. Repeated rows change alike; an empty table gives no
    rows. Columns of `docs` with the new names are replaced. Whoever knows the key can tell numbers from their surrogates.

    One pass finds the distinct entities, whose table alone is shuffled to settle collisions; another rewrites each
    text in place."""
    docs = docs.drop("n_entities", *[f"n_{k}" for k in TYPES])
    changed = written(changes(written(entities(docs), "pii-entities"), key), "pii-changed")
    few = changed.limit(MOST_CHANGED + 1).collect()
    if len(few) > MOST_CHANGED:
        docs, attempts = _marked(docs, changed), F.col("__attempts")
    else:
        attempts = F.create_map(*[F.lit(x) for r in sorted(few) for x in (f"{r['kind']}|{r['value']}", r["attempt"])]) if few else None

    def swapped(x: Column) -> Column:
        e, kind = x["e"], x["kind"]
        attempt = F.coalesce(F.element_at(attempts, F.concat(kind, F.lit("|"), canonical(e, kind))), F.lit(0)) if attempts is not None else F.lit(0)
        return _let(attempt, lambda a: F.struct(kind.alias("kind"), surrogate(e, kind, key, a).alias("out")))

    has = may_hold(F.col("text"))
    typed = F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), lambda e: F.struct(e.alias("e"), type_of(e).alias("kind")))
    x = docs.withColumn("__found", F.when(has, F.transform(typed, swapped)))
    gaps = F.split("text", ENTITY, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("__found.out", i), F.lit(""))))
    x = x.withColumn("text", F.when(has, F.array_join(pieces, "")).otherwise(F.col("text")))
    kinds = F.coalesce(F.filter("__found.kind", lambda k: k.isNotNull()), F.array().cast("array<string>"))
    counts = {"n_entities": F.size(kinds).cast("long")}
    for kind in TYPES:
        counts[f"n_{kind}"] = F.size(F.filter(kinds, lambda k: k == kind)).cast("long")  # noqa: B023
    return x.withColumns(counts).drop("__found", "__attempts")
