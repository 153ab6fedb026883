"""Text repair and number parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as page text has it, no-break and other Unicode spaces included.
WS = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


#: The characters that WS stands for.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def trimmed(text: Column) -> Column:
    """``text`` without white space at its ends, Unicode spaces included."""
    return F.btrim(text, F.lit(_SPACES))


def tokens(text: Column) -> Column:
    """The runs between white space; an empty array for blank text."""
    inner = trimmed(text)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{WS}+"))


def repaired_ordinals(text: Column) -> Column:
    """Ordinals that page extraction spaced out: ``1 s t`` to ``1st``, and so on to the fourth."""
    for digit, ending in (("1", "st"), ("2", "nd"), ("3", "rd"), ("4", "th")):
        text = F.regexp_replace(text, rf"\b{digit}\s+{ending[0]}\s+{ending[1]}\b", digit + ending)
    return text


def _number(text: Column, kind: str, cast: str) -> Column:
    plain = F.replace(trimmed(text), F.lit(","), F.lit(""))
    value = F.expr("0").cast(kind)
    parsed = plain.cast(kind) if cast == "cast" else plain.try_cast(kind)
    return F.when(plain.isin("", "-"), value).otherwise(parsed)


def parsed_int(text: Column) -> Column:
    """A count: thousands separators dropped, blank and ``-`` are 0, anything else that is no number is an error."""
    return _number(text, "bigint", "cast")


def parsed_float(text: Column) -> Column:
    return _number(text, "double", "cast")


def tried_int(text: Column) -> Column:
    """Like :func:`parsed_int`, but null instead of an error."""
    return _number(text, "bigint", "try")


def tried_float(text: Column) -> Column:
    return _number(text, "double", "try")


def has_any(text: Column, *needles: str) -> Column:
    """Whether ``text`` holds one of the literal ``needles``."""
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def unit_id(label: Column) -> Column:
    """A herd unit's id without leading zeros: ``E-01`` to ``E-1``."""
    return F.concat(F.lit("E-"), F.regexp_extract(label, r"^E-0*(\d+)$", 1).cast("bigint").cast("string"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
