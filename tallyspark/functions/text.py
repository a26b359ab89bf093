"""Column helpers for strings, decimals, dates and JSON. All run on the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"  # for arithmetic; comparisons for equality use ``amount_key``


def strip(c: Column) -> Column:
    """Trim every kind of white space (``trim`` only knows the space character)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def quote(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(words: Iterable[str]) -> str:
    return ", ".join(quote(w) for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when ``c`` holds one of the words as a substring: one pass, one alternation."""
    special = set(r"\.^$|?*+()[]{}")
    escaped = ["".join("\\" + ch if ch in special else ch for ch in w) for w in words]
    return c.rlike("|".join(escaped)) if escaped else F.lit(False)


def squash(c: Column) -> Column:
    """Lower-case with everything but letters and digits removed."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def value_tokens(c: Column) -> Column:
    """White-space split, squashed, blanks dropped; order and repeats kept."""
    return F.filter(F.transform(F.split(c, r"\s+"), squash), lambda t: t != "")


NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$"


def amount_key(c: Column) -> Column:
    """Normalised text of an amount: equal for equal numbers of any size, null for what is no number.

    Every step reads the one before it once, so the expression stays small; pin ``c`` if it is large itself.
    """
    text = strip(c)
    # exponents are rare; written out they compare like plain numbers, as far as a decimal holds them
    plain = F.when(F.lower(text).contains("e"), F.coalesce(text.try_cast(MONEY).cast("string"), F.upper(text))).otherwise(text)
    steps = ((r"^\+", ""), (r"^(-?)0+", "$1"), (r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)(?=\.|$)", "$10"), (r"^-0$", "0"))
    for pattern, replacement in steps:  # sign, leading and trailing zeros, a zero before the point, no minus zero
        plain = F.regexp_replace(plain, pattern, replacement)
    return F.when(text.rlike(NUMBER), plain)


def iso_date(c: Column) -> Column:
    """Date from the first ten characters, only when they are a padded ISO date."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def title_case(c: Column) -> Column:
    return F.initcap(c)


def humanise(c: Column) -> Column:
    spaced = F.lower(F.translate(c, "_", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def number_text(c: Column) -> Column:
    """Shortest decimal text of a confidence, e.g. ``0.7``."""
    return c.cast("string")


def token_type(variant: Column) -> Column:
    """Upper-case JSON token type of a variant value, without its nested schema."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def variant_text(variant: Column) -> Column:
    """Text of a JSON scalar: fractions print in shortest double form, the rest as written."""
    kind = token_type(variant)
    raw = variant.cast("string")
    return F.when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"),
                  raw.try_cast("double").cast("string")).otherwise(raw)


def case_map(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup as a constant map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), c)
    return hit if default is None else F.coalesce(hit, default)


def base64_text(binary: Column) -> Column:
    """One-line base64 (Spark's ``base64`` breaks lines every 76 characters)."""
    return F.regexp_replace(F.base64(binary), r"\s", "")


def base64url_text(binary: Column) -> Column:
    return F.translate(base64_text(binary), "+/=", "-_")


def base64url_bytes(c: Column) -> Column:
    """Bytes of unpadded base64url text, null when malformed."""
    std = F.translate(c, "-_", "+/")
    padded = F.concat(std, F.repeat(F.lit("="), F.pmod(-F.length(std), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64"))


def utf8_text(binary: Column) -> Column:
    """UTF-8 text with malformed sequences replaced."""
    return F.make_valid_utf8(binary.cast("string"))


def strip_fences(c: Column) -> Column:
    """Remove a ``` fence (and its language tag) around model text."""
    stripped = F.regexp_replace(c, r"^\s+|\s+$", "")
    opened = F.regexp_replace(stripped, r"^```[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"```$", "")
    return F.when(stripped.startswith("```"),
                  F.regexp_replace(closed, r"^\s+|\s+$", "")).otherwise(stripped)
