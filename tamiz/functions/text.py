"""Column expressions for values: normalisation chains, shapes, masks, CSV safety."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value".
EMPTY_LIKE = ["", "N/A", "NA", "n/a", "-", "NULL", "null", "#N/A", "#REF!", "S/D", "s/d"]
CHAINS = ("exact", "basic", "digits")


@lru_cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")


def norm_exact(c: Column) -> Column:
    return c.cast("string")


def norm_basic(c: Column) -> Column:
    """Lower case without accents, everything but letters and digits collapsed to single blanks; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(strip_accents(c.cast("string"))), "[^a-z0-9]+", " ")), F.lit(""))


def norm_digits(c: Column) -> Column:
    """Digits only, without leading zeros; empty is null."""
    return F.nullif(F.ltrim(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit("0")), F.lit(""))


def normalise(c: Column, chain: str) -> Column:
    return {"exact": norm_exact, "basic": norm_basic, "digits": norm_digits}[chain](c)


def pattern_shape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c.cast("string"), "[0-9]", "9"), "[A-Za-zÁÉÍÓÚÑáéíóúñ]", "A")


def is_empty_like(c: Column) -> Column:
    return F.trim(c).isin(EMPTY_LIKE)


def mask(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) <= 1, "•••").otherwise(F.concat(F.substring(t, 1, 1), F.lit("•••"), F.when(F.length(t) > 8, F.right(t, F.lit(1))).otherwise("")))


def mask_value(v: object) -> str:
    t = str(v).strip()
    return "•••" if len(t) <= 1 else t[0] + "•••" + (t[-1] if len(t) > 8 else "")


def csv_safe(c: Column) -> Column:
    """Keeps spreadsheet programs from reading a text as a formula."""
    return F.when(c.rlike("^[=+@]") | c.rlike("^-[^0-9.]"), F.concat(F.lit("'"), c)).otherwise(c)
