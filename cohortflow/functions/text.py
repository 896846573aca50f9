"""String decoding of entity values (JVM-side column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token decoding applied to every text value after flattening,
# applied in exactly this order (literal replacements, except the one regex).
# Kept as-is for identical results, including the known lossy cases
# ("x_2018" -> "x 18", "a_2f_b" -> "a_b").
DECODE_STEPS = [
    ("_2d", "-", False),
    ("_2f", "/", False),
    ("_20", " ", False),
    (" _", " ", False),
    (" +", " ", True),
    ("-_", "-", False),
    ("- ", "-", False),
    ("_28_", "(", False),
    ("_2e_", ".", False),
    ("_29_", ")", False),
    ("/_", "_", False),
]
# Fixed value: characters stripped from both ends at the end of decoding.
TRIM_CHARS = " \t\r\n"




def _changes(c: Column) -> Column:
    """True for every value the decoding could change: only text with an underscore,
    a double space, "- ", or whitespace at either end is affected by any step."""
    cond = c.contains("_") | c.contains("  ") | c.contains("- ")
    for ch in TRIM_CHARS:
        cond = cond | c.startswith(ch) | c.endswith(ch)
    return cond


def clean_string(c: Column | str) -> Column:
    """Decode tokens and trim; NULL stays NULL."""
    src = F.col(c) if isinstance(c, str) else c
    col = src
    for search, repl, is_regex in DECODE_STEPS:
        if is_regex:
            col = F.regexp_replace(col, search, repl)
        else:
            col = F.replace(col, F.lit(search), F.lit(repl))
    return F.when(_changes(src), F.btrim(col, F.lit(TRIM_CHARS))).otherwise(src)


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (F.btrim(c, F.lit(TRIM_CHARS)) != "")


# Spellings that count as missing for a categorical value.
MISSING_SPELLINGS = ["None", ""]


def is_missing_categorical(c: Column) -> Column:
    return c.isNull() | c.isin(*MISSING_SPELLINGS)
