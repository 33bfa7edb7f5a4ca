"""Words and lines as Spark expressions; all of them stay in the JVM."""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
#: bytes that end a word of `alnum_words`, as a regular expression class
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def ascii_lower(c: Column) -> Column:
    """A to Z only; `lower` does the same, faster, where all is ASCII."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(c, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(c))


def words(text: Column) -> Column:
    """The `[^\\x20\\x09-\\x0D]+` runs in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.array_remove(F.split(trimmed, "[\\x20\\x09-\\x0D]+"), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of ASCII digits and letters and of any other characters beyond ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
