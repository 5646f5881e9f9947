"""Text helpers: Unicode form, lines, previews, escaping, templates."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the size limit in bytes that services put on sources and previews.
SERVICE_LIMIT = 512 * 1024

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# Everything below U+0300 is already composed, so only other text goes to Python.
_COMPOSED = "^[\\u0000-\\u02ff]*$"


def nfc(column) -> Column:
    """NFC form of a text column (Arrow UDF; Spark has no built-in).

    The function is local so that it travels to the executors by value.
    """

    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.pandas_udf(compose, StringType())(_col(column))


def with_nfc(df: DataFrame, *columns: str) -> DataFrame:
    """Normalize columns once at ingest, sending only rows that need it through Python."""
    needs = F.lit(False)
    for name in columns:
        needs = needs | F.coalesce(~F.col(name).rlike(_COMPOSED), F.lit(False))
    plain = df.where(~needs)
    others = df.where(needs)
    for name in columns:
        others = others.withColumn(name, nfc(name))
    return plain.unionByName(others)


def logical_line_count(text) -> Column:
    return F.length(_col(text)) - F.length(F.translate(_col(text), "\n", "")) + 1


def escape_html(text) -> Column:
    # the ampersand goes first so that it does not touch the others' output
    result = _col(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        result = F.replace(result, F.lit(raw), F.lit(entity))
    return result


def has_interpolation(text) -> Column:
    """``${X}`` or ``$X``, but not the escaped ``$$``."""
    return _col(text).rlike(r"(?<!\$)\$(?:\{[^}]*\}|[A-Za-z_][A-Za-z0-9_]*)")


def strip_discriminator(name) -> Column:
    return F.regexp_replace(_col(name), r"#\d+$", "")


def producer_parts(producer, separator: str = "@") -> Column:
    """(name, version) split at the last separator; version is empty without one."""
    producer = _col(producer)
    found = producer.contains(separator)
    version = F.substring_index(producer, separator, -1)
    name = producer.substr(F.lit(1), F.length(producer) - F.length(version) - len(separator))
    return F.struct(
        F.when(found, name).otherwise(producer).alias("name"), F.when(found, version).otherwise("").alias("version")
    )


def import_binding(referent) -> Column:
    """(specifier, imported, local); null unless all three parts are there."""
    parts = F.split(_col(referent), r"\|", 3)
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")
    return F.when(good, F.struct(parts[0].alias("specifier"), parts[1].alias("imported"), parts[2].alias("local")))


def retry_delay(attempt, ceiling: int = 60) -> Column:
    """Seconds to wait after an attempt: doubling up to the ceiling."""
    # beyond 2**6 the ceiling holds, so the power cannot overflow
    return F.least(F.pow(F.lit(2), F.least(_col(attempt), F.lit(6))).cast("long"), F.lit(ceiling))
