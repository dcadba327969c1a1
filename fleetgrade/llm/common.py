"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six ASCII white-space characters that separate words (fixed by the contracts).
SPACE = r"[ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda variable holds its value, whereas a column used twice may be inlined
    and computed again, inside another lambda once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; the empty text has none."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased (``bytes.split`` knows just the six separators)."""
    return text.encode().lower().split() if text else []


def remainder(modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
                  F.lit(modulus).cast("bigint"))
