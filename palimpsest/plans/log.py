"""The mutation log: rows (key, value, tid, seq), where an empty value is a deletion.

tid is the logical time of a write and seq its place within one tid. There is no null in the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

LOG = StructType([StructField("key", StringType(), False), StructField("value", StringType(), False), StructField("tid", LongType(), False), StructField("seq", LongType(), False)])
TOMBSTONE = ""


def checked(df: DataFrame) -> DataFrame:
    """df as a log: the four columns, cast; a null in any of them fails the query that meets it."""

    def sound(name: str, kind: str) -> Column:
        c = F.col(name).cast(kind)
        return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"a mutation log has no null {name}"))).alias(name)

    return df.select(sound("key", "string"), sound("value", "string"), sound("tid", "long"), sound("seq", "long"))


def puts(df: DataFrame, tid: int, key: str = "key", value: str = "value", seq: str | None = None) -> DataFrame:
    """A batch of writes under one tid; seq names the column that orders rows of one key (default: none, 0)."""
    return checked(df.select(F.col(key).alias("key"), F.col(value).alias("value"), F.lit(tid).alias("tid"), (F.col(seq) if seq else F.lit(0)).alias("seq")))


def deletes(df: DataFrame, tid: int, key: str = "key") -> DataFrame:
    """A batch of deletions under one tid."""
    return puts(df.select(F.col(key).alias("key"), F.lit(TOMBSTONE).alias("value")), tid)


def oversized(log: DataFrame, limit: int = 65_535) -> DataFrame:
    """Rows that a format with 16-bit lengths can't hold."""
    return log.where((F.octet_length("key") > limit) | (F.octet_length("value") > limit))
