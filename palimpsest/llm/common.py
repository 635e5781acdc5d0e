"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.files import shared_folder


def position(df: DataFrame, name: str) -> int:
    """Which column has this name: the first that is spelt so, else the first but for upper and lower case."""
    for names, wanted in ((df.columns, name), ([c.lower() for c in df.columns], name.lower())):
        if wanted in names:
            return names.index(wanted)
    raise ValueError(f"no column {name} among {', '.join(df.columns)}")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names that clash, or clash with an operator's own, don't matter."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, each under its new name."""
    plain = numbered(df)
    return plain.select(*(plain[f"c{position(df, name)}"].alias(new) for new, name in wanted.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made inside each open `scratch`, innermost last.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and every executor see; an open `scratch` deletes it at its end."""
    path = shared_folder(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """What operators write to shared folders in here is deleted at the end: results must have been written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        delete(spark, *_MADE.pop())


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df once to the shared folder and return the rereading frame: lineage ends there.

    Lost executors then cost a reread of Parquet rather than a recomputation. The folder stays for as long as the frame
    may be read: until the `scratch` around it ends, else for the folder's owner to clear.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_id: str = "doc_id") -> DataFrame:
    """(out_id, text as UTF-8 bytes); all other columns are dropped, so their names can't clash."""
    return pick(df, **{out_id: id_col, "text": text_col}).withColumn("text", F.col("text").cast("binary"))


def emit(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 8 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about most_bytes of `column`; a longer single row is its own slice."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        sizes = [0 if n is None else n for n in pa.compute.binary_length(sizes).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
