"""Benchmark reports: CSV in and out, and a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESULT = "benchmark string, variant string, ops_per_sec double, p50_us double, p95_us double, p99_us double, p999_us double"


def write_csv(results: DataFrame, path: str) -> None:
    results.selectExpr(*[c.split()[0] for c in RESULT.split(", ")]).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=RESULT, header=True)


def markdown(summary: DataFrame) -> str:
    """A summary of a few rows as a Markdown table."""
    rows = [list(map(str, r)) for r in summary.collect()]
    lines = [summary.columns, ["---"] * len(summary.columns), *rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
