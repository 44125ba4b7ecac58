"""Where a run's artefacts go: long scalars, tables and predictions, all through Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """csv with a header, json or parquet; a directory of part files."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt in ("json", "parquet"):
        getattr(writer, fmt)(path)
    else:
        raise ValueError(f"Unknown format {fmt!r}")


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.schema("e1 string, e2 string, score double").option("header", True).option("nullValue", "\x00").csv(path)


def read_scores(spark, path: str) -> DataFrame:
    return spark.read.schema(SCORES).option("header", True).csv(path)


SCORES = "dataset string, matcher string, split string, n_gold long, n_unmatched long, n_predicted long, n_correct long, n_false_on_unmatched long, precision double, recall double, f1 double, hits_at_1 double, coverage double, abstain_rate double, runtime_s double"
