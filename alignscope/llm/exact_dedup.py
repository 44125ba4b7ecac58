"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of every task find the digests that may be frequent; their exact counts are then taken,
and the verified winners (at most `capacity` of them) are broadcast, so that their rows are labelled without a
shuffle. All other digests go through an ordinary shuffle, in which no group can exceed 2 * rows / capacity rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lean, stored


def normalised(text: str):
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def misra_gries(capacity: int):
    """Summary of a task's `digest` column: at most `capacity` (digest, n), n no more than the true count.

    Batches are pre-counted, and a full table is lowered by its (capacity + 1)-th largest count, which is the
    batched form of the decrement step: what a digest loses is at most rows / (capacity + 1).
    """

    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > capacity:
                n = np.fromiter(held.values(), np.int64, len(held))
                less = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
                held = {k: v - less for k, v in held.items() if v > less}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return lean(run)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
    group. Of equal texts the row with the largest id stays. Rows that repeat an id together with its text are
    counted as rows and all carry the same decision; a null id is never the one that stays unless its group has no
    other, and then keep_id is null and nothing of that group is kept. An empty table gives an empty table. Only the
    two named columns are read.
    """
    digests = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(text_col), 256).alias("digest")), "digests")
    rows = digests.count()
    summed = digests.select("digest").mapInArrow(misra_gries(capacity), "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    # the summaries' counts add up to `rows` at most, so fewer than `capacity` digests pass, and every digest with more
    # than 2 * rows / capacity rows is one of them
    found = summed.where(F.col("n") * capacity > rows).select("digest")
    frequent = digests.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = stored(frequent, "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    same = W.partitionBy("digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"keep_id": F.max("doc_id").over(same), "group_size": F.count("*").over(same)})
    both = heavy.select(*light.columns).unionByName(light)
    return both.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
