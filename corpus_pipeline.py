"""A corpus pipeline over `documents`: each stage works on all that the one before kept.

Language ID drops documents in which no language can be named; exact dedup and the near-duplicate join keep one
document of each group; decontamination drops documents with benchmark passages; the rest is encoded to piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignscope.llm.common import stored
from alignscope.llm.decontaminate import decontaminate
from alignscope.llm.exact_dedup import exact_dedup
from alignscope.llm.language_id import held_out, language_id, train
from alignscope.llm.near_dup import jaccard_join
from alignscope.llm.sentencepiece_trie import MODEL_FILE, encode, model_content, round_trip

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose largest language has a smaller share is rejected.
LEAST_SHARE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a number of its own for each row, stored so that every read sees the same one."""
    return stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select("_row"), "_row", "left_semi").select(*COLUMNS)


def name_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter and a language of at least LEAST_SHARE; learns from their labels.

    Every row is decided by its own text where it is read, rows with a null or repeated id too, and repeated rows alike;
    a null or empty text goes. Rows with a null id, text or lang are not learned from. Columns beyond those of documents
    are dropped; an empty table gives an empty table. There is no shuffle but that of the counts learned.
    """
    found = language_id(docs, train(docs.where(~held_out()).select("text", "lang")), carry=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts.

    One row of each text, also where rows repeat an id and text; a row with a null id stays only if no other has an id.
    Null texts are empty ones, so one of them stays; an empty table gives an empty table.
    """
    keyed = _keyed(docs)
    groups = exact_dedup(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    best = keyed.select("doc_id", "_row").join(groups, "_row").groupBy("_group").agg(F.max(F.struct("doc_id", "_row")).alias("_best"))
    return _keep(keyed, best.select("_best._row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of the near-duplicate join.

    One row of each class of texts, whatever ids they repeat; a row with a null id stays only if no other has an id.
    Texts without a word (null and empty ones) have no class and all stay; an empty table gives an empty table.
    """
    keyed = _keyed(docs)
    classes = jaccard_join(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_group"))
    best = keyed.select("doc_id", "_row").join(classes, "_row").groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")).alias("_best"))
    return _keep(keyed, best.select("_best._row"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of a benchmark item; every row is decided by its own text, whatever its id.

    Null and empty texts are clean; repeated rows are decided alike; an empty table of documents or of items drops
    nothing. Documents are not shuffled as long as the items are small enough to be sent to all tasks.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS))
    return found.where("not contaminated").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): the piece ids, and whether they decode to the text; one row per row.

    Null and empty texts have no ids; null and repeated ids are kept as they are; an empty table gives an empty table.
    """
    coded = encode(docs, model_content(MODEL_FILE), decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), round_trip().alias("round_trip"))


STAGES = [
    ("language_id", name_language),
    ("exact_dedup", drop_copies),
    ("near_dup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode_pieces),
]
#: Language ID and the encoding have no SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before kept, written as parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
