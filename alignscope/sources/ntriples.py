"""N-Triples: a graph as a set of lines with reversible IRIs and plain literals, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import literals as L


def _escaped(c):
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def lines(rel: DataFrame, attr: DataFrame, kind: str = "e") -> DataFrame:
    """(value): the distinct statements of one graph; empty literals are left out, literals lose their type."""
    iri = lambda c, k: F.concat(F.lit("<"), L.to_iri(F.col(c), k), F.lit(">"))
    edges = rel.select(F.concat_ws(" ", iri("head", kind), iri("relation", "r"), iri("tail", kind), F.lit(".")).alias("value"))
    text = L.value(F.col("literal"))
    values = attr.where((F.col("literal") != "") & (text != "")).select(F.concat_ws(" ", iri("head", kind), iri("attribute", "a"), F.concat(F.lit('"'), _escaped(text), F.lit('"')), F.lit(".")).alias("value"))
    return edges.union(values).distinct()


def write(rel: DataFrame, attr: DataFrame, path: str, kind: str = "e") -> int:
    """Writes the statements below path; returns how many."""
    lines(rel, attr, kind).write.mode("overwrite").text(path)
    return rel.sparkSession.read.text(path).count()


STATEMENT = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"([^"\\]*+(?:\\.[^"\\]*+)*+)") \.$'


def read(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object, is_literal) with IRIs mapped back."""
    part = lambda i: F.regexp_extract("value", STATEMENT, i)
    is_literal = part(3) == ""
    quoted = L.value(F.concat(F.lit('"'), part(4), F.lit('"')))
    return spark.read.text(path).where(F.col("value").rlike(STATEMENT)).select(L.from_iri(part(1)).alias("subject"), L.from_iri(part(2)).alias("predicate"), F.when(is_literal, quoted).otherwise(L.from_iri(part(3))).alias("object"), is_literal.alias("is_literal"))


def classify_objects(attr: DataFrame) -> DataFrame:
    """One row: how many literals are valid, invalid (unbalanced quotes), empty or ill-typed."""
    raw = F.col("literal")
    quoted = raw.startswith('"')
    bad = quoted & ~raw.rlike(L.LITERAL)
    return attr.agg(F.count_if(~bad & (raw != "")).alias("n_valid"), F.count_if(bad).alias("n_invalid"), F.count_if(raw == "").alias("n_empty"), F.count_if(L.is_ill_typed(raw)).alias("n_ill_typed"), F.count_if(~quoted & (raw != "")).alias("n_unquoted"))


#: A statement as the format has it: IRIs or blank nodes, and literals with a language or a type.
LINE = r'^\s*(?:<[^<>"{}|^`\\\x00-\x20]*>|_:\S+)\s+<[^<>"{}|^`\\\x00-\x20]*>\s+(?:<[^<>"{}|^`\\\x00-\x20]*>|_:\S+|"[^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>"{}|^`\\\x00-\x20]*>)?)\s*\.\s*(?:#.*)?$'


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, n_lines, n_statements, parses) of files: whether every line that is neither empty nor a comment is a statement."""
    out = None
    for path in paths:
        t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
        row = t.agg(F.count("*").alias("n_lines"), F.count_if(F.col("value").rlike(LINE)).alias("n_statements")).select(F.lit(path).alias("path"), "*", (F.col("n_lines") == F.col("n_statements")).alias("parses"))
        out = row if out is None else out.union(row)
    return out


def store_comparison(statements: DataFrame, pair_side: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: statements and subjects read back from N-Triples beside the distinct triples and heads of the frames they came from."""
    rel, attr = pair_side
    heads = rel.select("head").union(attr.where("literal <> ''").select("head")).distinct()
    triples = rel.distinct().groupBy().agg(F.count("*").alias("rel")).crossJoin(attr.where("literal <> ''").distinct().groupBy().agg(F.count("*").alias("attr")))
    back = statements.groupBy().agg(F.count("*").alias("n_statements"), F.countDistinct("subject").alias("n_subjects"))
    return back.crossJoin(triples).crossJoin(heads.groupBy().agg(F.count("*").alias("n_heads"))).select("n_statements", "n_subjects", (F.col("rel") + F.col("attr")).alias("n_triples"), "n_heads")
