"""A pair of knowledge graphs over the star-schema tables, for data that has no graph form of its own.

kg1 holds all rows; kg2 leaves out some customers and attributes, has names of its own, and turns one relation round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KGPair

LEFT, RIGHT = "http://left.example/", "http://right.example/resource/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _iri(kg: str, kind: str, key) -> object:
    return F.concat(F.lit(f"{LEFT}{kind}/" if kg == "kg1" else f"{RIGHT}{kind.upper()}_"), key.cast("string"))


def _name(kg: str, left: str, right: str):
    return F.lit(f"{LEFT}p/{left}" if kg == "kg1" else f"{RIGHT}ontology#{right}")


def missing(key):
    """Customers that the right graph does not have."""
    return (key * 7 + 3) % 11 == 0


class TablesLoader:
    supported_formats = ("parquet",)

    def __init__(self, supplied: bool = True, keep: Callable[[DataFrame, str], DataFrame] | None = None):
        """keep: how to hold the distinct pairs of part and supplier, which are all that is not read off the tables row by row."""
        self.supplied = supplied
        self.keep = keep or (lambda df, label: df)

    def load(self, spark: SparkSession, path: str) -> KGPair:
        t = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in ("nation", "customer", "supplier", "part", "orders", "lineitem")}
        if self.supplied:
            t["supplied"] = self.keep(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "supplied")
        rel, attr = [], []
        for kg in ("kg1", "kg2"):
            c = t["customer"] if kg == "kg1" else t["customer"].where(~missing(F.col("c_custkey")))
            o = t["orders"] if kg == "kg1" else t["orders"].where(~missing(F.col("o_custkey")))
            rel += self._rel(kg, t, c, o)
            attr += self._attr(kg, t, c, o)
        return KGPair("tables", _all(rel), _all(attr), self._align(t))

    def _rel(self, kg: str, t: dict[str, DataFrame], c: DataFrame, o: DataFrame) -> list[DataFrame]:
        def triples(df, head, relation, tail):
            return df.select(F.lit(kg).alias("kg"), head.alias("head"), relation.alias("relation"), tail.alias("tail"))

        iri = lambda kind, col: _iri(kg, kind, F.col(col))
        customer, order = iri("c", "o_custkey"), iri("o", "o_orderkey")
        lines = t["lineitem"] if kg == "kg1" else t["lineitem"].where(F.col("l_linenumber") != 7)
        out = [
            triples(c, iri("c", "c_custkey"), _name(kg, "inNation", "country"), iri("n", "c_nationkey")),
            triples(t["supplier"], iri("s", "s_suppkey"), _name(kg, "inNation", "country"), iri("n", "s_nationkey")),
            triples(t["nation"], iri("n", "n_nationkey"), _name(kg, "inRegion", "partOf"), iri("r", "n_regionkey")),
            triples(o, order, _name(kg, "placedBy", ""), customer) if kg == "kg1" else triples(o, customer, _name(kg, "", "hasOrder"), order),
            triples(lines, iri("o", "l_orderkey"), _name(kg, "contains", "item"), iri("p", "l_partkey")),
            triples(c, iri("c", "c_custkey"), F.lit(TYPE), F.concat(F.lit(f"{LEFT}t/"), F.lower("c_mktsegment")) if kg == "kg1" else F.concat(F.lit(f"{RIGHT}T_"), "c_mktsegment")),
            triples(t["part"], iri("p", "p_partkey"), F.lit(TYPE), F.concat(F.lit("http://types.example/"), F.replace("p_type", F.lit(" "), F.lit("_")))),
        ]
        if self.supplied:
            out.append(triples(t["supplied"], iri("p", "l_partkey"), _name(kg, "availableFrom", "vendor"), iri("s", "l_suppkey")))
        return out

    def _attr(self, kg: str, t: dict[str, DataFrame], c: DataFrame, o: DataFrame) -> list[DataFrame]:
        left = kg == "kg1"

        def triples(df, head, attribute, literal, key):
            df = df if left else df.where(F.col(key) % 5 != 0)
            return df.select(F.lit(kg).alias("kg"), head.alias("head"), attribute.alias("attribute"), literal.alias("literal"))

        iri = lambda kind, col: _iri(kg, kind, F.col(col))
        text = lambda col: F.concat(F.lit('"'), F.col(col) if left else F.lower(col), F.lit('"'))
        typed = lambda v, kind: F.concat(F.lit('"'), v, F.lit(f'"^^<{XSD}{kind}>'))
        cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        return [
            triples(c, iri("c", "c_custkey"), _name(kg, "name", "label"), text("c_name"), "c_custkey"),
            triples(c, iri("c", "c_custkey"), _name(kg, "balance", "saldo"), typed(cents, "integer"), "c_custkey"),
            triples(c, iri("c", "c_custkey"), _name(kg, "segment", "sector"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"@en')), "c_custkey"),
            triples(t["supplier"], iri("s", "s_suppkey"), _name(kg, "name", "label"), text("s_name"), "s_suppkey"),
            triples(t["part"], iri("p", "p_partkey"), _name(kg, "name", "label"), text("p_name"), "p_partkey"),
            triples(t["part"], iri("p", "p_partkey"), _name(kg, "size", "size"), F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"')), "p_partkey"),
            triples(o, iri("o", "o_orderkey"), _name(kg, "date", "datum"), typed(day, "date"), "o_orderkey"),
            triples(o, iri("o", "o_orderkey"), _name(kg, "priority", "urgency"), F.col("o_orderpriority"), "o_orderkey"),
        ]

    def _align(self, t: dict[str, DataFrame]) -> DataFrame:
        parts = []
        for kind, table, key in (("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("p", "part", "p_partkey")):
            k = F.col(key)
            e2 = F.when(missing(k), "").otherwise(_iri("kg2", kind, k)) if kind == "c" else _iri("kg2", kind, k)
            split = F.when(k % 10 <= 1, "train").when(k % 10 == 2, "valid").otherwise("test")
            parts.append(t[table].select(_iri("kg1", kind, k).alias("e1"), e2.alias("e2"), split.alias("split")))
        return _all(parts)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out
