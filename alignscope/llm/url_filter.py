"""URL filter: host/path rules, and logistic regression on hashed character n-grams for what no rule judges.

The regression learns from a small table of labelled urls. The query's is LABELLED, which rules and tables have no part
in; other tables are cut to `train_rows` urls by a hash of the url, so that the choice does not depend on the order of rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

# Words in the names of sites that corpora leave out, and of sites that they keep.
UNWANTED = "casino poker slots bets betting jackpot lottery pills viagra pharmacy adult xxx porn sex escort webcam dating loans payday crypto miner warez torrent crack keygen replica phishing malware clickbait giveaway".split()
WANTED = "news press journal library museum school college university science physics history recipes kitchen garden weather climate travel railway football chess music theatre books poetry maps city council health clinic software manual".split()
#: How names are put together: the same ways for both kinds, so that only the words tell them apart.
HOSTS, PATHS = ["www.{}.example.com", "{}-online.example.org", "my{}.test", "m.best-{}.example.net"], ["/", "/en/{}.html", "/de/7", "/fr/12/?page=2"]


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 to block). Wanted names come with every path, unwanted ones with one, as they are rarer."""
    good = [(f"https://{h.format(w)}{p.format(i)}", 0) for i, w in enumerate(WANTED) for h in HOSTS for p in PATHS]
    return good + [(f"https://{h.format(w)}{PATHS[(i + j) % len(PATHS)].format(i)}", 1) for i, w in enumerate(UNWANTED) for j, h in enumerate(HOSTS)]


def host_and_path(url: str) -> tuple:
    """Columns of the host (A-Z lower-cased) and path of a url column; both empty for null or where no :// is."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rules(df: DataFrame, rules=None) -> DataFrame:
    """Adds rule (host + path of the longest that fits, else null) and rule_verdict to a frame with host and path."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in reversed(rules):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def features(host: str, path: str, bits: int = 14, sizes=(2, 3, 4)) -> np.ndarray:
    """Distinct buckets (1 and up, 0 is the intercept) of the character n-grams of host and path; the two never share an n-gram."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            for i in range(len(text) - n + 1):
                found.add(1 + zlib.crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % ((1 << bits) - 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(rows: list[tuple[str, str, int]], bits: int = 14, epochs: int = 200, rate: float = 0.3, decay: float = 0.02) -> np.ndarray:
    """Weights by full-batch gradient descent with per-weight step sizes; rows: (host, path, 1 to block).

    The score of a url is the intercept and the sum of its n-grams' weights over the square root of their number. The
    intercept alone is not held down by decay, so a url of unknown n-grams is judged by how frequent the labels are.
    """
    w = np.zeros(1 << bits)
    if not rows:
        return w
    x = [features(h, p, bits) for h, p, _ in rows]
    col = np.concatenate(x)
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    scale = 1 / np.sqrt(np.array([len(v) for v in x]))
    y = np.array([r[2] for r in rows], float)
    squares = np.full(len(w), 1e-8)
    for _ in range(epochs):
        z = w[0] + np.bincount(row, w[col], len(x)) * scale
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, (err * scale)[row], len(w)) + decay * w / len(y)
        g[0] = err.sum()
        squares += g * g
        w -= rate * g / np.sqrt(squares)
    return np.round(w, 9)


def labelled_sample(urls: DataFrame, train_rows: int) -> list[tuple[str, str, int]]:
    """At most train_rows distinct (host, path, label) of a frame with host, path and label, by hash order."""
    rows = urls.select("host", "path", "label").distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(train_rows).collect()
    return sorted((r.host, r.path, int(r.label)) for r in rows)


def score(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds p_block, the probability that a frame's host and path are to be blocked."""
    bits = len(weights).bit_length() - 1

    @F.pandas_udf("double")
    def p_block(host: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(host, path, strict=True):
            if key not in known:
                f = features(*key, bits)
                known[key] = float(1 / (1 + np.exp(-np.clip(weights[0] + weights[f].sum() / np.sqrt(len(f)), -30, 30))))
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return df.withColumn("p_block", p_block("host", "path"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None, labels: DataFrame | None = None, train_rows: int = 4000) -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict, p_block).

    verdict is the longest fitting rule's, else block where p_block >= 0.5. labels: (url, label 1 to block) to learn
    from, of which train_rows distinct ones are taken; without it, urls that a rule judges are the labels. With nothing to learn from every p_block is 0.5,
    hence block. A null url has an empty host and path, and the regression judges it. Repeated rows are judged
    alike; an empty table gives an empty table; other columns are not read.
    """
    host, path = host_and_path("_url")
    df = match_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path")), rules)
    if labels is None:
        known = df.where("rule is not null").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("label"))
    else:
        h, p = host_and_path("_url")
        known = labels.where("url is not null and label is not null").select(F.col("url").alias("_url"), "label").select(h.alias("host"), p.alias("path"), "label")
    weights = train(labelled_sample(known, train_rows))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return score(df, weights).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def brute_force(pages: list[tuple[int, str | None]], labels: list[tuple[str, int]], rules=None, bits: int = 14) -> list[tuple]:
    """What url_filter returns (p_block unrounded): a url at a time, n-gram by n-gram, with the weights of train()."""

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[end:]
        stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
        return "".join(c.lower() if c in UPPER else c for c in rest[:end]), path[:stop]

    def grams(host, path):
        out = set()
        for mark, t in (("h", "^" + host + "$"), ("p", "^" + path + "$")):
            out |= {mark + t[i:j] for i in range(len(t)) for j in range(i + 2, i + 5) if j <= len(t)}
        return {1 + zlib.crc32(g.encode("utf-8", "surrogatepass")) % (2**bits - 1) for g in out}

    weights = train(sorted({(*parts(u), y) for u, y in labels}), bits)
    out = []
    for page, url in pages:
        host, path = parts(url)
        fits = [(len(h + p), h + p, v) for h, p, v in (RULES if rules is None else rules) if ("." + host).endswith("." + h) and path.startswith(p)]
        _, rule, said = max(fits, default=(0, None, None))
        g = grams(host, path)
        p_block = 1 / (1 + math.exp(-weights[0] - sum(weights[i] for i in sorted(g)) / math.sqrt(len(g))))
        out.append((page, host, path, rule, said or ("block" if p_block >= 0.5 else "allow"), p_block))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels=spark.createDataFrame(labelled_urls(), "url string, label int"))
