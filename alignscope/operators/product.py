"""Best entries of a product of two sparse matrices, made row by row in the tasks: products are never moved or stored.

Left rows (x, keys, vals) are cut into tiles, ranges of x. A tile gets the right rows (key, ids, vals) of its keys, and a
range of ids apart where these are many; of each left row its few best ids leave the task.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

#: What a tile holds at most, about: products, left entries, right entries; and the ids of a right row.
PRODUCTS, LEFT, RIGHT, IDS = 600_000_000, 4_000_000, 12_000_000, 1 << 18
#: Products made at once, unless a single row has more.
_AT_ONCE = 1_000_000


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of every run, one run after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def summed(rows: np.ndarray, keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sum of vals), by row and key."""
    order = np.lexsort((keys, rows))
    rows, keys, vals = rows[order], keys[order], vals[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.add.reduceat(vals, first) if len(first) else vals


def lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its k best: by rounded score, then by id."""
    scores = np.round(scores, 9)
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    at = np.arange(len(rows))
    first = np.maximum.accumulate(np.where(np.r_[True, rows[1:] != rows[:-1]], at, 0)) if len(rows) else at
    best = at - first < k
    return rows[best], ids[best], scores[best]


def _best_dense(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of positive entries that can be among a row's k best: the k best of maxima of blocks bound them."""
    n, width = total.shape
    at_least = np.zeros(n)
    if (blocks := width // 64) > k:
        tops = total[:, : blocks * 64].reshape(n, blocks, 64).max(axis=2)
        at_least = np.partition(tops, blocks - k, axis=1)[:, blocks - k] - 2e-9
    rows, cols = np.nonzero((total >= at_least[:, None]) & (total > 0))
    return rows, cols, total[rows, cols]


def _tile(batches, k: int):
    """The k best of every left row of one tile."""
    held: tuple[list, list] = ([], [])
    for t in batches:
        for side in (0, 1):
            some = t.filter(pc.equal(t.column("side"), side))
            if some.num_rows:
                vals = some.column("vals").flatten().to_numpy(zero_copy_only=False)
                keys = some.column("keys").flatten().to_numpy(zero_copy_only=False)
                held[side].append((some.column("k").to_numpy(), pc.list_value_length(some.column("keys")).to_numpy().astype(np.int64), keys, vals))
    if not held[0] or not held[1]:
        return
    (key, n, ids, vals), (x, n_x, keys_x, vals_x) = (tuple(np.concatenate([h[i] for h in some]) for i in range(4)) for some in held)
    held[0].clear(), held[1].clear()
    # right rows by key, one run of entries for each key
    order = np.argsort(key, kind="stable")
    at = spread((np.cumsum(n) - n)[order], n[order])
    ids, vals = ids[at], vals[at]
    known, col = np.unique(ids, return_inverse=True)
    col = col.astype(np.int32)
    del ids, at
    keys, first = np.unique(key[order], return_index=True)
    ends = np.r_[0, np.cumsum(n[order])]
    start, stop = ends[first], ends[np.r_[first[1:], len(order)]]
    # entries of left rows whose key the right side has
    at = np.minimum(np.searchsorted(keys, keys_x), len(keys) - 1)
    count = np.where(keys[at] == keys_x, stop[at] - start[at], 0)
    start_x, row_x = start[at], np.repeat(np.arange(len(x)), n_x)
    begins = np.r_[0, np.cumsum(n_x)]
    done = np.r_[0, np.cumsum(count)][begins]
    i, width = 0, len(known)
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(done, done[i] + _AT_ONCE, "right")) - 1)
        dense = width <= 8 * (done[j] - done[i]) / (j - i)
        if dense:
            j = max(i + 1, min(j, i + 4_000_000 // width))
        a = slice(begins[i], begins[j])
        c = count[a]
        b = spread(start_x[a], c)
        products = np.repeat(vals_x[a], c) * vals[b]
        rows = np.repeat(row_x[a] - i, c)
        if dense:
            total = np.bincount(rows * width + col[b], products, (j - i) * width).reshape(j - i, width)
            rows, cols, scores = _best_dense(total, k)
        else:
            cell, scores = rows * width + col[b], products
            order = np.argsort(cell)
            cell = cell[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else cell
            scores = np.add.reduceat(scores[order], first) if len(first) else scores
            rows, cols = np.divmod(cell[first], width)
        rows, cols, scores = _ranked(rows, cols, scores, k)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x[rows + i], pa.int64()), pa.array(known[cols], pa.int64()), pa.array(scores, pa.float64())], ["e1", "e2", "score"])
        i = j


def best_products(left: DataFrame, right: DataFrame, k: int, products: int = PRODUCTS, entries: int = LEFT, most: int = RIGHT) -> DataFrame:
    """(e1, e2, score): the k best ids of each left row (x, keys, vals) by its product with right rows (key, part, ids, vals).

    The driver sees the costs of at most 1,024 ranges of x. left and right are read several times and ought to be stored.
    """
    spark = left.sparkSession
    last = left.agg(F.max("x")).first()[0]
    if last is None:
        return spark.createDataFrame([], "e1 long, e2 long, score double")
    size = last // 1024 + 1
    bucket = F.floor(F.col("x") / size).cast("int").alias("bucket")
    met = stored(left.select(bucket, F.explode("keys").alias("key")).groupBy("bucket", "key").agg(F.count("*").alias("n")), "met")
    lengths = right.groupBy("key").agg(F.sum(F.size("ids")).alias("m"))
    costs = met.join(lengths, "key").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("p")).orderBy("bucket").collect()
    if not costs:
        return spark.createDataFrame([], "e1 long, e2 long, score double")
    filled = list(accumulate(r.n / entries + r.p / products for r in costs))
    tiles = spark.createDataFrame([(r.bucket, int(f - (r.n / entries + r.p / products) / 2)) for r, f in zip(costs, filled, strict=True)], "bucket int, tile int").coalesce(1)
    wanted = stored(met.join(F.broadcast(tiles), "bucket").select("key", "tile").distinct().groupBy("key").agg(F.collect_list("tile").alias("tiles")), "wanted")
    sent = right.join(wanted, "key")
    heavy = sent.select(F.explode("tiles").alias("tile"), F.size("ids").alias("m")).groupBy("tile").agg(F.sum("m").alias("m")).agg(F.max("m")).first()[0]
    n_tiles, parts = int(filled[-1]) + 1, -(-heavy // most)
    slot = lambda part: (F.col("tile") * parts + part).cast("int").alias("slot")
    sent = sent.select(F.explode("tiles").alias("tile"), F.pmod("part", F.lit(parts)).alias("_p"), F.col("key").alias("k"), F.col("ids").alias("keys"), "vals").select(slot(F.col("_p")), F.lit(0).alias("side"), "k", "keys", "vals")
    own = left.withColumn("bucket", bucket).join(F.broadcast(tiles), "bucket").withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = own.select(slot(F.col("_p")), F.lit(1).alias("side"), F.col("x").alias("k"), "keys", "vals")
    out = sent.union(own).repartitionById(n_tiles * parts, "slot").mapInArrow(lambda batches: _tile(batches, k), "e1 long, e2 long, score double")
    if parts == 1:
        return out
    best = F.row_number().over(W.partitionBy("e1").orderBy(F.desc("score"), "e2"))
    return out.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")
