"""What several operators share: shared-folder tables, a text kernel, joins for hot keys, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, release, shared_folder, shuffles  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one below the warehouse where that is unset: both are shared by all machines."""
    return shared_folder(spark)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- joins and components


def lookup(left: DataFrame, right: DataFrame, key: str, salt_by: str, salts: int = 16) -> DataFrame:
    """Left join to a right side that has each key once, with every left key dealt over `salts` tasks.

    The right side is repeated `salts` times, so it should be the smaller one. Null keys find nothing.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def _contract(batches):
    """Local spanning stars of the edges of one task (bounded by the task's own rows)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:  # hand on what there is, and begin anew
            yield _stars(parent, root)
            parent.clear()
    yield _stars(parent, root)


def _stars(parent, root):
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def contracted(edges: DataFrame, made_by=None) -> DataFrame:
    """Edges (a, b) of each task as local spanning stars.

    made_by makes the edges from the task's batches in the same pass: a pass over another's rows would take a second
    worker for each task, whose memory stays when it is done.
    """
    return edges.mapInArrow(lean((lambda batches: _contract(made_by(batches))) if made_by else _contract), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component."""
    return settled(contracted(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")), max_rounds)


def settled(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """components() of edges (a, b) that contracted() has made.

    Alternating large-star and small-star rounds over stored tables; the driver sees only a count and a checksum of
    each round. Hot nodes are salted. Raises if max_rounds do not suffice.
    """
    e = stored(edges.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = lookup(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: nodes at or below a node go to the least of those
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = lookup(large, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


# ---------------------------------------------------------------- Python workers


_outlasting: dict[str, object] = {}


def outlasting(cached):
    """A cached function whose values outlast a task; the worker's next run that does not keep it lets them go."""
    _outlasting[cached.__name__] = cached
    return cached


def give_back() -> None:
    """Unused memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def forget(but: str | None = None) -> None:
    """Lets go what outlasting functions hold, all but one."""
    held = [f for name, f in _outlasting.items() if name != but and f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        give_back()


def lean(run, keeps: str | None = None):
    """run, after whose last batch the worker gives unused memory back: workers outlive their tasks.

    keeps names the outlasting function that run uses; what others hold in this worker goes first.
    """

    @functools.wraps(run)
    def wrapped(batches):
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# ---------------------------------------------------------------- text kernel: UTF-8 bytes in numpy


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch with about `limit` bytes of text (one row at least): (slice, bytes, offsets). Null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    text = pc.fill_null(text, "") if text.null_count else text
    if not len(text):
        return
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and text.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True
#: A random 64-bit value for each byte, after folding of A-Z.
BYTE = _splitmix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
BYTE_FOLDED = BYTE[FOLD]
BASE = 0x9E6C63D0876A9A63 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        step = base
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % 2**64
        _powers[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 2**64)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[k] * BASE**k for i <= k < j, modulo 2**64."""
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=c[1:])
    return c


class Words:
    """The words of a chunk: runs of 0-9, a-z (A-Z folded) and of bytes from 0x80 on.

    starts, ends: byte positions; hashes: 64 bits of the folded bytes; bounds: the words of document d are
    bounds[d] .. bounds[d + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = IN_WORD[data]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[:-1] = inside
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        before[cut] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        c = prefix_hash(BYTE_FOLDED[data])
        self.hashes = mix((c[self.ends] - c[self.starts]) * powers(INVERSE, max(1, len(data)))[self.starts]) if len(self.starts) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, offsets)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words at each word, and whether they lie in one document."""
        k = len(self.hashes)
        out, whole = np.zeros(k, np.uint64), np.zeros(k, bool)
        if k >= n:
            h = np.zeros(k - n + 1, np.uint64)
            for j in range(n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : k - n + 1 + j]
            out[: k - n + 1] = mix(h + np.uint64(n))
            counts = np.diff(self.bounds)
            left = np.repeat(self.bounds[1:], counts) - np.arange(k)
            whole = left >= n
        return out, whole


def long_of(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
