"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `width` consecutive words of an item (a shorter item is one window). It occurs in a document only if its
rarest shingle does, so that one shingle is the whole prefix that the join needs. Shingles are ordered by their counts
in the documents; a joined prefix shingle fixes where the window would start and end (positional and length bounds),
and there the words are compared.

Items of at most `broadcast_bytes` go to all tasks, and documents are not shuffled. More items stay distributed: the
documents' shingles that pass a bit table of fixed size meet the prefixes in a join, with hot shingles dealt out.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, LOWER, UPPER, Words, chunks, lean, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans(UPPER, LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_FOLD))


class Windows:
    """The distinct windows of a block of items, with the hashes that the join compares."""

    def __init__(self, items: list[tuple[str, str | None]], width: int, size: int):
        self.width, self.size = width, size
        of: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                of[tuple(w[i : i + width])].add(item)
        self.words = sorted(of)
        self.items = [sorted(of[w]) for w in self.words]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.bytes = [tuple(x.encode("utf-8", "surrogatepass") for x in w) for w in self.words]
        # the windows as documents of the text kernel, so that both sides hash alike
        text = "\n".join(" ".join(w) for w in self.words).encode("utf-8", "surrogatepass")
        lengths = [sum(len(x) for x in b) + len(b) - 1 + 1 for b in self.bytes]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if len(lengths):
            offsets[-1] -= 1
        kernel = Words(np.frombuffer(text, np.uint8), offsets)
        self.hashes = np.zeros((len(self.words), width), np.uint64)
        for i, n in enumerate(self.length):
            self.hashes[i, :n] = kernel.hashes[kernel.bounds[i] : kernel.bounds[i] + n]
        # shingles of `size` words; a shorter window is a shingle of its own length
        self.shingles: list[tuple[int, int, int]] = []  # (hash, window, offset)
        for n in range(1, size + 1):
            h, whole = kernel.shingles(n)
            for i in np.flatnonzero((self.length == n) if n < size else (self.length >= n)):
                for j in range(self.length[i] - n + 1):
                    at = kernel.bounds[i] + j
                    assert whole[at]
                    self.shingles.append((int(h[at]), int(i), j))
        self.sizes = sorted({min(size, int(n)) for n in self.length})
        self.vocabulary = np.array(sorted({s[0] for s in self.shingles}), np.uint64)


class Lookup:
    """Positions of keys in a sorted array, behind a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.mask = keys, np.uint64((1 << 20) - 1)
        self.table = np.zeros(1 << 20, bool)
        self.table[(keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, index of the key found there)."""
        if not len(self.keys) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[k] == h[maybe]
        return maybe[hit], k[hit]


def _rarity(windows: Windows):
    keys, sizes = windows.vocabulary, windows.sizes

    def run(batches):
        look, n = Lookup(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                w = Words(data, offsets)
                for size in sizes:
                    h, whole = w.shingles(size)
                    n += np.bincount(look.find(h[whole])[1], minlength=len(keys))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["k", "n"])

    return lean(run)


def _prefixes(windows: Windows, counts: dict[int, int]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The rarest shingle of every window (ties: the smaller hash, then the first place): keys, key index -> (windows, offsets)."""
    place = {int(h): k for k, h in enumerate(windows.vocabulary)}
    best: dict[int, tuple[int, int, int]] = {}
    for h, i, j in windows.shingles:
        rank = (counts.get(place[h], 0), h, j)
        if i not in best or rank < best[i]:
            best[i] = rank
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, h, j) in best.items():
        by[h].append((i, j))
    keys = np.array(sorted(by), np.uint64)
    return keys, {k: tuple(np.array(x, np.int64) for x in zip(*by[int(h)], strict=True)) for k, h in enumerate(keys)}


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _match(windows: Windows, counts: dict[int, int]):
    keys, at = _prefixes(windows, counts)

    def run(batches):
        look = Lookup(keys)
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = Words(data, offsets)
                hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                for size in windows.sizes:
                    h, whole = w.shingles(size)
                    pos, key = look.find(np.where(whole, h, np.uint64(0)))
                    for k in np.unique(key):
                        where = pos[key == k]
                        win, off = at[int(k)]
                        start = (where[:, None] - off[None, :]).ravel()
                        which = np.tile(win, len(where))
                        doc = np.repeat(np.searchsorted(w.bounds, where, "right") - 1, len(win))
                        # the whole window must lie in the document
                        ok = (start >= w.bounds[doc]) & (start + windows.length[which] <= w.bounds[doc + 1])
                        start, which, doc = start[ok], which[ok], doc[ok]
                        if not len(start):
                            continue
                        span = start[:, None] + np.arange(windows.width)
                        same = (w.hashes[np.minimum(span, len(w.hashes) - 1)] == windows.hashes[which]) | (np.arange(windows.width) >= windows.length[which][:, None])
                        for s, i, d in zip(*(x[same.all(1)] for x in (start, which, doc)), strict=True):
                            if all(FOLD[data[w.starts[s + j] : w.ends[s + j]]].tobytes() == x for j, x in enumerate(windows.bytes[i])):
                                hits[d].append((int(s), int(s + windows.length[i]), int(i)))
                runs, items = [], []
                for d in range(len(part)):
                    runs.append([{"start": s - int(w.bounds[d]), "stop": e - int(w.bounds[d])} for s, e, _ in _merged(hits.get(d, []))])
                    items.append(sorted({x for _, _, i in hits.get(d, []) for x in windows.items[i]}))
                ids = part.column(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.bounds), pa.int64()), pa.array(runs, _OUT.field("runs").type), pa.array(items, _OUT.field("items").type)], schema=_OUT)

    return lean(run)


def _merged(spans):
    out: list[tuple[int, int, int]] = []
    for s, e, i in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), i)
        else:
            out.append((s, e, i))
    return out


_FOUND = "doc_id long, n_words long, runs array<struct<start:long,stop:long>>, items array<string>"


def _with_carried(run, carried: int):
    """run over (doc_id, text), beside whose rows the columns after them are carried along."""

    def wrapped(batches):
        for batch in batches:
            done = 0
            for out in run(iter([batch])):
                part = batch.slice(done, out.num_rows)
                done += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, *part.columns[2:]], [*out.schema.names, *(f"_carried{i}" for i in range(carried))])

    return lean(wrapped)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, size: int = 3, broadcast_bytes: int = 2 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, runs, items), and the columns to carry along under their names.

    runs are the maximal hit word runs, items the ids found. Words are runs of 0-9, a-z (A-Z folded) and characters from
    U+0080 on. Null and empty texts have no words, so no hits; items without words have no window, an item with a null
    id is left out, items that repeat an id count together. An empty table of items leaves every document clean.
    Repeated documents are judged alike, rows with null or repeated ids each by its own text. carry may name the id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)))
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item") + 16)).first()[0] or 0
    if total <= broadcast_bytes:
        windows = Windows([(r.item, r.text) for r in items.collect()], width, size)
        counted = rows.select("text").mapInArrow(_rarity(windows), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect() if len(windows.words) else []
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        found = rows.mapInArrow(_with_carried(_match(windows, {r.k: r.n for r in counted}), len(carry)), ", ".join([_FOUND, *(f"_carried{i} {kinds[f'_carried{i}']}" for i in range(len(carry)))]))
    else:
        found = _join(rows, items, width, size)
    return found.select(*(c for c in ("doc_id", "n_words", "runs", "items") if c not in carry), *(F.col(f"_carried{i}").alias(c) for i, c in enumerate(carry)))


# ---------------------------------------------------------------- items that stay distributed

BITS = 27  # of the table of shingles that items have: 16 MB, whatever the items


def _item_windows(width: int, size: int):
    """(item, window, words, h, off): every window of an item by its words, with each of its shingles and where it begins."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                w = Windows([(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())], width, size)
                if not w.words:
                    continue
                h, win, off = (np.array(x, kind) for x, kind in zip(zip(*w.shingles, strict=True), (np.uint64, np.int64, np.int64), strict=True))
                words = pa.array([" ".join(x) for x in w.words], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(h), pa.string()), words.take(pa.array(win, pa.int64())), pa.array(h.view(np.int64), pa.int64()), pa.array(off, pa.int32())], ["item", "words", "h", "off"])

    return lean(run)


def _passing(bits: bytes, size: int, counted: bool):
    """(h, n): counts, or (h, row, pos): places, of the documents' shingles that pass the bit table."""
    table, mask = np.frombuffer(bits, np.uint8), np.uint64((1 << BITS) - 1)

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = Words(data, offsets)
                for n in range(1, size + 1):
                    h, whole = w.shingles(n)
                    at = (h & mask).astype(np.int64)
                    pos = np.flatnonzero(whole & ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))
                    if counted:
                        keys, c = np.unique(h[pos], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c, pa.int64())], ["h", "n"])
                    else:
                        doc = np.searchsorted(w.bounds, pos, "right") - 1
                        row = part.column(0).to_numpy(zero_copy_only=False)[doc]
                        yield pa.RecordBatch.from_arrays([pa.array(h[pos].view(np.int64)), pa.array(row, pa.int64()), pa.array(pos - w.bounds[doc], pa.int64())], ["h", "row", "pos"])

    return lean(run)


_CHECKED = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("runs", _OUT.field("runs").type), ("hit", pa.list_(pa.string()))])


def _check(batches):
    """(row, n_words, runs, words of the windows found) from texts with the places where windows may begin."""
    for batch in batches:
        for part, data, offsets in chunks(batch, "text"):
            w = Words(data, offsets)
            runs, hit = [], []
            for d, found in enumerate(part.column(2).to_pylist()):
                spans, windows = [], set()
                for f in found or []:
                    v = [x.encode("utf-8", "surrogatepass") for x in f["words"].split(" ")]
                    s = int(w.bounds[d]) + f["start"]
                    if f["start"] >= 0 and s + len(v) <= w.bounds[d + 1] and all(FOLD[data[w.starts[s + j] : w.ends[s + j]]].tobytes() == x for j, x in enumerate(v)):
                        spans.append((f["start"], f["start"] + len(v), 0))
                        windows.add(f["words"])
                runs.append([{"start": s, "stop": e} for s, e, _ in _merged(spans)])
                hit.append(sorted(windows))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.bounds), pa.int64()), pa.array(runs, _OUT.field("runs").type), pa.array(hit, _CHECKED.field("hit").type)], schema=_CHECKED)


def _join(rows: DataFrame, items: DataFrame, width: int, size: int, salts: int = 16) -> DataFrame:
    """find_items for any number of items; the driver sees the bit table only."""
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    windows = stored(items.mapInArrow(_item_windows(width, size), "item string, words string, h long, off int"), "windows")
    bit = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    parts = windows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = bytearray(1 << (BITS - 3))
    for r in parts:
        table[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    texts = rows.select(F.col("_row").alias("row"), "text")
    counts = texts.select("text").mapInArrow(_passing(bytes(table), size, True), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # a window whose rarest shingle no document has cannot occur
    prefix = windows.select("words", "h", "off").distinct().join(counts, "h", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("p")).where("p.n > 0")
    prefix = prefix.select("p.h", F.struct("words", "p.off").alias("window"))
    places = texts.mapInArrow(_passing(bytes(table), size, False), "h long, row long, pos long").withColumn("_salt", F.pmod("pos", F.lit(salts)).cast("int"))
    prefix = prefix.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = places.join(prefix, ["h", "_salt"]).select("row", F.struct((F.col("pos") - F.col("window.off")).alias("start"), "window.words").alias("f")).where("f.start >= 0")
    checked = stored(texts.join(met.groupBy("row").agg(F.collect_set("f").alias("found")), "row", "left").mapInArrow(lean(_check), "row long, n_words long, runs array<struct<start:long,stop:long>>, hit array<string>"), "checked")
    of = checked.select("row", F.explode("hit").alias("words")).join(windows.select("words", "item").distinct(), "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.drop("text").join(checked.select(F.col("row").alias("_row"), "n_words", "runs"), "_row").join(of.withColumnRenamed("row", "_row"), "_row", "left")
    return out.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))


def decontaminate(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """find_items with counts and digests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), and what is carried."""
    found = find_items(docs, items, carry=carry, **options)
    n_hit = F.expr("aggregate(runs, 0L, (s, x) -> s + x.stop - x.start)")
    columns = {"doc_id": F.col("doc_id"), "n_words": F.col("n_words"), "n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": n_hit > 0}
    return found.select(*(c.alias(n) for n, c in columns.items() if n not in carry), *carry)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = 10) -> list[tuple]:
    """What decontaminate returns, by comparing every window with every place."""
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, t in items:
            v = words_of(t)
            n = min(width, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[i : i + n]:
                        hit.update(range(s, s + n))
                        found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
v as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as v from benchmark),
windows as (select distinct item_id, least(10, len(v)) as n, array_to_string(v[i:i + least(10, len(v)) - 1], ' ') as t from (select item_id, v, unnest(range(1, greatest(1, len(v) - 9) + 1)) as i from v where len(v) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, sizes)),
hits as (select doc_id, item_id, i, n from places join windows using (n, t)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from w left join words using (doc_id) left join items using (doc_id)
"""
