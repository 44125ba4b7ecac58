"""Exact substring dedup over a sparse suffix array, sorted deep-shallow.

Which 100-byte strings repeat is decided by suffixes at anchors only. An anchor is the k-gram of a 100-byte window
with the least hash (the first of equals), so equal windows have the same anchor at the same offset, and about one
position in 32 is an anchor. Anchors whose k-gram occurs once are dropped. Around the others, the text to the right
and (reversed) to the left of the anchor is sorted: multikey quicksort on 8-byte words to a shallow depth, then blind
tries for the groups that still share their prefix. With the common prefixes of neighbours, each offset's equal windows
are runs of both orders, and all but a run's first window begin a removed string.

What a task finds to be equal already, it settles itself, so a hot passage reaches others once per task. Anchors that
still have many different surroundings (the edges of a hot passage) are settled window by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, INVERSE, chunks, lean, lookup, mix, powers, prefix_hash, release, stored

SPAN, GRAM = 100, 38
OFFSETS = SPAN - GRAM + 1  # of an anchor in a window: 0 .. SPAN - GRAM; a set of them is a mask of 63 bits
SHALLOW = 16


# ---------------------------------------------------------------- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, block: int = 4000):
    """(position, document, least and largest offset, hash) of the anchors of a chunk of documents."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    c = prefix_hash(BYTE[data])
    h = mix((c[GRAM:] - c[:-GRAM]) * powers(INVERSE, len(data))[: len(data) - GRAM + 1])
    # rows of `block` windows; a column number in the low bits makes the first of equal hashes the least
    rows = -(-n // block)
    padded = np.full(rows * block + OFFSETS - 1, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    key = np.lib.stride_tricks.as_strided(padded, (rows, block + OFFSETS - 1), (block * 8, 8))
    key = (key & np.uint64(2**64 - 4096)) | np.arange(block + OFFSETS - 1, dtype=np.uint64)
    m, size = key, 1
    while size * 2 <= OFFSETS:
        m = np.minimum(m[:, :-size], m[:, size:])
        size *= 2
    m = np.minimum(m[:, :block], m[:, OFFSETS - size : OFFSETS - size + block])
    at = ((m & np.uint64(4095)).astype(np.int64) + (np.arange(rows) * block)[:, None]).ravel()[:n]
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    s = np.flatnonzero(np.arange(n) + SPAN <= offsets[1:][doc_of[:n]])
    if not len(s):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    p = at[first]
    d = doc_of[s[first]]
    return p - offsets[d], d, p - s[last], p - s[first], h[p]


#: Within a bucket 40 bits of the hash are kept: two k-grams that share them are only compared for nothing.
_ENTRY = np.dtype([("h", "<u4"), ("g", "u1"), ("doc", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("n", "u1")])
_FOUND = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1"), ("n", "u1")])


def _columns(e: np.ndarray, buckets: int) -> bytes:
    """Entries column by column, in order of document and place, which compresses better."""
    out = np.empty(len(e), _ENTRY)
    for f in ("doc", "pos", "lo", "hi", "n"):
        out[f] = e[f]
    h = e["h"] // np.uint64(buckets)
    out["h"], out["g"] = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) & np.uint64(255)
    return b"".join(np.ascontiguousarray(out[f]).tobytes() for f in _ENTRY.names)


def _entries(blob: bytes) -> np.ndarray:
    n = len(blob) // _ENTRY.itemsize
    columns, at = {}, 0
    for f in _ENTRY.names:
        t = _ENTRY.fields[f][0]
        columns[f] = np.frombuffer(blob, t, n, at)
        at += n * t.itemsize
    e = np.empty(n, _FOUND)
    for f in ("doc", "pos", "lo", "hi", "n"):
        e[f] = columns[f]
    e["h"] = columns["g"].astype(np.uint64) << np.uint64(32) | columns["h"]
    return e


def _find_anchors(buckets: int, held_entries: int = 1_500_000):
    """Entries of a task dealt by hash; of a hash that the task has more than once, all but the first are settled."""

    def flush(parts, serial):
        e = np.concatenate(parts)
        by_hash = np.argsort(e["h"], kind="stable")
        h = e["h"][by_hash]
        new = np.ones(len(e), bool)
        new[1:] = h[1:] != h[:-1]
        heads = by_hash[new]
        e["n"][heads] = np.minimum(np.diff(np.append(np.flatnonzero(new), len(e))), 2)
        is_head = np.zeros(len(e), bool)
        is_head[heads] = True
        first, rest = e[is_head], e[~is_head]
        bucket = (first["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, bucket = first[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(k, 0, _columns(first[cuts[k] : cuts[k + 1]], buckets)) for k in range(buckets) if cuts[k] < cuts[k + 1]]
        rows += [((serial + k) % buckets, 1, _columns(rest[i : i + 50_000], buckets)) for k, i in enumerate(range(0, len(rest), 50_000))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "settled", "entries"])

    def run(batches):
        parts, size, serial = [], 0, 0
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", 1 << 18):
                pos, d, lo, hi, h = anchors(data, offsets)
                ids = part.column(0)
                e = np.zeros(len(pos), _FOUND)
                e["h"], e["pos"], e["lo"], e["hi"], e["n"] = h, pos, lo, hi, 1
                e["doc"] = ids.to_numpy(zero_copy_only=False)[d]
                parts.append(e)
                size += len(e)
                serial += 1
                if size > held_entries:
                    yield flush(parts, serial)
                    parts, size = [], 0
        if size:
            yield flush(parts, serial)

    return lean(run)


def _repeating(batches):
    """(doc_id, anchor) of the entries whose hash occurs again, bucket by bucket over sorted batches; anchor packs pos, lo, hi."""

    def out(e):
        packed = (e["pos"].astype(np.int64) << 16) | (e["lo"].astype(np.int64) << 8) | e["hi"].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e["doc"], pa.int64()), pa.array(packed, pa.int64())], ["doc_id", "anchor"])

    def settle(parts):
        e = np.concatenate(parts)
        e = e[np.argsort(e["h"], kind="stable")]
        new = np.ones(len(e), bool)
        new[1:] = e["h"][1:] != e["h"][:-1]
        total = np.add.reduceat(e["n"].astype(np.int64), np.flatnonzero(new))
        return out(e[(total > 1)[np.cumsum(new) - 1]])

    held, parts = None, []
    for batch in batches:
        for bucket, settled, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            e = _entries(blob)
            if settled:
                yield out(e)
                continue
            if bucket != held and parts:
                yield settle(parts)
                parts = []
            held = bucket
            parts.append(e)
    if parts:
        yield settle(parts)


# ---------------------------------------------------------------- texts on their way through a shuffle


def _pack(batches):
    """(doc_id, packed): texts compressed one by one, which takes less room in a shuffle than its own block compression."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in batch.column(1)], pa.binary())], ["doc_id", "packed"])


def _packed(docs: DataFrame) -> DataFrame:
    return docs.mapInArrow(lean(_pack), "doc_id long, packed binary")


def _unpacked(packed: pa.Scalar, open_) -> bytes:
    return open_.decompress(packed.as_py()) if packed.is_valid else b""


# ---------------------------------------------------------------- surroundings of anchors


def _mask(lo: int, hi: int) -> int:
    return (1 << (hi + 1)) - (1 << lo)


def _surround(limit: int = 150_000):
    """(doc_id, pos, lo, hi, left, right, mask): what a task has once; mask is set where it found an earlier equal one."""

    def run(batches):
        first: dict[tuple[bytes, bytes], tuple[int, int, int, int]] = {}
        rows: list[tuple] = []

        def flush():
            rows.extend((*v, k[0], k[1], 0) for k, v in first.items())
            first.clear()
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return batch

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        names = ["doc_id", "pos", "lo", "hi", "left", "right", "mask"]
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, raw = doc.as_py(), _unpacked(packed, open_)
                for v in np.unique(found.values.to_numpy()).tolist():
                    pos, lo, hi = v >> 16, v >> 8 & 255, v & 255
                    key = (raw[pos - hi : pos], raw[pos : pos - lo + SPAN])
                    have = first.get(key)
                    if have is None:
                        first[key] = (doc, pos, lo, hi)
                    else:
                        if (doc, pos) == have[:2]:
                            continue
                        if (doc, pos) < have[:2]:
                            first[key], have = (doc, pos, lo, hi), have
                        else:
                            have = (doc, pos, lo, hi)
                        rows.append((*have, None, None, _mask(lo, hi)))
                if len(first) > limit or len(rows) > 4 * limit:
                    yield flush()
        if first or rows:
            yield flush()

    return lean(run)


# ---------------------------------------------------------------- deep-shallow sorting


def blind_trie(strings: list[bytes], members: list[int]) -> list[list[int]]:
    """Members in the order of their strings, equal ones together.

    Inner nodes know only the place at which their children differ. A string goes down by those characters alone; its
    common prefix with the leaf it reaches tells where it has to be put.
    """
    leaf = lambda i: (strings[i], [i])
    root: object = leaf(members[0])
    for i in members[1:]:
        s = strings[i]
        path = []
        node = root
        while isinstance(node, list):
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = node[0]
        if s == other:
            node[1].append(i)
            continue
        short = min(len(s), len(other))
        x = int.from_bytes(s[:short], "big") ^ int.from_bytes(other[:short], "big")
        same = short - (x.bit_length() + 7) // 8
        above = None
        for inner in path:
            if inner[0] >= same:
                break
            above = inner
        below = above[1][s[above[0]]] if above is not None and (s[above[0]] if above[0] < len(s) else -1) in above[1] else None
        if above is None:
            below = root
        c = s[same] if same < len(s) else -1
        if isinstance(below, list) and below[0] == same:
            below[1][c] = leaf(i)
            continue
        made = [same, {c: leaf(i), (other[same] if same < len(other) else -1): below}]
        if above is None:
            root = made
        else:
            above[1][s[above[0]]] = made
    out: list[list[int]] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.append(node[1])
    return out


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def deep_shallow(groups: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the order by (group, string); common[i] is the prefix that i-th and one before share, -1 across groups."""
    grid = _padded(strings, width)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    head = np.ascontiguousarray(np.pad(grid[:, :SHALLOW], ((0, 0), (0, max(0, SHALLOW - width)))))
    words = [groups.astype(np.uint64), *head.view(">u8").astype(np.uint64).T, np.minimum(length, SHALLOW).astype(np.uint64)]
    out: list[np.ndarray] = []
    stack = [(np.arange(len(strings)), 0)]
    while stack:  # multikey quicksort: three parts by the word at this depth; the middle part goes one word deeper
        idx, depth = stack.pop()
        if depth == len(words):
            if len(idx) > 1:
                idx = np.array([i for same in blind_trie(strings, idx.tolist()) for i in same])
            out.append(idx)
            continue
        if len(idx) <= 1:
            out.append(idx)
            continue
        w = words[depth][idx]
        pivot = np.partition(w, len(w) // 2)[len(w) // 2] if len(w) > 3 else w[len(w) // 2]
        stack += [(part, d) for part, d in ((idx[w > pivot], depth), (idx[w == pivot], depth + 1), (idx[w < pivot], depth)) if len(part)]
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    common = np.full(len(order), -1)
    if len(order) > 1:
        differ = grid[order[1:]] != grid[order[:-1]]
        same = np.where(differ.any(1), differ.argmax(1), width)
        same = np.minimum(same, np.minimum(length[order[1:]], length[order[:-1]]))
        common[1:] = np.where(groups[order[1:]] == groups[order[:-1]], same, -1)
    return order, common


def earlier_equal(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Masks of the offsets at which a row's window equals that of an earlier row of its group; rows come in order of place."""
    n = len(groups)
    masks = np.zeros(n, np.uint64)
    r_order, r_common = deep_shallow(groups, right, SPAN)
    l_order, l_common = deep_shallow(groups, [s[::-1] for s in left], OFFSETS - 1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(OFFSETS):
        some = np.flatnonzero((lo <= j) & (j <= hi))
        if len(some) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < SPAN - j)
        l_class[l_order] = np.cumsum(l_common < j)
        key = r_class[some] * (n + 1) + l_class[some]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        masks[some[first[back] != np.arange(len(some))]] |= np.uint64(1 << j)
    return masks


def _settle(rows_at_once: int = 150_000):
    """(doc_id, pos, mask) from rows sorted by key, doc_id, pos; whole keys are settled together."""

    def run(batches):
        def settle(table: pa.Table):
            key, doc, pos, lo, hi = (table.column(c).to_numpy() for c in ("key", "doc_id", "pos", "lo", "hi"))
            mask = np.zeros(len(key), np.uint64)
            todo = np.arange(len(key))
            _, group, size = np.unique(key[todo], return_inverse=True, return_counts=True)
            todo, group = todo[size[group] > 1], group[size[group] > 1]
            if len(todo):
                part = table.select(["left", "right"]).take(pa.array(todo))
                mask[todo] = earlier_equal(group, lo[todo], hi[todo], part.column("left").to_pylist(), part.column("right").to_pylist())
            some = np.flatnonzero(mask)
            return pa.RecordBatch.from_arrays([pa.array(doc[some], pa.int64()), pa.array(pos[some], pa.int64()), pa.array(mask[some].astype(np.int64), pa.int64())], ["doc_id", "pos", "mask"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows_at_once:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                whole = int(np.flatnonzero(key == key[-1])[0])  # the last key may go on
                if whole:
                    yield settle(t.slice(0, whole))
                    held = t.slice(whole).to_batches()
                    size = t.num_rows - whole
        if size:
            yield settle(pa.Table.from_batches(held))

    return lean(run)


def _windows(batches):
    """(w1, w2, doc_id, start, pos, j) for every window of the rows of a hot anchor."""
    for batch in batches:
        out: list[tuple] = []
        for doc, pos, lo, hi, left, right in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pos", "lo", "hi", "left", "right")), strict=True):
            text = left + right
            for j in range(lo, hi + 1):
                d = hashlib.blake2b(text[hi - j : hi - j + SPAN], digest_size=16).digest()
                out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), doc, pos - j, pos, j))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["w1", "w2", "doc_id", "start", "pos", "j"])


# ---------------------------------------------------------------- the operator


def _remove(batches):
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for doc, packed, found in zip(*(batch.column(i) for i in range(3)), strict=True):
            raw = np.frombuffer(_unpacked(packed, open_), np.uint8)
            n_removed = n_spans = 0
            if found.is_valid:
                pos, mask = (found.values.field(i).to_numpy() for i in range(2))
                edge = np.zeros(len(raw) + 1, np.int64)
                for j in range(OFFSETS):
                    start = pos[(mask >> j) & 1 == 1] - j
                    np.add.at(edge, start, 1)
                    np.subtract.at(edge, start + SPAN, 1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed = int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = raw[~gone]
            else:
                kept = raw
            for col, v in zip(cols, (doc.as_py(), len(raw), n_removed, n_spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_strings(docs: DataFrame, bucket_bytes: int = 24 << 20, hot_rows: int = 2000, hot_keys: int = 100_000) -> DataFrame:
    """(doc_id, pos, mask) of (doc_id, text): bit j of mask is set where the 100 bytes from pos - j also start earlier."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // bucket_bytes + 1)
    entries = docs.mapInArrow(_find_anchors(buckets), "bucket int, settled int, entries binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = entries.mapInArrow(lean(_repeating), "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    around = _packed(docs).join(found, "doc_id").select("doc_id", "packed", "anchors").mapInArrow(_surround(), "doc_id long, pos long, lo int, hi int, left binary, right binary, mask long")
    key = F.when(F.col("mask") == 0, F.xxhash64(F.substring("right", 1, GRAM))).otherwise(F.xxhash64("doc_id", "pos"))
    around = stored(around.withColumn("key", key), "around")
    del entries, found
    release(spark)
    open_rows = around.where("mask = 0")
    # fewer than hot_keys keys can have more than rows / hot_keys rows each
    counts = open_rows.groupBy("key").agg(F.count("*").alias("n"))
    limit = max(hot_rows, (counts.agg(F.sum("n")).first()[0] or 0) // hot_keys)
    hot = stored(counts.where(F.col("n") > limit).select("key"), "hot-anchors")
    columns = ["key", "doc_id", "pos", "lo", "hi", "left", "right"]
    settled = around.where("mask <> 0").select("doc_id", "pos", "mask")
    cold = open_rows.join(F.broadcast(hot), "key", "left_anti").select(*columns).repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(_settle(), "doc_id long, pos long, mask long")
    windows = open_rows.join(F.broadcast(hot), "key", "left_semi").select(*columns).mapInArrow(lean(_windows), "w1 long, w2 long, doc_id long, start long, pos long, j long")
    windows = stored(windows, "windows")
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.struct("w1", "w2").alias("w"), "first")
    again = lookup(windows.withColumn("w", F.struct("w1", "w2")).drop("w1", "w2"), firsts, "w", "start").where("first is not null and struct(doc_id, start) <> first")
    late = again.groupBy("doc_id", "pos").agg(F.expr("bit_or(shiftleft(1L, cast(j as int)))").alias("mask"))
    # stored, so that the surroundings' shuffle goes before the texts are moved once more
    masks = stored(settled.union(cold).union(late.select("doc_id", "pos", "mask")), "masks")
    del open_rows, counts, cold, firsts, again, late
    release(spark)
    return masks


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    A byte is removed if a 100-byte string that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Strings are judged on the input; matches never cross documents. Null and empty texts have
    no bytes; texts under 100 bytes lose none. Rows that repeat an id and text are one document and lose the same; ids
    are otherwise taken as unique. Texts of a null id are neither cut nor compared. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    masks = repeated_strings(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "mask")).alias("found"))
    return _packed(docs).join(masks, "doc_id", "left").select("doc_id", "packed", "found").mapInArrow(lean(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """What suffix_dedup returns, from a set of all 100-byte strings."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(docs):
        raw = (text or "").encode("utf-8", "surrogatepass")
        gone = bytearray(len(raw))
        for s in range(len(raw) - SPAN + 1):
            w = raw[s : s + SPAN]
            if w in seen:
                gone[s : s + SPAN] = b"\1" * SPAN
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
