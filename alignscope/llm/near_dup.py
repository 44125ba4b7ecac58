"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set comparison verifies them.

Every tree of the forest is a prefix trie over a few minima of a document's shingles, kept as a sorted run. Prefixes are
first matched at the full depth and then shortened level by level. At each level the agreement of whole signatures
(all minima of all trees) of the documents that met there tells how many pairs of which similarity exist, and thereby
the recall of the level; the first level whose recall reaches the target is taken, and documents under one node of it
are candidates. Candidates form families (connected over nodes), and a family is verified by counting shared shingles
in blocks of bounded size, which yields each document's number of links without writing pairs.

Texts with equal shingle sets (copies) take part once, with their count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, components, contracted, lean, long_of, lookup, mix, settled, stored

WIDTH, THRESHOLD = 5, (4, 5)  # words of a shingle; least similarity as a fraction
TREES, DEPTH, RECALL = 20, 6, 0.99999


#: Fewer matches of signatures at the threshold than this tell nothing about recall.
EVIDENCE = 200


def found(similarity: np.ndarray | float, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from `depth`, that a pair at the threshold itself shares in some tree with the target recall."""
    while depth > 1 and found(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def shorten(matches: dict[int, np.ndarray], threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with the target recall over the pairs that exist, by levels from the full depth on.

    matches: level -> how many matches of that level agree in 0, 1, ... minima. A pair of similarity s meets in
    trees * s**level trees, which turns matches into pairs. Without enough matches every pair is taken to lie at the
    threshold.
    """
    for level in sorted(matches, reverse=True):
        n = matches[level]
        s = np.arange(len(n)) / (len(n) - 1)
        n, s = n[s >= threshold], s[s >= threshold]
        if n.sum() < EVIDENCE:
            continue
        pairs = n / (trees * s**level)
        if (pairs * found(s, level, trees)).sum() >= recall * pairs.sum():
            return level
    return prefix_depth(threshold, trees, depth, recall)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of document d are hashes[bounds[d]:bounds[d + 1]], sorted.

    A text of fewer words than `width`, but not none, is one shingle.
    """
    w = Words(data, offsets)
    count = np.diff(w.bounds)
    h, whole = w.shingles(width)
    doc = np.repeat(np.arange(len(count)), count)
    keep_h, keep_d = [h[whole]], [doc[whole]]
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            keep_h.append(w.shingles(n)[0][w.bounds[short]])
            keep_d.append(short)
    h, doc = np.concatenate(keep_h), np.concatenate(keep_d)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


_SIGNED = "doc_id long, n long, d1 long, d2 long, sig binary"


def _sign(trees: int, depth: int, width: int):
    # odd multipliers: each orders the mixed 64-bit shingles in another way
    factors = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                h, bounds = shingle_sets(data, offsets, width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sigs: list[bytes | None] = [None] * len(n)
                if len(full):
                    starts = bounds[:-1][full]
                    d1[full], d2[full] = (np.add.reduceat(mix(h ^ np.uint64(c)), starts) for c in (0xA5A5A5A5A5A5A5A5, 0x0123456789ABCDEF))
                    sig = np.empty((len(full), len(factors)), np.uint32)
                    for k, a in enumerate(factors):
                        sig[:, k] = np.minimum.reduceat(h * a, starts) >> np.uint64(32)
                    for i, d in enumerate(full):
                        sigs[d] = sig[i].tobytes()
                none = n == 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(long_of(d1), pa.int64(), mask=none), pa.array(long_of(d2), pa.int64(), mask=none), pa.array(sigs, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return lean(run)


# ---------------------------------------------------------------- the forest


_FOREST = "key binary, a long, b long, n long"


def _tries(trees: int, depth: int, least: int):
    """Sorted tries of the documents of a batch, as three kinds of rows.

    (key, a): the least document a of a full prefix, the tree's number and minima as bytes. (a, b): an edge inside a
    full prefix. (a, b, n): n matches at level a agree in b minima, each document against the first one of its prefix.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), trees * depth)
            sig = flat.reshape(len(ids), trees, depth)
            keys, nodes, edges = [], [], []
            agree = np.zeros((depth + 1, trees * depth + 1), np.int64)
            for t in range(trees):
                order = np.lexsort((ids, *(sig[:, t, j] for j in range(depth - 1, -1, -1))))
                rows = sig[order, t]
                shared = np.zeros(len(order), np.int64)  # minima in common with the row before
                shared[1:] = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)
                for level in range(depth, least - 1, -1):
                    new = shared < level
                    new[:1] = True
                    starts = np.flatnonzero(new)
                    head = starts[np.cumsum(new) - 1]
                    other = np.flatnonzero(~new)
                    for i in range(0, len(other), 20_000):
                        k = other[i : i + 20_000]
                        agree[level] += np.bincount((flat[order[k]] == flat[order[head[k]]]).sum(1), minlength=agree.shape[1])
                    if level == depth:
                        first, inside = ids[order[starts]], ids[order[head]]
                        edges.append(np.stack([ids[order], inside])[:, ids[order] != inside])
                        raw = np.empty((len(starts), 1 + 4 * depth), np.uint8)
                        raw[:, 0] = t
                        raw[:, 1:] = rows[starts].astype(">u4").view(np.uint8).reshape(len(starts), 4 * depth)
                        keys.append(raw)
                        nodes.append(first)
            raw, node, (a, b) = np.concatenate(keys), np.concatenate(nodes), np.concatenate(edges, axis=1)
            level, same = np.nonzero(agree)
            size = raw.shape[1]
            key = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, raw.size + 1, size, dtype=np.int32)), pa.py_buffer(raw.tobytes())])
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([key, none(len(a) + len(level), pa.binary())]),
                    pa.concat_arrays([pa.array(node, pa.int64()), pa.array(a, pa.int64()), pa.array(level, pa.int64())]),
                    pa.concat_arrays([none(len(node), pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.int64())]),
                    pa.concat_arrays([none(len(node) + len(a), pa.int64()), pa.array(agree[level, same], pa.int64())]),
                ],
                ["key", "a", "b", "n"],
            )

    return lean(run)


def _runs(batches):
    """Edges from the first node of each run of equal keys to the others, over sorted batches (key, node)."""
    key_before, first = None, None
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if len(key) and key_before is not None and key[0] == key_before:
            new[0] = False
        heads = np.flatnonzero(new)
        head_nodes = np.concatenate([[first if first is not None else 0], node[heads]])
        of = head_nodes[np.cumsum(new)]
        edge = ~new & (of != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[edge], pa.int64()), pa.array(of[edge], pa.int64())], ["a", "b"])
        if len(key):
            key_before, first = key[-1], of[-1]


def candidates(signed: DataFrame, threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Edges (a, b), contracted, that connect all documents under one node of a trie, at the level that shorten() finds; signed has (node, sig).

    The driver sees one small table of counts by level and agreement. Levels end where even a pair at the threshold
    would be found all but once in a million times.
    """
    least = prefix_depth(threshold, trees, depth, 1 - 1e-6)
    forest = stored(signed.select("node", "sig").mapInArrow(_tries(trees, depth, least), _FOREST), "forest")
    matches = {level: np.zeros(trees * depth + 1) for level in range(least, depth + 1)}
    for r in forest.where("n is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        matches[r.a][r.b] = r.n
    cut = shorten(matches, threshold, trees, depth, recall)
    prefix = F.xxhash64(F.substring("key", 1, 1 + 4 * cut)).alias("prefix")
    over_all = contracted(forest.where("key is not null").select(prefix, "a").repartition("prefix").sortWithinPartitions("prefix", "a"), _runs)
    return contracted(forest.where("key is null and n is null").select("a", "b")).union(over_all)


# ---------------------------------------------------------------- verification


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                h, bounds = shingle_sets(data, offsets, width)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(long_of(h), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(5)] + [sets], ["root", "node", "copies", "block", "blocks", "set"])

    return lean(run)


def _shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements every two sets share."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1
    some = seen[col] > 1
    row, col = row[some], place[col[some]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        i, j = np.searchsorted(col, [c, c + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify_group(same: bool, nodes, copies, block, sets, threshold):
    """(nodes, links, least node reached inside the group) of one pair of blocks."""
    n = np.array([len(s) for s in sets], np.int64)
    inter = _shared(sets)
    num, den = threshold
    # shared / (a + b - shared) >= num / den
    linked = inter * (num + den) >= num * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, False)
    if not same:  # links inside a block are counted where it meets itself
        linked &= block[:, None] != block[None, :]
    label = nodes.copy()
    while True:
        reached = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(label, reached)
        if (new == label).all():
            return nodes, linked @ copies, label
        label = new


def _verify(threshold):
    """Groups of equal (root, lo, hi) over sorted batches."""

    def groups(batches):
        held, key = [], None
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if i == j:
                    continue
                if held and tuple(k[:, i]) != key:
                    yield key, held
                    held = []
                key = tuple(k[:, i])
                held.append(batch.slice(i, j - i))
        if held:
            yield key, held

    def run(batches):
        out: list[tuple] = []
        size = 0
        for (_, lo, hi), parts in groups(batches):
            t = pa.Table.from_batches(parts)
            nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            column = t.column("set")
            sets = [column[int(i)].values.to_numpy() for i in at]
            out.append(_verify_group(lo == hi, nodes, t.column("copies").to_numpy()[at], t.column("block").to_numpy()[at], sets, threshold))
            size += len(nodes)
            if size > 20_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    return lean(run)


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], ["node", "links", "least"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block_docs: int = 256, block_shingles: int = 200_000) -> DataFrame:
    """One row per row of docs: (doc_id, class_id, n_links).

    n_links counts the other rows whose shingle set has a Jaccard similarity of at least threshold (a fraction) with the
    row's; class_id is the least id reached over links. Words are runs of 0-9, a-z (A-Z folded) and characters from U+0080
    on; a text of fewer than `width` words is one shingle; null, empty and wordless texts have none, hence no links
    and a class of their own. Rows that repeat an id and text are copies of each other; rows that share an id have one
    class; a row with a null id has the class of its copies, or none. An empty table gives an empty table.

    Families too large for a block are split at random into blocks that meet pairwise, so a task's work is bounded by
    block_docs and block_shingles (a single longer text aside).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(docs.mapInArrow(_sign(trees, depth, width), _SIGNED), "signed")
    groups = signed.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n").alias("n")).where("node is not null")
    groups = stored(groups, "groups")
    # one signature for each distinct set: the row of its least id
    firsts = signed.select(F.col("doc_id").alias("node"), "d1", "d2", "sig").join(groups, ["node", "d1", "d2"]).dropDuplicates(["node"])
    families = settled(candidates(firsts, threshold[0] / threshold[1], trees, depth, recall))
    members = families.join(groups.groupBy("node").agg(F.sum("copies").alias("copies"), F.max("n").alias("n")), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")).select("root", "blocks")
    members = lookup(members, sizes, "root", "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = stored(members.select("root", "node", "copies", "block", "blocks"), "members")
    # members are a share of the documents, so both sides are shuffled at every size
    sets = docs.join(members.hint("merge"), F.col("doc_id") == F.col("node")).select("root", "node", "copies", "block", "blocks", "text").mapInArrow(_sets(width), "root long, node long, copies long, block int, blocks int, set array<long>")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "copies", "block", "set")
    verified = stored(pairs.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_verify(threshold), "node long, links long, least long"), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    classes = components(verified.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))).select("node", F.col("root").alias("class_id"))
    found = stored(links.join(classes, "node"), "links")
    # rows with copies find their group by its digest (hot ones dealt out), the others by their id
    many = groups.where("copies > 1").join(found, "node", "left").select(F.struct("d1", "d2").alias("digest"), F.struct("node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "node").alias("class_id")).alias("g"))
    rows = lookup(signed.select("doc_id", F.when(F.col("d1").isNotNull(), F.struct("d1", "d2")).alias("digest")).withColumn("_row", F.monotonically_increasing_id()), many, "digest", "_row")
    rows = rows.join(found, F.col("doc_id") == F.col("node"), "left")
    return rows.select("doc_id", F.coalesce("g.class_id", "class_id", "doc_id").alias("class_id"), (F.coalesce(F.col("g.copies") - 1, F.lit(0)) + F.coalesce("g.links", "links", F.lit(0))).alias("n_links"))


def brute_force(docs: list[tuple[int, str | None]], width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> dict[int, tuple[int, int]]:
    """doc_id -> (class_id, n_links) by comparing all pairs of shingle sets of words."""
    from .decontaminate import words_of

    sets = {}
    for d, t in docs:
        w = words_of(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    links = {d: [e for e in sets if e != d and sets[d] and len(sets[d] & sets[e]) * (threshold[0] + threshold[1]) >= threshold[0] * (len(sets[d]) + len(sets[e])) and sets[e]] for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in links[todo.pop()]:
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        out[d] = (min(seen), len(links[d]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
