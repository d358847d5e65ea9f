"""MinHash near-dedup by an LSH forest.

Each document has TREES * DEPTH MinHash values over its word shingles. A tree orders all documents by DEPTH of the
values; documents that agree on a longer prefix lie nearer. From the least prefix on, a region of the order is
halted at the depth where it is small enough to compare all its pairs; a denser one is split at the next value
(so depth adapts to each region), and before it is split each document is compared with its nearest neighbours in
the order, which share the longest prefixes. Documents that agree on all values of a tree are compared with one
another's representatives until none is left, so no group is too large. A candidate pair counts if the share of
equal values over all trees (a byte kept of each, corrected for chance) reaches the threshold. Groups are the
connected components of such pairs.

Documents with the same set of values are gathered first, so a text that thousands of documents share costs one
entry in the forest. Only (tree, prefix, values) rows are shuffled, never texts.

Defined results: a NULL or empty text, or one without words, has no near copies; texts of fewer than SHINGLE words
are one shingle, very long ones are signed whole; rows with a NULL doc_id are in no group and stay; repeated rows are one node; the least doc_id of
a group stays; an empty table gives an empty result; other columns aren't read or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, documents, fresh, id_text, map_batches, ready, stored
from .components import components
from .kernel import buffers, shingles, slices, words

SHINGLE, TREES, DEPTH, LEAST_DEPTH, LEAF, NEAR, THRESHOLD = 3, 14, 8, 2, 48, 12, 0.5
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the texts that have words, and their MinHash values, big-endian bytes."""
    data, at = buffers(texts)
    rows, out = [], []
    for i, j in slices(at):
        h, row, _, _ = words(data, at[i : j + 1])
        h, row = shingles(h, row, SHINGLE)
        if not len(h):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        part, buf = np.empty((len(starts), TREES * DEPTH), np.uint32), np.empty_like(low)
        for k in range(TREES * DEPTH):
            np.multiply(low, _A[k], out=buf)
            buf ^= high  # else every permutation is linear in the same 32 bits
            buf *= _A[-1 - k]
            buf += _B[k]
            part[:, k] = np.minimum.reduceat(buf, starts)
        rows.append(row[starts] + i)
        out.append(part)
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, TREES * DEPTH), np.uint32)
    return np.concatenate(rows), np.concatenate(out)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, values = signatures(batch.column("text"))
    raw = values.astype(">u4").tobytes()
    width = 4 * TREES * DEPTH
    return pa.record_batch([batch.column("doc_id").take(pa.array(rows)), pa.array([raw[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())], ["doc_id", "sig"])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a binary column of values of one width."""
    data, at = buffers(column.view(pa.string()) if pa.types.is_binary(column.type) else column.view(pa.large_string()))
    return data[at[0] : at[-1]].reshape(-1, width)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (tree, key): edges between documents that near-copy each other, a spanning forest for each region."""
    last, held = None, []

    def emit(key: np.ndarray, sketch: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        if len(ids) < 2:
            return None
        edges = region_edges(key.view(">u4").reshape(len(ids), DEPTH), sketch)
        return pa.record_batch([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], ["a", "b"]) if len(edges) else None

    for b in batches:
        if not b.num_rows:
            continue
        tree, key, sketch, ids = b.column("tree").to_numpy(), _fixed(b.column("key"), 4 * DEPTH), _fixed(b.column("sketch"), TREES * DEPTH), b.column("doc_id").to_numpy()
        head = np.ascontiguousarray(key[:, : 4 * LEAST_DEPTH]).view(f"V{4 * LEAST_DEPTH}").ravel()
        change = np.flatnonzero((tree[1:] != tree[:-1]) | (head[1:] != head[:-1])) + 1
        cuts = [0, *change.tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == 0 and last == (tree[0], head[0].tobytes()):
                held.append((key[:j], sketch[:j], ids[:j]))
                continue
            if held and (out := emit(*(np.concatenate(c) for c in zip(*held)))) is not None:
                yield out
            held = [(key[i:j], sketch[i:j], ids[i:j])]
        last = (tree[-1], head[-1].tobytes())
    if held and (out := emit(*(np.concatenate(c) for c in zip(*held)))) is not None:
        yield out


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketch rows; a byte is equal by chance once in 256."""
    return ((x == y).mean(axis=-1) - 1 / 256) * (256 / 255)


def region_edges(key: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Edges (row, row) among rows sorted by key that share its first LEAST_DEPTH values."""
    parent = np.arange(len(key))
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        good = alike(sketch[a], sketch[b]) >= THRESHOLD
        for x, y in zip(a[good].tolist(), b[good].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((x, y))

    work = [(0, len(key), LEAST_DEPTH)]
    while work:
        i, j, depth = work.pop()
        if j - i < 2:
            continue
        if j - i <= LEAF:
            a, b = np.triu_indices(j - i, 1)
            link(a + i, b + i)
        elif depth == DEPTH:  # equal in all values: representatives take whatever is like them, until none is left
            rest = np.arange(i, j)
            while len(rest) > 1:
                near = alike(sketch[rest], sketch[rest[0]]) >= THRESHOLD
                near[0] = True
                link(np.full(int(near.sum()) - 1, rest[0]), rest[near][1:])
                rest = rest[~near]
        else:
            for step in range(1, NEAR + 1):
                a = np.arange(i, j - step)
                link(a, a + step)
            cuts = np.flatnonzero(key[i + 1 : j, depth] != key[i : j - 1, depth]) + i + 1
            bounds = [i, *cuts.tolist(), j]
            work += [(s, e, depth + 1) for s, e in zip(bounds, bounds[1:])]
    return np.array(edges, np.int64).reshape(-1, 2)


def near_edges(docs: DataFrame) -> DataFrame:
    """Edges (a, b) of doc_ids whose components are the groups of near copies."""
    ready(docs.sparkSession)
    signed = stored(map_batches(id_text(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL"), _sign, "doc_id bigint, sig binary"), "signatures")
    same = cut(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    keys = signed.select("doc_id", F.unhex(F.md5("sig")).alias("k"))  # a group of equal signatures may be a third of all rows: its ids are never in one row
    copies = keys.hint("merge").join(same.select(F.unhex(F.md5("sig")).alias("k"), F.col("doc_id").alias("b")).hint("merge"), "k").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    width = 4 * DEPTH
    sketch = F.unhex(F.concat(*[F.substring(F.hex("sig"), 8 * k + 7, 2) for k in range(TREES * DEPTH)]))
    trees = same.select("doc_id", "sig", sketch.alias("sketch")).select("doc_id", "sketch", F.posexplode(F.array(*[F.substring("sig", 1 + t * width, width) for t in range(TREES)])).alias("tree", "key"))
    ordered = trees.repartition("tree", F.substring("key", 1, 4 * LEAST_DEPTH)).sortWithinPartitions("tree", "key", "doc_id")
    found = ordered.mapInArrow(_forest, "a bigint, b bigint")
    return found.union(copies).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of each document that has a near copy; group_id is the least doc_id of its group."""
    return components(near_edges(docs)).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies of a document of smaller doc_id's group."""
    key, gone = fresh(docs, "near"), near_groups(docs).filter("doc_id <> group_id")
    gone = gone.select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
