"""Retrieval: exact cosine neighbours by blocks, token search, filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a block's vectors as doubles (a task holds two blocks), and the rows and columns of one product.
BLOCK_BYTES, TILE = 1 << 25, (512, 2048)
#: Similarities are rounded to six digits; half a digit, with room for the last bits of a product.
DIGITS, HALF = 6, 4.9e-7


def cosine_neighbours(vectors: DataFrame, key: str, vector: str, k: int, blocks: int = 8) -> DataFrame:
    """(id, neighbour, similarity, rank): for each vector the k others of the largest cosine similarity, smaller ids first among equals. Exact: each pair of blocks is one task's, in products of TILE; only the best k of each pair go on. A block has BLOCK_BYTES at most, at any number of vectors; small tables have up to `blocks` of them. Vectors that are NULL or 0 have no neighbours."""
    kind = "array<float>" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "array<double>"
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("bigint")), F.lit(0))).first()
    blocks = max(1, -(-8 * size // BLOCK_BYTES), min(blocks, -(-n // 4096)))
    own = F.pmod(F.hash("id"), F.lit(blocks))
    sent = rows.withColumn("b", own).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = F.least("b", "c") * blocks + F.greatest("b", "c")
    found = sent.select(pair.alias("pair"), "b", "id", "v").repartition(blocks * (blocks + 1) // 2, "pair").groupBy("pair").applyInArrow(lambda t: _of_pair(t, k), "id bigint, neighbour bigint, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _of_pair(rows: pa.Table, k: int) -> pa.Table:
    """The best k of each vector of a block in the other block; of one block alone, in itself."""
    block, ids, lists = rows["b"].to_numpy(), rows["id"].to_numpy(), rows["v"].combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    width = np.diff(lists.offsets.to_numpy())
    if (width != width[0]).any():
        raise ValueError("vectors of different lengths")
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width[0])
    sides = []
    for own in np.unique(block):
        at = np.flatnonzero(block == own)
        at = at[np.argsort(ids[at], kind="stable")]
        unit = flat[at].astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        unit /= np.maximum(norm, 1e-300)[:, None]
        good = (norm > 0) & ~np.isnan(unit).any(axis=1)
        sides.append((ids[at][good], unit[good]))
    found = best_pairs(*sides[0], *sides[-1], k, len(sides) == 1)
    return pa.table(dict(zip(("id", "neighbour", "similarity"), (np.concatenate(c) for c in zip(*found)))))


def best_pairs(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other, similarity) of the best k for each row of a in b, and for each row of b in a unless they are the same. Rows are of length 1 and in the order of their ids, so that of equal similarities those found first stay."""
    left, right = ((np.full((len(x), k), -np.inf), np.zeros((len(x), k), dtype=np.int64)) for x in (a, b))
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            s = a[i : i + TILE[0]] @ b[j : j + TILE[1]].T
            x, y = slice(i, i + len(s)), slice(j, j + s.shape[1])
            if same:
                s[ids[x, None] == others[None, y]] = -np.inf
            _take(s, left, x, others[y], k)
            if not same:
                _take(s.T, right, y, ids[x], k)
    return [_listed(ids, *left), *([] if same else [_listed(others, *right)])]


def _take(s: np.ndarray, best: tuple[np.ndarray, np.ndarray], rows: slice, ids: np.ndarray, k: int) -> None:
    """Puts a product's similarities that are among the best k of their rows into best (similarities, ids)."""
    value, neighbour = (x[rows] for x in best)
    least = value[:, -1] + HALF
    if len(new := np.flatnonzero(np.isneginf(least))) and s.shape[1] > k:
        least[new] = np.partition(s[new], -k, axis=1)[:, -k] - 3 * HALF
    above = s > least[:, None]
    r, c = np.divmod(np.flatnonzero(above), s.shape[1]) if above.flags.c_contiguous else np.divmod(np.flatnonzero(above.T), len(s))[::-1]
    if not len(r):
        return
    hit = np.unique(r)
    row = np.concatenate([np.repeat(hit, k), r])
    v, n = np.concatenate([value[hit].ravel(), np.round(s[r, c], DIGITS)]), np.concatenate([neighbour[hit].ravel(), ids[c]])
    order = np.lexsort((n, -v, row))
    first = order[np.searchsorted(row[order], hit)[:, None] + np.arange(k)]
    value[hit], neighbour[hit] = v[first], n[first]


def _listed(ids: np.ndarray, value: np.ndarray, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    real = np.isfinite(value).ravel()
    return np.repeat(ids, value.shape[1])[real], neighbour.ravel()[real], value.ravel()[real]


def term_score(text: Column, terms: list[str]) -> Column:
    """How many times the terms occur as words, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.size(F.filter(words, lambda w: w.isin(terms)))
