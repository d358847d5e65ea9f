"""Best-two-fit packing of documents into bins of a fixed number of words.

A bin is filled greedily, with the largest piece that fits, until none does. Then its smallest piece is replaced by
two unpacked pieces if they fill the gap, expanded by that piece, more tightly; the pair of the largest sum is
taken. Documents longer than a bin are cut into full bins and a rest, so no word is lost.

Lengths are integers up to the capacity, so packing works on the histogram of lengths: a bin's pattern is repeated
as often as the counts allow, and pieces of equal length are then dealt to the pattern's places in order of doc_id.
Shards of about SHARD pieces, by hash of doc_id, are packed each by itself: their number grows with the data, the
work of each doesn't, and only (doc_id, length) is shuffled.

Defined results: a document without words (NULL, empty, white space alone) has no piece and is left out; rows that
repeat are packed each; rows with a NULL doc_id are packed too; an empty table gives no bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, documents, id_text, ready

CAPACITY, SHARD = 2048, 50_000
SCHEMA = "bin_id string, doc_id bigint, piece int, start int, length int, bin_used int"


def patterns(counts: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Bins as (lengths, how many alike), for counts[length] pieces of each length; counts ends at the capacity."""
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    places = np.arange(capacity + 1)

    def fitting() -> np.ndarray:
        """For each room, the largest length left that fits; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, places, 0))

    fit = fitting()
    while fit[capacity]:
        bin_, room, taken = [], capacity, False
        while fit[room]:
            size = int(fit[room])
            number = min(room // size, int(left[size]))
            bin_ += [size] * number
            left[size] -= number
            room -= size * number
            if not left[size]:
                fit = fitting()
        if room:
            least = bin_[-1]
            gap = room + least
            first = places[1 : gap + 1][left[1 : gap + 1] > 0]
            if len(first):
                other = fit[gap - first]
                twice = (other == first) & (left[first] < 2)
                if twice.any():  # the one piece of this length can't be both
                    below = np.maximum.accumulate(np.where((left > 0), places, 0))
                    other = np.where(twice, below[np.maximum(np.minimum(first - 1, gap - first), 0)], other)
                total = np.where(other > 0, first + other, 0)
                best = int(total.argmax())
                if total[best] > least:
                    pair = (int(first[best]), int(other[best]))
                    bin_[-1:] = pair
                    left[pair[0]] -= 1
                    left[pair[1]] -= 1
                    left[least] += 1
                    taken = True
        need = np.bincount(bin_, minlength=capacity + 1)
        sizes = np.flatnonzero(need)
        more = int((left[sizes] // need[sizes]).min())
        left[sizes] -= more * need[sizes]
        yield bin_, more + 1
        if more or taken or not left[sizes].all():
            fit = fitting()


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and start of each piece (of lengths from 1 to the capacity), and the words used of each bin."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    next_ = np.cumsum(counts) - counts
    bins, starts, used, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], 0
    for pattern, times in patterns(counts):
        at = 0
        for size in pattern:
            own = order[next_[size] : next_[size] + times]
            next_[size] += times
            bins[own], starts[own] = np.arange(number, number + times), at
            at += size
        used += [at] * times
        number += times
    return bins, starts, np.array(used, np.int64)


def word_count(text: str = "text"):
    """Words between white space; none for NULL."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"\S+")))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin_id, doc_id, piece, start, length, bin_used): where in which bin each piece of a document lies."""
    ready(docs.sparkSession)
    lengths = cut(id_text(docs).select("doc_id", word_count().alias("n")).filter("n > 0"))
    shards = max(1, math.ceil(lengths.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0) // SHARD)
    sharded = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], kind="stable")
        full, rest = (pdf.n // capacity).to_numpy(np.int64), (pdf.n % capacity).to_numpy(np.int64)
        row = np.repeat(np.arange(len(pdf)), full + (rest > 0))
        piece = np.arange(len(row)) - np.repeat(np.cumsum(full + (rest > 0)) - (full + (rest > 0)), full + (rest > 0))
        length = np.where(piece < full[row], capacity, rest[row])
        bins, start, used = pack(length, capacity)
        name = f"{int(pdf.shard.iloc[0])}-"
        return pd.DataFrame({"bin_id": [name + str(x) for x in bins], "doc_id": pdf.doc_id.iloc[row].astype("Int64").array, "piece": piece.astype("int32"), "start": start.astype("int32"), "length": length.astype("int32"), "bin_used": used[bins].astype("int32")})

    return sharded.groupBy("shard").applyInPandas(f, SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
