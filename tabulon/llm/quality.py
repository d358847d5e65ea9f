"""Quality rules: robust multivariate outliers among the documents of each language and source.

A document's statistics (STATISTICS, transformed) are a vector; for each (lang, source) the minimum covariance
determinant gives a centre and covariance that outliers can't move: from medians and quartiles, concentration steps
refit to the COVER share of documents nearest by Mahalanobis distance until the determinant settles, then once to
all within the 97.5 % quantile of chi-square. Distances are scaled so that their median is chi-square's, and a
document beyond the quantile of CUT_Z standard deviations is rejected. FLOOR, the least scale of each statistic, keeps covariances regular
where most documents of a group agree (no digits at all, say).

Each step is one pass over the statistics of all documents: they are binned by distance, and the moments of each
(group, bin) are summed where the rows are, so a hot group is no task of its own and nothing but moments is shuffled.
Models of GROUPS groups at most (half a KB each) are sent out at a time; more groups take further passes.

Defined results: a text that is NULL, empty or without words has no distance and is rejected; NULL is a language or
source of its own; groups of fewer than LEAST documents are judged with the rest of their language, and what is
still fewer with all such documents; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, documents, id_text, map_batches, ready
from .kernel import buffers, slices, words

STATISTICS = ("log_chars", "log_word_length", "upper", "digits", "symbols", "beyond_ascii", "distinct_words", "end_marks")
FLOOR = np.array([0.5, 0.06, 0.04, 0.1, 0.06, 0.05, 0.02, 0.06])
COVER, LEAST, GROUPS, BINS, STEPS, CUT_Z = 0.75, 40, 1000, 128, 12, 6.0
K = len(STATISTICS)
TRI = np.triu_indices(K)


def _class(*of: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for x in of:
        table[[ord(c) for c in x]] = True
    return table


_UPPER = _class("".join(map(chr, range(65, 91))))
_LETTER = _class("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
_LETTER[128:] = True
_DIGIT = _class("0123456789")
_SYMBOL = _class("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")
_END = _class(".?!")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text; NaN where there are no words."""
    data, at = buffers(texts)
    out = np.full((len(at) - 1, K), np.nan)
    for i, j in slices(at):
        part, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
        h, row, s, e = words(data, at[i : j + 1])
        n = np.bincount(row, minlength=j - i)
        good = np.flatnonzero(n)
        if not len(good):
            continue

        def count(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[part], dtype=np.int64)])[edge]
            return np.diff(total)[good].astype(float)

        size, m = np.diff(edge)[good].astype(float), n[good].astype(float)
        order = np.lexsort((h, row))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])]
        distinct = np.bincount(row[order][new], minlength=j - i)[good]
        letters = np.maximum(count(_LETTER), 1)
        beyond = np.zeros(256, bool)
        beyond[128:] = True
        share = lambda c, of: np.arcsin(np.sqrt(np.minimum(c / of, 1)))
        out[i + good] = np.stack([np.log(size), np.log(np.bincount(row, e - s, j - i)[good] / m), share(count(_UPPER), letters), share(count(_DIGIT), size), share(count(_SYMBOL), size), share(count(beyond), size), np.log(distinct + 1) / np.log(m + 1), share(count(_END), m)], axis=1)
    return out


def chi_square(z: float, k: int = K) -> float:
    """Quantile at so many standard deviations, by Wilson and Hilferty."""
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(K)], axis=1)


def distances(models: dict[str, tuple[np.ndarray, np.ndarray]], groups: list[str], x: np.ndarray) -> np.ndarray:
    """Squared distance of each row from its group's centre."""
    names, index = np.unique(np.array(groups, dtype=object).astype(str), return_inverse=True)
    centre = np.stack([models[g][0] for g in names])[index]
    y, out = x - centre, np.empty(len(x))
    order = np.argsort(index, kind="stable")
    bounds = np.searchsorted(index[order], np.arange(len(names) + 1))
    for g, s, e in zip(names, bounds, bounds[1:]):
        own = order[s:e]
        out[own] = np.einsum("ij,jk,ik->i", y[own], models[g][1], y[own])
    return out


def _bin(d2: np.ndarray) -> np.ndarray:
    return np.clip((np.log2(d2 + 1e-9) * 8 + BINS / 2).astype(np.int64), 0, BINS - 1)


def bin_edge(b: np.ndarray) -> np.ndarray:
    """Middle of a bin, as a squared distance."""
    return 2.0 ** ((b + 0.5 - BINS / 2) / 8)


def moments(stats: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each group: bins in order, and for each its count, sums and products."""
    told = stats.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            groups, x = np.array(b.column("g").to_pylist(), dtype=object).astype(str), _matrix(b)
            names, index = np.unique(groups, return_inverse=True)
            cell = index * BINS + _bin(distances(told.value, groups.tolist(), x))
            cols = [np.ones(len(x)), *x.T, *(x[:, p] * x[:, q] for p, q in zip(*TRI))]
            sums = np.stack([np.bincount(cell, c, len(names) * BINS) for c in cols], axis=1).reshape(len(names), BINS, -1)
            for g, s in zip(names.tolist(), sums):
                held[g] = held[g] + s if g in held else s
        for g, s in held.items():
            some = np.flatnonzero(s[:, 0])
            yield pa.record_batch([pa.array([g] * len(some)), pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(s[some, c])) for c in range(s.shape[1]))], ["g", "bin", *(f"m{c}" for c in range(s.shape[1]))])

    width = 1 + K + len(TRI[0])
    names = [f"m{c}" for c in range(width)]
    found = stats.mapInArrow(run, "g string, bin int, " + ", ".join(f"{n} double" for n in names))
    rows = found.groupBy("g", "bin").agg(*(F.sum(n).alias(n) for n in names)).toPandas().sort_values(["g", "bin"])
    return {g: (p["bin"].to_numpy(), p[names].to_numpy()) for g, p in rows.groupby("g")}


def fit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance from summed moments, with FLOOR."""
    n, mean = m[0], m[1 : 1 + K] / m[0]
    cov = np.zeros((K, K))
    cov[TRI] = m[1 + K :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, cov + np.diag(FLOOR**2)


def nearest(own: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """Moments of the share of documents of least distance; the bin on the border counts in part."""
    m = own[1]
    want, before = share * m[:, 0].sum(), np.cumsum(m[:, 0]) - m[:, 0]
    return (m * np.clip((want - before) / m[:, 0], 0, 1)[:, None]).sum(axis=0)


def middle(own: tuple[np.ndarray, np.ndarray]) -> float:
    """Median squared distance."""
    total = np.cumsum(own[1][:, 0])
    return float(bin_edge(own[0][np.searchsorted(total, total[-1] / 2)]))


def estimates(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scaled precision matrix of each group of stats (g, x0, ..)."""
    quart = stats.groupBy("g").agg(*(F.percentile_approx(f"x{k}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"x{k}") for k in range(K))).collect()
    models, deter = {}, {}
    for r in quart:
        q = np.array([r[f"x{k}"] for k in range(K)])
        models[r["g"]] = (q[:, 1], np.diag(1 / (((q[:, 2] - q[:, 0]) / 1.349) ** 2 + FLOOR**2)))
    for _ in range(STEPS):
        settled = True
        for g, own in moments(stats, models).items():
            mean, cov = fit(nearest(own, COVER))
            det = float(np.linalg.slogdet(cov)[1])
            settled &= abs(det - deter.get(g, np.inf)) < 0.02
            models[g], deter[g] = (mean, np.linalg.inv(cov)), det
        if settled:
            break
    half = chi_square(0.0)
    for last in (False, True):
        for g, own in moments(stats, models).items():
            scale = half / middle(own)
            if last:
                models[g] = (models[g][0], models[g][1] * scale)
            else:
                near = bin_edge(own[0]) * scale <= chi_square(1.96)
                mean, cov = fit(own[1][near].sum(axis=0))
                models[g] = (mean, np.linalg.inv(cov))
    return models


def grouped(stats: DataFrame) -> DataFrame:
    """stats (key, lang, source, x..) with g, the group that each row is judged in."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("NULL"))
    by_source = F.concat_ws("\x1f", part("lang"), part("source"))
    named = stats.withColumns({"gs": by_source, "gl": part("lang")})
    sizes = named.groupBy("gs", "gl").agg(F.count("*").alias("n"))
    few = sizes.filter(F.col("n") < LEAST).groupBy("gl").agg(F.sum("n").alias("m"))
    told = sizes.join(few, "gl", "left").select("gs", F.when(F.col("n") >= LEAST, F.col("gs")).when(F.col("m") >= LEAST, F.concat_ws("\x1f", "gl", F.lit("rest"))).otherwise(F.lit("rest")).alias("g"))
    return named.join(told, "gs").drop("gs", "gl")


def outliers(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, distance, rejected) of each row of docs."""
    spark = ready(docs.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(b.column("text"))
        return pa.record_batch([*(b.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x[:, k], from_pandas=True) for k in range(K))], ["doc_id", "lang", "source", *(f"x{k}" for k in range(K))])

    fields = ", ".join(f"x{k} double" for k in range(K))
    raw = map_batches(id_text(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), f, f"doc_id bigint, lang string, source string, {fields}")
    raw = cut(raw)
    stats = cut(grouped(raw.filter("x0 IS NOT NULL")))
    groups = sorted(r["g"] for r in stats.select("g").distinct().collect())
    result = raw.filter("x0 IS NULL").select("doc_id", "lang", "source", F.lit(None).cast("double").alias("distance"), F.lit(True).alias("rejected"))
    limit = chi_square(CUT_Z)
    for i in range(0, len(groups), GROUPS):
        own = groups[i : i + GROUPS]
        part = stats if len(groups) <= GROUPS else stats.filter((F.col("g") >= own[0]) & (F.col("g") <= own[-1]))
        told = spark.sparkContext.broadcast(estimates(part))

        def judge(b: pa.RecordBatch, told=told) -> pa.RecordBatch:
            d2 = distances(told.value, b.column("g").to_pylist(), _matrix(b))
            return pa.record_batch([*(b.column(c) for c in ("doc_id", "lang", "source")), pa.array(np.round(np.sqrt(d2), 4)), pa.array(d2 > limit)], ["doc_id", "lang", "source", "distance", "rejected"])

        result = result.unionByName(map_batches(part, judge, "doc_id bigint, lang string, source string, distance double, rejected boolean"))
    return result


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers(documents(spark, sf_dir))
