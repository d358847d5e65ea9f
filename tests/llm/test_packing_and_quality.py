import numpy as np
import pytest

from tabulon.llm import packing as K
from tabulon.llm import quality as Q


def slow_pack(lengths, capacity):
    """One bin after the other, without repeated patterns."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, room = [], capacity
        while any(x <= room for x in left):
            x = next(x for x in left if x <= room)
            left.remove(x)
            own.append(x)
            room -= x
        if room:
            gap, best = room + own[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if own[-1] < a + b <= gap and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best:
                least = own.pop()
                for x in best:
                    left.remove(x)
                left = sorted([*left, least], reverse=True)
                own += best
        bins.append(sorted(own))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_against_slow(seed):
    r = np.random.default_rng(seed)
    capacity, n = int(r.integers(5, 60)), int(r.integers(1, 120))
    lengths = r.integers(1, capacity + 1, n) if seed % 2 else np.minimum(capacity, 1 + r.poisson(capacity / 4, n))
    bins, start, used = K.pack(lengths, capacity)
    assert used.max() <= capacity and np.array_equal(np.bincount(bins, lengths), used)
    for b in range(len(used)):  # places follow each other without gaps
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(start[own])]
        assert np.array_equal(start[own], np.cumsum(lengths[own]) - lengths[own])
    slow = slow_pack(lengths.tolist(), capacity)
    assert len(slow) == len(used)
    assert sorted(map(sum, slow)) == sorted(used.tolist())


def test_pairs_replace_the_smallest():
    # greedy: 6, then 3 (gap 1); the 3 gives way to 2 + 2, which fills the bin
    assert sorted(sorted(p) for p, _ in K.patterns(np.bincount([6, 3, 2, 2], minlength=11))) == [[2, 2, 6], [3]]


def test_documents_keep_all_words(docs, corpus, empty):
    out = K.best_fit_packing(docs, 50).toPandas()
    assert (out.groupby("bin_id").length.sum() == out.groupby("bin_id").bin_used.first()).all() and out.bin_used.max() <= 50
    words = {}
    for i, t, *_ in corpus:
        if i is not None:
            words[i] = words.get(i, 0) + len((t or "").split())
    got = out.dropna(subset="doc_id").groupby("doc_id").length.sum().to_dict()
    assert got == {i: n for i, n in words.items() if n}
    assert K.best_fit_packing(empty).count() == 0


def robust(x):
    """Minimum covariance determinant over explicit subsets, from medians and quartiles."""
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    mean, inv = q[1], np.diag(1 / (((q[2] - q[0]) / 1.349) ** 2 + Q.FLOOR**2))
    d = lambda: np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
    for _ in range(30):
        own = x[np.argsort(d(), kind="stable")[: int(np.ceil(Q.COVER * len(x)))]]
        mean, inv = own.mean(axis=0), np.linalg.inv(np.cov(own.T, bias=True) + np.diag(Q.FLOOR**2))
    own = x[d() * Q.chi_square(0) / np.median(d()) <= Q.chi_square(1.96)]
    mean, inv = own.mean(axis=0), np.linalg.inv(np.cov(own.T, bias=True) + np.diag(Q.FLOOR**2))
    return d() * Q.chi_square(0) / np.median(d())


def test_statistics():
    import pyarrow as pa

    x = Q.statistics(pa.array(["Ab cd. ab", None, "", "..", "12 34 é"]))
    assert np.isnan(x[1:4]).all()
    share = lambda v: np.arcsin(np.sqrt(v))
    assert np.allclose(x[0], [np.log(9), np.log(2), share(1 / 6), 0, 0, 0, np.log(3) / np.log(4), share(1 / 3)])
    assert np.allclose(x[4], [np.log(8), np.log(2), 0, share(4 / 8), 0, share(2 / 8), 1, 0])


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (600, Q.K)) @ r.normal(0, 0.5, (Q.K, Q.K))
    x[:60] += 8
    rows = [("all", *map(float, v)) for v in x]
    stats = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{k} double" for k in range(Q.K)))
    model = Q.estimates(stats)
    got, want = Q.distances(model, ["all"] * 600, x), robust(x)
    assert np.corrcoef(np.log(got), np.log(want))[0, 1] > 0.97
    assert (got[:60] > Q.chi_square(Q.CUT_Z)).all() and (got[60:] > Q.chi_square(Q.CUT_Z)).mean() < 0.02


def test_outliers(spark, docs, corpus, empty):
    out = Q.outliers(docs)
    assert out.count() == len(corpus) and Q.outliers(empty).count() == 0
    assert out.filter("distance IS NULL AND NOT rejected").count() == 0
    no_words = sum(not any(c.isalnum() or ord(c) > 127 for c in t or "") for _, t, *_ in corpus)
    assert out.filter("distance IS NULL").count() == no_words


def test_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op4_quality_outliers(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.rejected): r["count"] for r in out.groupBy("quality", "rejected").count().collect()}
    assert n.get((0, True), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))
    assert n.get((1, True), 0) <= 0.1 * (n.get((1, True), 0) + n.get((1, False), 0))
