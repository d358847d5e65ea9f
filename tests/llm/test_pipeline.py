import itertools
import os
import sys

import pyarrow as pa

import corpus_pipeline as C
from tabulon.llm import language_id as L
from tabulon.llm import near_dedup as N
from tabulon.llm import secret_scan as S

sys.path.insert(0, os.path.dirname(__file__))
from test_dedup import shingle_set  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_against_brute_force(spark, docs, tmp_path):
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    secret = ' token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
    extra = spark.createDataFrame([(900, table.filter("doc_id = 3").first().text[:200] + " " + "zu ei sch ung keit " * 9 + secret, "aa", "s", 1)], COLUMNS)
    table.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = source.collect()
    model = L.train(L.sample(source))
    accepted = L.score(model, pa.array([r.text for r in rows], pa.string()))[2]
    kept = {}
    for r, good in zip(rows, accepted):  # one of each text, the least id
        if good:
            old = kept.get(r.text, ())
            kept[r.text] = (min([x for x in (*old, r.doc_id) if x is not None], default=None),)
    ids = {v[0]: t for t, v in kept.items()}
    sets = {i: shingle_set(t) for i, t in ids.items() if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i, j in itertools.combinations(sorted(sets), 2):
        v = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
        close += abs(v - N.THRESHOLD) < 0.12
        if v >= N.THRESHOLD:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert not close  # no pair near the threshold, where an estimate may differ
    want = {i: t for i, t in ids.items() if i is None or top(i) == i}
    assert secret.split('"')[1] in want[900]
    net = S.trained()
    want[900] = want[900].replace(secret.split('"')[1], S.MASK)
    out = C.run(spark, str(tmp_path)).toPandas()
    got = out.groupby(out.doc_id.fillna(-1)).length.sum().to_dict()
    assert got == {-1 if i is None else i: len(t.split()) for i, t in want.items()}
    assert (out.groupby("bin_id").length.sum() == out.groupby("bin_id").bin_used.first()).all() and net.threshold <= 0.5


def test_stages_keep_the_columns(spark, docs, empty, tmp_path):
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes, name
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
