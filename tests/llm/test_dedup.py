import hashlib
import itertools
import re
from collections import defaultdict

import duckdb
import pytest

from tabulon.llm import exact_dedup as E
from tabulon.llm import near_dedup as N
from tabulon.llm.base import scratch
from tabulon.llm.components import components

SF = "/root/testdata/sf0.001"


def test_exact_keeps_least_id_and_null_texts(docs, corpus):
    out = E.exact_dedup(docs)
    assert out.columns == docs.columns
    want = {}
    for i, t, *_ in corpus:
        if t is not None:
            want[t] = min((x for x in (want.get(t), i) if x is not None), default=None)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(t for _, t in got if t is not None) == sorted(want)
    assert all(want[t] == i for i, t in got if t is not None)
    assert sum(t is None for _, t in got) == sum(t is None for _, t, *_ in corpus)


def test_index_persists_and_grows(spark, docs):
    path = scratch(spark, "test")
    first = E.DigestIndex(spark, path, 4)
    n = first.ingest(docs.filter("doc_id < 100"))
    spark.sql(f"DROP TABLE {first.table}")
    again = E.DigestIndex(spark, path, 4)  # another session finds the folder
    assert again.read().count() == first_count(docs, 100)
    m = again.ingest(docs)
    assert m == n + 1
    new = {r.text for r in E.survivors(docs, again, m).filter("text IS NOT NULL").collect()}
    old = {r.text for r in docs.filter("doc_id < 100").collect()}
    assert not new & old
    assert {hashlib.sha256(t.encode()).digest() for t in (new | old) - {None}} == {bytes(r.digest) for r in again.read().collect()}
    again.ingest(docs)
    assert again.read().count() == len((new | old) - {None})


def first_count(docs, n):
    return docs.filter(f"doc_id < {n} AND text IS NOT NULL").select("text").distinct().count()


def test_op8_sql(spark):
    want = duckdb.sql(E.OP8_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).df().doc_id
    assert sorted(want) == sorted(r.doc_id for r in E.op8_exact_dedup(spark, SF).collect())


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 8), (8, 7), (7, 9), (3, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 131)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(w[i : i + N.SHINGLE]) for i in range(max(1, len(w) - N.SHINGLE + 1))} if w else set()


@pytest.mark.parametrize("which", ["corpus", "sf0.01"])
def test_near_against_brute_force(spark, docs, which):
    table = docs if which == "corpus" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: shingle_set(r.text) for r in table.filter("doc_id IS NOT NULL").select("doc_id", "text").collect()}
    group = {r.doc_id: r.group_id for r in N.near_groups(table).collect()}
    by = defaultdict(list)
    for i, s in rows.items():
        for x in s:
            by[x].append(i)
    pairs = {p for own in by.values() for p in itertools.combinations(sorted(own), 2)}
    like = {(i, j): len(rows[i] & rows[j]) / len(rows[i] | rows[j]) for i, j in pairs}
    near = [p for p, v in like.items() if v >= 0.55]
    assert near and sum(i in group and group[i] == group.get(j) for i, j in near) >= 0.9 * len(near)
    linked = {i for p, v in like.items() if v >= 0.35 for i in p}
    assert set(group) <= linked
    assert all(group[g] == g and g <= i for i, g in group.items())


def test_near_drops_all_but_one(docs):
    group = {r.doc_id: r.group_id for r in N.near_groups(docs).collect()}
    out = N.drop_near_copies(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert not [i for i in kept if group.get(i, i) != i]
    assert {g for g in group.values()} <= set(kept) and kept.count(None) == 2


def test_large_group_of_copies(spark):
    """A region far above LEAF is split, and still one group."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(w if i != k % 200 else f"z{k}" for i, w in enumerate(words))) for k in range(1500)]
    group = N.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(group) == 1500 and {r.group_id for r in group} == {0}


def test_empty(empty):
    assert E.exact_dedup(empty).count() == 0
    assert N.near_groups(empty).count() == 0 and N.drop_near_copies(empty).count() == 0
