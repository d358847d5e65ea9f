import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tabulon.llm import html_text as H
from tabulon.llm import tokens as K
from tabulon.llm import toxicity as X
from tabulon.llm.kernel import buffers

SF = "/root/testdata/sf0.001"


def test_split_is_the_pattern():
    r = random.Random(8)
    letters = "ab'strevml d1 2\n\t  .,!é’ßЖ中½ 　\xa0''🙂"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 30))) for _ in range(8000)] + ["'s's", "x  's ", "   ", "", "don't I've we'll"]
    data, at = buffers(pa.array(texts))
    start, row = K.split(data, at)
    out = [[] for _ in texts]
    for s, e, i in zip(start, np.append(start[1:], at[-1]), row):
        out[i].append(bytes(data[s:e]).decode())
    pattern = regex.compile(K.PATTERN)
    assert [pattern.findall(t) for t in texts] == out


def ranks_and_encoder():
    raw = open(K.VOCABULARY, "rb").read()
    return K.ranks(raw), K.encoder(raw)


@pytest.mark.parametrize("block", [K.BLOCK, 500])
def test_encode_and_decode_round_trip(docs, corpus, block):
    """Small blocks too, so that words are in many blocks."""
    _, e = ranks_and_encoder()
    out = K.decode(K.encode(docs, block=block)).collect()
    assert len(out) == len(corpus)
    key = lambda x: (str(x[0]), str(x[1]))
    for r, (i, t, *_) in zip(sorted(out, key=key), sorted(corpus, key=key)):
        assert r.doc_id == i and r.text == t == r.decoded
        assert r.ids == (None if t is None else e.encode_ordinary(t))


def test_op5_against_the_tokenizer(spark):
    _, e = ranks_and_encoder()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = K.op5_bpe(spark, SF).collect()
    assert len(out) == len(texts) and all(r.exact and r.ids == e.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_pieces_that_are_no_text(spark):
    known, _ = ranks_and_encoder()
    half = known["é".encode()[:1]]
    rows = spark.createDataFrame([(1, [half], "x"), (2, None, None), (3, [], "y")], "doc_id bigint, ids array<int>, note string")
    assert {(r.doc_id, r.decoded, r.note) for r in K.decode(rows).collect()} == {(1, "\ufffd", "x"), (2, None, None), (3, "", "y")}


def test_squeeze_and_spread():
    x = np.array([0, 1, 65535, 65536, 2**32 - 1, 7], np.uint32)
    assert K.spread(K.squeeze(x), 6).tolist() == x.tolist() and not len(K.spread(K.squeeze(x[:0]), 0))


def test_token_counts(docs, corpus, empty):
    _, e = ranks_and_encoder()
    sizes = sorted(len(e.encode_ordinary(t)) for _, t, *_ in corpus if t is not None)
    h = K.histogram(K.lengths(docs))
    for r in h.collect():
        n = r.n_tokens
        assert r.docs == sizes.count(n) and r.docs_at_least == sum(x >= n for x in sizes) and r.tokens_at_least == sum(x for x in sizes if x >= n)
        assert r.tokens_cut_here == sum(min(x, n) for x in sizes) and abs(r.share_up_to - sum(x <= n for x in sizes) / len(sizes)) < 1e-8
    cut, share = K.answer(h, [0, 10, 128, 10**7], [0.5, 1.0])
    assert cut == {k: sum(min(x, k) for x in sizes) for k in (0, 10, 128, 10**7)}
    assert share == {0.5: sizes[(len(sizes) + 1) // 2 - 1], 1.0: sizes[-1]}
    assert K.histogram(K.lengths(empty)).count() == 0 and K.encode(empty).count() == 0


CASES = [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"), ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
    ("<pre> a\n  b</pre>", " a\n  b"), ("x<script>var t='</p>';</script>y<style>p{}</style>", "xy"), ("<div hidden>no</div><div style='Display : NONE'>no</div><p aria-hidden=true>no<p>yes", "yes"), ("<!-- c -->a<!-- open", "a"),
    ("1 < 2 &amp; 3 &lt; 4 <3", "1 < 2 & 3 < 4 <3"), ("<b>a<i>b</b>c</i>", "abc"), ("</div>a</p>b", "a\n\nb"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("<h1>T</h1>x<h2>U", "T\n\nx\n\nU"), ("<p>a  \n b</p>", "a b"), ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<p>un<b>closed", "unclosed"), ("<title>no</title><body>yes", "yes"), ("<a title='x > y'>z</a>", "z"), ("<img alt='pic'> <input type=submit value=Go>", "pic Go"), ("", ""), (None, None), ("<", "<"), ("<div>" * 3000 + "deep", "deep"), ("<td>" * 600 + "x", "x"), ("<select><option>a<option>b</select>", "a\nb"),
]


@pytest.mark.parametrize("source,text", CASES)
def test_render(source, text):
    assert H.render(source) == text


def test_render_never_fails():
    r = random.Random(2)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b", "=\"'", ">", "<!--", "-->", "x", " ", "\n", "&amp;", "&#x110000;", "<pre>", "</", "<script>", "<!", "<?", "\x00", "é"]
    for _ in range(3000):
        assert isinstance(H.render("".join(r.choice(bits) for _ in range(r.randrange(40)))), str)


def test_extract(spark):
    rows = [(1, "u", "<p>a", "x"), (2, None, None, None), (None, "u", "", "x"), (1, "u", "<p>a", "x"), (3, "u", "w " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = {(r.page_id, r.text if len(r.text or "") < 9 else "long") for r in H.extract(pages).collect()}
    assert out == {(1, "a"), (2, None), (None, ""), (3, "long")} and H.extract(pages).count() == 5 and H.extract(pages.limit(0)).count() == 0
    words = lambda s: sorted(s.split())
    for p, t in zip(*[sorted(x.collect(), key=lambda r: r.page_id) for x in (spark.read.parquet(f"{SF}/pages.parquet"), H.op10_html_text(spark, SF))]):
        assert "track(" not in t.text and "margin" not in t.text
        plain = regex.sub(r"<[^>]*>", " ", regex.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", p.html))
        import html

        assert sorted("".join(words(html.unescape(plain)))) == sorted("".join(words(regex.sub(r"(?m)^(- )+", "", t.text))))


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(6)
    stock = ["".join(r.choice(["the", "ing", "er", "on", "an", "re", "ou"]) for _ in range(r.randint(4, 7))) for _ in range(2000)]
    bad = [f"bad{x}" for x in "abcdefgh"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(stock) for _ in range(60)]
        is_bad = i % 9 == 0
        if is_bad:
            for _ in range(6):
                w.insert(r.randrange(20, 40), r.choice(bad))
        rows.append((i, " ".join(w), "aa" if i % 2 else None))
        if i % 3 == 0:
            labels.append((i, int(is_bad)))
    rows += [(1000, None, None), (1001, "", "aa"), (1002, "bada badb badc badd", "zz"), (None, "x", "aa"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(*x, "s", 1, 2) for x in rows], "doc_id bigint, text string, lang string, n string, ids int, toxic int")
    return docs, spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id bigint, toxic int"), bad


def test_toxic_documents(toxic):
    docs, labels, bad = toxic
    found = [r.doc_id for r in X.flag(docs, labels).collect()]
    want = {i for i in range(900) if i % 9 == 0}
    assert len(want & set(found)) >= 0.95 * len(want) and len(set(found) - want - {1002}) <= 5
    assert found.count(0) == 2  # a row that repeats
    words = [r.word for r in X.lexicon(docs, labels).orderBy(F.desc("weight")).collect()]
    assert set(words[: len(bad)]) == set(bad)  # neighbours by chance come after them


def test_without_labels_or_rows(toxic):
    docs, labels, _ = toxic
    assert X.flag(docs, labels.limit(0)).count() == 0
    assert X.flag(docs.limit(0), labels).count() == 0
    assert X.flag(docs, labels.filter("toxic = 0")).count() == 0


def test_edges_against_brute_force(spark, toxic):
    import math

    from tabulon.llm.base import id_text

    docs, _, bad = toxic
    docs = docs.filter("doc_id < 60")
    texts = [r.text.split() for r in docs.select("text").collect() if r.text]
    vocabulary = sorted({w for t in texts for w in t})[:40]
    h = {w: X.words(*buffers(pa.array([w])))[0][0] for w in vocabulary}
    nodes = X.Nodes(np.array(list(h.values()), np.uint64))
    number = {w: int(nodes.number(np.array([x], np.uint64))[0]) for w, x in h.items()}
    want = {}
    for t in texts:
        for i, u in enumerate(t):
            for v in t[i + 1 : i + 1 + X.WINDOW]:
                if u in number and v in number and u != v:
                    p = tuple(sorted((number[u], number[v])))
                    want[p] = want.get(p, 0) + 1
    degree = np.zeros(len(nodes.h))
    for (a, b), n in want.items():
        degree[a] += n
        degree[b] += n
    pairs = X.pair_counts(id_text(docs), nodes).cache()
    got = {(r.a, r.b): r.n for r in pairs.collect() if r.b >= 0}
    assert got == {p: n for p, n in want.items() if n >= X.LEAST_PAIRS}
    ends = np.zeros(len(nodes.h))
    for r in pairs.collect():
        ends[r.a] += r.n if r.b < 0 else 0
    assert np.array_equal(ends, degree)
    edges = {(r.a, r.b): r.w for r in X.ppmi(pairs, nodes).collect()}
    for (a, b), n in got.items():
        value, low = math.log(n * degree.sum() / degree[a] / degree[b]), min(degree[a], degree[b])
        chance = degree[a] * degree[b] / degree.sum()
        assert ((a, b) in edges) == (value >= X.LEAST_INFORMATION and n - chance >= X.SIGNIFICANCE * chance**0.5)
        if (a, b) in edges:
            assert math.isclose(edges[a, b], value * n / (n + 1) * low / (low + 1), rel_tol=1e-9)


def test_lexicon_has_no_false_words(toxic):
    docs, labels, bad = toxic
    words = {r.word for r in X.lexicon(docs, labels).collect()}
    assert set(bad) <= words and len(words) <= 12


def test_pairs_near_chance_are_edges(spark):
    """n = 2 where chance gives 1: positive information, though within a standard deviation of chance."""
    nodes = X.Nodes(np.arange(4, dtype=np.uint64))
    pairs = spark.createDataFrame([(0, 1, 2), (2, 3, 12), (0, -1, 4), (1, -1, 8), (2, -1, 10), (3, -1, 10)], "a int, b int, n bigint")
    assert {(r.a, r.b) for r in X.ppmi(pairs, nodes).collect()} == {(0, 1), (2, 3)}


def test_walks_in_parts_against_matrix(spark):
    """Two languages, edges in parts, against powers of a dense matrix."""
    r = np.random.default_rng(3)
    nodes = X.Nodes(np.arange(30, dtype=np.uint64), np.arange(30) % 2)
    rows = [(a, b, float(r.random())) for a in range(30) for b in range(a + 1, 30) if (a - b) % 2 == 0 and r.random() < 0.4]
    start = r.random((2, 30))
    m = np.zeros((30, 30))
    for a, b, w in rows:
        m[a, b] = m[b, a] = w
    m /= m.sum(axis=0)
    want = start.T
    for _ in range(X.ROUNDS):
        want = (1 - X.RESTART) * m @ want + X.RESTART * start.T
    assert np.allclose(X.walks(spark.createDataFrame(rows, "a int, b int, w double").repartition(3), nodes, start), want.T, rtol=1e-5)


@pytest.fixture(scope="module")
def heavy(spark):
    """A third of the documents toxic, so that each planted term is in more than COMMON of them; badr is in four documents, fewer than LEAST_DOCS; badz in documents without labels alone."""
    r = random.Random(9)
    stock = ["".join(r.choice(["the", "ing", "er", "on", "an", "re", "ou"]) for _ in range(r.randint(4, 7))) for _ in range(800)]
    bad, rows = [f"bad{x}" for x in "abcdefgh"], []
    for i in range(600):
        w = [r.choice(stock) for _ in range(60)]
        if i % 3 == 0:
            for x in [r.choice(bad) for _ in range(6)] + ["badr"] * (i in (3, 6, 9, 12)) + ["badz"] * 2 * (i % 15 == 0):
                w.insert(r.randrange(25, 35), x)
        rows.append((i, " ".join(w), "aa"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600) if i % 5], "doc_id bigint, toxic int")
    return docs, labels, bad, {x.word: x.weight for x in X.lexicon(docs, labels).collect()}


def test_toxic_words_beyond_the_band(heavy):
    docs, labels, bad, words = heavy
    assert {*bad, "badr"} <= set(words)
    found = {r.doc_id for r in X.flag(docs, labels).collect()}
    assert len(found & set(range(0, 600, 3))) >= 190 and len(found) <= 205


def test_toxic_word_of_unlabelled_documents_alone():
    """Word 3 is in no labelled document and stands beside the toxic seeds 0, 1 and 2; word 4 does too, but clean documents favour it."""
    r = np.random.default_rng(1)
    edges = [(a, b, 1.0) for a in range(5, 200) for b in range(a + 1, 200) if r.random() < 0.2] + [(a, b, 5.0) for a in range(5) for b in range(a + 1, 5)] + [(a, 5 + a, 1.0) for a in range(5)]
    a, b, w = (np.array(x) for x in zip(*edges))
    ratio = np.full(200, -2.0)
    ratio[:5] = 9.0, 8.0, 7.0, X.seed_ratio(np.zeros(1), np.zeros(1), 50, 100)[0], -0.5
    step = lambda q: np.stack([np.bincount(a, w * x[b], 200) + np.bincount(b, w * x[a], 200) for x in q])
    weight = X.polarity(*X.walk(step, X.seeds(ratio)), ratio)
    assert (weight > 0).tolist() == [True] * 4 + [False] * 196
