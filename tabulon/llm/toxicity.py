"""Toxicity by lexicon induction over word graphs, one for each language of the lang column.

Seeds are by evidence: of labelled documents (copies and near copies of a text about once), two thirds, by hash, give each word a signed
likelihood ratio between toxic and clean ones, and of the words that are LIFT times as frequent in toxic ones at least, Benjamini and Hochberg's procedure takes all,
with a share of false ones below FALSE. Nodes of a language's graph are the words in SUPPORT..COMMON
of its documents, the seeds, and words below SUPPORT that stand within WINDOW words of seeds in more documents than
chance gives (LIFT times as many at least), by the same procedure. A word in several languages is a node in each one's graph. Edges are positive
pointwise mutual information, shifted by LEAST_INFORMATION, of two nodes within WINDOW words, discounted for small
counts. Random walks with restart, from the seeds and from words that clean documents favour, spread polarity; a
word's weight is the standardised log ratio of the two, 0 for words that clean documents favour. A document's score is
the sum of its words' weights above a cutoff, over the square root of its words. Cutoff and threshold are those of
best F1, of precision PRECISION if any are, on the third of labelled documents that gave no seeds: by language, and
over all languages together for one of fewer than LEAST_HELD toxic ones there.

What reaches the driver or goes out is bounded: a word of SUPPORT of the documents, or of RARE of the toxic ones or of
those around seeds, is one of at most 1/SUPPORT or 1/RARE times the mean number of distinct words. Edges stay in the
shared folder, and each step of a walk is a job over them that returns a number for each node.

Defined results: NULL and empty texts, and texts without lexicon words, score 0 and aren't flagged; documents
without labels are scored alike; a NULL language is one of its own; a text labelled both ways counts as both; without
seeds a language has no lexicon, and an empty table, or one without labels, no flags; very long texts are read whole;
ties between cutoffs go to the one nearest to LEXICON, between thresholds to the lower; repeated rows are flagged each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, id_text, map_batches, ready, stored
from .kernel import buffers, mix, shingles, slices, words

SUPPORT, COMMON, RARE, LEAST_DOCS, LEAST_TOXIC, WINDOW, LEAST_PAIRS, LEAST_INFORMATION = 0.005, 0.10, 0.001, 5, 3, 10, 2, 0.3
FALSE, LIFT, SEED_RATIO, RESTART, ROUNDS, LEXICON, CUTS = 0.01, 3.0, 3.5, 0.3, 16, 5.0, (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0)
#: SIGNIFICANCE 0: no pair of positive information is left out for being within what chance may give. SPAN: nodes whose sums a step's task adds up together. FINE: bins of scores in a factor of e. HELD: pairs that a task holds before it sends them on.
PRECISION, FOLDS, LEAST_HELD, FINE, RANGES, SIGNIFICANCE, BLOCK, SPAN, HELD = 0.95, 3, 10, 50, 512, 0.0, 1 << 18, 1 << 12, 2_000_000
MARKED_BITS = 1 << 26


def salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") if lang else 0


def keyed(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of rows i..j of (text, and lang if there is such a column): i, j, hashes of its words, hashes with the language in them, rows, starts and ends."""
    data, at = buffers(b.column("text"))
    if "lang" in b.schema.names:
        d = b.column("lang").dictionary_encode()
        salts, code = np.array([salt(x) for x in d.dictionary.to_pylist()], np.uint64), d.indices.to_numpy()
    else:
        salts, code = np.zeros(1, np.uint64), np.zeros(b.num_rows, np.int64)
    for i, j in slices(at):
        h, row, start, end = words(data, at[i : j + 1])
        yield i, j, h, h ^ salts[code[i + row]] if len(h) else h, row, start, end


def word_documents(docs: DataFrame, near: Nodes | None = None) -> DataFrame:
    """(lang, h, n): in how many documents of a language the word of each hash is, or is within WINDOW words of a node of near; in parts, which are to be added up."""
    told = docs.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                h, inverse = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x for _, x in own]))
                yield pa.record_batch([pa.array([lang]).take(pa.array(np.zeros(len(h), np.int64))), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "h", "n"])
            held.clear()

        for b in batches:
            names, lang = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for i, _, h, key, row, _, _ in keyed(b):
                if told.value is not None:
                    hit = told.value.number(key) >= 0
                    close, having = around(hit, row), np.unique(row[hit])
                    h, row = np.concatenate([h[close], np.zeros(len(having), np.uint64)]), np.concatenate([row[close], having])
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
                h, of = h[once], lang[i + row[once]]
                for k in np.unique(of).tolist():
                    own = np.unique(h[of == k], return_counts=True)
                    held.setdefault(str(names[k]), []).append(own)
                    size += len(own[0])
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang string, h bigint, n bigint")


def around(hit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which words are no hits, and within WINDOW words of one in their row."""
    close = np.zeros(len(hit), bool)
    for k in np.flatnonzero(hit).tolist():
        low, high = max(0, k - WINDOW), k + WINDOW + 1
        close[low:high] |= row[low:high] == row[k]
    return close & ~hit


def document_frequency(docs: DataFrame, near: Nodes | None = None) -> DataFrame:
    """(lang, h, n) of word_documents, added up."""
    return word_documents(docs, near).groupBy("lang", "h").agg(F.sum("n").alias("n"))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and few others: a bitmap of hashed ids (32 bits an id, MARKED_BITS at most) drops most, so that a join with ids needs few texts."""
    bits = min(MARKED_BITS, 1 << max(16, (32 * ids.count()).bit_length()))

    def spots(b: pa.RecordBatch) -> np.ndarray:
        return (mix(b.column("doc_id").to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits, bool)
        for b in batches:
            have[spots(b)] = True
        yield pa.record_batch([pa.array([np.packbits(have, bitorder="little").tobytes()])], ["have"])

    total = np.zeros(bits // 8, np.uint8)
    for r in ids.select("doc_id").coalesce(8).mapInArrow(mark, "have binary").toLocalIterator():
        total |= np.frombuffer(r["have"], np.uint8)
    told = docs.sparkSession.sparkContext.broadcast(total)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        k = spots(b)
        return b.filter(pa.array((told.value[k >> 3] >> (k & 7)) & 1 == 1))

    return map_batches(docs.filter("doc_id IS NOT NULL"), f, docs.schema)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, m0, m1, m2) of each row with words: three MinHash values of its 3-word shingles."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, least = [], []
        for i, _, h, _, row, _, _ in keyed(b):
            h, row = shingles(h, row, 3)
            if len(h):
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rows.append(i + row[starts])
                least.append([np.minimum.reduceat(mix(h ^ np.uint64(k)), starts).view(np.int64) for k in range(3)])
        if not rows:
            return None
        take = pa.array(np.concatenate(rows))
        return pa.record_batch([b.column("doc_id").take(take), b.column("lang").take(take), *(pa.array(np.concatenate(m)) for m in zip(*least))], ["doc_id", "lang", "m0", "m1", "m2"])

    return map_batches(docs, f, "doc_id bigint, lang string, m0 bigint, m1 bigint, m2 bigint")


class Nodes:
    """Sorted hashes of the graph's words (with their languages in them); a word's number is its place, its home the number of its language."""

    def __init__(self, h: np.ndarray, home: np.ndarray | None = None):
        order = np.argsort(h, kind="stable")
        self.h, self.home = h[order], np.zeros(len(h), np.int64) if home is None else home[order]

    def number(self, h: np.ndarray) -> np.ndarray:
        """-1 for other words."""
        if not len(self.h):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, i, -1)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.astype("<u4")), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")


def pair_counts(docs: DataFrame, nodes: Nodes) -> DataFrame:
    """(a, b, n): how often two nodes, a < b by number, stand within WINDOW words of each other, if LEAST_PAIRS times at least; and (a, -1, n): all such pairs of node a. Pairs are numbered, and each task sends each of RANGES ranges (more for very many nodes) of numbers as compressed differences and counts; a range is summed up in an array of fixed size."""
    told, v = docs.sparkSession.sparkContext.broadcast(nodes), max(1, len(nodes.h))
    ranges = max(RANGES, v * v >> 21)
    width = v * v // ranges + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return code, np.bincount(inverse, np.concatenate([x for _, x in held])).astype(np.int64)

        def sent() -> pa.RecordBatch:
            code, n = merged()
            held.clear()
            cuts = np.searchsorted(code // width, np.arange(ranges + 1))
            some = np.flatnonzero(np.diff(cuts))
            rows = [(int(r), int(cuts[r + 1] - cuts[r]), _pack(np.diff(code[cuts[r] : cuts[r + 1]], prepend=r * width)), _pack(n[cuts[r] : cuts[r + 1]])) for r in some]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["r", "size", "codes", "counts"])

        for b in batches:
            for _, _, _, key, row, _, _ in keyed(b):
                number = told.value.number(key)
                pos = np.flatnonzero(number >= 0)
                number, row, found = number[pos], row[pos], []
                for step in range(1, WINDOW + 1):
                    close = (pos[step:] - pos[:-step] <= WINDOW) & (row[step:] == row[:-step])
                    if not close.any():
                        break
                    near = close & (number[step:] != number[:-step])
                    x, y = number[step:][near], number[:-step][near]
                    found.append(np.minimum(x, y) * v + np.maximum(x, y))
                if found:
                    held.append(np.unique(np.concatenate(found), return_counts=True))
                    size += len(held[-1][0])
                if size > HELD:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(width, np.int64)

        def out() -> pa.RecordBatch:
            k = np.flatnonzero(total)
            a, b = (k + now * width) // v, (k + now * width) % v
            n = total[k]
            degree = np.bincount(a, n, v) + np.bincount(b, n, v)
            ends, often = np.flatnonzero(degree), n >= LEAST_PAIRS
            cols = (np.concatenate([a[often], ends]), np.concatenate([b[often], np.full(len(ends), -1)]), np.concatenate([n[often], degree[ends].astype(np.int64)]))
            total[:] = 0
            return pa.record_batch([pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int64))], ["a", "b", "n"])

        for batch in batches:
            for r, size, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("r", "size", "codes", "counts"))):
                if r != now and now >= 0:
                    yield out()
                now = r
                total[np.cumsum(_unpack(codes, size), dtype=np.int64)] += _unpack(counts, size)
        if now >= 0:
            yield out()

    sent = docs.select("text", *(["lang"] if "lang" in docs.columns else [])).mapInArrow(count, "r int, size int, codes binary, counts binary")
    return sent.repartition("r").sortWithinPartitions("r").mapInArrow(add, "a int, b int, n bigint")


def spellings(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(key, word) of the keys wanted: one spelling of each, in lower case."""
    told = docs.sparkSession.sparkContext.broadcast(Nodes(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, _ = buffers(b.column("text"))
            for _, _, _, key, _, start, end in keyed(b):
                hit = np.flatnonzero(told.value.number(key) >= 0)
                own, where = np.unique(key[hit], return_index=True)
                new = [(int(k), int(hit[w])) for k, w in zip(own, where) if int(k) not in seen]
                if new:
                    seen.update(k for k, _ in new)
                    yield pa.record_batch([pa.array(np.array([k for k, _ in new], np.uint64).view(np.int64)), pa.array([data[start[w] : end[w]].tobytes().decode("utf-8", "replace") for _, w in new])], ["key", "word"])

    return docs.select("text", "lang").mapInArrow(run, "key bigint, word string").groupBy("key").agg(F.min(F.lower("word")).alias("word"))


def seed_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed log-likelihood ratio of each word: positive if it is more frequent among toxic documents."""

    def part(k: np.ndarray, n: float, p: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0)

    p = (toxic + clean) / max(1, n_toxic + n_clean)
    g = 2 * (part(toxic, n_toxic, p) + part(n_toxic - toxic, n_toxic, 1 - p) + part(clean, n_clean, p) + part(n_clean - clean, n_clean, 1 - p))
    return np.where(toxic / max(1, n_toxic) >= clean / max(1, n_clean), 1, -1) * np.sqrt(np.maximum(g, 0))


def signed_root(k: Column, n: Column, m: Column, rest: Column) -> Column:
    """seed_ratio of k in n against m in rest."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / F.greatest(n * p, F.lit(1e-9)))).otherwise(0.0)

    k, n, m, rest = (x.cast("double") for x in (k, n, m, rest))
    p = (k + m) / (n + rest)
    g = 2 * (part(k, n, p) + part(n - k, n, 1 - p) + part(m, rest, p) + part(rest - m, rest, 1 - p))
    one = F.lit(1.0)
    return F.when(k / F.greatest(n, one) >= m / F.greatest(rest, one), 1.0).otherwise(-1.0) * F.sqrt(F.greatest(g, F.lit(0.0)))


def least_roots(bins: dict[str, dict[int, int]], tested: dict[str, int]) -> dict[str, float]:
    """From each language's counts of words by 20 times their roots, and how many words were tested: the least root at which, by Benjamini and Hochberg's procedure, a share below FALSE of the words beyond it are there by chance."""
    out = {}
    for lang, own in bins.items():
        rank = 0
        for k in sorted(own, reverse=True):
            rank += own[k]
            if math.erfc(k / 20 / math.sqrt(2)) * tested[lang] <= FALSE * rank:
                out[lang] = k / 20
    return out


def _evidence(counts: DataFrame) -> DataFrame:
    """The rows of counts (lang, root, enough, ..), one for each word tested, that are enough and beyond their language's least root."""
    rows = counts.groupBy("lang", F.when(F.col("enough") & (F.col("root") > 0), F.floor(F.least(F.col("root"), F.lit(60.0)) * 20)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    bins, tested = {}, {}
    for r in rows:
        tested[r["lang"]] = tested.get(r["lang"], 0) + r["n"]
        if r["bin"] is not None:
            bins.setdefault(r["lang"], {})[r["bin"]] = r["n"]
    least = least_roots(bins, tested)
    return counts.join(_by_language(counts.sparkSession, [(k, v) for k, v in least.items()], "least double"), "lang").filter(F.col("enough") & (F.col("root") >= F.col("least"))).drop("least")


def _by_language(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A row for each language, small enough to be sent out."""
    return F.broadcast(spark.createDataFrame(rows, f"lang string, {columns}"))


def information(pairs: DataFrame, nodes: Nodes) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Of rows (a, b, n) of pair_counts with b >= 0 the edges (a, b, w): discounted pointwise mutual information in their language, where it is LEAST_INFORMATION or more and the count lies SIGNIFICANCE standard deviations above that of chance."""
    degree = np.zeros(len(nodes.h))
    rows = pairs.filter("b < 0").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    degree[rows["a"].to_numpy()] = rows["n"].to_numpy()
    told = pairs.sparkSession.sparkContext.broadcast((degree, np.bincount(nodes.home, degree) if len(degree) else degree, nodes.home))

    def f(x: pa.RecordBatch) -> pa.RecordBatch:
        degree, total, home = told.value
        a, b, n = (x.column(c).to_numpy() for c in ("a", "b", "n"))
        chance = degree[a] * degree[b] / total[home[a]]
        value = np.log(n / chance)
        low, good = np.minimum(degree[a], degree[b]), (value >= LEAST_INFORMATION) & (n - chance >= SIGNIFICANCE * np.sqrt(chance))
        return pa.record_batch([pa.array(a[good]), pa.array(b[good]), pa.array((value * (n / (n + 1)) * (low / (low + 1)))[good])], ["a", "b", "w"])

    return f


def ppmi(pairs: DataFrame, nodes: Nodes) -> DataFrame:
    """(a, b, w): the edges of pair_counts."""
    return map_batches(pairs.filter("b >= 0"), information(pairs, nodes), "a int, b int, w double")


def packed(edges: DataFrame, weighed: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda x: x) -> DataFrame:
    """(t, size, a, b, w): edges in both directions, those to SPAN nodes a from t * SPAN on, as compressed arrays; w in single precision. weighed makes (a, b, w) of the rows of edges, in the same pass, so that a task has one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            x, y, w = (np.concatenate(c) for c in zip(*held))
            a, b, w = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order].astype("<f4").view("<u4")
            spans = np.arange(int(a[-1]) // SPAN + 2)
            cuts = np.searchsorted(a, spans * SPAN)
            rows = [(int(t), int(j - i), _pack(np.diff(a[i:j], prepend=t * SPAN)), _pack(b[i:j]), _pack(w[i:j])) for t, i, j in zip(spans, cuts[:-1], cuts[1:]) if j > i]
            held.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["t", "size", "a", "b", "w"])

        size = 0
        for x in map(weighed, batches):
            if x.num_rows:
                held.append([x.column(c).to_numpy() for c in ("a", "b", "w")])
                size += x.num_rows
            if size >= BLOCK:
                yield flush()
                size = 0
        if held:
            yield flush()

    return edges.mapInArrow(run, "t int, size int, a binary, b binary, w binary")


def walk(step: Callable[[np.ndarray], np.ndarray], start: np.ndarray) -> np.ndarray:
    """Visiting probabilities of random walks, one for each row of start; each returns to its start with probability RESTART. step sums, for each row and node, its neighbours' values times the edges' weights."""
    out = step(np.ones((1, start.shape[1])))[0]
    p = start
    for _ in range(ROUNDS):
        p = (1 - RESTART) * step(np.where(out > 0, p / np.maximum(out, 1e-300), 0)) + RESTART * start
    return p


def walks(edges: DataFrame, nodes: Nodes, start: np.ndarray, weighed: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda x: x) -> np.ndarray:
    """The walks from start (a row for each walk, a column for each node), over edges as packed takes them: each step is a job over the edges in the shared folder."""
    parts, sc = stored(packed(edges, weighed).repartition("t"), "edges"), edges.sparkSession.sparkContext

    def step(q: np.ndarray) -> np.ndarray:
        told = sc.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for x in batches:
                for t, n, a, b, w in zip(*(x.column(c).to_pylist() for c in ("t", "size", "a", "b", "w"))):
                    to, source, weight = np.cumsum(_unpack(a, n), dtype=np.int64), _unpack(b, n), _unpack(w, n).view("<f4").astype(np.float64)
                    own = sums.setdefault(t, np.zeros((len(q), SPAN)))
                    for k, values in enumerate(told.value):
                        own[k] += np.bincount(to, weight * values[source], SPAN)
            if sums:
                yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["t", "sums"])

        moved = np.zeros((len(q), -(-q.shape[1] // SPAN) * SPAN))
        for t, sums in zip(*(c.to_pylist() for c in parts.mapInArrow(run, "t int, sums binary").toArrow().columns)):
            moved[:, t * SPAN : (t + 1) * SPAN] += np.frombuffer(sums).reshape(len(q), SPAN)
        told.unpersist()
        return moved[:, : q.shape[1]]

    return walk(step, start)


def seeds(ratio: np.ndarray, least: float = SEED_RATIO) -> np.ndarray:
    """Where walks start, from words' seed ratios: at all words of ratio least at least, by their likelihood ratios, and at those of clean documents alike; nowhere if either are missing."""
    toxic, clean, start = np.flatnonzero(ratio >= least), np.flatnonzero(ratio < 0), np.zeros((2, len(ratio)))
    if len(toxic) and len(clean):
        start[0, toxic], start[1, clean] = ratio[toxic] ** 2 / (ratio[toxic] ** 2).sum(), 1 / len(clean)
    return start


def polarity(x: np.ndarray, y: np.ndarray, ratio: np.ndarray, cut: float = LEXICON) -> np.ndarray:
    """Weight of each word of a language, from the walks of toxic and clean seeds and the words' seed ratios, if it is beyond cut: 0 for all without walks."""
    size, reached = len(ratio), x + y > 0  # words without edges would make the spread too small
    if not x.any() or not y.any():
        return np.zeros(size)
    log = np.log((x + 0.1 / size) / (y + 0.1 / size))
    middle = np.median(log[reached])
    spread = max(0.05, 1.4826 * float(np.median(np.abs(log[reached] - middle))))
    weight = (log - middle) / spread
    return np.where((weight > cut) & (ratio >= 0), np.minimum(weight, 20.0), 0.0)


def calibrated(toxic: dict[int, int], clean: dict[int, int], n_toxic: int) -> tuple[float, float]:
    """F1 and threshold of the best bin of scores to begin at, of those of PRECISION if there are any; the lowest of those alike. Documents without lexicon words are never flagged."""
    bins = sorted({*toxic, *clean})
    if not toxic:
        return 0.0, math.inf
    best, t, c = (-9.0, math.inf), 0, 0
    for i in range(len(bins) - 1, -1, -1):
        t, c = t + toxic.get(bins[i], 0), c + clean.get(bins[i], 0)
        f1 = 2 * t / (t + c + n_toxic)
        value = f1 if t / (t + c) >= PRECISION else f1 - 2
        if value >= best[0]:  # down to where the next score below begins, so that the gap between is all flagged
            best = (value, math.exp((bins[i - 1] + 1) / FINE) if i else 0.0)
    return best


class Lexicon:
    """names: languages; nodes with their weights; rules: for each language the cutoff's number and the threshold."""

    def __init__(self, names: list[str], nodes: Nodes, weight: np.ndarray):
        self.names, self.nodes, self.weight = names, nodes, weight
        self.rules: dict[str, tuple[int, float]] = {}


def labelled_texts(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, toxic, held) of labelled documents with words, one of those of equal label that agree in one of three MinHash values, so that copies and near copies count about once; held: it gives no seeds."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    each = sketches(likely(own, known)).hint("merge").join(known.hint("merge"), "doc_id")
    for m in ("m0", "m1", "m2"):
        each = each.groupBy("lang", "toxic", m).agg(F.min(F.struct("doc_id", *(x for x in ("m0", "m1", "m2") if x != m))).alias("s")).select("lang", "toxic", m, "s.*")
    return each.select("doc_id", "lang", "toxic", (F.pmod("m2", F.lit(FOLDS)) == 0).alias("held"))


def _own(docs: DataFrame) -> DataFrame:
    return id_text(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))


def _graph_words(own: DataFrame, marked: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(lang, h, root) of the words that are nodes, and the least root of each language's seeds."""
    spark = own.sparkSession
    totals = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    numbers: dict[str, list[int]] = {}
    for r in marked.filter("NOT held").groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect():
        numbers.setdefault(r["lang"], [0, 0])[r["toxic"]] = r["n"]
    told = _by_language(spark, [(k, c, t) for k, (c, t) in numbers.items()], "clean bigint, toxic bigint")
    given = marked.filter("NOT held").select("doc_id", F.concat(F.col("toxic").cast("string"), "lang").alias("lang"))
    texts = likely(own.select("doc_id", "text"), given).hint("merge").join(given.hint("merge"), "doc_id")
    by = word_documents(texts).groupBy(F.substring("lang", 2, 1 << 20).alias("lang"), "h").agg(F.sum(F.when(F.col("lang").startswith("1"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("both")).filter(F.col("both") >= LEAST_TOXIC)
    enough = (F.col("k") >= F.greatest(F.lit(float(LEAST_TOXIC)), RARE * F.col("toxic"))) & (F.col("k") * F.col("clean") >= LIFT * F.col("toxic") * (F.col("both") - F.col("k")))
    tested = stored(by.join(told, "lang").select("lang", "h", signed_root(F.col("k"), F.col("toxic"), F.col("both") - F.col("k"), F.col("clean")).alias("root"), enough.alias("enough")), "tested")
    found = _evidence(tested).select("lang", "h", "root").toArrow()
    langs, h, root = found["lang"].to_pylist(), found["h"].to_numpy().view(np.uint64), found["root"].to_numpy()
    least: dict[str, float] = {}
    for lang, r in zip(langs, root.tolist()):
        least[lang] = min(r, least.get(lang, r))
    if not least:
        return tested.select("lang", "h", "root").limit(0), least
    some = _by_language(spark, [(k, float(totals[k])) for k in least], "total double")
    known = stored(document_frequency(own.join(F.broadcast(some.select("lang")), "lang", "left_semi").select("doc_id", "text", "lang")).filter(F.col("n") >= LEAST_TOXIC).join(some, "lang"), "known")
    low = F.greatest(F.lit(float(LEAST_DOCS)), SUPPORT * F.col("total"))
    band = known.filter((F.col("n") >= low) & (F.col("n") <= F.greatest(low, COMMON * F.col("total")))).select("lang", "h")
    near = stored(document_frequency(own, Nodes(h ^ np.array([salt(x) for x in langs], np.uint64))).withColumnRenamed("n", "k"), "near")
    close = stored(known.select("lang", "h", "n", (F.col("n") < low).alias("rare")).join(near, ["lang", "h"], "left").fillna(0, ["k"]), "close")
    having = {r["lang"]: r["k"] for r in near.filter("h = 0").collect()}
    sums = _by_language(spark, [(r["lang"], r["n"], r["k"], having.get(r["lang"], 0)) for r in close.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect()], "all_n bigint, all_k bigint, having bigint")
    rare = close.filter("rare").join(sums, "lang").select("lang", "h", signed_root(F.col("k"), F.col("n"), F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n")).alias("root"), ((F.col("k") >= F.greatest(F.lit(float(LEAST_TOXIC)), RARE * F.col("having"))) & (F.col("k") * F.col("all_n") >= LIFT * F.col("n") * F.col("all_k"))).alias("enough"))
    every = band.union(_evidence(rare).select("lang", "h")).union(spark.createDataFrame(found).select("lang", "h")).distinct()
    return every.join(tested.select("lang", "h", "root"), ["lang", "h"], "left").fillna(0.0, ["root"]), least


def induce(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon with its rules, and (doc_id, lang, scores, terms) at each of CUTS of the documents that have lexicon words."""
    ready(docs.sparkSession)
    own = _own(docs)
    marked = stored(labelled_texts(own, labels), "marked")
    graph, least = _graph_words(own, marked)
    table = graph.toArrow()
    names, number = np.unique(np.array(table["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    names = names.tolist()
    key = table["h"].to_numpy().view(np.uint64) ^ np.array([salt(x) for x in names], np.uint64)[number] if names else np.zeros(0, np.uint64)
    nodes, ratio = Nodes(key, number), table["root"].to_numpy()[np.argsort(key, kind="stable")] if names else np.zeros(0)
    start, weight = np.zeros((2, len(key))), np.zeros(len(key))
    for x, name in enumerate(names):
        start[:, nodes.home == x] = seeds(ratio[nodes.home == x], least[name])
    if start.any():
        pairs = stored(pair_counts(own, nodes), "pairs")
        walked = walks(pairs.filter("b >= 0"), nodes, start, information(pairs, nodes))
        for x in range(len(names)):
            here = nodes.home == x
            weight[here] = polarity(*walked[:, here], ratio[here], CUTS[0])
    lexicon_ = Lexicon(names, nodes, weight)
    scores = stored(scored(own, lexicon_), "scores")
    held = marked.filter("held").select("doc_id", "toxic", F.col("lang").alias("held_lang"))
    numbers = {(r["held_lang"], r["toxic"]): r["n"] for r in held.groupBy("held_lang", "toxic").agg(F.count("*").alias("n")).collect()}
    each = scores.hint("merge").join(held.hint("merge"), "doc_id").select("lang", "toxic", F.posexplode("scores").alias("cut", "score")).filter("score > 0")
    bins = each.groupBy("lang", "toxic", "cut", F.floor(F.log("score") * FINE).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    for name in names:
        alone = numbers.get((name, 1), 0) >= LEAST_HELD
        best = (-9.0, 0, math.inf)
        for cut in range(len(CUTS)):
            parts: tuple[dict[int, int], dict[int, int]] = ({}, {})
            for r in bins:
                if r["cut"] == cut and (not alone or r["lang"] == name):
                    parts[r["toxic"]][r["bin"]] = parts[r["toxic"]].get(r["bin"], 0) + r["n"]
            f1, threshold = calibrated(parts[1], parts[0], sum(n for (lang, t), n in numbers.items() if t and (not alone or lang == name)))
            if parts[1] and (f1, -abs(CUTS[cut] - LEXICON)) > (best[0], -abs(CUTS[best[1]] - LEXICON)):
                best = (f1, cut, threshold)
        if best[2] < math.inf:
            lexicon_.rules[name] = best[1:]
    return lexicon_, scores


def scored(own: DataFrame, told_: Lexicon) -> DataFrame:
    """(doc_id, lang, scores, terms) of the documents that have lexicon words: at each of CUTS the score, and how many words it is of."""
    some = np.flatnonzero(told_.weight > 0)
    told = own.sparkSession.sparkContext.broadcast((Nodes(told_.nodes.h[some]), told_.weight[some]))

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        nodes, weight = told.value
        rows, scores, terms = [], [], []
        for i, j, _, key, row, _, _ in keyed(b):
            number = nodes.number(key)
            hit = number >= 0
            if not hit.any():
                continue
            w, of, total = weight[number[hit]], row[hit], np.bincount(row, minlength=j - i)
            own_rows = np.unique(of)
            sums = np.stack([np.bincount(of, np.where(w > c, w, 0.0), j - i)[own_rows] for c in CUTS], axis=1)
            rows.append(i + own_rows)
            scores.append(sums / np.sqrt(total[own_rows])[:, None])
            terms.append(np.stack([np.bincount(of[w > c], minlength=j - i)[own_rows] for c in CUTS], axis=1))
        if not rows:
            return None
        take = pa.array(np.concatenate(rows))
        at = pa.array(np.arange(len(take) + 1, dtype=np.int32) * len(CUTS))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).ravel().astype(t))) for x, t in ((scores, np.float64), (terms, np.int32))]
        return pa.record_batch([b.column("doc_id").take(take), b.column("lang").take(take), *lists], ["doc_id", "lang", "scores", "terms"])

    return map_batches(own, f, "doc_id bigint, lang string, scores array<double>, terms array<int>")


def flag(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, terms) of the documents that are toxic: the score, and how many lexicon words they have."""
    lexicon_, scores = induce(docs, labels)
    rules = _by_language(docs.sparkSession, [(k, c + 1, t) for k, (c, t) in lexicon_.rules.items()], "cut int, threshold double")
    found = scores.join(rules, "lang").select("doc_id", "threshold", F.element_at("scores", F.col("cut")).alias("score"), F.element_at("terms", F.col("cut")).alias("terms"))
    return found.filter((F.col("terms") > 0) & (F.col("score") >= F.col("threshold"))).select("doc_id", F.round("score", 6).alias("score"), "terms")


def lexicon(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, weight) of the induced lexicon, beyond each language's cutoff; of a word in several languages the greatest weight."""
    found, _ = induce(docs, labels)
    cuts = np.array([CUTS[found.rules[x][0]] if x in found.rules else math.inf for x in found.names])
    some = np.flatnonzero(found.weight > cuts[found.nodes.home]) if len(cuts) else np.zeros(0, np.int64)
    rows = [(int(h), float(w)) for h, w in zip(found.nodes.h[some].view(np.int64), found.weight[some])]
    return spellings(_own(docs), found.nodes.h[some]).join(docs.sparkSession.createDataFrame(rows, "key bigint, weight double"), "key").groupBy("word").agg(F.max("weight").alias("weight"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
