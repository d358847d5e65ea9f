"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

For each language of the lang column a model of order ORDER is trained on a bounded sample of labelled documents
(SAMPLE a language, chosen by hash of doc_id; whole texts). All languages share one sorted array of n-gram hashes
for each order, with one row of log probabilities for all languages, so that scoring a character is one binary
search; only n-grams that no language has go on to the next lower order. A document gets the language of the least
cross-entropy for each character. A third of the sample is held out; each language's limit is calibrated between the
cross-entropies of its own held-out texts, all but REJECTED of them, and those that held-out texts of the other
languages have without their own models; it isn't beyond REACH of the way to the same texts with their characters
shuffled, which alone counts if there is one language, and it is wider for short texts; a document beyond it is rejected.

Letters are compared in lower case, digits as 0, all else as one space. Defined results: a text that is NULL,
empty or without letters is rejected, with NULL as its language and entropy; equal entropies go to the language
first in the alphabet; with no labelled documents everything is rejected; repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, fresh, id_text, map_batches, ready
from .kernel import buffers, slices

#: SAMPLE: labelled documents for each language at most. SLACK: standard deviations of the held-out entropies, above their mean, that are still accepted. REACH: the part of the way from that mean to the entropy of the same characters in random order that is accepted at most, but for SLACK. REJECTED: the share of own texts, and of those of other languages, that a limit may lie on the wrong side of.
ORDER, SAMPLE, SLACK, REACH, REJECTED, VOCABULARY = 4, 240, 6.0, 0.6, 0.005, 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = [np.uint64(0xD1B54A32D192ED03 * (n + 1) % (1 << 64)) for n in range(ORDER + 1)]
BOS = 1


def _fold() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
        else:
            table[c] = 48 if x.isdigit() else 32
    return table


_FOLD: list[np.ndarray] = []


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points with ORDER marks before each text, the position of each text's first character, and that of its end."""
    if not _FOLD:
        _FOLD.append(_fold())
    mark = chr(BOS) * ORDER
    raw = np.frombuffer((mark + mark.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + ORDER) - size
    codes = _FOLD[0][np.minimum(raw, (1 << 16) - 1)]
    if len(far := np.flatnonzero(raw >= 1 << 16)):  # beyond the table, letters stay as they are
        points, where = np.unique(raw[far], return_inverse=True)
        codes[far] = np.array([c if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in points.tolist()], np.uint32)[where]
    spans = (first[:, None] - np.arange(1, ORDER + 1)).ravel()
    codes[spans] = BOS
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]
    moved = np.cumsum(keep) - keep
    codes = codes[keep]
    ends = np.r_[moved, len(codes)][first + size]
    return codes.astype(np.uint64), np.r_[moved, len(codes)][first], ends


def gram_hashes(codes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n characters that end at each position, or at those given."""
    own = codes if at is None else codes[at]
    total, power = own + np.uint64(7), _BASE
    for k in range(1, n):
        if at is None:
            total[k:] += (codes[:-k] + np.uint64(7)) * power
        else:
            total += (codes[at - k] + np.uint64(7)) * power
        power = np.uint64(int(power) * int(_BASE) % (1 << 64))
    if not n:
        total[:] = 0
    total *= np.uint64(0xFF51AFD7ED558CCD)
    return np.bitwise_xor(total, _SALT[n], out=total)


class Sorted:
    """A sorted array of hashes with a directory of their leading bits, so that a search is a few steps."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows, self.bits = keys, rows, max(4, len(keys).bit_length() + 1)
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.start).max(initial=0))

    def find(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there; keys mustn't be empty."""
        last = np.int32(len(self.keys) - 1)
        i = np.minimum(self.start[(own >> np.uint64(64 - self.bits)).astype(np.int32)], last)
        there = self.keys[i]
        for _ in range(self.steps - 1):
            i = np.minimum(i + (there < own), last)
            there = self.keys[i]
        return i, there == own


class Model:
    """grams[n]: sorted hashes and log probabilities (a row for each, a column for each language); contexts[n]: sorted hashes of the n - 1 characters before, and log weights of the order below."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.grams: list[Sorted] = [Sorted(np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32))]
        self.contexts: list[Sorted] = [self.grams[0]]
        self.mean = self.deviation = self.noise = self.reach = np.zeros(len(languages))

    def scores(self, codes: np.ndarray, at: np.ndarray | None = None, n: int = ORDER) -> np.ndarray:
        """Log probability of the character at each position, in each language."""
        if not n:
            return np.full((len(at), len(self.languages)), -np.log(VOCABULARY), np.float32)
        found, there = self.grams[n].find(gram_hashes(codes, n, at))
        out = self.grams[n].rows.take(found, axis=0)
        if len(miss := np.flatnonzero(~there)):
            where = miss if at is None else at[miss]
            c, known = self.contexts[n].find(gram_hashes(codes, n - 1, where - 1))
            out[miss] = self.scores(codes, where, n - 1) + np.where(known[:, None], self.contexts[n].rows[c], np.float32(0))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character for each text and language, and the number of characters; 0 for texts without letters."""
        codes, first, end = encode([*texts, " "])
        letters = np.cumsum(np.r_[0, codes > 57])
        first, end = first[:-1], end[:-1]
        count = np.where(letters[end] - letters[first] > 0, end - first, 0)
        sums = np.add.reduceat(self.scores(codes), np.stack([first, end], axis=1).ravel(), axis=0, dtype=np.float64)[::2]
        return -sums / np.maximum(count, 1)[:, None], count

    def limit(self, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The largest entropy that is accepted of texts of so many characters in their best languages."""
        spread = np.sqrt(self.deviation[best] ** 2 + self.noise[best] ** 2 / np.maximum(count, 1))
        return self.mean[best] + np.maximum(self.reach[best], SLACK * spread)


def _lookup(keys: np.ndarray, values: np.ndarray, own: np.ndarray, default: float = 0) -> np.ndarray:
    if not len(keys):
        return np.full(len(own), default)
    i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[i] == own, values[i], default)


def _shuffled(text: str) -> str:
    return "".join(np.random.default_rng(len(text)).permutation(list(text)).tolist())


def train(by_language: dict[str, list[str]]) -> Model:
    """A model from each language's texts; every third text, in the order given, calibrates the limits."""
    by_language = {k: v for k, v in by_language.items() if any(t.strip() for i, t in enumerate(v) if i % 3 != 2)}
    languages = sorted(by_language)
    model = Model(languages)
    if not languages:
        return model
    fit = {k: [t for i, t in enumerate(v) if i % 3 != 2] for k, v in by_language.items()}
    counts: list[list] = []  # by language, by order: keys, counts or continuation counts, context and suffix hashes
    for k in languages:
        codes, first, end = encode(fit[k])
        inside = np.zeros(len(codes) + 1, np.int32)
        np.add.at(inside, first, 1)
        np.add.at(inside, end, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        own, left = [], None
        for n in range(ORDER, 0, -1):
            keys, where, number = np.unique(gram_hashes(codes, n, at), return_index=True, return_counts=True)
            where = at[where]
            if left is not None:  # lower orders count the different characters before
                number = _lookup(*np.unique(left, return_counts=True), keys, 1).astype(np.int64)
            left = gram_hashes(codes, n - 1, where)
            own.append((keys, number.astype(float), gram_hashes(codes, n - 1, where - 1), left))
        counts.append(own[::-1])
    for n in range(1, ORDER + 1):
        keys, where = np.unique(np.concatenate([c[n - 1][0] for c in counts]), return_index=True)
        context = np.concatenate([c[n - 1][2] for c in counts])[where]
        suffix = np.concatenate([c[n - 1][3] for c in counts])[where]
        ckeys = np.unique(context)
        rows, weights = np.zeros((len(keys), len(languages)), np.float32), np.zeros((len(ckeys), len(languages)), np.float32)
        below = model.grams[n - 1]
        for x, c in enumerate(counts):
            k, number, ctx, _ = c[n - 1]
            ones, twos = (number == 1).sum(), (number == 2).sum()
            discount = min(0.95, ones / (ones + 2 * twos)) if ones and twos else 0.5
            uk, inverse = np.unique(ctx, return_inverse=True)
            total, types = np.bincount(inverse, number, len(uk)), np.bincount(inverse, minlength=len(uk))
            gamma = discount * types / np.maximum(total, 1)
            low = np.full(len(keys), 1 / VOCABULARY) if n == 1 else np.exp(below.rows[below.find(suffix)[0], x])
            lam = _lookup(uk, gamma, context, 1.0)
            seen = np.maximum(_lookup(k, number, keys) - discount, 0) / np.maximum(_lookup(uk, total, context, 1.0), 1)
            rows[:, x] = np.log(np.where(_lookup(k, number, keys) > 0, seen, 0) + lam * low)
            weights[:, x] = np.log(_lookup(uk, gamma, ckeys, 1.0))
        model.grams.append(Sorted(keys, rows))
        model.contexts.append(Sorted(ckeys, weights))
    mean, deviation, noise, reach = [], [], [], []
    apart = {k: [t for i, t in enumerate(v) if i % 3 == 2] or v for k, v in by_language.items()}
    scored = {k: model.entropies(v) for k, v in apart.items()}
    for x, k in enumerate(languages):
        held, (e, number) = apart[k], scored[k]
        own = e[(e.argmin(axis=1) == x) & (number > 0), x]
        size = number[(e.argmin(axis=1) == x) & (number > 0)]
        middle = float(np.median(own)) if len(own) else 0.0
        mean.append(middle)
        wild = [t for t in map(_shuffled, held) if t.strip()]
        far = REACH * max(0.0, float(np.median(model.entropies(wild)[0].min(axis=1))) - middle) if wild else 0.0
        foreign = np.concatenate([np.zeros(0), *(v[n > 0, x] for z, (v, n) in scored.items() if z != k)])
        if len(own) and len(foreign):
            high, low = np.quantile(own, 1 - REJECTED) - middle, np.quantile(foreign, REJECTED) - middle
            far = min(far, float(max(high, (high + low) / 2)))
        reach.append(far)
        deviation.append(float(1.4826 * np.median(np.abs(own - middle))) if len(own) else 0.0)
        noise.append(float(np.median(np.abs(own - middle) * np.sqrt(size))) if len(own) else 0.0)
    model.mean, model.deviation, model.noise, model.reach = map(np.array, (mean, deviation, noise, reach))
    return model


def sample(docs: DataFrame, most: int = SAMPLE) -> dict[str, list[str]]:
    """Whole texts of at most so many labelled documents a language, by hash of doc_id: a bounded sample, for fitting alone."""
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    share = {r["lang"]: min(1.0, 1.5 * most / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    chosen = F.lit(False)
    for k, s in share.items():
        chosen = chosen | ((F.col("lang") == k) & (spot < int(s * (1 << 30))))
    rows = id_text(docs, F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND doc_id IS NOT NULL").filter(chosen).withColumn("spot", spot).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["spot"], r["doc_id"], r["text"])):
        if len(own := out.setdefault(r["lang"], [])) < most:
            own.append(r["text"])
    return out


def score(model: Model, texts: pa.Array) -> tuple[list[str | None], list[float | None], list[bool]]:
    _, at = buffers(texts)
    language: list[str | None] = []
    entropy: list[float | None] = []
    accepted: list[bool] = []
    for i, j in slices(at):
        part = [t or "" for t in texts.slice(i, j - i).to_pylist()]
        if not model.languages:
            language += [None] * len(part)
            entropy += [None] * len(part)
            accepted += [False] * len(part)
            continue
        e, number = model.entropies(part)
        best = e.argmin(axis=1)
        low = e[np.arange(len(part)), best]
        good = (number > 0) & (low <= model.limit(best, number))
        language += [model.languages[b] if n else None for b, n in zip(best, number)]
        entropy += [round(float(v), 6) if n else None for v, n in zip(low, number)]
        accepted += good.tolist()
    return language, entropy, accepted


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, entropy, accepted) of each row of docs."""
    spark = ready(docs.sparkSession)
    told = spark.sparkContext.broadcast(model or train(sample(docs)))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        language, entropy, accepted = score(told.value, b.column("text"))
        return pa.record_batch([b.column("doc_id"), pa.array(language, pa.string()), pa.array(entropy, pa.float64()), pa.array(accepted)], ["doc_id", "language", "entropy", "accepted"])

    return map_batches(id_text(docs), f, "doc_id bigint, language string, entropy double, accepted boolean")


def keep_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns; nothing is shuffled."""
    spark = ready(docs.sparkSession)
    told, text = spark.sparkContext.broadcast(model or train(sample(docs))), docs.columns.index("text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(score(told.value, b.column(text).cast(pa.string()))[2]))

    return map_batches(docs, f, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
