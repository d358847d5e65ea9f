"""BPE encoding and decoding by a table of distinct words, and exact token counts.

Texts are split into words by the tokenizer's own pattern, vectorised over UTF-8 bytes; a word is a span that BPE
never merges across. Texts are taken in blocks of about BLOCK bytes. A block gives its distinct words, once each, to
buckets by hash, and keeps its texts as numbers of words. A bucket's task encodes each distinct word once, for all
blocks that have it, and gives each block the ids of its words; there the ids go back to the texts by position. All
of it is sequences of numbers, compressed; what is shuffled is the words of blocks, their ids, and the texts as
numbers. The way is the same at any size, and nothing that grows with the data is sent out: only the vocabulary is.

Decoding joins ids with the table of pieces.

The vocabulary (a tiktoken rank file) is a parameter, read on the driver alone. Special tokens in a text are ordinary text.

Defined results: a NULL text has NULL ids and no length, and isn't counted; an empty text has no ids and length 0;
rows with a NULL doc_id, and repeated rows, are encoded each; an empty table gives an empty result; a very long text
is encoded whole, in a block of its own size; words of equal frequency are numbered by hash, which shows nowhere; bytes of ids
that are no UTF-8 decode to replacement characters. Within a block two words of one 64-bit hash would get the same ids: a chance of 4e-9 a block,
and decoding shows it; buckets compare the words themselves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .base import documents, id_text, map_batches, ready, scratch
from .kernel import SLICE, buffers, slices, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 32 << 20


@lru_cache(maxsize=2)
def ranks(raw: bytes) -> dict[bytes, int]:
    """Of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=2)
def encoder(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(raw), special_tokens={})


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 number, 3 white space."""
    import sys

    import regex

    table = np.zeros(sys.maxunicode + 1, np.uint8)
    points = np.arange(sys.maxunicode + 1, dtype="<u4")
    points[0xD800:0xE000] = 33
    every = points.tobytes().decode("utf-32-le")
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = k
    return table


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in bytes) and rows of the words of rows at[0]..at[-1]: each goes to the start of the next, or its row's end."""
    base, n = int(at[0]), int(at[-1] - at[0])
    part = data[base : base + n]
    lead = np.flatnonzero((part & 0xC0) != 0x80)  # first bytes of characters
    if not len(lead):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(lead) == n:
        points = part
    else:
        points = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    m = len(kind)
    first = np.zeros(m + 1, bool)
    first[np.searchsorted(lead, at - base)] = True
    first[m] = True
    space = kind == 3
    change = np.empty(m, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first[:m]
    start = change.copy()
    # a space right before a letter, number or sign belongs to it; of several white characters the last does if it is a space, else it stands alone
    run_end = np.flatnonzero(space & np.r_[change[1:], True])  # last white character of each run
    inner = run_end[~first[run_end + 1]]  # followed by something in the same text
    alone = ~change[inner]  # the run has more than this one
    start[inner[alone]] = True
    joined = inner[points[inner] == 32]
    start[joined + 1] = False
    # contractions: an apostrophe that begins a word of signs by itself, before the letters
    quote = np.flatnonzero(points == 39)
    quote = quote[start[quote] & (quote + 1 < m)]
    if len(quote):
        p = np.concatenate([points, np.zeros(3, points.dtype)])
        f = np.concatenate([first, np.ones(3, bool)])
        one, two = p[quote + 1], p[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~f[quote + 1]
        pair = one.astype(np.int64) * 256 + two
        long = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & ~f[quote + 1] & ~f[quote + 2]
        for q, size in [*((x, 2) for x in quote[short].tolist()), *((x, 3) for x in quote[long & ~short].tolist())]:
            end = q + size
            start[q + 1 : end] = False
            if end < m and not first[end] and not start[end]:
                start[end] = True
    at_char = np.flatnonzero(start)
    begin = lead[at_char]
    return begin + base, np.searchsorted(at - base, begin, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word."""
    start, row = split(data, at)
    base = int(at[0])
    end = np.append(start[1:], at[-1])
    values = data[base : int(at[-1])].astype(np.uint64)
    return span_hashes(values, start - base, end - base), row, start, end


def squeeze(x: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed by planes: all lowest bytes first, all highest last."""
    planes = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def spread(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of each span, one after the other."""
    size = size.astype(np.int64)
    return data[np.repeat(start.astype(np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Block:
    """Texts of about BLOCK bytes: their distinct words, numbered by falling frequency, and the texts as word numbers."""

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]] = []

    def add(self, b: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> None:
        """Rows of b, whose texts are at[0]..at[-1] of data."""
        h, row, start, end = word_hashes(data, at)
        words, first, inverse, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        length = end[first] - start[first]
        per_row = np.bincount(row, minlength=b.num_rows).astype(np.int32)
        rest = [c for c in b.schema.names if c != "text"] + (["text"] if "kept" in b.schema.names else [])
        meta = pa.record_batch([pa.array(per_row, mask=np.asarray(b.column("text").is_null())), *(b.column(c) for c in rest if c != "kept")], ["words", *(c for c in rest if c != "kept")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, meta.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(meta)
        self.parts.append((sink.getvalue().to_pybytes(), words, inverse.astype(np.int32), often, length, gather(data, start[first], length).tobytes()))
        self.size += int(at[-1] - at[0])

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """One row for each bucket of words, and one for each part of the texts, of bucket -1."""
        size = np.cumsum([0, *(len(p[1]) for p in self.parts)])
        h, first, inverse = np.unique(np.concatenate([p[1] for p in self.parts]), return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[3] for p in self.parts]), len(h))
        rank = np.empty(len(h), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(h))
        length = np.concatenate([p[4] for p in self.parts])
        begin, blob = np.cumsum(length) - length, np.frombuffer(b"".join(p[5] for p in self.parts), np.uint8)
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rank, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            spots = first[own]
            out.append((block, k, len(own), squeeze(np.diff(rank[own], prepend=0)), squeeze(length[spots]), pa.compress(gather(blob, begin[spots], length[spots]), codec="zstd", asbytes=True)))
        for i, p in enumerate(self.parts):
            out.append((block, -1, len(p[2]), p[0], squeeze(rank[inverse[size[i] : size[i + 1]][p[2]]]), b""))
        for k in range(0, len(out), 64):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "bucket", "n", "a", "b", "c"])


SPLIT = "block bigint, bucket int, n int, a binary, b binary, c binary"


def split_blocks(rows: DataFrame, buckets: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Words and texts of blocks, in one table of the shared folder (so that both are of the same blocks, whatever is computed again), bucketed by block: texts aren't shuffled to meet their words' ids. rows: (text, ..); the other columns stay with the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, number, base = Block(), 0, TaskContext.get().partitionId() << 32
        for b in batches:
            data, at = buffers(b.column("text"))
            for i, j in slices(at, min(SLICE, most)):
                block.add(b.slice(i, j - i), data, at[i : j + 1])
                if block.size >= most:
                    yield from block.rows(base + number, buckets)
                    block, number = Block(), number + 1
        if block.parts:
            yield from block.rows(base + number, buckets)

    spark, path = rows.sparkSession, scratch(rows.sparkSession, "blocks")
    name = f"tabulon_blocks_{path.rsplit('-', 1)[1]}"
    kept = rows.mapInArrow(run, SPLIT).withColumn("kind", F.when(F.col("bucket") < 0, "texts").otherwise("words"))
    kept.write.format("parquet").partitionBy("kind").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", path).saveAsTable(name)
    both = spark.table(name)
    return both.filter("kind = 'words'").drop("kind"), both.filter("kind = 'texts'").drop("kind")


def encoded_words(words: DataFrame, vocabulary: str, with_ids: bool) -> DataFrame:
    """(block, bucket, n, a, b, c): for each block's words of a bucket, the ids (c) and how many each has (b). A bucket is one task's, which encodes each word once, whatever block it is in."""
    told = words.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, whole = encoder(told.value), ranks(told.value)
        now, known = None, {}

        def one(w: bytes) -> bytes:
            ids = known[w] = np.array([whole[w]] if w in whole else e.encode_ordinary(w.decode("utf-8", "surrogatepass")), "<u4").tobytes()
            return ids

        for b in batches:
            out = []
            for bucket, n, lengths_, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "b", "c"))):
                if bucket != now:
                    now, known = bucket, {}
                end = np.cumsum(spread(lengths_, n), dtype=np.int64)
                data = pa.decompress(blob, decompressed_size=int(end[-1]), codec="zstd", asbytes=True)
                stops = end.tolist()
                ids = [known.get(w) or one(w) for w in map(data.__getitem__, map(slice, [0, *stops], stops))]
                size = np.fromiter(map(len, ids), np.int64, n) // 4
                out.append((squeeze(size), squeeze(np.frombuffer(b"".join(ids), "<u4")) if with_ids else b""))
            if out:
                yield pa.record_batch([*(b.column(c) for c in ("block", "bucket", "n", "a")), *(pa.array(c, pa.binary()) for c in zip(*out))], ["block", "bucket", "n", "a", "b", "c"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, SPLIT)


def by_position(rows: DataFrame, vocabulary: str, schema: str, emit, with_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """emit(meta, ids in each text, ids) for the parts of all blocks: a block's encoded words meet its texts, and ids are looked up by the place of each word."""
    buckets = max(64, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words, texts = split_blocks(rows, buckets, block)

    def meet(known: pa.Table, parts: pa.Table) -> pa.Table:
        found = [(np.cumsum(spread(x, n), dtype=np.int64), spread(y, n), z) for n, x, y, z in zip(*(known.column(c).to_pylist() for c in ("n", "a", "b", "c")))]
        place = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
        count = np.concatenate([np.zeros(0, np.uint32), *(f[1] for f in found)])
        if len(place) and int(place.max()) + 1 != len(place):
            raise RuntimeError("a block lacks words")
        size, begin = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        size[place], begin[place] = count, np.cumsum(count, dtype=np.int64) - count
        flat = np.concatenate([np.zeros(0, np.uint32), *(spread(z, int(y.sum())) for _, y, z in found)]).astype(np.int32) if with_ids else None
        out = []
        for n, x, y in zip(*(parts.column(c).to_pylist() for c in ("n", "a", "b"))):
            number = spread(y, n)
            own, meta = size[number], pa.ipc.open_stream(x).read_next_batch()
            ends = np.cumsum(meta.column("words").fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            total = np.diff(np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], ends])])
            out.append(emit(meta, total, gather(flat, begin[number], own) if with_ids else None))
        return pa.Table.from_batches(out) if out else to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    encoded = encoded_words(words, vocabulary, with_ids)
    return encoded.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(meet, schema)


def lists_of(meta: pa.RecordBatch, total: np.ndarray, ids: np.ndarray) -> pa.Array:
    words = meta.column("words")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total)]).astype(np.int32)), pa.array(ids), mask=words.is_null() if words.null_count else None)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, ids) of each row of docs."""
    ready(docs.sparkSession)

    def emit(meta: pa.RecordBatch, total: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([meta.column("doc_id"), meta.column("text"), lists_of(meta, total, ids)], ["doc_id", "text", "ids"])

    return by_position(id_text(docs).withColumn("kept", F.lit(True)), vocabulary, "doc_id bigint, text string, ids array<int>", emit, block=block)


class Pieces:
    """The table of pieces, by id: as large as the tokenizer's vocabulary."""

    def __init__(self, vocabulary: str):
        known = ranks(open(vocabulary, "rb").read())
        every = [b""] * (max(known.values()) + 1)
        for piece, k in known.items():
            every[k] = piece
        self.size = np.array([len(p) for p in every], np.int64)
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(every), np.uint8)

    def join(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the pieces of ids, in order, and where those of ids at[0], at[1].. begin."""
        size = self.size[ids]
        return gather(self.data, self.start[ids], size), np.concatenate([[0], np.cumsum(size)])[at]


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encoded with the column decoded, from ids; NULL for NULL. Ids are joined with the table of pieces, which is sent out (its size is that of the vocabulary): an array by id is its hash table."""
    told = ready(encoded.sparkSession).sparkContext.broadcast(Pieces(vocabulary))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = b.column("ids")
        size = np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        data, at = told.value.join(ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
        none, raw = np.asarray(ids.is_null()), data.tobytes()
        texts = [None if gone else raw[i:j].decode("utf-8", "replace") for gone, i, j in zip(none.tolist(), at[:-1].tolist(), at[1:].tolist())]
        return b.append_column("decoded", pa.array(texts, pa.string()))

    return map_batches(encoded, f, StructType([*encoded.schema.fields, StructField("decoded", StringType())]), 4 << 20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text: by the MD5 of both, so that texts needn't stay with the ids."""
    told = ready(spark).sparkContext.broadcast(Pieces(VOCABULARY))

    def emit(meta: pa.RecordBatch, total: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        data, at = told.value.join(ids, np.concatenate([[0], np.cumsum(total)]))
        exact = [d is None or hashlib.md5(data[i:j]).digest() == d for d, i, j in zip(meta.column("digest").to_pylist(), at[:-1].tolist(), at[1:].tolist())]
        gone = np.asarray(meta.column("digest").is_null())
        return pa.record_batch([meta.column("doc_id"), pa.array(total.astype(np.int32), mask=gone), lists_of(meta, total, ids), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    rows = id_text(documents(spark, sf_dir)).withColumn("digest", F.unhex(F.md5("text")))
    return by_position(rows, VOCABULARY, "doc_id bigint, n_tokens int, ids array<int>, exact boolean", emit)


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs with a text."""
    ready(docs.sparkSession)

    def emit(meta: pa.RecordBatch, total: np.ndarray, _: None) -> pa.RecordBatch:
        return pa.record_batch([meta.column("doc_id"), pa.array(total.astype(np.int32))], ["doc_id", "n_tokens"])

    return by_position(id_text(docs).filter("text IS NOT NULL"), vocabulary, "doc_id bigint, n_tokens int", emit, with_ids=False)


def histogram(counted: DataFrame) -> DataFrame:
    """For each length that occurs: the documents of it, the sums over it and all longer ones, the tokens that are left where every text is cut to that length, and the share of documents not longer. One row a length, so the windows are small."""
    h = counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))
    up = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    tokens = F.col("docs") * F.col("n_tokens").cast("bigint")
    sums = h.withColumns({"docs_at_least": F.sum("docs").over(up), "tokens_at_least": F.sum(tokens).over(up), "docs_up_to": F.sum("docs").over(down), "tokens_up_to": F.sum(tokens).over(down)})
    beyond = F.col("docs_at_least") - F.col("docs")
    return sums.select("n_tokens", "docs", "docs_at_least", "tokens_at_least", (F.col("tokens_up_to") + beyond * F.col("n_tokens")).alias("tokens_cut_here"), F.round(F.col("docs_up_to") / (F.col("docs_up_to") + beyond), 9).alias("share_up_to"))


def answer(hist: DataFrame, limits: list[int], shares: list[float]) -> tuple[dict[int, int], dict[float, int]]:
    """From a histogram: the tokens left at each context limit, and the least length that has each share of documents."""
    cut_to = {}
    for limit in limits:
        r = hist.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)).cast("bigint") * F.col("docs"))).first()
        cut_to[limit] = int(r[0] or 0)
    return cut_to, {s: hist.filter(F.col("share_up_to") >= s - 1e-9).agg(F.min("n_tokens")).first()[0] for s in shares}


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(documents(spark, sf_dir)))
