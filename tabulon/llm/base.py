"""What all operators of this subpackage share: reading, scratch space, Arrow batches, fresh column names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BATCH = "4MB"

#: Environment of Python workers: freed arrays from 4 MB on go back to the system at once, as workers outlive their tasks.
FREED = {"MALLOC_MMAP_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it isn't installed, and bounds the batches sent to them by bytes, BATCH each, where the session has Spark's own bound: texts are long, and a batch is held on both sides."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(size, BATCH)
    env = spark.sparkContext.environment
    for name, value in FREED.items():
        env.setdefault(name, value)
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one, on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabulon-"))
    return shared_dir(spark)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabulon-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Materialised as a Parquet table in the shared folder: for large tables, which take less room so than as checkpoints. Folders tabulon-* there can go when the job has ended."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name = "_" + name
    return name


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as bigint and text as string, beside the columns named; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 1 << 30) -> DataFrame:
    """f over each Arrow batch, or over rows of it of about so many bytes; an empty input gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, int(b.num_rows * most / max(b.nbytes, most)))
            for i in range(0, b.num_rows, step):
                if (out := f(b.slice(i, step))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
