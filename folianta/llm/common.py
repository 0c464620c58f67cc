"""What the operators of this subpackage share: inputs, shared storage, Arrow slicing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python, which ends at BATCH_BYTES too.
BATCH_ROWS = 2000
#: A key with more than one in so many of the rows is hot; so there are fewer hot keys than this.
HOT_SHARE = 4096
#: Bytes of an Arrow batch: both sides hold some of them for every task, so this bounds an executor's memory beside its heap.
BATCH_BYTES = 4 << 20
#: Bytes of text that a vectorised step works on at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (local tests) a temporary folder takes its place, which is
    removed when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folianta-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir() if spark.sparkContext.getCheckpointDir() else found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(rows: DataFrame, side: DataFrame, key: str, n: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``side`` with a ``salt`` that splits hot keys, to be joined on both.

    ``side`` has one row per key with ``n``, the rows that have it. Rows of a hot key get one of
    n * HOT_SHARE / total salts by their columns ``by``, and its side row is repeated once for each. The
    list of hot keys, HOT_SHARE at most, is the only thing broadcast.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(8, -(-int(total) // HOT_SHARE))
    salts = F.when(F.col(n) > bound, F.ceil(F.col(n) / bound).cast("int"))
    hot = side.select(F.col(key), salts.alias("__salts")).filter("__salts IS NOT NULL")
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    return salted, side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))


def joined_by_hot_key(rows: DataFrame, side: DataFrame, key: str, n: str, how: str, *by: str) -> DataFrame:
    """``rows`` joined with ``side`` (one row per key, ``n``: rows that have it), hot keys split over many tasks."""
    side = cut(side)
    a, b = spread(rows, side, key, n, *by)
    return a.join(b, [key, "salt"], how).drop("salt")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10000:
        spark.conf.set(key, str(BATCH_ROWS))
    # a batch of long texts ends at so many bytes
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_array(column: pa.Array) -> pa.Array:
    """A string column as large_string without nulls (null counts as the empty text)."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a single longer row stays whole."""
    n = batch.num_rows
    if not n:
        return
    column = text_array(batch.column(text))
    offsets = pa.Array.from_buffers(pa.int64(), len(column) + 1, [None, column.buffers()[1]], offset=column.offset).to_numpy()
    start = 0
    while start < n:
        end = start + 1
        while end < n and offsets[end + 1] - offsets[start] <= limit:
            end += 1
        yield batch.slice(start, end - start)
        start = end
