"""A stored full-text index over paragraphs: postings with positions, term statistics and entries.

``stored`` builds the index once for the documents at hand and opens it afterwards. It lies under
``search-index/`` of the session's shared folder, by a fingerprint of the documents' files (paths,
lengths, times), so changed documents get an index of their own. Four tables:

* ``entries``: one row per paragraph with the columns of its work, author and source;
* ``postings``: one row per token and paragraph with the places of the token, in ranges of
  (bucket, token, paragraph) so that a frequent token is spread over many files, and a query reads
  the directories of its tokens' buckets and there the row groups that hold them;
* ``terms``: in how many paragraphs a token is; ``totals``: paragraphs and their mean length.

A place is the number of the column times ``COLUMN_STEP`` plus the position in it: consecutive
places are consecutive tokens of one column. Works without an id are not indexed, rows of one
paragraph id count as one paragraph, and null columns as empty.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folianta.functions import text as tx

#: Columns that the index covers.
INDEXED = ("text", "title", "code", "author", "source_name")

#: Tokens that a column may have before its places would meet the next column's.
COLUMN_STEP = 1 << 32

#: Directories of postings.
BUCKETS = 64

#: Form of the stored tables, search text included; another form gets another folder.
FORMAT = 3

#: Columns of postings, which an empty table of directories does not tell.
POSTINGS = "token string, paragraph_id long, language string, source_id int, length int, places array<long>, bucket int"

_LOCAL: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in local sessions only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="folianta-index-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return _LOCAL[key]


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the files under ``path``: their names, lengths and times; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return f"v{FORMAT}-{row.n}-{(row.h or 0) & (1 << 64) - 1:016x}"


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def with_places(entries: DataFrame) -> DataFrame:
    """``entries`` with ``length``, the number of tokens, and ``all_tokens``, an array of (token, place)."""
    out = entries.withColumns({f"l_{c}": tx.once(tx.index_tokens(F.coalesce(F.col(c), F.lit("")))) for c in INDEXED})

    def placed(i: int, c: str) -> Column:
        return F.transform(f"l_{c}", lambda t, at: F.struct(t.alias("token"), (at.cast("long") + F.lit(i * COLUMN_STEP)).alias("place")))

    tokens = F.concat(*[placed(i, c) for i, c in enumerate(INDEXED)])
    length = sum((F.size(f"l_{c}") for c in INDEXED), F.lit(0))
    return out.withColumn("length", length).withColumn("all_tokens", tokens).drop(*[f"l_{c}" for c in INDEXED])


def postings_of(tokens: DataFrame) -> DataFrame:
    """Postings of rows ``with_places``; the range partitioning that the files need serves the grouping too."""
    rows = tokens.select("paragraph_id", "language", "source_id", "length", F.inline("all_tokens"))
    rows = rows.withColumn("bucket", bucket_of(F.col("token"))).repartitionByRange("bucket", "token", "paragraph_id")
    one = rows.groupBy("bucket", "token", "paragraph_id").agg(
        F.min("language").alias("language"), F.min("source_id").alias("source_id"), F.max("length").alias("length"), F.sort_array(F.collect_set("place")).alias("places")
    )
    return one.sortWithinPartitions("bucket", "token", "paragraph_id")


@dataclass(frozen=True)
class Index:
    """An index in ``path``."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def entries(self) -> DataFrame:
        return self._read("entries")

    def postings(self, tokens: Sequence[str]) -> DataFrame:
        """Postings of some tokens."""
        buckets = self.spark.range(1).select(*[bucket_of(F.lit(t)) for t in tokens]).first()
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("token").isin(list(tokens)))

    def frequency(self, token: str) -> Column:
        """In how many paragraphs a token is, 0 for an unknown one."""
        found = self._read("terms").filter(F.col("token") == token).agg(F.coalesce(F.sum("df"), F.lit(0)).cast("double"))
        return found.scalar()

    def total(self, column: str) -> Column:
        return self._read("totals").select(column).scalar()


def build(entries: DataFrame, path: str) -> None:
    """Write the index of ``entries`` under ``path``; each table is made of those before it.

    Texts are cut into tokens once: their table is read by the range partitioning's sample, the postings and the
    totals, and deleted then.
    """
    spark = entries.sparkSession
    entries.write.parquet(f"{path}/entries")
    with_places(spark.read.parquet(f"{path}/entries")).select("paragraph_id", "language", "source_id", "length", "all_tokens").write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    postings_of(tokens).write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    postings.groupBy("bucket", "token").agg(F.count("*").alias("df")).sortWithinPartitions("token").select("token", "df").write.parquet(f"{path}/terms")
    length = tokens.groupBy("paragraph_id").agg(F.max("length").alias("length"))
    length.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length")).coalesce(1).write.parquet(f"{path}/totals")
    used = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tokens")
    used.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(used, True)


def stored(spark: SparkSession, documents: str, entries) -> Index:
    """The index of the documents at a path; ``entries`` is called, and the index built, if there is none yet.

    It is built beside its place and then renamed, so that no reader sees a part of it; of two
    builders at once the later one's copy is removed.
    """
    root = f"{shared_folder(spark)}/search-index"
    final = f"{root}/{fingerprint(spark, documents)}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(final)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = f"{root}/part-{uuid.uuid4().hex}"
        build(entries(), part)
        source = jvm.org.apache.hadoop.fs.Path(part)
        if fs.exists(path) or not fs.rename(source, path):
            fs.delete(source, True)
    return Index(spark, final)


def _next_to_each_other(columns: Sequence[str]) -> Column:
    """Whether places of the columns follow each other; null places count as none."""
    none = F.array().cast("array<bigint>")
    out = F.coalesce(F.col(columns[0]), none)
    for step, c in enumerate(columns[1:], 1):
        out = F.array_intersect(out, _shifted(F.coalesce(F.col(c), none), step))
    return F.size(out) > 0


def _shifted(places: Column, step: int) -> Column:
    return F.transform(places, lambda x: x - step)


def lookup(index: Index, phrases: Sequence[Sequence[str]], scope: Column | None = None) -> DataFrame:
    """Paragraphs with any token of the phrases: paragraph_id, length, ``tf_<token no>`` and ``match_<phrase no>``.

    Tokens are numbered as ``tokens_of`` lists them. A phrase of one token matches where it occurs, a longer one
    where its tokens stand next to each other in a column. ``scope`` is a condition on language and source_id.
    """
    tokens = tokens_of(phrases)
    rows = index.postings(tokens)
    if scope is not None:
        rows = rows.filter(scope)
    rows = rows.withColumn("tf", F.size("places"))
    placed = {t for p in phrases if len(p) > 1 for t in p}
    is_token = [F.col("token") == t for t in tokens]
    found = rows.groupBy("paragraph_id").agg(
        F.max("length").alias("length"),
        *[F.coalesce(F.max(F.when(is_token[i], F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i in range(len(tokens))],
        *[F.max(F.when(is_token[i], F.col("places"))).alias(f"at_{i}") for i, t in enumerate(tokens) if t in placed],
    )
    matches = {}
    for k, phrase in enumerate(phrases):
        at = [tokens.index(t) for t in phrase]
        matches[f"match_{k}"] = F.col(f"tf_{at[0]}") > 0 if len(at) == 1 else _next_to_each_other([f"at_{i}" for i in at])
    return found.withColumns(matches).drop(*[f"at_{i}" for i in range(len(tokens))])


def tokens_of(phrases: Sequence[Sequence[str]]) -> list[str]:
    """Distinct tokens of some phrases, in order."""
    return list(dict.fromkeys(t for p in phrases for t in p))
