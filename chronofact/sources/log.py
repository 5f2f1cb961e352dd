"""Transaction logs as files: JSON lines with recovery, Parquet with compaction, snapshots.

A log row is (t, seq, op, e, a, v). One writer appends; readers filter by t,
which Parquet statistics and partitions of t prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "t long, seq int, op string, e string, a string, v string"
CORRUPT = "_corrupt_record"


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The valid prefix of a JSON-lines log: whole transactions before the first one with a broken line, over all files.

    A broken line's transaction is read from what is left of it. Where that
    has no number, the line counts for the transaction of the last whole line
    before it in its file, or of the first one after it; if its file has no
    whole line, transactions after the first gap in t are dropped.
    """
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    rows = lines.select(parsed.alias("r"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.select("r.*", "_file", "_at")
    whole = rows.filter(F.col(CORRUPT).isNull() & F.col("t").isNotNull())
    left = F.regexp_extract(F.coalesce(CORRUPT, F.lit("")), r'"t"\s*:\s*(\d+)\s*,', 1)
    broken = rows.filter(F.col(CORRUPT).isNotNull() | F.col("t").isNull()).select("_file", "_at", F.when(left != "", left.cast("long")).alias("own"))
    broken = broken.groupBy("_file").agg(F.min(F.struct("_at", "own")).alias("first")).select("_file", "first._at", "first.own")
    beside = broken.withColumnRenamed("_at", "_stop").join(whole.select("_file", "_at", "t"), "_file", "left")
    before = F.max_by("t", F.when(F.col("_at") < F.col("_stop"), F.col("_at")))
    torn = beside.groupBy("_file", "own").agg(F.coalesce("own", before, F.min("t")).alias("t"))
    found = torn.agg(F.count("*").alias("n"), F.count("t").alias("n_known"), F.min("t").alias("t")).first()
    kept = whole.drop(CORRUPT, "_file", "_at")
    if found["n"] > found["n_known"]:
        nexts = kept.select((F.col("t") + 1).alias("t")).distinct()
        gap = nexts.join(kept.select("t").distinct(), "t", "left_anti").agg(F.min("t")).first()[0]
        kept = kept.filter(F.col("t") < gap) if gap is not None else kept
    return kept if found["t"] is None else kept.filter(F.col("t") < found["t"])


def append(rows: DataFrame, path: str, bucket: int = 500) -> None:
    """Parquet, in folders of bucket transactions each."""
    rows.withColumn("head", F.floor(F.col("t") / bucket)).write.mode("append").partitionBy("head").parquet(path)


def read(spark: SparkSession, path: str, first: int = 0, last: int | None = None, bucket: int = 500) -> DataFrame:
    """Transactions first to last; folders outside are not listed as input."""
    df = spark.read.parquet(path).filter((F.col("head") >= first // bucket) & (F.col("t") >= first))
    if last is not None:
        df = df.filter((F.col("head") <= last // bucket) & (F.col("t") <= last))
    return df.drop("head")


def last_transaction(spark: SparkSession, path: str) -> int:
    """-1 for an empty log."""
    newest = spark.read.parquet(path).agg(F.max("head")).first()[0]
    return -1 if newest is None else spark.read.parquet(path).filter(F.col("head") == newest).agg(F.max("t")).first()[0]


def compacted(spark: SparkSession, path: str, target: str, bucket: int = 500) -> None:
    """The log in one sorted file for each folder, under a new path."""
    df = spark.read.parquet(path)
    df.repartition("head").sortWithinPartitions("head", "t", "seq").write.partitionBy("head").parquet(target)


def truncated(spark: SparkSession, path: str, target: str, first: int, bucket: int = 500) -> None:
    """Transactions from first on, under a new path; the old one stays until readers have moved."""
    append(read(spark, path, first, None, bucket), target, bucket)


def branch(base: DataFrame, n: int, overlay: DataFrame) -> DataFrame:
    return base.filter(F.col("t") <= n).unionByName(overlay.withColumn("t", F.col("t") + n + 1))


# Snapshots: states of views as of a transaction, in folders named by it.


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def store_snapshot(view: DataFrame, path: str, t: int) -> None:
    view.write.mode("overwrite").parquet(f"{path}/t={t}")


def snapshots(spark: SparkSession, path: str) -> list[int]:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n[2:]) for n in found if n.startswith("t=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def latest_snapshot(spark: SparkSession, path: str, t: int | None = None) -> tuple[int, DataFrame] | None:
    """The newest whole snapshot, or the newest one up to t."""
    known = [s for s in snapshots(spark, path) if t is None or s <= t]
    return (known[-1], spark.read.parquet(f"{path}/t={known[-1]}")) if known else None


def store_every(view, log: DataFrame, path: str, every: int = 100) -> int | None:
    """A snapshot of view(log) if every transactions have passed since the last one."""
    spark = log.sparkSession
    now = log.agg(F.max("t")).first()[0]
    known = snapshots(spark, path)
    if now is None or known and now - known[-1] < every:
        return None
    store_snapshot(view(log), path, now)
    return now


def remove_old_snapshots(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    old = snapshots(spark, path)[:-keep]
    for t in old:
        fs, target = _fs(spark, f"{path}/t={t}")
        fs.delete(target, True)
    return old


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all stored files, for size reports."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
