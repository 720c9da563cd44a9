"""Session helper with settings that the plans rely on."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def get_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions are left to the cluster's own settings."""
    builder = SparkSession.builder.appName("quire")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores where the input has fewer splits, as a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows that the driver made, sent as Arrow: rows of Python objects would start further Python workers on all executors."""
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items())}))


def _root(spark: SparkSession) -> str:
    """The folder of a session's intermediate tables, under ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder under /tmp and a cluster one in its warehouse, unless that lies on the
    driver's own disk, where executors wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
        if not local and (base.startswith("file:") or "://" not in base):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder that the driver and all executors see; ``clean_up`` removes those of the session."""
    return f"{_root(spark)}/{uuid.uuid4().hex}/{tag}"


def clean_up(spark: SparkSession) -> bool:
    """Remove the session's intermediate tables, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a cached or locally checkpointed frame it survives the loss of any executor. What the write shuffled is freed with it,
    so the steps of a job hold their tables and the shuffle of one step on disk, not those of all.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)
    return spark.read.schema(df.schema).parquet(path)


def rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows from 0 in an order, over all partitions: ranges are sorted on their own and start where those before end.

    The ranges are written first, so that counts and rows come from one dealing. Only a count per range is sent along.
    """
    ranges = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, total = [], 0
    for r, n in sorted(ranges.groupBy("_range").count().collect()):
        starts.append((r, total))
        total += n
    table = F.broadcast(small_table(df.sparkSession, starts, _range=pa.int32(), _start=pa.int64()))  # a row per range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranges.withColumn(name, within).join(table, "_range")
    return placed.withColumn(name, F.col(name) + F.col("_start") - 1).drop("_range", "_start")


def rank_within(df: DataFrame, key: str, order: list, name: str) -> DataFrame:
    """Number the rows of each key from 0 in an order. Keys are cut where a range of the sort ends, so none is one task.

    Only a key that goes on from an earlier range has rows before it: one a range at most, and those counts are sent along.
    """
    ranges = materialise(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    along = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(key, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(along))
    before = F.broadcast(counts.where("_before > 0").select(F.col(key).alias("_key"), F.col("_range").alias("_at"), "_before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("_range", key).orderBy(*order))
    met = ranges.withColumn(name, within).join(before, (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn(name, F.col(name) - 1 + F.coalesce("_before", F.lit(0))).drop("_range", "_at", "_key", "_before")
