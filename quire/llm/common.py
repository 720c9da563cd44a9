"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import materialise, rank, shared_dir, small_table, spread

__all__ = ["few", "heavy_keys", "lower_ascii", "marked", "marks", "materialise", "rank", "read", "salted_join", "shared_dir", "small_table"]

#: Places of a table of marks, 16 MB in 4,096 rows whatever the input.
MARKS, PAGE = 1 << 27, 1 << 15

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in ("documents", "pages") else df


def few(batches: Iterator[pa.RecordBatch], most: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches, some at a time: what a kernel makes of 10,000 texts may be many times what a worker should hold."""
    return (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def heavy_keys(counts: DataFrame, key: str, n: str, share: int = 500, least: int = 10_000) -> list:
    """Keys that hold over one row in ``share``: fewer than ``share`` of them, whatever the input.

    ``counts`` has one row per key with its number of rows in column ``n``; keys of fewer than ``least`` rows fit any task.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    rows = counts.where((F.col(n) * share > total) & (F.col(n) >= least)).where(F.col(key).isNotNull())
    return [r[0] for r in rows.select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, heavy: list, salts: int = 64) -> DataFrame:
    """Left join to a table with unique keys; rows of heavy keys are dealt over ``salts`` partitions.

    Only the right rows of heavy keys are copied, so the copies are fewer than ``len(heavy) * salts``.
    """
    hot = F.col(key).isin(heavy) if heavy else F.lit(False)
    hot = F.coalesce(hot, F.lit(False))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    a = left.withColumn("_salt", F.when(hot | F.col(key).isNull(), salt).otherwise(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.withColumn("_salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(MARKS))


def marks(keys: DataFrame, key: str) -> DataFrame:
    """(_page, _bits): a bit at the hash of every key that isn't null."""
    places = keys.where(F.col(key).isNotNull()).select(_place(key).alias("p"))
    dealt = places.select(F.floor(F.col("p") / PAGE).cast("int").alias("_page"), (F.col("p") % PAGE).alias("at")).repartition("_page")
    return materialise(dealt.groupBy("_page").agg(F.bitmap_construct_agg("at").alias("_bits")), "marks")


def marked(df: DataFrame, key: str, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among those of ``marks``, and rows whose key isn't or is null, without a shuffle."""
    at = F.col("_at") % PAGE
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(F.col("_byte"), (at % 8).cast("int")) == 1
    met = df.withColumn("_at", _place(key)).withColumn("_page", F.floor(F.col("_at") / PAGE).cast("int")).join(F.broadcast(table), "_page", "left")
    hit = F.coalesce(bit, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    met = met.withColumn("_byte", byte).withColumn("_hit", hit)
    return tuple(met.where(c).select(*[F.col(f"`{x}`") for x in df.columns]) for c in (F.col("_hit"), ~F.col("_hit")))
