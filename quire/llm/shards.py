"""Sharding by histogram sort, in built-in functions only.

Law ``bytes``: rows are ordered by a 128-bit key (hash of the text, hash of the id), so equal texts lie
together, and cut into shards of near-equal bytes. Splitters are found by counting: exact bytes and rows below
candidate key boundaries over all partitions, boundaries refined 256-fold a round where a splitter has not met
its tolerance, down to a single row. Only these counts, at most 256 for each splitter and round, reach the driver.

Then rows are exchanged once, by bins far smaller than a shard: a bin is a prefix of the key long enough for some
tens of thousands of rows; a prefix that equal texts fill further is cut by whole text hashes, and a text hash of
too many rows by its ids. Counts of bins, summed along the order of keys as a table, make each bin's first slot.

A shard's bytes differ from the mean by at most the tolerance or the largest row beside a splitter. A group of
equal texts larger than a shard runs over several. Null texts have no bytes, equal empty ones and count 8 as
each row does; rows without an id come as one id; equal rows take neighbouring slots. Rows that agree in text
and id can't be told apart by key, so a splitter never parts them. Columns of the caller may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise

SHARDS = 24
OVERHEAD = 8
_DEPTH = 16  # bytes of the key


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): all that the sort needs of a row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.concat(_hex(F.xxhash64(t)), _hex(F.xxhash64(F.col(doc_id)))).alias("key"),
    )


def boundaries(rows: DataFrame, wants: list[tuple[str, int, float]], size: str = "size") -> list[tuple[str, int, int]]:
    """For each (measure, amount, tolerance) a boundary (key, bytes below, rows below).

    ``measure`` is bytes or rows. Each round is one aggregate over the rows of open brackets, at most
    256 counts for each.
    """
    done: list[tuple[str, int, int] | None] = [None] * len(wants)
    open_: dict[str, tuple[int, int, list[int]]] = {"": (0, 0, list(range(len(wants))))}
    for depth in range(_DEPTH):
        if not open_:
            break
        prefix = F.substring("key", 1, 2 * depth) if depth else F.lit("")
        some = rows.where(prefix.isin(list(open_))) if depth else rows
        counts = some.groupBy(prefix.alias("p"), F.substring("key", 2 * depth + 1, 2).alias("d")).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()
        bins: dict[str, list[tuple[str, int, int]]] = {}
        for r in counts:
            bins.setdefault(r["p"], []).append((r["d"], r["b"], r["n"]))
        nearer: dict[str, tuple[int, int, list[int]]] = {}
        for p, (b0, n0, mine) in open_.items():
            edges = [(b0, n0)]
            own = sorted(bins.get(p, []))
            for _, b, n in own:
                edges.append((edges[-1][0] + b, edges[-1][1] + n))
            for w in mine:
                measure, amount, tolerance = wants[w]
                at = [e[measure == "rows"] for e in edges]
                k = next((i for i in range(len(own)) if at[i + 1] >= amount), len(own) - 1)
                if k < 0:
                    done[w] = (p, b0, n0)
                    continue
                low, high = amount - at[k], at[k + 1] - amount
                name = p + own[k][0]
                if min(low, high) <= tolerance or own[k][2] == 1 or depth == _DEPTH - 1:
                    done[w] = (name, *edges[k]) if low <= high else (name + "G", *edges[k + 1])
                else:
                    nearer.setdefault(name, (*edges[k], []))[2].append(w)
        open_ = nearer
    return done


def _place(key: Column, bounds: list[str]) -> Column:
    """Number of boundaries at or below the key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(bounds)), ",")
    lo, hi = F.lit(0), F.lit(len(bounds))
    start = F.struct(lo.alias("lo"), hi.alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        below = F.get(table, mid) <= key
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"),
        )

    rounds = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(rounds, start, step, lambda acc: acc["lo"])


def _bins(rows: DataFrame, n: int, per_bin: int) -> DataFrame:
    """Rows with the bin of their key: a prefix of it, longer where equal texts make a prefix large. Bins sort as their keys do."""
    digits = max(1, math.ceil(math.log(max(n, 1) / per_bin, 16))) if n > per_bin else 1
    levels = [digits, 16, 16 + digits]
    out, open_ = None, rows.select("key")
    names = []
    for k, d in enumerate(levels[:-1]):
        counts = open_.groupBy(F.substring("key", 1, d).alias("p")).agg(F.count("*").alias("rows"))
        large = materialise(counts.where(F.col("rows") > 4 * per_bin).select("p"), f"large{k}")
        names.append((d, large))
        if not large.limit(1).count():
            break
        open_ = open_.join(large, F.substring("key", 1, d) == F.col("p"), "left_semi")
    joined = rows
    for k, (d, large) in enumerate(names):
        # at most one prefix for each 4 * per_bin rows
        joined = joined.join(large.select(F.col("p").alias(f"_p{k}")), F.substring("key", 1, d) == F.col(f"_p{k}"), "left")
    for k in reversed(range(len(names))):
        longer = F.substring("key", 1, levels[k + 1]) if out is None else out
        out = F.when(F.col(f"_p{k}").isNull(), F.substring("key", 1, levels[k])).otherwise(longer)
    return joined.withColumn("_bin", out).drop(*[f"_p{k}" for k in range(len(names))])


def shard(rows: DataFrame, shards: int = SHARDS, rows_per_bin: int = 25_000, tolerance: float = 1e-4) -> DataFrame:
    """Add shard and slot to rows that have ``key`` and ``size``; further columns go along."""
    slim = rows.select("key", "size")
    whole = slim.agg(F.sum("size"), F.count("*")).first()
    total, n = whole[0] or 0, whole[1]
    wants = [("bytes", -(-total * j // shards), tolerance * total / shards) for j in range(1, shards)]
    cuts = sorted(k for k, _, _ in boundaries(slim, wants)) if n else []
    # equal keys of boundaries have equal counts; a cut on the same key as another leaves a shard empty
    placed = _bins(rows, n, rows_per_bin).withColumn("shard", _place(F.col("key"), cuts).cast("int"))
    counts = placed.groupBy("shard", "_bin").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(counts.select("shard", "_bin", F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    within = F.row_number().over(Window.partitionBy("shard", "_bin").orderBy("key", *[c for c in ("doc_id",) if c in rows.columns]))
    out = placed.withColumn("_row", within).join(starts, ["shard", "_bin"])
    return out.withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_bin", "_row", "_start")


_DIGEST = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _digest(c: str) -> Column:
    return {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}.get(c, F.col(c)).alias(c)


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs``."""
    narrow = materialise(keyed(docs, doc_id, text), "keyed")
    return shard(narrow, shards).select("doc_id", *map(_digest, _DIGEST))


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard, which replace columns of those names."""
    own = [c for c in docs.columns if c not in _DIGEST]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc")
    narrow = docs.select(row, (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.concat(_hex(F.xxhash64(t)), _hex(F.xxhash64(F.col(f"`{doc_id}`")))).alias("key"))
    return shard(narrow, shards).select("_doc.*", *map(_digest, _DIGEST))
