"""Mixing sources to target weights by the cube method.

A source's target over its size is the number of times each of its words is wanted, between 0 and 2. The whole
part is taken of every document; the rest is an inclusion probability. The cube method moves these
probabilities along the null space of two balancing constraints, the tokens and the documents of the source,
until they are 0 or 1: of three open documents one at least is settled by each move, and the expected
value of each stays what it was. Each source is dealt into buckets of about BUCKET documents that fly on their own;
the two documents that each leaves open at most meet in fewer buckets of their source, and so on. A source
lands as soon as its open documents fit one bucket, so any number of sources ends in some log n levels.

Landing: the larger two thirds fly, or fewer, so that the smaller ones left have room for the tokens of the largest; the
one that stays open is settled by lot and those left make up for the tokens won or lost; they land in turn. The
last few fly under both constraints, then under that on tokens alone, and the last open one is rounded to the nearer side.

Documents are dealt by a hash of id and size and every random number comes from a seed, the source and the bucket,
so a rerun takes the same documents whatever the layout. Null texts have size 0 and nothing is taken of them. Sources
that are null form one source, the last. Equal rows are documents of their own, dealt by their number; which of
them is taken can't be told. An empty table gives an empty result. Ids may be of any type; columns of the
caller may have any name.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import heavy_keys, materialise, rank, salted_join, small_table

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
CAP = 2.0
BUCKET = 4_000
#: Up to this many sources the targets are worked out on the driver and sent along; beyond it both are done by aggregates and joins.
DRIVER_SOURCES = 50_000
REPEATS = 100_000


def size_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> dict[str | None, float]:
    """Target of each source: shares by weight, none above ``cap`` times its size, the excess reshared."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode()) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, fixed, open_ = total * sum(size.values()), {}, list(order)
    while open_:
        left = want - sum(fixed.values())
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * size[s]]
        if not over:
            return fixed | {s: unit * weight[s] for s in open_}
        fixed |= {s: cap * float(size[s]) for s in over}
        open_ = [s for s in open_ if s not in fixed]
    return fixed


_EDGE = 1e-9


def _reach(p: list[float], u: list[float]) -> float:
    """How far p can go along u within [0, 1]."""
    return min((((1 - x) if d > 0 else x) / abs(d) for x, d in zip(p, u) if d), default=0.0)


def flight(units: list[tuple[float, float]], rng: random.Random, both: bool = True) -> list[float]:
    """Move the probabilities of (size, probability) units until at most two, or one, are open.

    ``both``: balance tokens and documents; else tokens alone.
    """
    p = [x for _, x in units]
    need = 3 if both else 2
    active: list[int] = []
    for i in range(len(p)):
        if _EDGE < p[i] < 1 - _EDGE:
            active.append(i)
        while len(active) == need:
            s = [units[k][0] for k in active]
            if both:
                u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            else:
                u = [s[1], -s[0]] if any(s) else [1.0, -1.0]
            top = max(map(abs, u))
            u = [x / top for x in u]
            now = [p[k] for k in active]
            ahead, back = _reach(now, u), _reach(now, [-x for x in u])
            step = ahead if rng.random() * (ahead + back) < back else -back
            for k, x, d in zip(active, now, u):
                y = x + step * d
                p[k] = 0.0 if y < _EDGE else 1.0 if y > 1 - _EDGE else y
            left = [k for k in active if 0 < p[k] < 1]
            if len(left) == need:  # rounding kept all inside: settle the nearest
                k = min(left, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                left.remove(k)
            active = left
    return p


def _settle(p: list[float], units: list[tuple[float, float]], among: list[int], by: list[int], rng: random.Random) -> None:
    """Settle the last open of ``among`` by lot; the open ones of ``by`` make up for the tokens won or lost."""
    for k in (k for k in among if 0 < p[k] < 1):
        z = 1.0 if rng.random() < p[k] else 0.0
        owed = (p[k] - z) * units[k][0]
        rest = [j for j in by if 0 < p[j] < 1]
        room = sum(((1 - p[j]) if owed > 0 else p[j]) * units[j][0] for j in rest)
        if room > abs(owed):
            p[k] = z
            for j in rest:
                p[j] += ((1 - p[j]) if owed > 0 else p[j]) * owed / room


def land(units: list[tuple[float, float]], rng: random.Random) -> list[float]:
    """Last stage of a source: flights of the larger documents, again and again, then the nearer side for what is left."""
    p = [x for _, x in units]

    def fly(part: list[int]) -> None:
        for both in (True, False):
            for k, x in zip(part, flight([(units[k][0], p[k]) for k in part], rng, both)):
                p[k] = x

    while True:
        order = sorted((k for k in range(len(p)) if 0 < p[k] < 1), key=lambda k: -units[k][0])
        cut, room = len(order), 0.0
        while cut and (len(order) - cut < len(order) / 3 or room < units[order[0]][0]):
            cut -= 1
            room += min(p[order[cut]], 1 - p[order[cut]]) * units[order[cut]][0]
        if not cut:
            break
        fly(order[:cut])
        _settle(p, units, order[:cut], order[cut:], rng)
        if any(0 < p[k] < 1 for k in order[:cut]):
            break
    fly([k for k in order if 0 < p[k] < 1])
    return [float(x >= 0.5) if 0 < x < 1 else x for x in p]


def _fly(rows: DataFrame, seed: int, bucket: int) -> DataFrame:
    """One level: open rows (doc_id, k, sid, size, base, p) with p moved; sources of at most ``bucket`` rows land."""
    counts = materialise(rows.groupBy("sid").agg(F.count("*").alias("open")), "open")
    total = counts.agg(F.sum("open")).first()[0] or 0
    buckets = counts.select("sid", F.ceil(F.col("open") / bucket).alias("buckets"))
    each = salted_join(rows, buckets, "sid", heavy_keys(counts, "sid", "open"))
    place = F.pmod(F.xxhash64("doc_id", "size", "k", F.lit(seed)), F.col("buckets"))
    names = ["doc_id", "k", "sid", "size", "base", "p"]
    n = min(20_000, max(1, -(-total // bucket)))
    dealt = each.select(*names, place.alias("bucket"), (F.col("buckets") == 1).alias("last")).repartition(n, "sid", "bucket").sortWithinPartitions("sid", "bucket", F.desc("size"), "doc_id", "k", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def each() -> Iterator[tuple]:
            for b in batches:
                types[:] = b.schema.types[:6]
                yield from zip(*(b.column(i).to_pylist() for i in range(8)))

        for (sid, bucket_), group in groupby(each(), key=lambda r: (r[2], r[6])):
            group = list(group)
            rng = random.Random(f"{seed}/{bucket_}/{sid}")
            units = [(float(r[3]), r[5]) for r in group]
            p = land(units, rng) if group[0][7] else flight(units, rng)
            cols = [*list(zip(*group))[:5], p]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    out = dealt.select(*names)
    return dealt.mapInArrow(run, out.schema)


def _key(c):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def source_table(by: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> tuple[DataFrame, bool]:
    """(skey, sid, source_size, target) of sources (source, source_size, n) and whether the table may be broadcast."""
    spark = by.sparkSession
    known = by.limit(DRIVER_SOURCES + 1).collect()
    if len(known) <= DRIVER_SOURCES:
        want = targets([(r["source"], r["source_size"]) for r in known], weights, total, cap)
        order = sorted((r for r in known if r["source"] is not None), key=lambda r: r["source"].encode()) + [r for r in known if r["source"] is None]
        rows = [("" if r["source"] is None else "=" + r["source"], i, r["source_size"], float(want[r["source"]])) for i, r in enumerate(order)]
        return small_table(spark, rows, skey=pa.string(), sid=pa.int64(), source_size=pa.int64(), target=pa.float64()), True
    ranked = rank(by.select(_key(F.col("source")).alias("skey"), F.col("source").isNull().alias("none"), "source_size"), ["none", "skey"], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("skey", "sid", "source_size", weight.alias("weight")), "sources")
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    want, unit = total * (whole[0] or 0), 0.0
    unit, last = want / whole[1], -1
    while True:  # the unit only grows, so what is over stays over
        over = F.lit(unit) * F.col("weight") > cap * F.col("source_size")
        r = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if r[0] == last or not r[2]:
            break
        last, unit = r[0], (want - cap * (r[1] or 0)) / r[2]
    target = F.when(over, cap * F.col("source_size")).otherwise(F.lit(unit) * F.col("weight"))
    return materialise(ranked.select("skey", "sid", "source_size", target.cast("double").alias("target")), "targets"), False


def plan(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, seed: int = 17, bucket: int = BUCKET, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row of ``docs``."""
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"))
    sized = materialise(one.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    by = materialise(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n")), "by_source")
    table, small = source_table(by, weights, total, cap)
    sized = sized.withColumn("skey", _key(F.col("source")))
    if small:
        known = sized.join(F.broadcast(table), "skey")  # at most DRIVER_SOURCES rows
    else:
        known = salted_join(sized, table, "skey", heavy_keys(by.select(_key(F.col("source")).alias("skey"), "n"), "skey", "n"))
    # equal rows are numbered, a stretch of numbers to a task
    known = known.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(REPEATS).cast("long"))))
    k = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + REPEATS, F.col("rows")) - 1)).alias("k")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_ = known.select("doc_id", k, "sid", "size", F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"))
    settled, level = [], 0
    while True:
        level += 1
        flown = materialise(_fly(open_, seed + level, bucket), f"flight{level}")
        settled.append(flown.where("p <= 0 or p >= 1"))
        open_ = flown.where("p > 0 and p < 1")
        if not open_.limit(1).count():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.union(more)
    copies = (F.col("base") + F.when(F.col("p") >= 1, 1).otherwise(0)).cast("int")
    name = F.when(F.col("skey") != "", F.substring("skey", 2, 1 << 30)).alias("source")
    table = table.select("sid", name, "source_size", "target")
    if small:
        out = done.join(F.broadcast(table), "sid")
    else:
        out = salted_join(done, table, "sid", heavy_keys(materialise(done.groupBy("sid").count(), "rows"), "sid", "count"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it, with their columns as they were.

    Rows are found again by id and source, words being counted anew only where rows share both; of rows that
    agree in size too the copies go round.
    """
    name = lambda c: F.col(f"`{c}`")
    doc_id, source = (name(options.get(c, c)) for c in ("doc_id", "source"))
    whole = F.struct(*[name(c) for c in docs.columns]).alias("row")
    got = plan(docs, **options)
    got = got.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    got = got.groupBy("doc_id", "source").agg(F.sum("rows").alias("rows"), F.sum("copies").alias("copies"), F.collect_list(F.struct("size", "copies", "rows")).alias("each"))
    got = materialise(got.where("copies > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), "rows", "copies", "each"), "copies")
    rows = docs.select(whole, doc_id.alias("id"), source.cast("string").alias("src"), name(options.get("text", "text")).alias("t"))
    on = F.col("id").eqNullSafe(F.col("i")) & F.col("src").eqNullSafe(F.col("s"))
    one = rows.join(got.where("rows = 1").hint("merge"), on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    many = got.where("rows > 1").select("i", "s", F.explode("each").alias("e")).select("i", "s", F.col("e.size").alias("size"), F.col("e.copies").alias("copies"), F.col("e.rows").alias("rows"))
    if not many.limit(1).count():
        return one.select("row.*")
    # equal keys: each task numbers its rows, and the numbers of the tasks before it are added
    same = rows.join(many, on & (size_of("t") == F.col("size"))).where("copies > 0")
    same = materialise(same.select("row", F.xxhash64("i", "s", "size").alias("key"), F.col("copies").alias("c"), F.col("rows").alias("m")), "same")
    part = same.select("*", F.spark_partition_id().alias("at"))
    nth = F.row_number().over(Window.partitionBy("key", "at").orderBy(F.lit(1)))
    before = part.groupBy("key", "at").count().withColumn("before", F.sum("count").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    placed = part.withColumn("nth", nth).join(before.select("key", "at", "before"), ["key", "at"])
    at = F.col("nth") + F.coalesce("before", F.lit(0))
    mine = F.floor(F.col("c") / F.col("m")) + F.when(at <= F.col("c") % F.col("m"), 1).otherwise(0)
    again = placed.withColumn("mine", mine.cast("int")).where("mine > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mine"))))
    return one.union(again).select("row.*")
