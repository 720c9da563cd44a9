"""Projections of the job log: (seq, event_id, ts, job_id, kind, payload columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What the standard event types mean in the log.
KINDS = {"view": "ocr.job.submitted", "click": "ocr.job.started", "purchase": "ocr.job.completed", "error": "ocr.job.completed", "signup": "artifact.created"}


#: A job record (MISC-09); ``job_record`` holds rows against it.
RECORD = "id string, filename string, model string, pipeline_mode string, pages int, duration_s double, timestamp timestamp, status string, failed_pages array<int>, text_artifact_id string"
STATUSES = ["pending", "processing", "complete", "error"]


def job_record(rows: DataFrame) -> DataFrame:
    """Rows as job records (MISC-09): an id, a known status, no negative counts, failed pages tidied; others raise."""
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], RECORD).schema}
    cols = [F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    out = rows.select(*cols)
    ok = (F.coalesce(F.trim("id"), F.lit("")) != "") & F.col("status").isin(STATUSES) & (F.coalesce("pages", F.lit(0)) >= 0) & (F.coalesce("duration_s", F.lit(0.0)) >= 0)
    bad = F.raise_error(F.concat(F.lit("bad job record "), F.coalesce("id", F.lit("without id")))).cast("string")
    pages = F.coalesce(clean_failed_pages(F.col("failed_pages")), F.array().cast("array<int>"))
    return out.withColumn("id", F.when(F.coalesce(ok, F.lit(False)), F.col("id")).otherwise(bad)).withColumn("failed_pages", pages)


def log_view(events: DataFrame) -> DataFrame:
    """A job log from plain events."""
    kind = F.lit(None).cast("string")
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    n = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), "ts", kind.alias("kind"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").alias("status"),
        F.col("value").alias("duration_s"), F.when(F.col("event_type") == "error", n).alias("failed_page"), n.alias("k"),
    )


def job_history(log: DataFrame) -> DataFrame:
    """Fold of a job's events in order of seq (AGG-16).

    Each attribute is an ordered aggregate, so a job's events are combined before the shuffle and never listed.
    """
    jobs = log.where(F.col("kind").startswith("ocr.job."))
    status = (
        F.when(F.col("kind") == "ocr.job.submitted", "pending").when(F.col("kind") == "ocr.job.started", "processing")
        .when((F.col("kind") == "ocr.job.cancelled") | F.col("status").isin("error", "cancelled"), "error").otherwise("complete")
    )
    ended = F.col("kind") == "ocr.job.completed"
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    return jobs.groupBy("job_id").agg(
        F.max_by(status, "seq").alias("status"), F.min_by("ts", "seq").alias("timestamp"), F.min("seq").alias("position"),
        last(F.bround("duration_s", 2), ended & F.col("duration_s").isNotNull()).alias("duration_s"),
        last(F.col("failed_page"), ended & F.col("failed_page").isNotNull()).alias("failed_page"),
    )


def newest_first(rows: DataFrame, time: str, position: str, most: int | None = None) -> DataFrame:
    """Time down, position down, cut after the sort (WIN-06, SRT-02, SRT-04)."""
    out = rows.orderBy(F.desc(time), F.desc(position))
    return out.limit(most) if most else out


def latest(log: DataFrame, key: str) -> DataFrame:
    """The last row of each key as a whole, with the place of its first (AGG-17)."""
    made = log.where(F.col("kind") == "artifact.created")
    rest = [c for c in made.columns if c != key]
    return made.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min("seq").alias("first_seq")).select(key, "r.*", "first_seq")


def log_filter(log: DataFrame, kinds: list[str] | None = None, job_id=None, since=None, until=None, limit: int | None = None) -> DataFrame:
    """Filters that reach the scan, in order of insertion (SRT-03); both times inclusive."""
    out = log
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if job_id is not None:
        out = out.where(F.col("job_id") == job_id)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    return out.orderBy("seq").limit(limit) if limit else out


def expire(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that still live (SRT-06, SRT-10, STM-07)."""
    return rows.where(F.col(expires) > now)


def retain(rows: DataFrame, now: Column, seconds: int, completed: str = "completed_at", terminal: str = "terminal") -> DataFrame:
    """Finished records older than the retention go; none where it is 0 or less (SRT-10)."""
    if seconds <= 0:
        return rows
    old = F.col(terminal) & (F.col(completed) < now - F.expr(f"INTERVAL {seconds} SECONDS"))
    return rows.where(~F.coalesce(old, F.lit(False)))


def keep_newest(rows: DataFrame, most: int, created: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows, of each group or of all (SRT-05, SRT-07, SRT-11).

    Of all rows it is a sort with limit, which keeps partial lists, not a window over one partition.
    """
    order = [F.desc(created), F.desc(tie)]
    if not by:
        return rows.orderBy(*order).limit(most)
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def upsert(table: DataFrame, new: DataFrame, key: str, seq: str, most: int | None = None) -> DataFrame:
    """The row of highest ``seq`` per key, then the cap (SRT-05)."""
    every = table.unionByName(new)
    rest = [c for c in every.columns if c != key]
    out = every.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*").select(*every.columns)
    return keep_newest(out, most, seq, key) if most else out


def hot_rate_window(events: DataFrame, client: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """``rate_window`` for clients that hold a large share of all events: each client's time is cut into stretches of
    ``seconds``, a stretch looks at its own events and those of the one before, so no task holds a client whole.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.withColumn("_us", us).withColumn("_at", F.floor(F.col("_us") / (seconds * 1_000_000)))
    own = own.withColumn("_real", F.lit(True))
    before = own.withColumn("_at", F.col("_at") + 1).withColumn("_real", F.lit(False))
    w = Window.partitionBy(client, "_at").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    out = own.union(before).withColumn("in_window", F.count("*").over(w)).where("_real")
    return out.withColumn("limited", F.col("in_window") > limit).drop("_us", "_at", "_real")


def rate_window(events: DataFrame, client: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests of a client in the trailing window and whether the limit is passed (WIN-09)."""
    w = Window.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > limit)


def page_runs(pages: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Distinct pages as runs such as 1-25,27; pages are numbered from 1 (WIN-07)."""
    p = pages.select(doc, (F.col(page) + 1).alias("p")).distinct()
    p = p.withColumn("g", F.col("p") - F.row_number().over(Window.partitionBy(doc).orderBy("p")))
    runs = p.groupBy(doc, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda r: r["t"]), ",").alias("page_range"))


def chunk_progress(pages: DataFrame, size: int = 25) -> DataFrame:
    """Tumbling count windows of pages with running characters and percent (STM-08). ``pages``: chars."""
    c = pages.groupBy("doc_id", F.floor(F.col("page_index") / size).alias("chunk")).agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
    w = Window.partitionBy("doc_id").orderBy("chunk")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pages").over(Window.partitionBy("doc_id"))
    return c.withColumn("total_chars", F.sum("chars").over(run)).withColumn("percent", F.floor(F.sum("pages").over(run) * 100 / total))


def stage_percent(current: Column, total: Column, low: int, high: int) -> Column:
    """Percent of a stage between its bounds (MATH-07)."""
    return F.when(total <= 0, low).otherwise(low + F.floor(current / total * (high - low))).cast("int")


def remap_chunk_pages(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages of a chunk numbered as in the document; out of range they keep their number (JN-17)."""
    out = texts.join(chunks, ["chunk", "local_page"], "left")
    return out.withColumn("page_index", F.coalesce("document_page", "local_page")).drop("document_page")


def clean_failed_pages(pages: Column) -> Column:
    """Distinct in order, negatives dropped, at most 10,000 (SET-09)."""
    return F.slice(F.array_distinct(F.filter(pages, lambda p: p >= 0)), 1, 10_000)
