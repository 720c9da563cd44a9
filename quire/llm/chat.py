"""Chat formatting: multi-party perspective rotation.

For every participant (a role other than ``system``) of a conversation the dialogue is rendered with that
speaker as assistant, every other speaker as a user with a name, and system messages as they are. The loss
mask covers what the assistant says and its end mark, and nothing else.

``rotate`` has one row per message and perspective: its rendered text and its masked code-point range.
``dialogues`` joins them: the rendered dialogue in parts of about PART characters, each with its place in the dialogue
and the masked ranges, counted over the whole dialogue. A conversation may have any number of messages: rows
are sorted over all partitions, offsets are running sums within a range of the sort plus what lies before it.

Null texts are empty messages, null roles a participant named ``unknown``. Messages of the same turn are
ordered by role and what is rendered; equal rows are equal messages and stay. Messages without a conversation or turn are
rendered like others, grouped under the null key and ordered first. Names come from roles: characters
outside ``[A-Za-z0-9_-]`` become ``_``. A conversation of system messages alone has no perspectives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import heavy_keys, materialise, salted_join

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART = 1 << 16


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, speaker, role, rendered, mask_start, mask_end) per message and perspective.

    The list of speakers of a conversation is made first and joined to its messages; conversations with over
    1/500 of the messages are salted, so one may hold any share of them.
    """
    # special marks inside messages are broken up, or a message could forge a turn
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    m = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), clean.alias("said"))
    m = m.withColumn("key", F.coalesce(F.col("conv").cast("string"), F.lit("\x00")))
    who = m.groupBy("key").agg(F.array_remove(F.sort_array(F.collect_set("speaker")), "system").alias("who"), F.count("*").alias("messages"))
    who = materialise(who, "speakers")
    each = salted_join(m, who.select("key", "who"), "key", heavy_keys(who, "key", "messages"))
    each = each.select("conv", "turn", "speaker", "said", F.explode("who").alias("perspective"))
    seen = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_")
    head = F.concat(F.lit(OPEN), seen, F.when(seen == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    body = F.concat(F.col("said"), F.lit(CLOSE))
    start = F.length(head).cast("long")
    mine = seen == "assistant"
    return each.select(
        F.col("conv").alias("conv_id"), "perspective", "turn", "speaker", seen.alias("role"),
        F.concat(head, body).alias("rendered"),
        F.when(mine, start).alias("mask_start"), F.when(mine, start + F.length(body)).alias("mask_end"),
    )


def dialogues(rotated: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, perspective, part, start, text, masks) from the rows of ``rotate``.

    A message belongs to the part in which it starts, so a part has at most ``part`` characters and one message;
    the parts of a dialogue, in order, are all of it. ``masks``: array of start and end, in the dialogue.
    """
    who = ["conv_id", "perspective"]
    order = [F.col(c) for c in (*who, "turn", "speaker", "rendered")]
    size = F.length("rendered").cast("long")
    ranges = materialise(rotated.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = materialise(ranges.groupBy(*who, "_range").agg(F.sum(size).alias("chars")), "sums")
    # only dialogues that run over several ranges need what lies before; of those a range has two at most
    w = Window.partitionBy(*who).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.sum("chars").over(w)).where("before > 0")
    before = before.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_range").alias("_r"), "before")
    inside = Window.partitionBy("_range", *who).orderBy("turn", "speaker", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.withColumn("_at", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    met = at.join(before, (F.col("_range") == F.col("_r")) & F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")), "left")
    start = F.col("_at") + F.coalesce("before", F.lit(0))
    rows = met.select(*who, start.alias("at"), F.floor(start / part).alias("part"), "rendered", (start + F.col("mask_start")).alias("a"), (start + F.col("mask_end")).alias("b"))
    one = F.sort_array(F.collect_list(F.struct("at", "rendered", "a", "b")))
    g = rows.groupBy(*who, "part").agg(one.alias("rows"))
    masks = F.transform(F.filter("rows", lambda r: r["a"].isNotNull()), lambda r: F.struct(r["a"].alias("start"), r["b"].alias("end")))
    text = F.array_join(F.transform("rows", lambda r: r["rendered"]), "")
    return g.select(*who, "part", F.get("rows", F.lit(0))["at"].alias("start"), text.alias("text"), masks.alias("masks"))
