"""Conversation structure repair: the cheapest edits that make the turns of a conversation a legal dialogue.

A legal dialogue is empty, or an optional system turn and then pairs of a user and an assistant turn. Edits: Keep a
turn, Rerole it to user or assistant, Delete it, Insert an empty turn. A blank turn (no character other than ASCII white
space) and a duplicate (role and text of an earlier one) must go; a truncated one (its last such character isn't ``.``, ``!``
or ``?``) costs more if it stays. A role counts by its first character, so one that doesn't begin with s, u or a
(an empty one too) can be reroled or deleted, never kept. Of equally cheap audits (the edits' initials in order) the
ASCII-least is taken.

The dynamic programme runs over the turns that stay. ``best[r]`` is the least cost, less the deletion sum so far, of all
ways whose last turn that stays has role r: a running minimum, as a gap costs the difference of two deletion sums. The
pair of roles at a gap's ends says what must be inserted. Between ways of equal cost the audit decides; no audit of the same
turns begins another, so ranks of the audits so far, with the letters that come next, order them without strings.

Turns are sorted by conversation and turn in ranges over all partitions (nulls first; turns of one number by role, then
the first letters, hash and what else tells texts apart), so a conversation may hold any share of the rows. It is cut where a range ends: each
such segment gives costs and ranks for all pairs of first and last role, small tables that are joined along the conversation
and tell each segment its own pair. Only first occurrences of a role and text go through the programme; what lies between
them is priced by position.

Null roles and texts are one space each, so a turn without text is blank. Rows without a conversation are one conversation,
without a turn come first; equal rows are duplicates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
VISIBLE = "[^\\x20\\x09-\\x0D]"
START, SYSTEM, USER, ASSISTANT = range(4)
INF = float("inf")

NAMES = {USER: "user", ASSISTANT: "assistant"}

#: What must be inserted between turns that stay, by the role before and the role after; what isn't there can't be mended.
GAP = {
    (START, SYSTEM): (), (START, USER): (), (SYSTEM, USER): (), (ASSISTANT, USER): (), (USER, ASSISTANT): (),
    (START, ASSISTANT): (USER,), (SYSTEM, ASSISTANT): (USER,), (ASSISTANT, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,),
}
#: What must be inserted after the last turn that stays.
CLOSE = {START: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults that the checksum of conversation and turn picks: a repair's test input.

    Of 20 values 0 drops a row, 1 empties its text, 2 removes its stops, 3 repeats it and 4 makes it the user's.
    """
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), one), F.lit(":"), F.coalesce(F.col(turn).cast("string"), one))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, one).alias("role"), F.coalesce(text, one).alias("text"), (F.crc32(key) % 20).alias("_f"))
    rows = rows.where("_f <> 0").withColumn("text", F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")))
    times = F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_n", F.explode(times)).select("conv_id", "turn", "role", "text")


def _is_blank(text: Column) -> Column:
    return ~text.rlike(VISIBLE)


def _is_truncated(text: Column) -> Column:
    return ~text.rlike(f"[.!?][\\x20\\x09-\\x0D]*\\z")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: their place among those of their conversation, and the initial before."""
    conv, at, before = object(), 0, None
    for b in batches:
        places, befores = [], []
        for c, r in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist()):
            if c != conv:
                conv, at, before = c, 0, None
            places.append(at)
            befores.append(before)
            at, before = at + 1, r[:1]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array(befores, pa.string())], names=[*b.schema.names, "_at", "_before"])


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` sorted over all partitions, written, with ``_range``, place in the segment ``_at`` and initial ``_before``."""
    digest = F.sha2("text", 256)
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64), digest]
    # rows that are equal in all of that are equal, so any number may part them
    dealt = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any")
    slim = dealt.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, turn {dict(rows.dtypes)['turn']}, role string, text string, _at long, _before string"
    placed = slim.mapInArrow(_numbered, schema).withColumn("_range", F.spark_partition_id())
    return materialise(placed, "turns")


def candidates(turns: DataFrame) -> DataFrame:
    """A row per role and text of a conversation: its first place, number of rows, and the faults of the first."""
    text = F.col("text")
    first = F.min(F.struct("_range", "_at")).alias("first")
    g = turns.groupBy("conv_id", "role", F.sha2("text", 256).alias("_text")).agg(first, F.count("*").alias("n"), F.first(_is_blank(text)).alias("blank"), F.first(_is_truncated(text)).alias("cut"))
    return g.select("conv_id", F.substring("role", 1, 1).alias("initial"), "first.*", "n", "blank", "cut")


def _step(best: list, rank: list, initial: str, cut: bool):
    """One turn that may stay: new minima and ranks, and for each role how it came about (role before, letter) or None.

    ``best`` holds costs less the deletion sum behind the last turn that stays, so nothing is added for a gap.
    """
    own = TRUNCATED * cut - DELETE  # of this row's part in the deletion sum it takes none
    ways = [(SYSTEM, KEEP + own, "K")] if initial == "s" else []
    for role in (USER, ASSISTANT):
        kept = initial == NAMES[role][0]
        ways.append((role, (KEEP if kept else REROLE) + own, "K" if kept else "R"))
    found = [(best[r], (rank[r], "D"), None) for r in range(4)]  # deleted
    for role, cost, letter in ways:
        for r in range(4):
            gap = GAP.get((r, role))
            if gap is not None and best[r] < INF:
                got = (best[r] + cost + INSERT * len(gap), (rank[r], "I" * len(gap) + letter), (r, letter))
                if got[:2] < found[role][:2]:
                    found[role] = got
    places = {k: i for i, k in enumerate(sorted({f[1] for f in found if f[0] < INF}))}
    return [f[0] for f in found], [places.get(f[1], 0) for f in found], [f[2] for f in found]


def _segment(rows: list, n: int, start: int) -> tuple[list, list, list]:
    """Costs and ranks of the ways through a segment of n rows from a role before it, and the steps that lead there."""
    best, rank, back = [INF] * 4, [0] * 4, []
    best[start] = 0
    for _, initial, cut in rows:
        best, rank, how = _step(best, rank, initial, cut)
        back.append(how)
    return [b + DELETE * n for b in best], rank, back


def _path(rows: list, back: list, end: int) -> list[tuple[int, str, int, tuple]]:
    """(place, letter, role, roles inserted before) of the turns that stay."""
    out, role = [], end
    for (place, _, _), how in zip(reversed(rows), reversed(back)):
        if how[role] is not None:
            before, letter = how[role]
            out.append((place, letter, role, GAP[before, role]))
            role = before
    return out[::-1]


def _audit(n: int, path: list, tail: tuple) -> str:
    """Letters of n rows; insertions stand right before what stays, after the deletions, as D comes before I."""
    out, at = [], 0
    for place, letter, _, gap in path:
        out += ["D" * (place - at), "I" * len(gap), letter]
        at = place + 1
    return "".join(out) + "D" * (n - at) + "I" * len(tail)


def _last(cost: list, rank: list) -> int:
    """The role to end with."""
    return min((cost[r] + INSERT * len(CLOSE[r]), rank[r], len(CLOSE[r]), r) for r in range(4) if cost[r] < INF)[3]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list]]:
    """The row that opens each segment (it has no initial), and the segment's candidates (place, initial, truncated)."""
    head, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["initial"] is None:
                if head:
                    yield head, rows
                head, rows = r, []
            else:
                rows.append((r["_at"], r["initial"], r["cut"]))
    if head:
        yield head, rows


def _table(head: dict, rows: list) -> dict:
    """Cost and audit rank of a segment by first and last role, 16 numbers each."""
    n = head["turns"]
    ways = [_segment(rows, n, s) for s in range(4)]
    texts = [_audit(n, _path(rows, back, e), ()) if cost[e] < INF else None for cost, _, back in ways for e in range(4)]
    places = {t: i for i, t in enumerate(sorted({t for t in texts if t is not None}))}
    cost = [None if t is None else ways[k // 4][0][k % 4] for k, t in enumerate(texts)]
    return {"conv_id": head["conv_id"], "_range": head["_range"], "cost": cost, "ranks": [places.get(t) for t in texts]}


def _chain(table: pa.Table) -> pa.Table:
    """First and last role of each segment along one conversation, from its segments' tables."""
    rows = sorted(table.to_pylist(), key=lambda r: r["_range"])
    best, rank, back = [0, INF, INF, INF], [0] * 4, []
    for r in rows:
        found = [(INF, (0, 0), None)] * 4
        for k, c in enumerate(r["cost"]):
            s, e = divmod(k, 4)
            if c is not None and best[s] < INF:
                found[e] = min(found[e], (best[s] + c, (rank[s], r["ranks"][k]), s))
        places = {k: i for i, k in enumerate(sorted({f[1] for f in found if f[0] < INF}))}
        best, rank = [f[0] for f in found], [places.get(f[1], 0) for f in found]
        back.append([f[2] for f in found])
    end, pairs = _last(best, rank), []
    for how in reversed(back):
        pairs.append((how[end], end))
        end = how[end]
    out = [{"conv_id": r["conv_id"], "_range": r["_range"], "start": s, "end": e, "ends": r is rows[-1]} for r, (s, e) in zip(rows, reversed(pairs))]
    return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field("conv_id"), ("_range", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("ends", pa.bool_())]))


def _solve(head: dict, rows: list) -> dict:
    """Cost, audit and edits of a segment with given roles at its ends, or of a whole conversation."""
    n, end = head["turns"], head["end"]
    cost, rank, back = _segment(rows, n, START if end is None else head["start"])
    if end is None:
        end = _last(cost, rank)
    tail = () if head["ends"] is False else CLOSE[end]
    path, edits = _path(rows, back, end), []
    for place, letter, role, gap in path:
        edits += [{"at": place, "nth": k - len(gap), "edit": "I", "role": NAMES[g]} for k, g in enumerate(gap)]
        edits.append({"at": place, "nth": 0, "edit": letter, "role": NAMES[role] if letter == "R" else None})
    edits += [{"at": n, "nth": k, "edit": "I", "role": NAMES[g]} for k, g in enumerate(tail)]
    return {"conv_id": head["conv_id"], "_range": head["_range"], "cost": int(cost[end]) + INSERT * len(tail), "audit": _audit(n, path, tail), "edits": edits}


def _each_segment(df: DataFrame, f, fields: list, ddl: str) -> DataFrame:
    """``f`` of every segment: ``df`` has the candidates, and a row without initial that opens each segment."""

    def run(batches):
        out, schema = [], None

        def typed():
            nonlocal schema
            for b in batches:
                schema = pa.schema([b.schema.field("conv_id"), ("_range", pa.int32()), *fields])
                yield b

        for head, rows in _segments(typed()):
            out.append(f(head, rows))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = df.repartition("_range", "conv_id").sortWithinPartitions("_range", "conv_id", "_at")
    return dealt.mapInArrow(run, f"conv_id {dict(df.dtypes)['conv_id']}, _range int, {ddl}")


EDIT = pa.struct([("at", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("role", pa.string())])


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """Equal conversation, range and so on; the null conversation is one."""
    out = a["conv_id"].eqNullSafe(b["conv_id"]) & (a["_range"] == b["_range"])
    for c in more:
        out = out & (a[c] == b[c])
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations with columns conv_id, turn, role and text.

    Report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation. Turns: (conv_id, _range,
    at, nth, edit, role, text), which is also their order.
    """
    turns = ordered(rows)
    firsts = materialise(candidates(turns), "firsts")
    legal = F.concat("_before", F.substring("role", 1, 1)).isin("su", "ua", "au")
    pair = F.count_if((F.col("_at") > 0) & ~legal).alias("illegal")
    ends = [F.min_by(F.substring("role", 1, 1), "_at").alias("opens"), F.max_by(F.substring("role", 1, 1), "_at").alias("closes")]
    heads = materialise(turns.groupBy("conv_id", "_range").agg(F.count("*").alias("turns"), pair, *ends), "segments")

    # conversations in several ranges: fewer than ranges
    along = Window.partitionBy("conv_id").orderBy("_range")
    several = heads.withColumn("before", F.lag("closes").over(along)).withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    several = materialise(several, "several")
    met = ~F.concat("before", "opens").isin("su", "ua", "au")
    mine = firsts.where("NOT blank").select("conv_id", "_range", "_at", "initial", "cut")
    part = several.select("conv_id", "_range")
    opens = several.select("conv_id", "_range", F.lit(-1).cast("long").alias("_at"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("boolean").alias("cut"), "turns")
    inside = mine.join(part, _same(mine, part), "left_semi").withColumn("turns", F.lit(None).cast("long"))
    tables = _each_segment(opens.unionByName(inside), _table, [("cost", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))], "cost array<bigint>, ranks array<bigint>")
    chains = tables.groupBy("conv_id").applyInArrow(_chain, f"conv_id {dict(rows.dtypes)['conv_id']}, _range int, start int, end int, ends boolean")

    opens = heads.join(chains, _same(heads, chains), "left").select(heads["conv_id"], heads["_range"], F.lit(-1).cast("long").alias("_at"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("boolean").alias("cut"), "turns", "start", "end", "ends")
    empty = {"turns": F.lit(None).cast("long"), "start": F.lit(None).cast("int"), "end": F.lit(None).cast("int"), "ends": F.lit(None).cast("boolean")}
    solved = _each_segment(opens.unionByName(mine.withColumns(empty)), _solve, [("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(EDIT))], "cost bigint, audit string, edits array<struct<at:bigint,nth:int,edit:string,role:string>>")
    solved = materialise(solved, "edits")

    turn = F.col("turn").cast("long")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0))
    n = F.col("n")
    facts = [
        turns.groupBy("conv_id").agg(gaps.alias("gaps")),
        firsts.groupBy("conv_id").agg(F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(n - 1)).alias("duplicate"), F.count_if(~F.col("blank") & F.col("cut")).alias("truncated")),
        heads.groupBy("conv_id").agg(F.sum("illegal").alias("illegal")),
        several.groupBy("conv_id").agg(F.count_if(met).alias("illegal")),
        solved.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("_range", "audit"))).alias("audits")),
    ]
    all_ = facts[0]
    for f in facts[1:]:
        all_ = all_.unionByName(f, allowMissingColumns=True)
    audit = F.array_join(F.transform(F.coalesce(F.first("audits", ignorenulls=True), F.array()), lambda a: a["audit"]), "").alias("audit")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    report = all_.groupBy("conv_id").agg(*sums, audit)

    edits = solved.select("conv_id", "_range", F.explode("edits").alias("e")).select("conv_id", "_range", F.col("e.at").alias("_at"), "e.nth", "e.edit", F.col("e.role").alias("new"))
    put = edits.where("edit = 'I'").select("conv_id", "_range", F.col("_at").alias("at"), "nth", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    stay = edits.where("edit <> 'I'")
    kept = turns.join(stay, _same(turns, stay, "_at")).select(turns["conv_id"], turns["_range"], turns["_at"].alias("at"), "nth", "edit", F.coalesce("new", "role").alias("role"), "text")
    return report, kept.unionByName(put)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as they pass by."""
    conv, state = None, None
    for b in batches:
        convs, hashes = [], []
        for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
            if state is None or c != conv:
                if state is not None:
                    convs.append(conv)
                    hashes.append(state.hexdigest())
                conv, state = c, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        kind = b.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns as ``role:text``, joined by newlines.

    A hash of a whole conversation takes its turns one after another, so they stream through one task, in constant memory.
    """
    lines = repaired.select("conv_id", "_range", "at", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "_range", "at", "nth")
    return dealt.mapInArrow(_hashed, f"conv_id {dict(lines.dtypes)['conv_id']}, repaired_sha256 string")
