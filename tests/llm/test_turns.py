"""Conversation repair against a plain programme over strings."""

import collections
import hashlib
import random
import re

from quire.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
GAPS = {("", "s"): "", ("", "u"): "", ("s", "u"): "", ("a", "u"): "", ("u", "a"): "", ("", "a"): "u", ("s", "a"): "u", ("a", "a"): "u", ("u", "u"): "a"}
NAME = {"u": "user", "a": "assistant"}


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (role, text) in order."""
    seen, ways = set(), {"": (0, "", ())}
    blank = dup = cut_n = 0
    for role, text in rows:
        empty, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not empty and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        blank, dup, cut_n = blank + empty, dup + (again and not empty), cut_n + cut
        seen.add((role, text))
        new = {s: (c + 4, a + "D", ls) for s, (c, a, ls) in ways.items()}
        options = [] if empty or again else [(x, 3, "R", NAME[x]) for x in "ua"] + ([(role[0], 0, "K", role)] if role[:1] in ("s", "u", "a") else [])
        for to, cost, letter, name in options:
            for s, (c, a, ls) in ways.items():
                if (s, to) in GAPS:
                    gap = GAPS[s, to]
                    got = (c + cost + 3 * cut + 3 * len(gap), a + "I" * len(gap) + letter, ls + tuple(f"{NAME[g]}:" for g in gap) + (f"{name}:{text}",))
                    if to not in new or got[:2] < new[to][:2]:
                        new[to] = got
        ways = new
    tails = {"": (), "a": (), "u": ("assistant:",), "s": ("user:", "assistant:")}
    best = min((c + 3 * len(tails[s]), a + "I" * len(tails[s]), ls + tails[s]) for s, (c, a, ls) in ways.items())
    firsts = [r[:1] for r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(firsts, firsts[1:]))
    return blank, dup, cut_n, illegal, *best


def check(spark, rows):
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-1 if t is None else t, " " if r is None else r, " " if x is None else x))
    order = lambda v: (v[0], v[1], v[2][:64].encode(), hashlib.sha256(v[2].encode()).hexdigest())
    report, repaired = turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    hashes = {r.conv_id: r.repaired_sha256 for r in turns.digests(repaired).collect()}
    got = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=order)
        want = brute([v[1:] for v in own])
        assert got[c] == want[:6], (c, own)
        assert hashes.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(want[6]).encode()).hexdigest()
    return {r.conv_id: r.gaps for r in report.collect()}


def test_repair_against_strings(spark):
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "u2"]), rng.choice(["a.", "b", "c!", "", " \t", "d e?\n"]), "x"))
    check(spark, rows)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same.", "", f"{t}!"]), None) for t in range(3000)]
    rows += [(c, t, "user", "x.", None) for c in (1, 9) for t in range(3)]
    gaps = check(spark, rows)
    assert gaps[7] == 0


def test_repair_edges(spark):
    rows = [(None, None, None, None, None), (None, 3, "user", "hi.", "a"), (None, 3, "user", "hi.", "a"), (1, None, "assistant", "yes.", None), (1, None, "assistant", "no.", None),
            (2, 5, "", "no role.", None), (3, 1, "user", "x" * 200_000, None), (3, 9, "assistant", "y" * 100 + "1.", None), (3, 9, "assistant", "y" * 100 + "0.", None), (4, 2, "system", "only.", None)]
    gaps = check(spark, rows)
    assert gaps == {None: 0, 1: 0, 2: 0, 3: 7, 4: 0}
    report, repaired = turns.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == repaired.count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "A. b? c!", None) for c in range(20) for t in range(8)] + [(None, 1, None, None, None), (5, None, "user", "x", None)]
    got = collections.Counter((r.conv_id, r.turn, r.role, r.text) for r in turns.damage(spark.createDataFrame(rows, SCHEMA)).collect())
    want = collections.Counter()
    for c, t, r, x, _ in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if f:
            want[c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x] += 2 if f == 3 else 1
    assert got == want
