"""Phrase mining against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from quire.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, words string, shard int"


def brute(rows, least, longest):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def brute_scores(f, n):
    out = {}
    for (lang, p), a in f.items():
        inside = any(g == lang and v >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), v in f.items() if len(q) > len(p))
        if len(p) > 1 and not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "Éa", "éa", "x-y", "zz", "q\x00r", " ", "ü" * 70]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary[: rng.randrange(2, 11)]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\x0c", " ;", "?", "!", ":"]) for _ in range(rng.randrange(0, 60))]
        rows.append((i % 100, "".join(words), rng.choice(["en", "en", "de", None, "und"]), "clash", 3))
    rows += [(1, None, "en", None, None), (2, "", "de", None, None), (3, "...!!", "fr", None, None), (4, "same words again " * 500, "en", None, None)] + [(5, "a b c d e f g", "rare", None, None)] * 6
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    f, n = brute([(r[1], r[2]) for r in rows], 5, 5)
    found, totals = phrases.mine(df, least=5, positions=700)
    assert {(r.lang, tuple(r.words)): r.f for r in found.collect()} == f
    assert {r.lang: r.n for r in totals.collect() if r.n} == +n
    scored = phrases.score(found, totals)
    want = brute_scores(f, n)
    assert {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in scored.collect()} == want
    ranked = collections.defaultdict(dict)
    for r in phrases.top(scored, 10).collect():
        ranked[r.lang][r["rank"]] = r.phrase
    for lang in {k[0] for k in want}:
        order = sorted(((-v[4], -v[0], p.encode()), p) for (g, p), v in want.items() if g == lang)[:10]
        assert [ranked[lang][i + 1] for i in range(len(ranked[lang]))] == [p for _, p in order]


def test_empty(spark):
    found, totals = phrases.mine(spark.createDataFrame([], SCHEMA), least=1)
    assert found.count() == totals.count() == 0


def test_bitmaps():
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 5, 1000)
    maps = phrases.Bitmaps(ids)
    assert all(maps.popcounts(5) == [(ids == k).sum() for k in range(5)])
    moved = maps.shifted()
    assert all(moved.popcounts(5) == maps.popcounts(5))
    for k in range(5):
        bits = {int(c % moved.blocks) * 64 + i for c, x in zip(moved.code, moved.bits) if c // moved.blocks == k for i in range(64) if int(x) >> i & 1}
        assert bits == {int(i) + 1 for i in np.flatnonzero(ids == k)}
    p, w, n = phrases.extensions(ids, ids)
    want = collections.Counter((a, b) for a, b in zip(ids, ids[1:]) if a >= 0 and b >= 0)
    assert dict(zip(zip(p, w), n)) == want
    for a in (ids, np.empty(0, np.int64), np.array([-1])):
        assert (phrases._unpack(phrases._pack(a)) == a).all()


def test_exact_products(spark):
    """Products of over 64 bits."""
    big = 3_000_000_000_007
    rows = [("en", ["a"], big), ("en", ["b"], big - 2), ("en", ["a", "b"], big - 5)]
    found = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    total = 2_000_000_000_000_011
    got = phrases.score(found, spark.createDataFrame([("en", total)], "lang string, n long")).first()
    assert got.score == 1000 * (big - 5) * total // (big * (big - 2))
