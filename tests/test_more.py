"""Operators without SQL of their own, and joins of heavy keys, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from quire.functions import trust
from quire.operators import glossary, jobs, kernels, paged
from quire.session import clean_up, materialise, rank
from quire.sources import glossaries


def test_platt_over_a_table_equals_the_plain_fit(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), float(rng.random() < 0.6)) for _ in range(300)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "raw double, target double")
    want = kernels.fit_platt([r for r, _ in rows if r is not None], [t for r, t in rows if r is not None])
    got = trust.fit_platt(df, "raw", "target")
    assert max(abs(g - w) for g, w in zip(got, want)) < 1e-6
    assert trust.fit_platt(df.limit(0), "raw", "target") == (1.0, 0.0)


def test_rank_goes_over_all_partitions(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, i long").repartition(5)
    got = [(r.k, r.i) for r in sorted(rank(df, [F.desc("k"), F.col("i")], "n").collect(), key=lambda r: r.n)]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 100
    assert sorted(r.n for r in rank(df, ["i"], "n").collect()) == list(range(100))
    assert rank(df.limit(0), ["i"], "n").count() == 0


def test_scripts_by_range_and_by_name(spark):
    texts = ["abc дд", "ﾊﾝｶｸ", "漢字かな", "", None, "123", "ab дд", "ﬁx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(paged.script(F.col("t")).alias("s")).select("s.*").collect()]
    assert got == [kernels.dominant_script(t) for t in texts]


def test_git_glossary_of_a_checkout(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "GLOSSARY.md").write_text("# terms\nhaus = house\nbaum = tree\n")
    run("add", "-A")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")
    got = {(r.source, r.target) for r in glossaries.read_git(spark, str(tmp_path)).collect()}
    assert got == {("haus", "house"), ("baum", "tree")}
    for bad in ({"ref": "-x"}, {"path": "../a"}, {"ref": "nothing"}):
        try:
            glossaries.read_git(spark, str(tmp_path), **bad).collect()
        except ValueError:
            continue
        raise AssertionError(bad)


def test_hot_rate_window_equals_the_plain_one(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaab"), rng.randrange(600)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, client string, s long").withColumn("ts", F.timestamp_seconds("s"))
    plain = {r.id: (r.in_window, r.limited) for r in jobs.rate_window(df, "client", "ts", 5).collect()}
    assert {r.id: (r.in_window, r.limited) for r in jobs.hot_rate_window(df, "client", "ts", 5).collect()} == plain


def test_glossaries_as_one_expression_or_by_terms(spark, monkeypatch):
    df = spark.createDataFrame([("The cat, the dog.",), (None,)], "text string")
    terms = spark.createDataFrame([("the", "A", False), ("dog", "$1", True)], "source string, target string, case_sensitive boolean")
    some = terms.where("target <> '$1'")
    folded = [r.text for r in paged.apply_glossary(df, some).collect()]
    monkeypatch.setattr(paged, "FOLDED", 0)
    assert folded == [r.text for r in paged.apply_glossary(df, some).collect()] == ["A cat, A dog.", None]


def test_store_names_are_checked_and_folders_removed(spark, tmp_path):
    store = glossary.ParquetLexicon(spark, str(tmp_path))
    e = spark.createDataFrame([(0, "a", "b")], "pos long, source string, target string")
    store.save_glossary(e, "g", " G ")
    try:
        store.save_glossary(e, "g", "again")
    except ValueError:
        pass
    assert store.delete_glossary("g") and not store.delete_glossary("g")
    assert store.health().first()["rows"] == 0


def test_stores_on_one_path_see_each_other(spark, tmp_path):
    """What was deleted stays away under its id, reopened stores go on, and of two writers none is lost."""
    e = lambda *s: spark.createDataFrame([(i, x, x.upper()) for i, x in enumerate(s)], "pos long, source string, target string")
    one = glossary.ParquetLexicon(spark, str(tmp_path))
    assert one.list_glossaries().count() == 0 and one.version == 0
    one.save_glossary(e("old"), "g", "G")
    one.delete_glossary("g")
    two = glossary.ParquetLexicon(spark, str(tmp_path))
    assert two.version == 2
    two.save_glossary(e("new"), "g", "G")
    assert [r.source for r in one.list_entries("g").collect()] == ["new"]

    change, calls = one._change, []

    def late(f):
        """Another writer comes between reading a version and making the next."""

        def with_other(meta):
            if not calls:
                calls.append(1)
                two.save_glossary(e("other"), "h", "H")
            return f(meta)

        change(with_other)

    one._change = late
    one.toggle_glossary("g", False)
    got = {r.id: (r.enabled, r.entry_count) for r in glossary.ParquetLexicon(spark, str(tmp_path)).list_glossaries().collect()}
    assert got == {"g": (False, 1), "h": (True, 1)}


def test_ids_that_hold_most_rows_are_ranked_in_ranges(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None, f"x{i}"]), i) for i in range(3000)]
    rng.shuffle(rows)
    got = glossary.suffix_ids(spark.createDataFrame(rows, "id string, pos long").repartition(5)).collect()
    seen, want = {}, {}
    for i, p in sorted(rows, key=lambda r: r[1]):
        k = seen[i] = seen.get(i, -1) + 1
        want[p] = None if i is None else f"{i}_{k}" if k else i
    assert {r.pos: r.unique_id for r in got} == want



def test_clean_up_removes_the_sessions_tables(spark):
    df = materialise(spark.range(3), "x")
    assert df.count() == 3 and clean_up(spark)


def test_alignment_costs_least_of_all_monotone_pairings():
    rng = random.Random(3)

    def cheapest(lines, room, i, j):
        if i == len(lines) and j == len(room):
            return 0.0
        tries = []
        if i < len(lines) and j < len(room):
            tries.append(kernels.match_cost(len(lines[i]), room[j]) + cheapest(lines, room, i + 1, j + 1))
        if i < len(lines):
            tries.append(kernels.SKIP_LINE + cheapest(lines, room, i + 1, j))
        if j < len(room):
            tries.append(kernels.SKIP_BOX + cheapest(lines, room, i, j + 1))
        return min(tries)

    for _ in range(60):
        lines = ["x" * rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))]
        boxes = [(0.0, 0.0, rng.random(), rng.random()) for _ in range(rng.randrange(1, 6))]
        area = [max(1e-6, b[2] * b[3]) for b in boxes]
        room = [a * sum(map(len, lines)) / sum(area) for a in area]
        cost, texts, _ = kernels.align_lines(lines, boxes)
        assert abs(cost - cheapest(lines, room, 0, 0)) < 1e-7
        assert sorted(t for ts in texts.values() for t in ts) == sorted(lines)


def test_alignment_of_many_pages_is_that_of_each(monkeypatch):
    """Pages of unlike sizes fill their tables together, in one batch or several."""
    rng = random.Random(4)
    pages = []
    for _ in range(80):
        lines = ["x" * rng.randrange(0, 40) for _ in range(rng.randrange(0, 30))]
        pages.append((lines, [(0.0, 0.0, rng.random(), rng.random()) for _ in range(rng.choice([0, 1, 2, 5, 25]))]))

    def plain(lines, boxes):
        """The table cell by cell."""
        if not lines or not boxes:
            return 0.0, {}, 0
        whole = lambda x: round(kernels.UNIT * x)
        area = [max(1e-6, b[2] * b[3]) for b in boxes]
        room = [a * (max(1, sum(map(len, lines))) / math.fsum(area)) for a in area]
        table = {(0, 0): (0, ())}
        for i in range(len(lines) + 1):
            for j in range(len(boxes) + 1):
                tries = []
                if i and j:
                    c, way = table[i - 1, j - 1]
                    tries.append((c + whole(kernels.match_cost(len(lines[i - 1]), room[j - 1])), (*way, (i - 1, j - 1))))
                if i:
                    c, way = table[i - 1, j]
                    tries.append((c + whole(kernels.SKIP_LINE), (*way, (i - 1, None))))
                if j:
                    c, way = table[i, j - 1]
                    tries.append((c + whole(kernels.SKIP_BOX), way))
                if tries:
                    table[i, j] = min(tries, key=lambda t: t[0])
        cost, way = table[len(lines), len(boxes)]
        texts, last = {}, 0
        for i, j in way:
            last = last if j is None else j
            texts.setdefault(last, []).append(lines[i])
        return cost / kernels.UNIT, texts, sum(j is not None for _, j in way)

    want = [plain(*p) for p in pages]
    for cells in (1, 4000, 1 << 22):
        monkeypatch.setattr(kernels, "CELLS", cells)
        assert kernels.align_many(pages) == want


def test_spelling_by_a_joined_index_equals_the_speller(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    known = {word() for _ in range(400)}
    texts = [" ".join(rng.choice([str.lower, str.upper, str.capitalize])(word()) + rng.choice(["", ",", "1", "_x", "²"]) for _ in range(30)) for _ in range(60)] + [None, "", "123"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "i int, text string, word string").repartition(3)
    words = spark.createDataFrame([(w,) for w in sorted(known)] * 2 + [(None,)], "word string")
    speller = kernels.Speller(known)
    want = sorted((i, None if t is None else speller.correct(t)) for i, t in [*enumerate(texts), (0, texts[0])] if t is not None)
    for sent in (paged.SENT, 0):
        monkeypatch.setattr(paged, "SENT", sent)
        out = paged.spell(df, words)
        assert out.columns == df.columns
        got = [(r.i, r.text) for r in out.collect()]
        assert sorted(g for g in got if g[1] is not None) == want and len(got) == len(texts) + 1
    assert any(g != t for (_, g), t in zip(want, [texts[0]]))
