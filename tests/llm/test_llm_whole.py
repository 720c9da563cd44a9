"""Training-data operators on rows that an id doesn't tell apart."""

from quire.llm import jaccard


def words(tag, n=80):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_keep_first_with_repeated_and_missing_ids(spark):
    a, b, c, e, f = map(words, "abcef")
    rows = [
        (1, a), (5, f"{a} more"), (5, c), (5, c.upper()),  # of id 5 one row is a copy of id 1, the other a document of its own
        (7, b), (7, e),  # one id, two documents
        (None, f"{b} more"), (None, f), (None, f"{f} more"), (None, f), (None, None), (None, " "), (8, ""), (8, None), (8, words("g")),
    ]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    for n in (1, 3, 7):
        out = jaccard.keep_first(d.repartition(n))
        assert out.columns == d.columns
        got = [(r.doc_id, (r.text or "").strip().lower()) for r in out.collect()]
        rest = [r for r in got if r[0] is not None or not r[1].startswith("f")]
        assert sorted(rest, key=str) == sorted([(1, a), (5, c), (7, b), (7, e), (8, ""), (8, words("g")), (None, "")], key=str)
        assert len(got) == len(rest) + 1


def test_marks_let_every_key_pass(spark):
    from quire.llm.common import marked, marks

    df = spark.createDataFrame([(i,) for i in [None, *range(-500, 5000)]], "`doc.id` long")
    hit, rest = marked(df, "doc.id", marks(spark.range(0, 5000, 7), "id"))
    hit, rest = [r[0] for r in hit.collect()], [r[0] for r in rest.collect()]
    assert set(range(0, 5000, 7)) <= set(hit) and None in rest and len(hit) < 800 and len(hit) + len(rest) == 5501


def test_chains_of_copies_are_not_made(spark):
    from quire.llm import jaccard

    # five classes that may not link by the place of their shingle: a chain, as of a group of over 32 rows, would tie them
    rows = [(7, 0, node, (100 << 32) + 20) for node in range(5)]
    rows = spark.createDataFrame(rows * 9, "shingle long, salt long, node long, place long")
    assert jaccard.candidates(rows).count() == 0


def test_a_write_frees_what_it_shuffled(spark):
    import time

    from quire.session import FREED, materialise

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    out = materialise(spark.range(10_000).repartition(4, "id"), "freed")
    end = time.time() + 10  # they go in the background
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(FREED, None) is None and out.count() == 10_000


def test_repeated_hashes_are_counted_in_place():
    import tracemalloc

    import numpy as np

    for n, values in [(0, 1), (1, 1), (2, 1), (2, 9), (1000, 40), (1000, 5000)]:
        hashes = np.random.default_rng(n + values).integers(-values, values, n)
        keys, times = np.unique(hashes, return_counts=True)
        got = jaccard.repeated(hashes)
        assert [x.tolist() for x in got] == [keys[times > 1].tolist(), times[times > 1].tolist()]
    many = np.random.default_rng(1).integers(0, 1 << 62, 1_000_000)
    tracemalloc.start()
    jaccard.repeated(many)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < many.nbytes  # unique made several copies


def test_kernels_take_some_texts_of_a_batch_at_a_time(spark):
    import pyarrow as pa

    from quire.llm.common import few

    batch = pa.table({"x": list(range(2_500))}).to_batches()[0]
    parts = list(few(iter([batch, batch.slice(0, 0), batch])))
    assert max(p.num_rows for p in parts) <= 1_000 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(2_500)] * 2
    d = spark.range(0, 2_500, 1, 1).selectExpr("id", "concat('a b c d e ', id) AS t")
    seen = jaccard.signatures(d, "id", "t")
    assert seen.where("kind = 0").count() == 2_500 and seen.where("kind = 1").collect()[0]["n"] == 2_500


def test_tables_of_the_driver_start_no_python_on_executors(spark):
    import pyarrow as pa

    from quire.llm import mixing
    from quire.session import rank, small_table

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    by = spark.createDataFrame([("a", 10, 2), (None, 4, 1), ("b", 0, 1)], "source string, source_size long, n long")
    table, small = mixing.source_table(by)
    assert small and "LocalRelation" in plan(table) and "RDD" not in plan(table)
    assert table.dtypes == [("skey", "string"), ("sid", "bigint"), ("source_size", "bigint"), ("target", "double")]
    assert sorted((r.skey, r.sid, r.source_size) for r in table.collect()) == [("", 2, 4), ("=a", 0, 10), ("=b", 1, 0)]
    assert small_table(spark, [], x=pa.int32()).count() == 0
    ranked = rank(spark.range(50).repartition(3), ["id"], "at")
    assert "ExistingRDD" not in plan(ranked) and "LogicalRDD" not in plan(ranked)
    assert [(r.id, r["at"]) for r in ranked.orderBy("id").collect()] == [(i, i) for i in range(50)]


def phrased(spark, texts: int = 400, phrases: int = 200):
    """Texts of words of their own, with two phrases each that some other texts have too; the last two are near copies."""
    import random

    r = random.Random(5)
    out = []
    for i in range(texts):
        words = [f"w{i}x{k}" for k in range(80)]
        for at in (10, 40):
            p = r.randrange(phrases)
            words[at : at + 6] = [f"p{p}q{k}" for k in range(6)]
        out.append((i, " ".join(words)))
    out.append((texts, out[-1][1] + " more"))
    return spark.createDataFrame(out, "doc_id long, text string").repartition(100)


def test_a_common_phrase_makes_no_region(spark, monkeypatch):
    sizes = []
    links_of = jaccard.links_of
    monkeypatch.setattr(jaccard, "links_of", lambda docs, members, *a: sizes.append(members.count()) or links_of(docs, members, *a))
    d = phrased(spark)
    got = {r.doc_id: r.component_id for r in jaccard.join(d).collect()}
    assert got == {i: min(i, 399) for i in range(401)}
    assert sizes == [2]


def test_sets_of_regions_that_fit_are_not_written(spark, monkeypatch):
    written = []
    materialise = jaccard.materialise

    def counted(df, tag):
        out = materialise(df, tag)
        written.extend([out.count()] * (tag == "sets"))
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    monkeypatch.setattr(jaccard, "SHARE", 500)
    base = [f"a{k}" for k in range(100)]
    large = [(i, " ".join([*base[:i], f"b{i}", *base[i + 1 :]])) for i in range(20)]
    small = [(100 + 2 * i + j, " ".join([f"c{i}x{k}" for k in range(100)] + ["more"] * j)) for i in range(30) for j in range(2)]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(large + small, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(20)} | {100 + 2 * i + j: 100 + 2 * i for i in range(30) for j in range(2)}
    assert written == [20]


def test_shingles_met_twice_are_all_marked(spark):
    """Of shingles that two sets have among their first, each has its bit, whatever the number of buckets."""
    import numpy as np

    d = phrased(spark)
    none = np.empty(0, np.int64), np.empty(0, np.uint8)
    sets = [s for s in jaccard.shingle_sets(r.text.encode() for r in d.collect())]
    first = np.concatenate([s[: 2 * (len(s) - (4 * len(s) + 4) // 5 + 1)] for s in sets])
    twice = jaccard.repeated(first.copy())[0]
    assert len(twice) > 50
    for n in (1, 100_000_000):
        bits = np.unpackbits(jaccard.met_twice(d, none, n), bitorder="little")
        assert bits[twice & (len(bits) - 1)].all() and bits.sum() <= len(twice)
