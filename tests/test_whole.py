"""Queries and operators that take all rows, against brute force."""

import random
from difflib import SequenceMatcher

import pytest

from quire.operators import glossary, kernels
from quire.plans import catalog

TEXTS = ["naïve café", "plain ascii", "日本語のテキスト", "", None, "plain ascii", "Ünï"]


def tables(spark, path, texts, items):
    """A folder of documents and test items; ids of items have gaps."""
    spark.createDataFrame(list(enumerate(texts)) + [(None, "no id é")], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7 + 50 * i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    want = [(i, t, i % len(items)) for i, t in enumerate(texts)] + [(None, "no id é", 0)]
    return [(i, 7 + 50 * k, t, items[k]) for i, t, k in want]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_of_all_documents(spark, tmp_path):
    rows = tables(spark, tmp_path, [*TEXTS, "é" * 1500], ["naive cafe", "日本のテキスト", "é" * 1030])
    want = {}
    for i, item, a, b in rows:
        a, b = a and a[:1024], b[:1024]
        want[i, item] = None if a is None else edits(a, b) / max(len(a), len(b))
    got = {(r.doc_id, r.item_id): r.distance for r in catalog.QUERIES["norm_levenshtein_all"](spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_ratio_equals_difflib(seed):
    rng = random.Random(seed)
    for _ in range(40):
        letters = rng.choice(["ab", "abc é", "abcdefghijklmnop ", "abcdefgh日本語 .,;:"])
        make = lambda n: "".join(rng.choices(letters, [rng.random() ** 4 + 0.001 for _ in letters], k=rng.randrange(n)))
        a, b = make(rng.choice([8, 60, 700])), make(rng.choice([8, 60, 260, 500]))
        if rng.random() < 0.4 and a:
            at = rng.randrange(len(a))
            b = b[: len(b) // 2] + a[at : at + 80] + b[len(b) // 2 :]
        assert kernels.ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_similarity_of_whole_documents(spark, tmp_path):
    item = "the passage that stands at the end of a long text"
    rows = tables(spark, tmp_path, [*TEXTS, "x y " * 200 + item, "x y " * 200 + item], [item, "naïve café", "日本語"])
    got = {(r.doc_id, r.item_id): r.ratio for r in catalog.QUERIES["similarity"](spark, str(tmp_path)).collect()}
    clean = lambda t: " ".join(t.lower().split())
    assert got == {(i, k): None if a is None else SequenceMatcher(None, clean(a), clean(b)).ratio() for i, k, a, b in rows}


def test_nearest_of_any_number_of_queries(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], f"l{i % 3}") for i in range(60)]
    t = spark.createDataFrame(rows, "term_id long, vector array<double>, lang string")
    q = spark.createDataFrame([(i, v, None if i % 7 == 0 else g) for i, v, g in rows[:25]], "query_id long, qvec array<double>, lang string")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = set()
    for i, v, g in rows[:25]:
        near = sorted((-cos(v, w), k) for k, w, h in rows if i % 7 == 0 or g == h)[:3]
        want |= {(i, k, r) for r, (_, k) in enumerate(near, 1)}
    for most in (4, 100):
        got = [(r.query_id, r.term_id, r["rank"]) for r in glossary.nearest(t, q, max_queries=most).collect()]
        assert set(got) == want and len(got) == len(want)


def test_upper_case_keeps_the_length(spark, con):
    from pyspark.sql import functions as F

    from quire.functions.text import upper

    want = con.execute("SELECT i, upper('x' || chr(i::INT) || 'ßy') FROM range(1, 65536) t(i) WHERE i NOT BETWEEN 55296 AND 57343").fetchall()
    rows = spark.range(1, 65536).where("id NOT BETWEEN 55296 AND 57343")
    c = F.concat(F.lit("x"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("ßy"))
    new = {0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB}  # their capitals came with Unicode 16, which DuckDB's tables are older than
    got = sorted(tuple(r) for r in rows.select("id", upper(c)).collect() if r.id not in new)
    assert got == sorted(w for w in want if w[0] not in new)


def test_blocks_of_german_capitals(spark):
    from quire.operators import blocks as B

    d = spark.createDataFrame([(2, "maß und stoß", "en", "s", 12)], "doc_id long, text string, lang string, source string, n_chars long")
    row = B.blocks_view(d).first()
    assert row.text == "MAẞ UND STOẞ" and row.x0 == 0.05 + 0.001 * (12 % 5)


def test_glossaries_of_over_a_million_entries(spark, tmp_path):
    from quire.sources import glossaries as S

    pairs = spark.range(1_000_001).selectExpr("'a' || id AS source", "'b' AS target")
    pairs.coalesce(1).write.option("header", True).csv(str(tmp_path / "big"))
    for format in ("csv", "delimited"):  # noqa: A001
        assert S.read(spark, format, str(tmp_path / "big")).count() == 1_000_001
    assert S.read_table(pairs, "source", "target").count() == 1_000_001
    with pytest.raises(ValueError):
        S.read(spark, "csv", str(tmp_path / "big"), max_entries=1_000_000)


def test_chunks_of_a_batch_leave_in_parts():
    import pyarrow as pa

    from quire.operators import paged

    class Docs:  # stands for a frame: what its batches become
        def select(self, *_):
            return self

        def mapInArrow(self, run, kind):  # noqa: N802
            batch = pa.record_batch({"doc_id": list(range(1_000)), "text": [f"a{i}. " * 9 for i in range(999)] + [None]})
            return list(run(iter([batch])))

    parts = paged.chunk_documents(Docs(), 20)
    assert len(parts) == 4 and [i for p in parts for i in sorted(set(p["doc_id"].to_pylist()))][:999] == list(range(999))


def test_blocks_of_documents_without_a_language(spark):
    from quire.operators import blocks as B

    d = spark.createDataFrame([(5, "a\nb\nc\nd\ne\nf", None, "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    row = B.blocks_view(d).where("block_index = 5").first()
    assert row.text is None and row.x0 is None and row.y1 == 1.0


def test_distance_beyond_a_share_as_by_the_distance_itself(spark):
    import random

    from pyspark.sql import functions as F

    from quire.functions import trust

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abß😀 ") for _ in range(n))
    pairs = [(None, "a"), ("a", None), ("", ""), ("", "a"), ("a", ""), ("x" * 1024 + "a", "x" * 1024 + "b")]
    for n in [*range(1, 40), 64, 65, 130, 1300]:
        a = word(n)
        pairs += [(a, a[::-1]), (a, a), (a, word(n)), (a, "".join(c for c in a if r.random() < 0.7) + "b"), (a[: n // 3], a)]
    d = spark.createDataFrame(pairs, "a string, b string")
    for share in (0.0, 0.25, 0.4, 0.6):
        rows = d.select("a", "b", trust.beyond(F.col("a"), F.col("b"), share).alias("got"), (trust.normalised_distance(F.col("a"), F.col("b")) > share).alias("want"))
        assert not [r for r in rows.collect() if r.got != r.want]


def test_repeats_as_by_counting(spark):
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from quire.functions import trust

    r = random.Random(4)
    texts = [None, "", "a" * 17, "a" * 18, "😀" * 18] + ["".join(r.choice("ab😀"[: 2 + i % 2]) for _ in range(i)) for i in range(12, 150)] + [t * 3 for t in ("abcdef", "abcde", "äöüßéè")]
    texts += ["".join(map(chr, range(0x100, 0x100 + 300_000))).replace("\ud800", ""), "".join(f"{i:06d}" for i in range(60_000))]
    texts = [t and "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for i, t, got in d.select("i", "t", trust.repeats(F.col("t"))).collect():
        assert got == (t is not None and len(t) >= 18 and max(Counter(t[k : k + 6] for k in range(len(t) - 5)).values()) >= 3), i


def test_contracts_see_changed_and_doubled_rows(spark):
    from quire.operators import blocks as B

    rows = [(1, 0, i, 0.0, 0.0, 1.0, 1.0, t) for i, t in enumerate([None, "", "a", "x" * 32, "x" * 33, "ß" * 40])]
    b = spark.createDataFrame(rows, "doc_id long, page_index long, block_index long, x0 double, y0 double, x1 double, y1 double, text string")
    assert B.keeps(b, b, "annotate_only") and B.keeps(b, b.orderBy(b.block_index.desc()), "may_reorder")
    for i in range(len(rows)):
        other = [(*r[:7], "y" * 33 if r[2] == i else r[7]) for r in rows]
        assert not B.keeps(b, spark.createDataFrame(other, b.schema), "annotate_only")
        assert not B.keeps(b, b.union(b.where(b.block_index == i)), "may_reorder")
    seen = []
    plain = B.DataFrame.exceptAll
    B.DataFrame.exceptAll = lambda *a: seen.append(a)
    try:
        assert B.keeps(b, b, "annotate_only") and not seen  # rows meet once, not once each way
    finally:
        B.DataFrame.exceptAll = plain


def test_cross_check_compares_whole_texts(spark, tmp_path):
    """Readings that agree in their first 1,024 characters only, and ones that differ there only (F3 of round 4)."""
    import duckdb
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from compare import plain, rows_of
    from quire.functions import trust

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghij klm") for _ in range(n))
    head, long = word(1024), word(3000)
    pairs = [(head + "a" * 2000, head + "b" * 2000, 2), ("a" * 1024 + long, "b" * 1024 + long, 0), (long, long + "x" * 1900, 0), (long, long + "x" * 2100, 2)]
    d = spark.createDataFrame(pairs, "a string, b string, want int")
    level = trust.cross_checked(F.lit(0), F.col("a"), F.col("b"), F.lit(None).cast("string"))
    assert all(x.got == x.want for x in d.select("want", level.alias("got")).collect())

    # turned round, the first line begins as before and the second doesn't, though most of it stays
    lines = [head + word(4000) + head[::-1], "q" * 1100 + long + long[::-1] + "z" * 1100, word(2500)]
    rows = [(2 * i + 1, "\n".join(["short", "two", x, "four"]), "de", "web", len(x) + 15) for i, x in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    names, got = rows_of(entry.queries()["cross_checked_level"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.execute(entry.oracle_sql()["cross_checked_level"])
    cols = [x[0] for x in rel.description]
    order = [cols.index(c) for c in sorted(cols)]
    assert names == sorted(cols) and got == sorted(tuple(plain(x[i]) for i in order) for x in rel.fetchall())
    assert len(got) == 12
