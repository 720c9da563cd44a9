"""Language identification: held-out accuracy, the code's distances and edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import language

SCHEMA = "doc_id long, text string, lang string, id string, held_out int, score string"
SYLLABLES = {"aa": ["ba", "lo", "ti"], "bb": ["kra", "uz", "ti"], "cc": ["öl", "sy", "mm"], "dd": ["пр", "ив", "ет"], "ee": ["xo", "xi", "lo"]}


def texts(n, langs):
    rng = np.random.default_rng(1)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(20)), lang, "clash", 1, None) for i in range(n) for lang in [langs[i % len(langs)]]]


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc"], sorted(SYLLABLES)])
def test_held_out_accuracy(spark, langs):
    df = spark.createDataFrame(texts(300, langs), SCHEMA)
    rows = language.identify(df, language.fit(df)).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == langs[r.doc_id % len(langs)] for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_judged_rows_are_not_used(spark):
    df = spark.createDataFrame(texts(200, ["aa", "cc"]), SCHEMA)
    model = language.fit(df)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = language.fit(df.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))))
    assert other.languages == model.languages and (other.odds == model.odds).all()
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    moved = {r.doc_id - 1: (r.lang_pred, r.score) for r in language.identify(df.select((F.col("doc_id") + 1).alias("doc_id"), "text"), model).collect()}
    assert plain == moved


def test_edges(spark):
    rows = texts(120, ["aa", "dd"])
    rows += [(900, None, "aa", None, None, None), (901, "", "aa", None, None, None), (902, "12 ½ ... _", "aa", None, None, None), (None, "ba" * 300_000, "zz", None, None, None), (903, "ba lo", None, None, None, None)]
    rows += [(904, "é", "aa", None, None, None)] * 3 + [(905, "한국", "dd", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(df)
    assert model.languages == ["aa", "dd"]  # the row without an id teaches nothing
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[None].lang_pred == "aa" and not by[None].held_out and by[903].lang_pred == "aa"
    assert by[905].lang_pred in ("aa", "dd") and 0 < by[905].score <= 1
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 904}) == 1
    empty = language.fit(df.limit(0))
    assert empty.languages == [] and {r.lang_pred for r in language.identify(df, empty).collect()} == {"und"}
    one = language.fit(df.where("lang = 'aa'"))
    assert {(r.lang_pred, r.score) for r in language.identify(df.where("doc_id < 10"), one).collect()} == {("aa", 1.0)}


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(texts(400, ["aa", "bb"]) + texts(1, ["aa"]) * 100, SCHEMA)
    n = {r["lang"]: r["count"] for r in language.sample(df, most=30).groupBy("lang").count().collect()}
    assert n["aa"] <= 30 and 15 <= n["bb"] <= 30


def test_ambiguous(spark):
    df = spark.createDataFrame(texts(200, ["aa", "bb"]), SCHEMA)
    model = language.fit(df)
    got = language.identify(spark.createDataFrame([(1, "ß"), (2, "balo balo loba lolo")], "doc_id long, text string"), model).collect()
    assert [r.ambiguous for r in sorted(got)] == [True, False]


def test_codewords():
    for n in range(2, 40):
        code = language.codewords(n)
        rows, columns = {r.tobytes() for r in code}, {(c * c[0]).tobytes() for c in code.T}
        assert len(rows) == n and len(columns) == code.shape[1] and (np.abs(code.sum(axis=0)) < n).all()
        least = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert least >= (2 ** (n - 2) if n <= language.EXHAUSTIVE else 4 + code.shape[1] // 5)


def test_a_batch_is_judged_a_few_documents_at_a_time():
    import pyarrow as pa

    from quire.llm import language

    b = pa.RecordBatch.from_pydict({"id": list(range(300))})
    parts = list(language._few(iter([b, b.slice(0, 0), b])))
    assert max(p.num_rows for p in parts) <= 128 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(300), *range(300)]
