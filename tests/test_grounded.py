"""The data source of grounded answers: pruned files, failed pages, plugged backends."""

import json

from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, LessThan, LessThanOrEqual

from quire.sources import grounded as G

SCHEMA = "doc_id long, page_index long, width double, height double, answer string"


def answers(spark, n=60):
    rows = [(d, p, 100.0, 200.0, json.dumps([{"bbox": [10, 20, 30, 40], "text": f"t{d}.{p}"}, {"bbox": [1], "text": "x"}, {"bbox": [0, 0, 9, 9], "text": " "}, 7])) for d in range(n) for p in range(2)]
    return spark.createDataFrame(rows + [(5, 9, 100.0, 200.0, None), (6, 9, 100.0, 200.0, "no json")], SCHEMA)


def test_answers_read_back(spark, tmp_path):
    path = str(tmp_path / "answers")
    G.write_answers(answers(spark), path, 6)
    got = G.read_grounded(spark, path).collect()
    assert len(got) == 60 * 2 * 4
    first = {(r.doc_id, r.page_index, r.item): r for r in got}
    assert (first[3, 1, 0].text, first[3, 1, 0].reason) == ("t3.1", None)
    assert [round(first[3, 1, 0][c], 9) for c in ("x0", "y0", "x1", "y1")] == [0.1, 0.1, 0.3, 0.2]
    assert [first[0, 0, i].reason for i in range(4)] == [None, "missing_or_bad_bbox", "empty_content", "not_dict"]


def test_filters_leave_files_out(spark, tmp_path):
    path = str(tmp_path / "answers")
    G.write_answers(answers(spark), path, 6)
    reader = G.GroundedReader(path, 1, G.grounded_items)
    assert len(reader.partitions()) == 6
    for filters, most in (([EqualTo(("doc_id",), 30)], 1), ([GreaterThan(("doc_id",), 55)], 1), ([LessThan(("doc_id",), 0)], 0), ([In(("doc_id",), (1, 59))], 2), ([EqualTo(("page_index",), 0)], 6)):
        assert list(reader.pushFilters(filters)) == filters
        assert sum(len(f.paths) for f in reader.partitions()) <= most
    G.register(spark)
    df = spark.read.format("grounded").option("task_bytes", 1).load(path)
    assert df.rdd.getNumPartitions() == 6
    some = df.where("doc_id >= 20 AND doc_id < 25")
    assert some.rdd.getNumPartitions() <= 2
    assert {r.doc_id for r in some.collect()} == set(range(20, 25))
    assert df.where("doc_id = 1000").count() == 0


def test_bounds():
    assert G.may_hold(None, None, [EqualNullSafe(("doc_id",), None)]) and not G.may_hold(None, None, [EqualTo(("doc_id",), 1)])
    assert G.may_hold(3, 5, [LessThanOrEqual(("doc_id",), 3)]) and not G.may_hold(3, 5, [LessThan(("doc_id",), 3)])
    assert not G.may_hold(3, 5, [EqualTo(("doc_id",), None)])


def test_a_failing_page_is_a_row(spark, tmp_path):
    class Broken(G.GroundedSource):
        @classmethod
        def name(cls):
            return "grounded_broken"

        @staticmethod
        def backend(answer):
            if "t5." in answer:
                raise ValueError("unreadable")
            return [{"bbox": [0, 0, 50, 100], "text": "whole", "label": None, "reason": None}]

    path = str(tmp_path / "answers")
    G.write_answers(answers(spark, 10), path, 2)
    got = G.read_grounded(spark, path, "doc_id < 7", Broken).collect()
    assert [(r.doc_id, r.error, r.item, r.reason) for r in got if r.error] == [(5, "ValueError: unreadable", None, None)] * 2
    assert {(r.text, r.x1) for r in got if not r.error} == {("whole", 0.5)}
    assert len(got) == 7 * 2 + 2


def test_a_plain_folder_has_no_ranges(spark, tmp_path):
    answers(spark, 5).coalesce(2).write.json(str(tmp_path / "plain"))
    assert G.read_grounded(spark, str(tmp_path / "plain"), "doc_id = 3").count() == 8
