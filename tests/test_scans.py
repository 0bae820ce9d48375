"""Scan scoring and differences of views, case by case."""

from stratafolio.operators import scans as S


def test_scored_headings():
    gold = [{"page": 1, "text": "BÁO CÁO TÌNH HÌNH AN NINH\nQUÝ MỘT NĂM NAY", "label": None}, {"page": 1, "text": "Chương I Quy định chung", "label": "Chương I"}, {"page": 3, "text": "Điều 2. Phạm vi", "label": "Điều 2"}]
    pick = lambda *rows: S.scored_headings(gold, [{"page": p, "text": t} for p, t in rows])
    got = pick((1, "Báo cáo tình hình an ninh"), (2, "CHƯƠNG I quy định chung"), (1, "Chương I"), (3, "Điều 2.  Phạm vi"), (3, "Phạm vi"), (9, "Điều 2. Phạm vi"), (1, "Something else"))
    assert [(e, k, x) for _, e, k, x in got] == [(0, "heading", False), (1, "heading", False), (None, "duplicate", False), (2, "heading", True), (2, "split-part", False), (None, "extra", False), (None, "extra", False)]
    assert S.scored_headings([], [{"page": 1, "text": "x"}]) == [(0, None, "extra", False)] and S.scored_headings(gold, []) == []


def test_view_differences():
    assert S.view_differences("a b c d".split(), "a x c d e".split()) == [("b", "x"), ("", "e")]
    assert S.view_differences([], []) == [] and S.view_differences(["a"], []) == [("a", "")]


def test_queries_by_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c"]), (2, None, ["x"])], "pair_id long, left array<string>, right array<string>")
    assert {tuple(r) for r in S.differing_views(df).collect()} == {(1, "b", "c"), (2, "", "x")}
