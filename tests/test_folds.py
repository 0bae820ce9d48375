"""Folds and packings against plain loops over the same rows."""

import random
from collections import defaultdict

import pytest

from stratafolio.operators import geometry, outline, segments, units


@pytest.fixture(scope="module")
def numbered(spark):
    rng = random.Random(31)
    rows = [(d, i, rng.randint(0, 40), rng.choice([None, 1, 2, 3, 25, 22, 20])) for d in range(12) for i in range(rng.randint(1, 70))]
    return rows, spark.createDataFrame(rows, "doc int, ord int, size int, rank int")


def by_doc(rows):
    out = defaultdict(list)
    for r in sorted(rows):
        out[r[0]].append(r)
    return out


def test_capped_windows(numbered):
    rows, df = numbered
    got = {(r["doc"], r["ord"]): r["window"] for r in segments.capped_windows(df, ["doc"], "ord", "size", most=7, most_size=100).collect()}
    for doc, own in by_doc(rows).items():
        window, held = 0, []
        for _, i, size, _ in own:
            if held and (len(held) == 7 or sum(held) + size > 100):
                window, held = window + 1, []
            held.append(size)
            assert got[doc, i] == window


def test_levels_of_any_ranks(spark, numbered):
    rows, df = numbered
    got = {(r["doc"], r["ord"]): r["level"] for r in outline.levels_of_ranks(df, ["doc"], "ord", "rank").collect()}
    for doc, own in by_doc(rows).items():
        level, era = {}, 0
        for n, (_, i, _, rank) in enumerate(own):
            era = n if rank is None else era
            above = [k for k in range(era, n) if rank is not None and (own[k][3] if own[k][3] is not None else -1) < rank and (own[era][3] is None or k >= era)]
            level[n] = min(9, level[max(above)] + 1 if above else 1)
            assert got[doc, i] == level[n], (doc, i)
    four = outline.levels_of_ranks(spark.createDataFrame([(1, i, r) for i, r in enumerate((20, 21, 22, 21))], "doc int, ord int, rank int"), ["doc"], "ord", "rank")
    assert [r["level"] for r in four.orderBy("ord").collect()] == [1, 2, 3, 2]


def test_depths(spark):
    rng = random.Random(8)
    rows = [(d, g, rng.choice([0.1, 0.2, 0.3, 0.5])) for d in range(6) for g in range(20)]
    got = {(r["doc"], r["gap"]): r["depth"] for r in segments.depths(spark.createDataFrame(rows, "doc int, gap int, c double"), ["doc"], "gap", "c").collect()}
    for d in range(6):
        c = [x for k, _, x in rows if k == d]
        for g in range(20):
            a = b = g
            while a and c[a - 1] >= c[a]:
                a -= 1
            while b < 19 and c[b + 1] >= c[b]:
                b += 1
            assert abs(got[d, g] - (c[a] + c[b] - 2 * c[g])) < 1e-6


def test_depths_deal_nothing_anew(spark):
    """Peaks come from the windows that the cosines' shuffle has dealt, without Python."""
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(("a b", "a", "a c", "d", "d e"), 1)], "doc_id int, ord int, text string")
    plan = segments.depths(segments.block_cosine(lines), ["doc_id"], "gap", "cosine")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" not in plan


def test_page_windows(numbered):
    rows, df = numbered
    lines = df.selectExpr("doc", "ord", "ord div 40 AS page", "ord div 9 AS block")
    got = {(r["doc"], r["ord"]): (r["page"], r["window"]) for r in units.page_windows(lines, ["doc"], "page", "block", "ord", 12).collect()}
    for doc, own in by_doc(rows).items():
        pages = defaultdict(list)
        for _, i, *_ in own:
            pages[i // 40].append(i)
        for page, ords in pages.items():
            window, used, block, size = 0, 0, None, defaultdict(int)
            for i in ords:
                size[i // 9] += 1
            for i in ords:
                if len(ords) > 12 and i // 9 != block:
                    block = i // 9
                    window, used = (window, used + size[block]) if used + size[block] <= 12 else (window + 1, size[block])
                assert got[doc, i] == (page, window)


def test_matched_boxes(spark):
    rng = random.Random(4)
    box = lambda: (x := rng.randint(0, 60), y := rng.randint(0, 30), x + rng.randint(10, 30), y + rng.randint(5, 12))
    left, right = ([(p, i, tuple(map(float, box()))) for p in range(5) for i in range(25)] for _ in range(2))
    schema = "page int, id int, box struct<left:double,top:double,right:double,bottom:double>"
    got = {(r["page"], r["left_id"]): r["right_id"] for r in geometry.matched_boxes(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["page"], "id", "box", 0.3).collect()}

    def share(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    want = {}
    for page in range(5):
        taken = set()
        for _, i, a in (x for x in left if x[0] == page):
            best = max(((share(a, b), -j) for _, j, b in (x for x in right if x[0] == page) if j not in taken and share(a, b) >= 0.3), default=None)
            if best:
                want[page, i] = -best[1]
                taken.add(-best[1])
    assert got == want and len(want) > 20


def test_visual_lines(spark):
    glyphs = [(1, 0, 10.0, 0.0, 10.0, 10.0), (1, 1, 10.5, 2.0, 11.0, 8.0), (1, 2, 30.0, 22.0, 31.0, 9.0), (1, 3, 33.0, 24.0, 34.0, 20.0), (1, 4, 41.0, 35.0, 41.0, 5.0), (2, 0, 5.0, 0.0, 5.0, 4.0)]
    df = spark.createDataFrame(glyphs, "page int, id int, baseline double, top double, bottom double, scale double")
    got = {(r["page"], r["id"]): r["line"] for r in geometry.visual_lines(df, ["page"], "id", baseline="baseline", top="top", bottom="bottom", scale="scale").collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 2, (2, 0): 1}


def test_inherited_follows_long_chains_and_tells_cycles(spark):
    from stratafolio.operators.merge import inherited, list_labels

    rows = [(1, i, i - 1 if i else None, "root" if i == 0 else None) for i in range(400)] + [(2, 0, 1, None), (2, 1, 0, None)]
    got = inherited(spark.createDataFrame(rows, "doc int, node int, up int, v string"), ["doc"], "node", "up", "v").collect()
    assert {(r["effective"], r["cycle"]) for r in got if r["doc"] == 1} == {("root", False)} and {(r["effective"], r["cycle"]) for r in got if r["doc"] == 2} == {(None, True)}
    deep = list_labels(spark.createDataFrame([(1, i, i) for i in range(1, 10)], "l int, ord int, level int"), ["l"], "ord", "level").orderBy("ord").collect()
    assert deep[-1]["label"] == "1.1.1.1.1.1.1.1.1"
