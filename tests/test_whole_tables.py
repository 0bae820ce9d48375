"""Queries over whole tables against brute force."""

import re
from collections import Counter, defaultdict
from itertools import combinations
from math import sqrt

import pytest

from stratafolio.operators import joins
from stratafolio.operators.segments import block_cosine
from stratafolio.plans import registry
from stratafolio.session import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect() if r["text"] is not None}


def test_block_cosine_of_all_documents(spark, texts):
    want = {}
    for doc, text in texts.items():
        words = [set(re.findall("[a-z]+", x.lower())) for x in text.split("\n")]
        for gap in range(1, len(words)):
            a, b = set().union(*words[max(gap - 2, 0) : gap]), set().union(*words[gap : gap + 2])
            if a and b:
                want[doc, gap] = len(a & b) / sqrt(len(a) * len(b))
    got = {(r["doc_id"], r["gap"]): r["cosine"] for r in registry.QUERIES["w20_block_cosine"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(d for d, _ in got) >= 400


def test_similar_pairs_of_all_parts(spark):
    brands = defaultdict(list)
    for r in table(spark, SF, "part").select("p_brand", "p_partkey", "p_name", "p_type").collect():
        brands[r["p_brand"]].append((r["p_partkey"], set(re.findall("[a-z]+", f"{r['p_name']} {r['p_type'].lower()}"))))
    pairs = {(x[0], y[0]): 2 * len(x[1] & y[1]) / (len(x[1]) + len(y[1])) for rows in brands.values() for x, y in combinations(sorted(rows, key=lambda v: v[0]), 2)}
    want = {k: v for k, v in pairs.items() if v >= 0.5}
    got = {(r["id"], r["id_b"]): r["dice"] for r in registry.QUERIES["j9_similar_pairs"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(b for _, b in got) > 600


def test_similar_pairs_of_copies_are_all_made_and_none_shuffled(spark, tmp_path, monkeypatch):
    """Copies of one set in several rows of ids, sets with one word in common, and nulls, which are in no pair."""
    monkeypatch.setattr(joins, "PIECE", 3)
    names = [("red bolt", "LARGE"), ("red ring", "LARGE"), ("old tin nut", "SMALL"), ("bolt red", "LARGE"), ("hot", "HOT"), (None, "LARGE"), ("red bolt", None), ("", "")]
    rows = [(len(names) * k + i, brand, name, kind) for k in range(8) for i, (name, kind) in enumerate(names) for brand in (["a", "b", None][(i + k) % 3],)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.QUERIES["j9_similar_pairs"](spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    words = {i: (brand, set(re.findall("[a-z]+", f"{name} {kind.lower()}"))) for i, brand, name, kind in rows if None not in (brand, name, kind)}
    pairs = {(a, b): 2 * len(words[a][1] & words[b][1]) / max(len(words[a][1]) + len(words[b][1]), 1) for a, b in combinations(sorted(words), 2) if words[a][0] == words[b][0]}
    assert len(got) == len({(r["id"], r["id_b"]) for r in got}) == 72
    assert {(r["id"], r["id_b"]): r["dice"] for r in got} == pytest.approx({k: v for k, v in pairs.items() if v >= 0.5}, abs=1e-6)
    assert not [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "id_b" in x]


def test_doubled_letters_of_long_texts(spark, texts):
    letters = {d: [c for c in t.lower() if c.isalpha()] for d, t in texts.items()}
    want = {d: sum(a == b for a, b in zip(t, t[1:], strict=False)) / (len(t) - 1) for d, t in letters.items() if len(t) >= 12}
    got = {r["doc_id"]: r["share"] for r in registry.QUERIES["d17_doubled"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=1e-9) and any(len(texts[d]) >= 3000 for d in got)


def test_repeated_text_of_all_languages(spark, texts):
    keys = {(d, i): re.sub("[0-9]+", "#", x).lower() for d, t in texts.items() for i, x in enumerate(t.split("\n"), 1)}
    counts = Counter((d % 50, k) for (d, _), k in keys.items())
    got = {(r["page"], r["ord"]): r["others"] for r in registry.QUERIES["ag2_repeated_text"](spark, SF).collect()}
    assert got == {(d, i): counts[d % 50, k] - 1 if k else 0 for (d, i), k in keys.items()}


def test_block_cosine_shuffles_no_word(spark):
    """Texts are dealt once by document; lines that are left out leave the gaps that the others reach."""
    rows = [(1, o, t) for o, t in ((1, "a b c"), (2, "b c"), (5, "c d"), (6, ""), (7, "a d"), (15, "a"))] + [(2, 1, None), (2, 2, "a"), (2, 3, "A b"), (3, 1, "a")]
    df = block_cosine(spark.createDataFrame(rows, "doc_id int, ord int, text string"), 3)
    want = {}
    for doc in (1, 2, 3):
        for gap in range(20):
            a, b = (set().union(*[re.findall("[a-z]+", (t or "").lower()) for d, o, t in rows if d == doc and first <= o - gap <= last]) for first, last in ((-2, 0), (1, 3)))
            if a and b:
                want[doc, gap] = len(a & b) / sqrt(len(a) * len(b))
    assert {(r["doc_id"], r["gap"]): r["cosine"] for r in df.collect()} == pytest.approx(want, abs=1e-6)
    dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert dealt and all("hashpartitioning(doc_id#" in x and "word" not in x and "gap" not in x for x in dealt)
