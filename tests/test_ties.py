"""Ties, halves and long texts, where the small tables have none."""

import time

import duckdb
from pyspark.sql import functions as F

from stratafolio.operators import decisions
from stratafolio.plans import registry


def orders(spark, folder, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_boundaries_of_a_long_text(spark):
    """Time grows with the text, not with its square."""
    text = "Điều 12. a-b 3c\n" * 500
    kinds = [1 if c.isnumeric() else 2 if c.isalpha() else 0 for c in text]
    want = [0, *(i for i in range(1, len(text)) if kinds[i - 1] != kinds[i] or not kinds[i]), len(text)]
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x"), (5, "."), (6, "😀é1")], "id int, text string")
    began = time.time()
    got = {r["id"]: r["places"] for r in df.select("id", decisions.boundaries(F.col("text")).alias("places")).collect()}
    assert got == {1: want, 2: [0], 3: [0], 4: [0, 1], 5: [0, 1], 6: [0, 1, 2, 3]} and time.time() - began < 20


def test_entity_ends_at_halves_round_to_even(spark, tmp_path):
    spark.createDataFrame([(30, 1, "click", 30.5), (20, 1, "click", 40.25), (31, 1, "click", 29.5)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r["event_id"]: r["reason"] for r in registry.QUERIES["fv11_entities"](spark, str(tmp_path)).collect()} == {30: None, 20: None, 31: None}


def test_of_equal_prices_the_first_order_is_taken(spark, tmp_path):
    rows = [(3, 1, 5.0), (1, 1, 5.0), (2, 1, 5.0), (4, 2, None), (5, 2, 7.0), (6, 2, 7.0), (7, 3, None)]
    got = registry.QUERIES["st5_arg_max"](spark, orders(spark, tmp_path, sorted(rows))).collect()
    assert {r["o_custkey"]: (r["best"], r["worst"]) for r in got} == {1: (1, 1), 2: (5, 5), 3: (None, None)}


def test_segments_at_one_place_go_by_id(spark, tmp_path):
    got = registry.QUERIES["w7_segment_gaps"](spark, orders(spark, tmp_path, [(i, 1, 5.0) for i in (9, 4, 7, 1, 8)] + [(2, 1, 1.0)])).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["segment"])] == [2, 1, 4, 7, 8, 9]


def test_segments_without_a_place_and_gaps_at_halves_as_the_sql_says(spark, tmp_path):
    inf = float("inf")
    prices = [[5.0, None, 7.0, 40.5, inf, -inf], [0.0, 10.285, 20.57, 30.575, -3.0], [5.0, 15.0, 24.999, 34.9985, 1e17, 1e307], [None], [9.0], [None, 2.0, 1.0], [100.1, 110.1, 120.1]]
    folder = orders(spark, tmp_path, [(10 * k + i, k, x) for k, row in enumerate(prices) for i, x in enumerate(row)])
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = duck.sql(registry.ORACLES["w7_segment_gaps"]).fetchall()
    got = registry.QUERIES["w7_segment_gaps"](spark, folder).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
