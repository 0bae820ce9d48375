"""The steps of binding a quote, and the bounded search for edits against all windows."""

import random
import time

import duckdb

from stratafolio.operators import binding as B
from stratafolio.plans import registry

UNITS = {1: "Thanh toán trong 30 ngày kể từ ngày ký.", 2: "Bên A giao hàng cho Bên B.", 3: "Bên B nhận hàng.", 4: "Phạt chậm giao là 8 % giá trị."}


def test_steps():
    at = lambda *x: B.bind(*x, path="CHƯƠNG I > Điều 2. Giao hàng", labels=["Số lượng:"])
    assert at("30 ngày", "value", 1, UNITS) == (1, 17, 24, "EXACT")
    assert at("ngày", "value", 1, UNITS)[3] == "AMBIGUOUS"
    assert at("điều 2 . giao hàng", "label", 2, UNITS)[3] == "CONTEXT" and at("số lượng", "label", 2, UNITS)[3] == "CONTEXT"
    assert at("nhận hàng", "value", 2, UNITS) == (3, 6, 15, "NEIGHBOUR")
    assert at("BÊN A GIAO", "value", 2, UNITS) == (2, 0, 10, "CASE")
    assert at("Phạt chậm gaio", "value", 4, UNITS)[3] == "MISSING" and at("Phạt chậm gio là", "value", 4, UNITS) == (4, 0, 17, "EDITED")
    assert at(" ", "value", 1, UNITS)[3] == "EMPTY" and at("x", "value", 9, UNITS)[3] == "UNKNOWN_UNIT" and at("không có", "value", 1, UNITS)[3] == "MISSING"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def closest(text: str, quote: str):
    m = len(quote)
    k = min(6, max(1, m // 30))
    windows = [(distance(text[s : s + n], quote), s, s + n) for s in range(len(text)) for n in range(max(1, m - k), m + k + 1) if s + n <= len(text)]
    best = min((d for d, _, _ in windows), default=k + 1)
    found = [(a, b) for d, a, b in windows if d == best]
    if best > k or any(a >= found[0][1] or b <= found[0][0] for a, b in found):
        return None
    return min(found, key=lambda x: abs(x[1] - x[0] - m))


def test_edits_against_all_windows():
    rng, hits = random.Random(3), 0
    for _ in range(150):
        text = "".join(rng.choices("abcd ", k=rng.randint(10, 70)))
        at = rng.randrange(len(text))
        quote = list(text[at : at + rng.randint(8, 40)])
        for _ in range(rng.randint(0, 2)):
            quote[rng.randrange(len(quote))] = rng.choice(["", "x", "ab"]) if quote else ""
        quote = "".join(quote)
        if len(quote) >= 8:
            assert B.within_edits(text, quote) == closest(text, quote), (text, quote)
            hits += closest(text, quote) is not None
    assert hits > 40


def test_places_that_overlap_are_several():
    assert B.bind("AN AN AN", "text", 2, {2: "an an an an an b"}, None, []) == (None, None, None, "MISSING")
    assert B.bind("AN AN AN", "text", 2, {2: "x an an an b"}, None, []) == (2, 2, 10, "CASE")


def test_edits_in_texts_of_any_length():
    """A place counts wherever it stands, a second one makes two, and time grows with the text and not with the quote times the text."""
    rng, quote = random.Random(4), "Bên B trả đủ tiền trong ba mươi ngày kể từ ngày nhận hàng và hóa đơn hợp lệ."
    edited = quote.replace("đủ ", "").replace("hóa", "hoá")
    words = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(50_000))
    at = 150_000
    text = words[:at] + quote + words[at:]
    assert B.bind(edited, "value", 1, {1: text}, None, []) == (None, None, None, "MISSING")  # five edits, two are allowed
    edited = quote.replace("đủ", "đu").replace("tiền", "tiên")
    began = time.time()
    assert B.bind(edited, "value", 1, {1: text}, None, []) == (1, at, at + len(quote), "EDITED")
    assert B.bind(edited, "value", 1, {1: text + quote}, None, [])[3] == "MISSING"
    assert B.within_edits("a" * 100_000, "a" * 150 + "b" + "a" * 149) is None and B.within_edits("ab" * 2000, "ab" * 300 + "x" + "ab" * 300) is None
    assert time.time() - began < 20


def test_edits_of_long_quotes_against_all_windows():
    rng = random.Random(5)
    for k in range(8):
        text = list("abc " * 40) if k % 2 else rng.choices("abcd ", k=160)
        for _ in range(3):
            text[rng.randrange(len(text))] = "y"
        quote = list(text[20 : 20 + rng.randint(60, 95)])
        for _ in range(k % 4):
            quote[rng.randrange(len(quote))] = rng.choice(["", "x", "ab"])
        assert B.within_edits("".join(text), "".join(quote)) == closest("".join(text), "".join(quote))


def test_letters_whose_lower_case_is_longer_or_depends_on_the_place():
    assert B.within_edits("İİ Bên A giao hàng", "Bên A gioa hàng") is None and B.within_edits("İİ Bên A giao hàng", "Bên A gio hàng") == (3, 18)
    assert B.bind("BÊN A", "value", 1, {1: "İ Bên A"}, None, []) == (1, 2, 7, "CASE")


def test_query_as_the_sql_says_in_long_lines_and_other_letters(spark, tmp_path):
    texts = {3: "x\nab ΟΔΟΣ και ΑΣ" + " word" * 2000, 6: "x\nabİİ quote of the line", 9: "x\nab word word word word" + " word" * 1500, 12: "x\nab cde fghi ΑΣΑ, and ends", 5: "x\ny quote ΑΣ, of the line"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.ORACLES["b3_quote_binding"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["b3_quote_binding"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str) and len(want) == 5


def test_quotes_meet_the_units_in_one_shuffle(spark):
    units = spark.createDataFrame([("a", i, t, "CHƯƠNG I > Giao hàng", ["Số lượng:"]) for i, t in UNITS.items()] + [("b", 1, None, None, None), ("b", 2, "nhận hàng", None, None), (None, 1, "nhận hàng", None, None)],
                                  "doc string, ord int, text string, path string, labels array<string>")
    rows = [(1, "a", 1, "30 ngày", "value"), (2, "a", 1, "30 ngày", "value"), (3, "a", 2, "nhận hàng", "value"), (4, "a", 2, "số lượng", "label"), (5, "a", 5, "giá trị", "value"), (6, "a", None, "giá trị", "value"),
            (7, None, 1, "nhận hàng", "value"), (8, "b", 1, "nhận hàng", "value"), (9, "c", 1, "x", "value"), (10, "a", 4, None, "value"), (11, "b", 2, "nhận hàng", "value")]
    out = B.bound(spark.createDataFrame(rows, "id int, doc string, unit int, quote string, role string"), units, ["doc"])
    assert out.columns == ["id", "doc", "unit", "quote", "role", "bound_unit", "start", "end", "status"]
    assert sorted((r["id"], r["bound_unit"], r["start"], r["end"], r["status"]) for r in out.collect()) == [
        (1, 1, 17, 24, "EXACT"), (2, 1, 17, 24, "EXACT"), (3, 3, 6, 15, "NEIGHBOUR"), (4, None, None, None, "CONTEXT"), (5, None, None, None, "UNKNOWN_UNIT"), (6, None, None, None, "UNKNOWN_UNIT"),
        (7, None, None, None, "UNKNOWN_UNIT"), (8, 2, 0, 9, "NEIGHBOUR"), (9, None, None, None, "UNKNOWN_UNIT"), (10, None, None, None, "EMPTY"), (11, 2, 0, 9, "EXACT")]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
