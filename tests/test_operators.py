"""The library's operators on small cases with known outcomes, and every query against its oracle."""

import io
import os
import random
import zipfile
from itertools import pairwise

import duckdb
import pytest
from pyspark.sql import functions as F

from stratafolio.functions import text as T
from stratafolio.operators import diff, joins, trees, windows
from stratafolio.plans import registry
from stratafolio.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def test_sequence_keys(spark):
    cases = {
        "Chương IV QUY ĐỊNH CHUNG": ("Chương #", 4, "roman"), "Article 17: Scope": ("Article #:", 17, "decimal"), "- Điều 28. Thực hiện công việc": ("Điều #.", 28, "decimal"),
        "I think this is body text": None, "IIII. not a canonical number": None, "a) Chứng thực bản sao": None, "": None,
    }
    df = spark.createDataFrame(list(cases), "string").withColumn("k", T.sequence_key(F.col("value")))
    assert {r["value"]: r["k"] and tuple(r["k"]) for r in df.collect()} == cases


def test_heading_names(spark):
    df = spark.createDataFrame(["1. Thông tin chung", "3. THÔNG TIN CHUNG", "Item 1: Document Approval.", "Document Approval", "A Plan", "B Plan"], "string")
    a, b, c, d, e, f = [r[0] for r in df.select(T.heading_name(F.col("value"))).collect()]
    assert a == b and c == d and e != f


def test_sequence_profile(spark):
    texts = "Điều 1. A|body|Điều 2. B|Điều 3. C|Điều 4. D|Điều 5. E|Điều 6. F|Điều 8. H|Điều 8. H again|Điều 5. see above".split("|")
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, ord int, text string").withColumn("k", T.sequence_key(F.col("text"))).filter("k IS NOT NULL")
    got = windows.anomalies(df.select("doc", "ord", "k.key", "k.value"), ["doc"], "key", "ord", "value").orderBy("ord").collect()
    assert [(r["kind"], r["previous"], r["value"], r["missing"]) for r in got] == [("gap", 6, 8, 1), ("repeat", 8, 8, None), ("decrease", 8, 5, None)]


def test_levels_of_edges(spark):
    rows = [(1, 1, 0), (1, 2, 1), (1, 3, -1), (1, 4, 3), (1, 5, 6), (1, 6, 0)] + [(2, i, i - 1) for i in range(1, 30)]
    got = trees.levels(spark.createDataFrame(rows, "doc int, ord long, parent long"), ["doc"], "ord", "parent").orderBy("doc", "ord").collect()
    assert [(r["resolution"], r["level"]) for r in got[:6]] == [("root", 1), ("parent", 2), ("outside", None), ("unresolved", None), ("unresolved", None), ("root", 1)]
    assert [r["level"] for r in got[6:]] == [min(i, 9) for i in range(1, 30)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(7)
    for _ in range(500):
        k = rng.randint(1, 5)
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        script, complete = diff.edit_script(a, b)
        assert complete and sum(s[0] != "equal" for s in script) == len(a) + len(b) - 2 * lcs(a, b)
        assert [i for _, i, _ in script if i is not None] == list(range(len(a))) and [j for *_, j in script if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for s, i, j in script if s == "equal")
        kept = [(i, j) for s, i, j in script if s == "equal"]
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in pairwise(kept))


def test_edit_script_gives_up():
    a, b = [0, *range(10, 20), 1], [0, *range(30, 40), 1]
    script, complete = diff.edit_script(a, b, 5)
    assert not complete and [(i, j) for s, i, j in script if s == "equal"] == [(0, 0), (11, 11)]


def test_hunks_and_similarity():
    assert diff.hunks("Thanh toán trong 30 ngày.", "Thanh toán trong 45 ngày.") == [("text_modified", 17, 19, 17, 19, False)]
    assert diff.hunks("a b", "a  b") == [("text_modified", 1, 2, 1, 3, False)]
    assert diff.hunks("a", "a b")[0][0] == "text_inserted" and diff.hunks("", "") == []
    assert diff.dice([], []) == (1.0, True) and diff.dice("abcd", "abxd") == (0.75, True) and diff.dice("ab", "cd", 1) == (0.0, False)
    assert diff.pairing(["a b c", "x y"], ["a b d", "q", "x y"]) == ([(0, 0, 2 / 3), (1, 2, 1.0)], True)


def test_versions(spark):
    rows = [(1, "A\nC", "A\nB\nC"), (2, "same\nThanh toán 30 ngày", "same\nThanh toán 45 ngày"), (3, None, "x"), (4, "x", ""), (5, None, None)]
    got = diff.changes(spark.createDataFrame(rows, "pair_id long, old string, new string")).collect()
    by = {k: sorted((r["kind"], r["old_ord"], r["new_ord"]) for r in got if r["pair_id"] == k) for k in range(1, 6)}
    assert by[1] == [("matched", 0, 0), ("matched", 1, 2), ("only_in_new", None, 1)] and by[2] == [("matched", 0, 0), ("modified", 1, 1)]
    assert by[3] == [("only_in_new", None, 0)] and by[4] == [("only_in_old", 0, None)] and by[5] == []


def test_moved_blocks(spark):
    swap = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 4, 1, 2], 1)], "doc int, old int, new int")
    got = windows.moved_blocks(swap, ["doc"], "old", "new").orderBy("old_first").collect()
    assert [(r["old_first"], r["new_first"], r["size"]) for r in got] == [(1, 3, 2), (3, 1, 2)]


def test_as_of_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 3, "d")], "g int, t int, x string")
    right = spark.createDataFrame([(1, 2, "r"), (1, 5, "s"), (3, 1, "q"), (None, 1, "n")], "g int, t int, y string")
    got = {r["x"]: r["y"] for r in joins.as_of(left, right, ["g"], "t", ["y"]).collect()}
    assert got == {"a": "s", "b": None, "c": None, "d": "n"}


def word_file(paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file(
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>One  two</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:ins w:author="x" w:date="d"><w:r><w:t>new</w:t></w:r></w:ins></w:p>'
    ))
    (tmp_path / "b.txt").write_bytes(b"none")
    (tmp_path / "c.bin").write_bytes(b"junk%PDF-1.7")
    found = files.detected(files.files(spark, str(tmp_path)))
    assert {os.path.basename(r["path"]): r["format"] for r in found.collect()} == {"a.docx": "docx", "b.txt": "unknown", "c.bin": "pdf"}
    rows = files.paragraphs(found.filter("format <> 'pdf'")).collect()
    read = sorted((r["ord"], r["source_id"], r["container"], r["text"], r["style"], r["bold"], r["num_id"], r["num_level"]) for r in rows if r["ord"])
    assert read[0] == (1, "body[1]/p[1]", "body", "One two", "Heading1", True, "3", 1)
    assert read[1][1:4] == ("body[1]/tbl[1]/tr[1]/tc[1]/p[1]", "cell", "cell") and read[2][1] == "body[1]/p[2]"
    assert sum(r["problem"] is not None for r in rows) == 1
    assert [(r["kind"], r["author"], r["text"]) for r in files.revisions(found).collect()] == [("insert", "x", "new")]


def test_ocr_lines(spark):
    words = [("d", 1, 1, 1, 1, 2, 10, 0, 5, 5, 90.25, "b"), ("d", 1, 1, 1, 1, 1, 0, 1, 5, 5, 80.25, "a"), ("d", 1, 1, 1, 1, 3, 0, 0, 0, 0, -1.0, " ")]
    df = spark.createDataFrame(words, "doc string, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    r = files.ocr_lines(df).first()
    assert (r["text"], r["left"], r["right"], r["bottom"], r["confidence"], r["lowest"]) == ("a b", 0, 15, 6, 85.2, 80.25)


def test_stream_of_documents(spark, tmp_path):
    from stratafolio.sources.lines import lines
    from stratafolio.streaming import incremental

    docs = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = incremental.arriving(spark, f"{tmp_path}/in", "doc_id long, text string")
    incremental.apply(stream, lines, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


# ------------------------------------------------------------------------------------------------------ queries and oracles


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    try:
        return f"{float(x):.6g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    found = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    rows = lambda data: sorted(tuple(cell(r[c]) for c in columns) for r in data)
    assert rows(got) == rows(want)
