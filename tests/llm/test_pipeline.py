"""The pipeline's stages on a small corpus whose outcome is known."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from stratafolio.llm import bpe
from tests.llm.conftest import words

KEY = "aZ8kQ1xPw93LmVt0Yb7Rc5Ne"


def corpus(spark):
    rng, rows = random.Random(9), []
    for i in range(300):
        text = words(rng.randint(80, 200), i)
        if i % 10 == 0:
            text += f" {KEY} password = hunter2hunter"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 3 == 0:
            near = text.split()
            near[5] = "edited"
            rows.append((1000 + i, " ".join(near), "en", f"src{i % 3}", len(text)))
    rows += [(5000 + i, "too short", "en", "src0", 9) for i in range(20)] + [(6000, None, None, None, None), (None, words(90, 777), "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_stages(spark, tmp_path):
    docs, rows = corpus(spark)
    columns, kept, tables = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(out := f"{tmp_path}/{len(tables)}")
        kept = tables[name] = spark.read.parquet(out)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(tables[n].columns == columns for n in names[:-1])
    ids = lambda n: sorted(r["doc_id"] for r in tables[n].filter("doc_id IS NOT NULL").collect())
    base = [i for i in range(300)]
    assert ids(names[0]) == sorted(base + [1000 + i for i in range(0, 300, 3)])
    assert set(base) <= set(ids(names[1])) and len(ids(names[1])) <= 300 + 3
    assert ids(names[2]) == ids(names[1])
    clean = {r["doc_id"]: r for r in tables[names[2]].collect()}
    assert all(KEY not in r["text"] and "hunter2" not in r["text"] and r["n_chars"] == len(r["text"]) for i, r in clean.items() if i in base[::10])
    original = {r[0]: r[1] for r in rows}
    assert all(clean[i]["text"] == original[i] for i in base if i % 10)
    assert set(ids(names[3])) <= set(ids(names[2]))
    merges = bpe.merges(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    last = {r["doc_id"]: r for r in kept.collect()}
    assert kept.count() == tables[names[3]].count()
    for r in tables[names[3]].collect():
        got = last[r["doc_id"]]
        assert merges.decode(np.frombuffer(got["ids"], "<u4"))[0].tobytes() == r["text"].encode()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and got["n_tokens"] == len(got["ids"]) // 4


def test_run_on_an_empty_table(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_matches_the_stages(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg(F.sum(F.xxhash64("doc_id", "ids_sha256").cast("decimal(38,0)"))).first() == again.agg(F.sum(F.xxhash64("doc_id", "ids_sha256").cast("decimal(38,0)"))).first()
