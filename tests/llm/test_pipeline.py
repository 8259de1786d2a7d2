"""The pipeline on a small corpus: columns stay, stages take effect, the whole runs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import simhash


def corpus(spark, path):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words, 120))
        rows.append((i, f"Cookie notice\n{text}\ncall +1 (988) 555-2485", "en", f"s{i % 3}", 0))
    rows += [(100 + i, rows[i][1], "en", rows[i][3], 0) for i in range(10)]  # exact copies
    rows += [(200, "too short", "en", "s1", 0), (201, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{path}/documents.parquet")
    return d


def test_stages(spark, tmp_path):
    d = corpus(spark, tmp_path)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        if i < 4:
            assert out.columns == d.columns
        out.write.parquet(str(tmp_path / str(i)))
        d = spark.read.parquet(str(tmp_path / str(i)))
        ids = [r.doc_id for r in d.select("doc_id").collect()]
        if i == 0:
            assert sorted(ids) == sorted([*range(60), *range(100, 110)])
        if i == 1:
            assert sorted(ids) == sorted({r.component_id for r in simhash.classes(spark.read.parquet(str(tmp_path / "0"))).collect()}) and len(ids) <= 60
        if i == 2:
            assert d.where("text like '%555-2485%'").count() == 0 and d.where("text like '%+1 (___) ___-____%'").count() == len(ids)
            assert d.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == d.count()


CLASHING = ("kept", "removed", "pii", "fp", "size", "hash", "whole", "threshold", "bucket", "cell", "batch", "slot", "n_words", "first", "host", "words", "row", "base_failed", "__s")


def test_pipeline_with_clashing_columns_repeated_ids_nulls_and_long_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, prose(150), "en", f"s{i % 2}", 0) for i in range(30)]
    rows += [rows[3], rows[3], (3, prose(150), "en", "s0", 0)]  # repeated rows, and an id of two texts
    rows += [(None, prose(120), None, None, None), (None, None, None, "s0", None), (50, "", "en", "s1", 0), (51, prose(60_000), "en", "s1", 0), (52, "x" * 300_000, "en", "s1", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    d.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns
        at.write.parquet(str(tmp_path / f"s{i}"))
        at = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert at.where(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        if i < 3:
            assert {*range(30), None, 51} <= ids and not ids & {50, 52}
        if i == 1:
            assert at.where("doc_id = 3").count() == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert any(r.doc_id == 51 and r.over_budget for r in out) or 51 not in ids


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "batch" in out.columns
