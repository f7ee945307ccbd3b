"""The corpus pipeline, stage by stage, against the operators' own checks."""

import numpy as np

import corpus_pipeline
from rollkin.llm import compression_bands, queries


def test_stages_keep_the_columns_and_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, tables = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, small).cache()
        tables.append(kept)
    assert [t.columns for t in tables[:-1]] == [corpus_pipeline.COLUMNS] * 4
    counts = [docs.count(), *(t.count() for t in tables)]
    assert counts[0] >= counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    good = {r["doc_id"] for r in compression_bands.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in tables[0].select("doc_id").collect()} == good
    assert all(r["n_chars"] == len(r["text"]) for r in tables[1].collect())
    words = [set(zip(*[r["text"].split()[i:] for i in range(5)])) for r in tables[2].collect()]
    for a in range(len(words)):
        for b in range(a):
            assert 100 * len(words[a] & words[b]) < 80 * max(1, len(words[a] | words[b]))
    assert all(r["restored"] for r in tables[4].collect())
    total = lambda t: float(np.sum([len(r["text"].split()) for r in t.collect()]))
    assert 0.5 < total(tables[3]) / total(tables[2]) < 0.9


ROWS = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string"


def test_stages_on_nulls_repeats_and_clashing_names(spark, small):
    prose = [" ".join(f"{w}{i}" for i in range(k, k + 120)) for k, w in ((0, "alpha"), (200, "beta"))]
    rows = [(1, prose[0], "en", "a"), (1, prose[0], "en", "a"), (2, prose[0] + " more", None, None), (3, prose[1], "de", "b"), (4, None, None, None), (5, "", "en", "a"), (None, prose[1], None, "c"), (None, None, None, None)]
    docs = spark.createDataFrame([(i, t, lang, s, None, "x", "y") for i, t, lang, s in rows], ROWS)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, small)
        assert name == "sentence_pieces" or found.columns == corpus_pipeline.COLUMNS
        ids[name] = sorted((r["doc_id"] for r in found.collect()), key=str)
    every = sorted((r[0] for r in rows), key=str)
    assert not {4, 5} & set(ids["quality_rules"]) and ids["quality_rules"].count(1) in (0, 2)
    assert ids["line_dedup"] == every and ids["sentence_pieces"] == every
    assert ids["ngram_jaccard_join"] == sorted([1, 3, 4, 5, None], key=str)
    assert ids["source_mix"].count(1) in (0, 2) and {4, 5} <= set(ids["source_mix"])


def test_stages_on_an_empty_table(spark, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ROWS), small).count() == 0


def test_run_gives_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "piece_ids", "n_pieces", "restored", "decoded_crc32"]


def test_every_operator_is_registered():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
