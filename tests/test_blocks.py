"""Pairs of a block are scored in pieces: however it is dealt, each pair comes once, and no pairs are stored or joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkin.functions import similarity as sim
from rollkin.operators import blocks, rules
from rollkin.sources import registry as rg


@pytest.fixture(scope="module")
def register(spark, small):
    return rg.derived_registry(spark, small)


@pytest.mark.parametrize("side_rows", [2, 1000])
def test_each_pair_of_a_block_comes_once(register, side_rows):
    def shared(rows, a, b):
        both = blocks.over_texts(rows["name_norm"], a, b, blocks.word_grams, blocks.set_similarities)
        return both, both >= 0.5, both == 1.0

    grams = register.withColumn("grams", sim.word_grams(F.col("name_norm")))
    found = blocks.scored_pairs(register, "relation_type", ["name_norm"], 8, shared, "double", side_rows)
    a, b = grams.alias("a"), grams.alias("b")
    same = F.expr("a.year = b.year AND a.relation_type = b.relation_type AND a.id < b.id AND abs(coalesce(a.age, 0) - coalesce(b.age, 0)) <= 8")
    value = sim.set_similarity(F.col("a.grams"), F.col("b.grams"))
    want = a.join(b, same).where(value >= 0.5).select("a.id", "b.id", value)
    assert sorted(map(tuple, found.select("a", "b", "score").collect())) == sorted(map(tuple, want.collect())) != []


def test_grams_are_those_of_the_column_functions(spark):
    texts = ["", "A", "ANNA-MARIA O'NEIL", "ÉVA  B2", "x y x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sim.word_grams(F.col("t")), sim.grams_of(F.col("t")))
    for t, words, grams in df.collect():
        assert sorted(words) == sorted(blocks.word_grams(t)) and grams == blocks.text_grams(t)
    assert np.array_equal(blocks.set_similarities(np.zeros((1, 2), np.float32), np.zeros((1, 2), np.float32)), [[0.0]])


@pytest.mark.parametrize("rule", [rules.fuzzy_dup, rules.cosine_dup])
def test_pairs_of_a_sound_are_neither_stored_nor_joined(register, rule, monkeypatch):
    monkeypatch.setattr(rules, "written", None)
    text = rule(register)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "id_a" not in text
