"""Tables with a row for each record, text or gram aren't broadcast, however small Spark believes them to be."""

import pytest
from pyspark.sql import functions as F

from rollkin.functions import similarity as sim
from rollkin.operators import combined, extraction, flags, rules
from rollkin.sources import registry as rg


@pytest.fixture(scope="module")
def register(spark, small):
    return rg.derived_registry(spark, small)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_not_broadcast(spark, register, tmp_path):
    register.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).write.parquet(f"{tmp_path}/pairs")
    vectors = sim.vectors(register.select(F.col("id").alias("key"), F.col("name").alias("text")))
    assert "Broadcast" not in plan(sim.cosines(spark.read.parquet(f"{tmp_path}/pairs"), vectors))
    assert "Broadcast" not in plan(sim.rare_grams(vectors, 0.8))


@pytest.mark.parametrize("rule", [rules.dup_epic, rules.dup_identity, rules.cross_part_dup, rules.phonetic_dup, rules.fuzzy_dup, rules.same_birth_date])
def test_sides_of_pairs_are_not_broadcast(register, rule):
    assert "Broadcast" not in plan(rule(register))


def test_records_are_not_broadcast_to_flags(register):
    found = rules.dup_epic(register).withColumn("id", F.col("voter_id"))
    reviews = found.select("id", F.col("id").alias("flag_id"), F.lit("confirmed").alias("verdict"), F.lit("").alias("reviewer"), F.lit("").alias("notes"), F.lit("2025-01-01").alias("reviewed_at"))
    assert "Broadcast" not in plan(flags.flag_export(found, reviews, register))
    assert "Broadcast" not in plan(flags.by_constituency(found, reviews, register))
    assert "Broadcast" not in plan(flags.without_old_format(found, reviews))
    leads = rules.dup_epic(register).withColumn("rule", F.lit("fuzzy_new"))
    assert "Broadcast" not in plan(combined.duplicate_map(leads, register))


def test_markers_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("D", 0, "| **1** |")], "doc_id string, page_index int, text string").write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    assert "Broadcast" not in plan(extraction.pages_to_read_again(extraction.extract(pages), pages))


def test_candidate_pairs_are_not_shuffled_to_be_told_apart(register):
    pairs = rules.profile_candidates(register)
    assert "Aggregate" not in plan(pairs)
    assert pairs.count() == pairs.distinct().count() > 0


def test_groups_of_references_are_not_broadcast(register):
    names = register.selectExpr("year", "relation_epic AS reference", "father_or_guardian_name AS father").where("reference IS NOT NULL AND father IS NOT NULL").distinct()
    assert "Broadcast" not in plan(rules.name_clusters(names))
    assert "Broadcast" not in plan(rules.sibling_groups(register))
    assert "Broadcast" not in plan(combined.findings(register))
    assert "Broadcast" not in plan(combined.siblings(register))
