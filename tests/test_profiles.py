"""The pair models over groups of records give what they give over joined pairs, without storing or joining any."""

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollkin.operators import blocks, candidates, combined, profiles, rules
from rollkin.plans import catalog
from rollkin.sources import registry as rg


@pytest.fixture(scope="module")
def register(spark, small):
    """The smallest register twice, so that blocks hold copies, with some blanks and odd values."""
    rows = rg.derived_registry(spark, small)
    again = rows.withColumns({
        "id": F.col("id") + 1000, "epic_no": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat("epic_no", F.lit("9"))), "relation_epic": F.when(F.col("id") % 7 != 0, F.col("relation_epic")),
        "father_or_guardian_name": F.when(F.col("id") % 3 == 0, F.concat("father_or_guardian_name", F.lit("S"))).otherwise(F.col("father_or_guardian_name")),
        "verified_dob": F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), "verified_dob")).otherwise(F.col("verified_dob")), "age": F.when(F.col("id") % 11 != 0, F.col("age")),
    })
    return rules.written(rows.unionByName(again), "register")


def found(df):
    return sorted(map(tuple, df.select(*rules.FLAG_COLUMNS).collect()), key=repr)


def test_comparison_models_equal_those_over_joined_pairs(register):
    fuzzy, cosine, leads = found(rules.fuzzy_new(register)), found(rules.cosine_new(register)), found(rules.duplicate_leads(register))
    rows = rules.written(rules.compared(register), "compared")
    assert fuzzy == found(rules.fuzzy_new_of(rows)) != []
    assert cosine == found(rules.cosine_new_of(register, rows)) != []
    assert leads == sorted([*fuzzy, *cosine], key=repr)


def test_tiles_hold_each_pair_once(monkeypatch):
    rows = pa.table({"group": [1] * 30 + [2] * 11, "id": [*range(30), *range(20, 31)], "side": [3] * 30 + [1, 2] * 5 + [3]})
    whole = [x for i, j in blocks.tiles(rows, lambda p, q: np.ones((len(p), len(q)), bool)) for x in zip(i.tolist(), j.tolist())]
    monkeypatch.setattr(blocks, "TILE", (5, 7))
    monkeypatch.setattr(blocks, "SLICE", 4)
    tiled = [x for i, j in blocks.tiles(rows, lambda p, q: np.ones((len(p), len(q)), bool)) for x in zip(i.tolist(), j.tolist())]
    side, ids = rows["side"].to_pylist(), rows["id"].to_pylist()
    want = {(i, j) for i in range(41) for j in range(41) if rows["group"][i] == rows["group"][j] and ids[i] < ids[j] and side[i] & 1 and side[j] & 2}
    assert set(whole) == set(tiled) == want and len(whole) == len(tiled) == len(want)


def test_likeness_is_the_same_for_all_texts_and_for_some(monkeypatch):
    column = pa.chunked_array([["ANNA LEE", "ANNA LEA", None, "", "ANNA LEE", "BO", "AAAAAAAAAAAA"]])
    i, j = np.indices((7, 7)).reshape(2, -1)
    whole = profiles.Texts(column).likeness(i, j)
    monkeypatch.setattr(profiles, "WHOLE", 0)
    some = profiles.Texts(column)
    assert np.array_equal(some.likeness(i, j), whole, equal_nan=True) and np.isnan(whole.reshape(7, 7)[2]).all()
    assert np.array_equal(some.alike(np.arange(7), np.arange(7), 0.7), whole.reshape(7, 7) >= 0.7) and whole[4] == 1.0


@pytest.mark.parametrize("rule", [rules.fuzzy_new, rules.cosine_new, rules.duplicate_leads])
def test_compared_pairs_are_neither_stored_nor_joined(register, rule, monkeypatch):
    names, write = [], rules.written
    for module in (rules, candidates):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    plan = rule(register)._jdf.queryExecution().executedPlan().toString()
    assert names == ["view"] and "MapInArrow" in plan and "id_a" not in plan


def test_similarities_are_rounded_as_by_spark(spark):
    x = np.array([[0.6125, 0.6115, 0.8125, 1.0005], [0.0005, 0.0015, 0.1234999, 1 / 3]])
    df = spark.createDataFrame([(float(v),) for v in x.ravel()], "v double").select(F.bround("v", 3)).collect()
    assert profiles.rounded(x).ravel().tolist() == [r[0] for r in df]
    assert [Decimal(repr(v)).quantize(Decimal("0.001"), ROUND_HALF_EVEN) for v in (0.6125, 0.6115)] == [Decimal("0.612"), Decimal("0.612")]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_are_scored_whole_however_batches_fall(size):
    groups = np.repeat(np.arange(40), np.random.default_rng(3).integers(1, 9, 40))
    table = pa.table({"group": groups, "at": np.arange(len(groups))})
    got = list(blocks._whole_groups(iter(table.to_batches(max_chunksize=size)), 10))
    assert sum((t["at"].to_pylist() for t in got), []) == list(range(len(groups)))
    held = [set(t["group"].to_pylist()) for t in got]
    assert len(got) > 5 and not any(a & b for n, a in enumerate(held) for b in held[:n])


def test_totals_and_sides_of_leads_are_those_of_stored_flags(register):
    flags = rules.written(rules.duplicate_leads(register), "leads")
    columns = ["id", "n_cosine", "n_fuzzy", "best_dup", "dup_rank"]
    lists = combined.lead_lists(flags, register)
    assert sorted(map(tuple, rules.lead_totals(register).select(*columns).collect())) == sorted(map(tuple, lists.select(*columns).collect())) != []
    sides = combined.duplicate_map(flags, register)
    assert sorted(map(tuple, rules.lead_rows(register).select(*sides.columns).collect()), key=repr) == sorted(map(tuple, sides.collect()), key=repr)


@pytest.mark.parametrize(("query", "stored"), [
    ("a19_report_summary", {"register", "view", "leads"}), ("s15_report_parts", {"register", "view", "leads", "ranked"}), ("a19_checks", {"register"}), ("c03_duplicate_map", {"register", "view"}),
])
def test_report_queries_store_no_pairs(spark, small, monkeypatch, query, stored):
    """Names of references, a row each at most, are stored as well."""
    names, write = set(), rules.written
    for module in (rules, candidates, combined, catalog, rg):
        monkeypatch.setattr(module, "written", lambda df, name: names.add(name) or write(df, name))
    catalog.queries()[query](spark, small)
    assert names - {"names", "name_pairs", "alike", "many", "gone", "runs"} == stored


def test_evidence_model_equals_the_one_over_joined_pairs(register, monkeypatch):
    counted = register.withColumns({"mobile_no": F.when(F.col("id") % 3 == 0, F.lit("1")).otherwise(F.col("mobile_no")), "national_id_hash": F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id") % 50))})
    want = found(rules.new_model_1_of(counted, reaching=False))
    names, write = [], rules.written
    for module in (rules, candidates):
        monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    assert found(rules.new_model_1(counted)) == want != []
    assert names == ["view"]


def test_partners_come_in_the_order_of_the_report(register):
    flags = rules.written(rules.duplicate_leads(register), "leads")
    listed = combined.lead_lists(flags, register).select("id", F.posexplode("duplicates").alias("at", "d")).select("id", (F.col("at") + 1).alias("place"), "d.partner", "d.model", "d.score")
    assert sorted(map(tuple, rules.partners_in_order(register).collect())) == sorted(map(tuple, listed.collect())) != []


def test_lists_of_partners_keep_far_and_negative_ids():
    ids, partners = np.array([5, 5, 1, 5, 5]), np.array([2**40, -(2**40), 7, 3, 4])
    fuzzy, cosine = np.array([700, 0, 900, 800, 0], np.int16), np.array([0, 900, 900, 800, 950], np.int16)
    lists = profiles._listed(ids, partners, fuzzy, cosine)
    assert lists.num_rows == 4
    got = profiles._ordered(lists.rename_columns(["group", *lists.column_names[1:]])).to_pylist()
    assert [(r["id"], r["place"], r["partner"], r["model"], r["score"]) for r in got] == [
        (1, 1, 7, "fuzzy", 0.9), (1, 2, 7, "cosine", 0.9), (5, 1, 4, "cosine", 0.95), (5, 2, -(2**40), "cosine", 0.9), (5, 3, 3, "fuzzy", 0.8), (5, 4, 3, "cosine", 0.8), (5, 5, 2**40, "fuzzy", 0.7),
    ]


def test_whole_dossier_and_documents_are_those_of_joined_leads(spark, register):
    """Also where several records of a year have one ID, which then counts once among a person's partners."""
    rows = rules.written(register.withColumn("epic_no", F.when(F.col("id") % 9 == 0, F.concat(F.lit("S"), F.col("id") % 4)).otherwise(F.col("epic_no"))), "register")
    listed = combined.report(rows, rules.written(rules.duplicate_leads(rows), "leads"))
    totals = combined.report(rows, None, leads=rules.lead_totals(rows))
    columns = ["id", "role", "epic_no", "row_id", "year", "name", "age", "lookup_status"]
    got, want = (sorted(map(tuple, df.select(*columns).collect()), key=repr) for df in (combined.whole_dossier(totals, rows), combined.dossier(listed, rows)))
    assert got == want and any(r[1] == "partner" and r[2].startswith("S") for r in got) and any(r[1] == "partner" and r[2].startswith("ABC") for r in got)
    table = catalog._document_table(rows)
    columns = ["id", "role", "epic_no", "doc_type", "n_bytes"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (combined.listed_documents(totals, rows, table), combined.dossier_documents(combined.dossier(listed, rows), table)))
    assert got == want != []
