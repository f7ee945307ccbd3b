"""Named files, the posting index, pages by token, seats by task."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rollkin.operators import combined, enrichment, explore, flags
from rollkin.sources import binaries, named_files, text_index


def listing(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def plan_of(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    return df._jdf.queryExecution().executedPlan().toString()


def lines(path):
    with open(path) as f:
        return f.read().splitlines()


@pytest.fixture
def ranked(spark):
    rows = [(i, f"E{i}", f"N,{i}", "S1" if i % 3 else "Seat/2", "1", i, 30, "Male", "high", 0.5, 1, 0, "x") for i in range(1, 124)]
    return spark.createDataFrame(rows, "rank long, epic_no string, name string, constituency string, part_no string, serial_no int, age int, gender string, severity string, best_dup double, n_dups int, n_logical int, summary string").repartition(5)


def test_parts_are_named_by_their_ranks(ranked, tmp_path):
    combined.write_parts(ranked, f"{tmp_path}/out")
    assert listing(f"{tmp_path}/out") == ["0001-0050.csv", "0051-0100.csv", "0101-0123.csv"]
    found = lines(f"{tmp_path}/out/0051-0100.csv")
    assert found[0].replace('"', "").split(",") == combined.REPORT_FILE and len(found) == 51
    assert [int(x.split(",")[0]) for x in found[1:]] == list(range(51, 101)) and '"N,51"' in found[1]
    combined.write_parts(ranked.where("rank <= 10"), f"{tmp_path}/out")
    assert listing(f"{tmp_path}/out") == ["0001-0010.csv"]


def test_parts_by_seat(ranked, tmp_path):
    combined.write_by_seat(ranked, f"{tmp_path}/out", 50)
    assert listing(f"{tmp_path}/out") == ["S1/0001-0050.csv", "S1/0051-0082.csv", "Seat_2/0001-0041.csv"]
    assert [int(x.split(",")[0]) for x in lines(f"{tmp_path}/out/Seat_2/0001-0041.csv")[1:]] == list(range(3, 124, 3))


def test_a_failed_write_leaves_no_file(spark, ranked, tmp_path):
    broken = ranked.withColumn("file", F.when(F.col("rank") == 77, None).otherwise("a.csv"))
    with pytest.raises(Exception, match="no file name"):
        named_files.write_named(broken, f"{tmp_path}/out", F.col("file"), F.col("rank"))
    assert listing(f"{tmp_path}/out") == []
    named_files.write_named(ranked.where("false"), f"{tmp_path}/out", F.lit("a.csv"), F.col("rank"))
    assert listing(f"{tmp_path}/out") == []
    for name in ("a.csv", "b.csv"):
        named_files.write_named(ranked, f"{tmp_path}/out", F.lit(name), F.col("rank"), overwrite=False)
    assert listing(f"{tmp_path}/out") == ["a.csv", "b.csv"] and len(lines(f"{tmp_path}/out/b.csv")) == 124


@pytest.fixture
def people(spark):
    rows = [(i, f"S{i % 3}", str(i % 4) if i % 9 else None, i % 50 if i % 7 else None, f"ABC{i:07d}", f"RAM KUMAR {i % 13}" if i % 5 else "O'Neil 50%_x", None if i % 11 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, constituency_no string, part_no string, serial_no int, epic_no string, name string, age int").repartition(4)
    empty = {c: F.lit(None).cast("string") for c in explore.SEARCHED if c not in df.columns}
    return df.withColumns(empty).withColumns({"name_norm": F.trim(F.regexp_replace(F.upper("name"), "[^A-Z]+", " ")), "house_norm": F.lit("")})


@pytest.mark.parametrize("query", ["ram", "KUMAR 1", "50%_", "o'neil", "%", "1", "11", "  ", "", "absent text", "C00000", "m k", "é"])
def test_the_index_finds_what_a_scan_finds(spark, people, tmp_path, query):
    explore.build_index(people, f"{tmp_path}/index")
    found = sorted(r["id"] for r in explore.indexed_search(spark, f"{tmp_path}/index", query).collect())
    assert found == (sorted(r["id"] for r in explore.search(people, explore.Filters(query=query)).collect()) if query.strip() else [])


def test_the_index_is_read_instead_of_the_register(spark, people, tmp_path):
    explore.build_index(people, f"{tmp_path}/index")
    found = explore.indexed_search(spark, f"{tmp_path}/index", "kumar 12")
    assert "EqualTo(gram" in plan_of(spark, found) and found.count() and all(f"{tmp_path}/index/lists" in f for f in found.inputFiles())
    assert text_index._rarest(spark, f"{tmp_path}/index", "kumar 12")[0] in (" 12", "12\x00")


@pytest.mark.parametrize("sort", ["roll", "name", "youngest", "oldest", "id number", "house"])
def test_pages_by_token_equal_offsets(people, sort):
    token, seen = None, []
    while True:
        page = explore.page_after(people, sort, token, 70)
        ids = [r["id"] for r in page.collect()]
        if not ids:
            break
        seen += ids
        token = explore.token_of(page, sort)
    assert seen == [r["id"] for r in people.orderBy(*explore.sort_orders()[sort]).collect()]


def test_pages_by_token_keep_rows_whose_ids_repeat(people):
    """A page may end among rows that are equal in all keys, and be filled by them."""
    again = people.limit(40).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).localCheckpoint()
    token, seen = None, []
    while True:
        page = explore.page_after(again, "roll", token, 3)
        seen += [(r["id"], r["copy"]) for r in page.collect()]
        if (token := explore.token_of(page, "roll", token)) is None:
            break
    assert len(seen) == 200 and len(set(seen)) == 200


def test_a_deep_page_skips_files(spark, people, tmp_path):
    explore.cluster_by(people, "roll", f"{tmp_path}/roll")
    stored = spark.read.parquet(f"{tmp_path}/roll")
    token = explore.token_of(stored.orderBy(*explore.sort_orders()["roll"]).limit(250), "roll")
    page = explore.page_after(stored, "roll", token, 20)
    assert [r["id"] for r in page.collect()] == [r["id"] for r in people.orderBy(*explore.sort_orders()["roll"]).offset(250).limit(20).collect()]
    assert re.search(r"PushedFilters: \[.*GreaterThan(OrEqual)?\(constituency_no", plan_of(spark, page))


def test_csv_of_a_search(people, tmp_path):
    explore.write_csv(people.select("id", "constituency_no", "part_no", "serial_no"), f"{tmp_path}/out", "found.csv", limit=40)
    assert listing(f"{tmp_path}/out") == ["found.csv"]
    want = [r["id"] for r in people.orderBy(*explore.sort_orders()["roll"]).limit(40).collect()]
    assert [int(x.split(",")[0]) for x in lines(f"{tmp_path}/out/found.csv")[1:]] == want


def test_images_are_read_without_moving_them(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('E', id % 90) AS epic_no", "concat('t', id) AS doc_type", "encode(repeat('x', cast(id AS int)), 'utf-8') AS image", "id AS fetched_at")
    binaries.store(rows.union(rows.limit(1).withColumn("epic_no", F.lit(None))), "docs_test", "epic_no", 8, f"{tmp_path}/docs")
    wanted = spark.createDataFrame([("E7", 1, "self"), ("E7", 2, "partner"), ("none", 3, "self"), (None, 4, "self")], "epic_no string, id long, role string").withColumn("row_id", F.lit(0))
    found = combined.dossier_documents(wanted, "docs_test")
    assert sorted((r["id"], r["doc_type"], r["n_bytes"]) for r in found.collect()) == [(i, f"t{n}", n) for i in (1, 2) for n in (187, 277, 367, 7, 97)]
    assert sorted(r["doc_type"] for r in binaries.fetched(spark, "docs_test", wanted, "epic_no").collect()) == ["t187", "t277", "t367", "t7", "t97"]
    assert [r["n_bytes"] for r in explore.profile_documents(spark, "docs_test", "E7").collect()] == [367, 277, 187, 97, 7]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = combined.dossier_documents(wanted, "docs_test")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    (scan,) = [i for i, x in enumerate(plan) if "FileScan" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(plan[scan])
    for x in reversed(plan[:scan]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)


def test_no_task_has_two_seats(spark):
    rows = [(f"E{i}", None if i % 37 == 0 else f"S{i % 23}") for i in range(500)]
    work = enrichment.by_seat(spark.createDataFrame(rows, "epic_no string, constituency_no string"))
    found = work.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct(F.coalesce("constituency_no", F.lit("")))).collect()
    assert len(found) == 24 and all(r[1] == 1 for r in found) and work.count() == 500 and work.columns == ["epic_no", "constituency_no"]
    assert enrichment.by_seat(spark.createDataFrame([], "epic_no string, constituency_no string")).count() == 0


def test_reviews_are_appended_and_numbered_on(spark):
    schema = "id long, flag_id long, verdict string, reviewer string, notes string, reviewed_at date"
    old = spark.createDataFrame([(4, 1, "confirmed", None, None, None)], schema)
    new = spark.createDataFrame([(2, "legitimate", "a", None, None), (1, "needs_info", "b", "n", None)], "flag_id long, verdict string, reviewer string, notes string, reviewed_at date")
    assert sorted((r["id"], r["flag_id"], r["verdict"]) for r in flags.appended(old, new).collect()) == [(4, 1, "confirmed"), (5, 1, "needs_info"), (6, 2, "legitimate")]
    assert {r["flag_id"]: r["verdict"] for r in flags.latest_reviews(flags.appended(old, new)).collect()} == {1: "needs_info", 2: "legitimate"}
    with pytest.raises(Exception, match="unknown verdict"):
        flags.appended(old, new.withColumn("verdict", F.lit("maybe"))).collect()
