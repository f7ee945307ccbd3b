import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from rollkin.sources import registry as rg
from rollkin.sources import store as st
from rollkin.streaming import arrivals


@pytest.fixture
def arrive(spark, tmp_path):
    columns = [f.name for f in arrivals.ARRIVING]

    def one(name, *people):
        rows = [tuple({"name": n, "serial_no": s, "epic_no": f"E{s}", "age": "30", "constituency_no": "S1", "part_no": "1"}.get(c, "") for c in columns) for s, n in people]
        spark.createDataFrame(rows, arrivals.ARRIVING).coalesce(1).write.parquet(f"{tmp_path}/out-{name}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        (part,) = [f for f in os.listdir(f"{tmp_path}/out-{name}") if f.endswith(".parquet")]
        shutil.move(f"{tmp_path}/out-{name}/{part}", f"{tmp_path}/in/{name}.parquet")
        time.sleep(0.02)

    return one


def names(rows):
    return sorted((r["serial_no"], r["name"]) for r in rows.collect())


def test_arriving_files_are_upserted(spark, tmp_path, arrive):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    arrive("a", ("1", "ALPHA"), ("2", "BETA"), ("3", " "))
    arrivals.load(spark, folder, store, f"{tmp_path}/cp", 2025).awaitTermination()
    arrive("b", ("2", "BETA NEW"), ("4", "DELTA"))
    arrivals.load(spark, folder, store, f"{tmp_path}/cp", 2025).awaitTermination()
    now = st.read(spark, store)
    assert names(now) == [(1, "ALPHA"), (2, "BETA NEW"), (4, "DELTA")]
    assert now.where("year <> 2025").count() == 0 and now.where(F.col("name_norm") == "").count() == 0 and set(rg.NATURAL_KEY) <= set(now.columns)
    assert names(st.read(spark, store, 1)) == [(1, "ALPHA"), (2, "BETA")]


def test_of_one_key_in_a_batch_the_last_row_wins(spark, tmp_path, arrive):
    arrive("a", *[("1", f"FIRST {i}") for i in range(20)], ("1", "LAST OF A"))
    arrive("b", *[("2", f"B {i}") for i in range(20)], ("2", "LAST OF B"), ("1", "LATER FILE"))
    arrivals.load(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/cp", 2025).awaitTermination()
    assert names(st.read(spark, f"{tmp_path}/store")) == [(1, "LATER FILE"), (2, "LAST OF B")]


def test_a_lost_checkpoint_changes_nothing(spark, tmp_path, arrive):
    folder, store = f"{tmp_path}/in", f"{tmp_path}/store"
    arrive("a", ("1", "ALPHA"), ("2", "BETA"))
    arrivals.load(spark, folder, store, f"{tmp_path}/cp", 2025).awaitTermination()
    arrive("b", ("2", "BETA NEW"))
    arrivals.load(spark, folder, store, f"{tmp_path}/cp", 2025).awaitTermination()
    before = names(st.read(spark, store))
    arrivals.load(spark, folder, store, f"{tmp_path}/another", 2025).awaitTermination()
    assert names(st.read(spark, store)) == before == [(1, "ALPHA"), (2, "BETA NEW")]
    assert names(st.read(spark, store, 2)) == before  # a reader of the version before still can


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, f"k string, v string, {st.ORDER} long")


def test_only_touched_buckets_are_rewritten_and_commits_dont_race(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert st.upsert(store, rows_of(spark, *[(f"k{i}", "old", 1) for i in range(200)]), ["k"], 16) == 1
    first = st.manifest(spark, store)["buckets"]
    assert st.upsert(store, rows_of(spark, ("k7", "new", 2), (None, "null", 2)), ["k"]) == 2
    second = st.manifest(spark, store)["buckets"]
    assert len(first) == 16 and 1 <= sum(first[b] != second[b] for b in first) <= 2
    assert st.upsert(store, rows_of(spark, ("k7", "stale", 1), (None, "null again", 3)), ["k"]) == 3
    now = {r["k"]: r["v"] for r in st.read(spark, store).collect()}
    assert now["k7"] == "new" and now[None] == "null again" and len(now) == 201 and st.read(spark, store).count() == 201
    assert st.upsert(store, rows_of(spark), ["k"]) == 3
    with pytest.raises(st.CommitConflict):
        st._commit(spark, store, st.manifest(spark, store))
    assert st.vacuum(spark, store, 1) > 0 and st.versions(spark, store) == [3] and st.read(spark, store).count() == 201
