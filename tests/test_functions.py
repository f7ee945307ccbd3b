"""Normalisers, dates and similarities on hand-made values."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollkin.functions import dates as dt
from rollkin.functions import similarity as sim
from rollkin.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    ("Smt. ALPHA  beta-1", "ALPHA BETA"), ("MR MRS GAMMA", "MRS GAMMA"), ("  mr. ", "MR"), ("", ""), (None, ""), ("LATE. D'Souza", "D SOUZA"), ("MRX Y", "MRX Y"),
])
def test_norm_name(spark, raw, want):
    assert one(spark, tx.norm_name(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("E-72", "E72"), ("e 72/ a", "E72A"), (None, ""), ("-", "")])
def test_norm_house(spark, raw, want):
    assert one(spark, tx.norm_house(F.col("v")), v=raw) == want


@pytest.mark.parametrize(("name", "want"), [
    ("KNIGHT", "NT"), ("THOMPSON", "0MPSN"), ("PHILIP", "FLP"), ("SCHOOL", "SKL"), ("CHURCH", "XRX"), ("RED WIDGET", "RT WJT"), ("RRED", "RT"), ("WHITE", "WT"), ("XAVIER", "SFR"),
    ("EDGE", "EJ"), ("THUMB", "0M"), ("", ""),
])
def test_phonetic(spark, name, want):
    assert one(spark, tx.phonetic(F.col("v")), v=name) == want


def test_same_sound_of_spelling_drift(spark):
    keys = {one(spark, tx.phonetic(F.col("v")), v=n) for n in ("BASFOR", "BASPHOR", "BUSFOR")}
    assert len(keys) == 1


@pytest.mark.parametrize(("raw", "want"), [(" 12 ", 12), ("12a", None), ("", None), (None, None), ("-3", -3)])
def test_to_int(spark, raw, want):
    assert one(spark, tx.to_int(F.col("v")), v=raw) == want


def test_small_text_functions(spark):
    c = F.col("v")
    assert one(spark, tx.clean_cell(c), v="nan") == "" and one(spark, tx.clean_cell(c), v=" a ") == "a"
    assert one(spark, tx.year_of_file(c), v="roll-2021-v2.pdf") == 2021 and one(spark, tx.year_of_file(c), v="x.pdf") is None
    assert one(spark, tx.digits_as_int(c), v="No 12b") == 12 and one(spark, tx.digits_as_int(c), v="b") is None
    assert one(spark, tx.sex(c), v=" female") == "F" and one(spark, tx.sex(c), v="x") == "?"
    assert one(spark, tx.relation_kind(c), v="Husband") == "spouse" and one(spark, tx.relation_kind(c), v="MTHR") == "parent" and one(spark, tx.relation_kind(c), v="Other") == ""
    assert one(spark, tx.seat_key(c), v=" ") == "(unknown)" and one(spark, tx.file_stem(c), v="a/b c") == "a_b_c"
    assert one(spark, tx.image_type(F.unhex(c)), v="FFD8FFE000104A46") == "jpg" and one(spark, tx.image_type(F.unhex(c)), v="25504446") == "pdf"


@pytest.mark.parametrize(("a", "b", "want"), [
    ("RAM KUMAR", "RAM KUMAR SINGH", True), ("RAM", "RAM KUMAR", False), ("RAMA", "RAMA KUMAR", True), ("KUMAR", "RAM KUMAR", False), ("RAM", "RAM", True), ("", "RAM", False),
    ("RAM SINGH", "RAM KUMAR", False),
])
def test_household_name_match(spark, a, b, want):
    assert one(spark, tx.household_name_match(F.col("a"), F.col("b")), a=a, b=b) is want


def test_dates(spark):
    c = F.col("v")
    assert one(spark, dt.real_dob(c), v="1990-01-01") is None and str(one(spark, dt.real_dob(c), v="1990-02-03T00:00")) == "1990-02-03" and one(spark, dt.real_dob(c), v="1990-02-31") is None
    assert one(spark, dt.age_on_new_year(F.to_date(c), F.lit(2024)), v="1990-06-01") == 33
    sims = [one(spark, dt.dob_similarity(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("1990-02-03", "1990-02-03"), ("1990-01-01", "1990-01-01"), ("1990-02-03", "1990-05-05"), ("1990-02-03", "1991-02-03"), ("", "1990-02-03"))]
    assert sims == [1.0, 0.6, 0.5, 0.0, None]
    assert one(spark, dt.age_closeness(F.col("a"), F.col("b")), a=30, b=33) == pytest.approx(0.7) and one(spark, dt.age_closeness(F.col("a"), F.col("b")), a=30, b=60) == 0


def plain_cosine(a, b):
    grams = lambda s: Counter(f"  {s} "[i : i + 3] for i in range(len(s) + 1))
    x, y = grams(a), grams(b)
    norm = lambda v: math.sqrt(sum(n * n for n in v.values()))
    return sum(n * y[g] for g, n in x.items()) / (norm(x) * norm(y))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("AB C", min_size=1, max_size=8), st.text("AB C", min_size=1, max_size=8)), min_size=1, max_size=12, unique=True))
def test_cosine_equals_a_plain_model(spark, pairs):
    found = {(r["a"], r["b"]): r["cosine"] for r in sim.text_cosines(spark.createDataFrame(pairs, "a string, b string")).collect()}
    for a, b in pairs:
        want = plain_cosine(a, b)
        assert found.get((a, b), 0.0) == pytest.approx(want, abs=1e-9) and 0 <= want <= 1 + 1e-9
        assert plain_cosine(b, a) == pytest.approx(want)


def test_set_similarity_and_status(spark):
    a, b = sim.word_grams(F.col("a")), sim.word_grams(F.col("b"))
    assert one(spark, sim.set_similarity(a, b), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, sim.set_similarity(a, b), a="", b="") == 0.0
    words = [one(spark, sim.status(F.col("v").cast("double")), v=v) for v in ("1.0", "0.9", "0.7", "0.1", "0.0", None)]
    assert words == ["exact", "strong", "partial", "weak", "differ", "—"]


@pytest.mark.parametrize(("born", "day", "age"), [("2000-02-29", "2025-02-28", 24), ("2000-02-29", "2025-03-01", 25), ("2000-07-01", "2025-07-01", 25), ("2000-07-02", "2025-07-01", 24), ("2025-07-01", "2025-07-01", 0), (None, "2025-07-01", None)])
def test_age_on_a_day(spark, born, day, age):
    row = spark.createDataFrame([(born, day)], "born string, day string").select(dt.age_on(F.col("born").cast("date"), F.col("day").cast("date")).alias("age"))
    assert row.first()["age"] == age


def test_age_closeness_of_a_missing_age_is_null(spark):
    assert one(spark, dt.age_closeness(F.col("a"), F.nullif(F.col("b"), F.lit("")).cast("int")), a=30, b="") is None
    assert one(spark, dt.age_closeness(F.nullif(F.col("a"), F.lit("")).cast("int"), F.col("b")), a="", b=30) is None
