"""Candidate pairs bounded by the evidence that a model needs.

Pairs of records that agree on one common value are quadratic in that value's block,
though one agreement is rarely enough for a flag. ``composite_keys`` works out, from a
model's points, which sets of agreements a flagged pair must have at the least; records
are then joined on the values of each such set at once, in a single join over (set,
values). What a pair can reach at most, with everything known but how alike the names
are, is part of the join's condition, so that no other pair leaves it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkin.functions import similarity as sim
from rollkin.sources.scratch import sorted_join, written

#: Signals that exclude each other stand in one group, each with the value that both records share, if any.
EVIDENCE_GROUPS = [
    [("name_exact", "name_key"), ("name_strong", "name_gram"), ("name_phonetic", "sound_key"), ("name_weak", None)],
    [("dob_exact", "dob"), ("dob_placeholder", "dob"), ("dob_year", None), ("age_exact", "best_age"), ("age_close", None)],
    [("national_id", "national_id_hash")], [("mobile", "mobile_no"), ("mobile_shared", "mobile_no")], [("relation_epic", "reference")],
    [("father_name_match", "father")], [("mother_name_match", "mother")], [("spouse_name_match", "spouse")], [("same_house", "house")], [("gender_same", "sex")],
]
#: A pair with none of these signals is a candidate only by the sound of its enrolled names.
BLOCK_SIGNALS = {"national_id", "dob_exact", "mobile", "relation_epic"}
#: Values that hardly narrow a block, the weakest first; left out of a key while two others remain.
WEAK = ["sex", "best_age"]
#: Cosine from which on names are strongly alike.
STRONG = 0.85


def signal_sets(groups: list, points: dict[str, float], threshold: float, blocks: set[str], otherwise: str) -> Iterable[frozenset[str]]:
    """The values that a pair shares, for each choice of signals that reaches ``threshold``."""
    for chosen in itertools.product(*[[*g, (None, None)] for g in groups]):
        if sum(points[s] for s, _ in chosen if s) >= threshold - 1e-9:
            shared = {v for _, v in chosen if v}
            yield frozenset(shared if blocks & {s for s, _ in chosen} else shared | {otherwise})


def _minimal(sets: Iterable[frozenset[str]]) -> list[frozenset[str]]:
    """Those without another one inside them; equal names sound equal."""
    whole = set(sets)
    closure = {s: s | {"sound_key"} if "name_key" in s else s for s in whole}
    return [s for s in whole if not any(t != s and t <= closure[s] for t in whole)]


def composite_keys(groups: list, points: dict[str, float], threshold: float, blocks: set[str] = BLOCK_SIGNALS, otherwise: str = "name_phonetic") -> list[tuple[str, ...]]:
    """Sets of values such that each pair that reaches ``threshold`` shares all values of one of them."""
    kept = []
    for s in _minimal(signal_sets(groups, points, threshold, blocks, otherwise)):
        for weak in WEAK:
            if len(s) > 2:
                s = s - {weak}
        if "name_gram" in s and (otherwise in s or len(s) > 2):  # a list of grams multiplies the rows of a record
            s = s - {"name_gram"}
        kept.append(s)
    return sorted(tuple(sorted(s)) for s in _minimal(kept))


def _shared_rows(records: DataFrame, keys: list[tuple[str, ...]], lists: set[str]) -> DataFrame:
    """``records`` with a row for each key whose values are all there, as ``key`` and ``value``; columns in ``lists`` are arrays of values."""
    found = []
    for i, key in enumerate(keys):
        plain = [c for c in key if c not in lists]
        many = [c for c in key if c in lists]
        there = reduce(lambda x, y: x & y, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in plain], F.lit(True))
        row = lambda *cs, i=i: F.struct(F.lit(i).alias("key"), F.xxhash64(*cs).alias("value"))
        values = F.transform(F.col(many[0]), lambda g: row(*plain, g)) if many else F.array(row(*plain))  # noqa: B023
        found.append(F.when(there, values))
    rows = F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return records.withColumn("_row", F.explode(rows)).select("*", "_row.key", "_row.value").drop("_row")


def pairs_on_any(records: DataFrame, keys: list[tuple[str, ...]], columns: list[str], where: Column, lists: set[str] = frozenset()) -> DataFrame:
    """Distinct pairs (a, b), a < b, of one year that share all values of one of ``keys`` and satisfy ``where`` over x_a and x_b of ``columns``."""
    rows = _shared_rows(records, keys, set(lists)).select("id", "year", "key", "value", *columns)
    a, b = (rows.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("year", "key", "value", *columns)]) for x in "ab")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("year", "key", "value")])
    return a.join(sorted_join(b), same & (F.col("a") < F.col("b")) & where).select("a", "b").distinct()


def with_rare_grams(view: DataFrame, column: str, threshold: float, name: str) -> DataFrame:
    """``view`` with the grams of ``column`` one of which two texts share if their cosine reaches ``threshold``, as an array."""
    texts = view.where(F.col(column) != "").select(F.col(column).alias("key")).distinct()
    rare = sim.rare_grams(sim.vectors(texts, text="key"), threshold).groupBy("key").agg(F.collect_set("gram").alias(name))
    return view.join(sorted_join(rare.withColumnRenamed("key", column)), column, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def _hashed(view: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as hashes, null for empty: equal texts stay equal, so a bound over them can only be too high."""
    return view.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.xxhash64(c)) for c in columns})


def evidence_pairs(view: DataFrame, mobile_counts: DataFrame, points: dict[str, float], threshold: float, age_window: int, most_shared: int = 4) -> DataFrame:
    """Pairs (a, b) of ``view`` that are in a block of the evidence model and can reach its threshold.

    In a block: equal national ID, real birth date, mobile number that at most
    ``most_shared`` IDs have, reference, or sound of the enrolled names with ages
    within the window; and different IDs.
    """
    keys = composite_keys(EVIDENCE_GROUPS, points, threshold)
    house = F.when(F.col("house_norm") != "", F.concat_ws("|", "house_norm", F.coalesce("constituency_no", F.lit(""))))
    counted = view.join(sorted_join(mobile_counts.select("year", "mobile_no", F.col("n").alias("mobile_n"))), ["year", "mobile_no"], "left")
    grams = with_rare_grams(counted.withColumn("house", house), "name_key", STRONG, "name_gram")
    texts = ["name_key", "sound_key", "dob", "national_id_hash", "mobile_no", "reference", "father", "mother", "spouse", "house", "sex", "name_phonetic", "epic_no"]
    placeholder, born = F.coalesce(F.col("dob").endswith("-01-01"), F.lit(False)), F.substring("dob", 1, 4)
    records = _hashed(grams.withColumns({"placeholder": placeholder, "born": born}), texts)
    columns = [*texts, "best_age", "age", "placeholder", "born", "mobile_n"]
    col = F.col
    both = lambda c: col(f"{c}_a").isNotNull() & col(f"{c}_b").isNotNull()
    same = lambda c: F.coalesce(col(f"{c}_a") == col(f"{c}_b"), F.lit(False))
    worth = lambda c, equal, other=0.0: F.when(same(c), equal).when(both(c), other).otherwise(0.0)
    p = points
    years = F.abs(col("best_age_a") - col("best_age_b"))
    unshared = F.coalesce("mobile_n_a", F.lit(1)) <= most_shared
    real = same("dob") & ~col("placeholder_a")
    dates = (
        F.when(real, p["dob_exact"]).when(same("dob"), p["dob_placeholder"])
        .when(both("dob"), F.when(col("placeholder_a") | col("placeholder_b"), F.when(col("born_a") == col("born_b"), p["dob_year"]).otherwise(0.0)).otherwise(p["dob_conflict"]))
        .when(years == 0, p["age_exact"]).when(years <= 2, p["age_close"]).when(years >= 8, p["age_far"]).otherwise(0.0)
    )
    most = (
        worth("name_key", p["name_exact"], p["name_strong"]) + dates + worth("national_id_hash", p["national_id"], p["national_id_conflict"])
        + F.when(same("mobile_no"), F.when(unshared, p["mobile"]).otherwise(p["mobile_shared"])).otherwise(0.0) + worth("reference", p["relation_epic"], p["relation_conflict"])
        + worth("father", p["father_name_match"]) + worth("mother", p["mother_name_match"]) + worth("spouse", p["spouse_name_match"]) + worth("house", p["same_house"])
        + worth("sex", p["gender_same"], p["gender_diff"])
    )
    near = F.abs(F.coalesce("age_a", F.lit(0)) - F.coalesce("age_b", F.lit(0))) <= age_window
    in_block = same("national_id_hash") | real | (same("mobile_no") & unshared) | same("reference") | (same("name_phonetic") & near)
    other_id = ~F.col("epic_no_a").eqNullSafe(F.col("epic_no_b"))
    return pairs_on_any(records, keys, columns, (most >= threshold - 1e-6) & in_block & other_id, {"name_gram"})


#: Names one of which must be alike, or a date or reference equal, before two profiles are tied to one person.
ANCHOR_NAMES = ("father", "mother", "spouse")


def alike_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b), both ways: distinct texts of ``texts`` (column key) whose trigram cosine reaches ``threshold``.

    Texts are compared once, however many records have them, and only where they share
    one of the rarer grams of both.
    """
    grams = written(sim.vectors(texts.where("key <> ''").select("key").distinct(), text="key"), "grams")
    rare = sim.rare_grams(grams, threshold)
    a, b = (rare.withColumnRenamed("key", x) for x in "ab")
    pairs = written(a.join(sorted_join(b), "gram").where("a < b").select("a", "b").distinct(), "text_pairs")
    found = sim.cosines(pairs, grams).where(F.col("cosine") >= threshold)
    return found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def anchored_sound_pairs(view: DataFrame, age_window: int) -> DataFrame:
    """Pairs (a, b) whose enrolled names sound alike within the age window and that are tied to one person.

    Tied: an equal birth date or reference, or an equal or strongly alike name of a parent
    or spouse. IDs differ, and genders don't conflict. The join is on the sound together
    with what ties, where one side also stands under the names that are like its own.
    """
    named = view.where("name_phonetic <> ''")
    tie = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("tied"))
    own = named.select("id", "year", "name_phonetic", "age", "epic_no", "sex", F.explode(F.array(*[tie(c, F.col(c)) for c in ("dob", "reference", *ANCHOR_NAMES)])).alias("t"))
    own = written(own.select("*", "t.*").drop("t").where("tied <> ''"), "ties")
    names = own.where(F.col("kind").isin(*ANCHOR_NAMES))
    like = written(alike_texts(names.select(F.col("tied").alias("key")), STRONG - 0.0005), "alike")  # similarities are rounded to three digits
    wide = own.unionByName(names.join(sorted_join(like.select(F.col("a").alias("tied"), F.col("b").alias("other"))), "tied").withColumn("tied", F.col("other")).drop("other"))
    a, b = (df.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("age", "epic_no", "sex")], "year", "name_phonetic", "kind", "tied") for df, x in ((wide, "a"), (own, "b")))
    near = F.abs(F.coalesce("age_a", F.lit(0)) - F.coalesce("age_b", F.lit(0))) <= age_window
    where = near & ~F.col("epic_no_a").eqNullSafe(F.col("epic_no_b")) & ~((F.col("sex_a") != "") & (F.col("sex_b") != "") & (F.col("sex_a") != F.col("sex_b")))
    return a.join(sorted_join(b), ["year", "name_phonetic", "kind", "tied"]).where((F.col("a") < F.col("b")) & where).select("a", "b").distinct()
