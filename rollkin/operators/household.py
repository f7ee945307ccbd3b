"""Family links inside houses, for all houses at once.

A house is a (year, constituency, house) group. Relation names are resolved to
co-residents by a join within houses; components come from the edge table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.functions import text as tx
from rollkin.operators.components import connected_components
from rollkin.sources.scratch import sorted_join

HOUSE = ["year", "constituency_no", "house_norm"]
PARENT_GAP = 13


def members(registry: DataFrame) -> DataFrame:
    return registry.where("house_norm <> ''").select(
        *HOUSE, "id", "name", "age", tx.sex(F.col("gender")).alias("sex"), F.coalesce("name_norm", F.lit("")).alias("name_norm"),
        F.coalesce("relation_name_norm", F.lit("")).alias("relation_norm"), tx.relation_kind(F.col("relation_type")).alias("kind"),
        tx.initial(F.col("relation_type")).alias("relation"), F.coalesce("part_no", F.lit("")).alias("part_no"), "serial_no",
    )


def wanted_sex(relation: Column) -> Column:
    """The sex of a father, mother, husband or wife."""
    return F.when(relation.isin("F", "H"), "M").when(relation.isin("M", "W"), "F")


def link_score(kind: Column, relation: Column, age: Column, other_age: Column, other_sex: Column, exact: Column) -> Column:
    """How well a co-resident fits a named relation: sex, a plausible age gap, the exact spelling."""
    known = (F.coalesce(age, F.lit(0)) != 0) & (F.coalesce(other_age, F.lit(0)) != 0)
    gap = other_age - age
    parent = F.when(gap.between(PARENT_GAP, 60), 2).when(gap >= PARENT_GAP, 1).otherwise(-2)
    spouse = F.when(F.abs(gap) <= 20, 1).otherwise(-1)
    by_age = F.when(known, F.when(kind == "parent", parent).otherwise(spouse)).otherwise(0)
    return F.when(wanted_sex(relation) == other_sex, 2).otherwise(0) + by_age + F.when(exact, 1).otherwise(0)


def _first_two(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first two rows of each group, numbered in ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("place <= 2")


def links(people: DataFrame) -> DataFrame:
    """(house, id, target, kind, ...): the best co-resident for each named relation.

    Of equal scores the one earlier on the roll wins (lower part, serial, id). A score only
    depends on what is wanted (relation, name, age) and on a co-resident's name, age and
    sex. So names are matched once a house, however many have them, and of the co-residents
    that are equal in these the first two on the roll stand for all: the second is taken by
    an elector who would be linked to themself.
    """
    last = 1_000_000_000
    wanted = ["relation_norm", "kind", "relation", "age"]
    seeker = people.where("relation_norm <> '' AND kind <> ''")
    # names that match share a word: joined on it, a house of thousands makes no all-pairs join
    words = lambda df, c: df.select(*HOUSE, c).distinct().select("*", F.explode(F.array_distinct(F.split(c, " "))).alias("word"))
    names = words(seeker, "relation_norm").join(sorted_join(words(people.withColumnRenamed("name_norm", "o_name_norm"), "o_name_norm")), [*HOUSE, "word"])
    names = names.where(tx.household_name_match(F.col("relation_norm"), F.col("o_name_norm"))).select(*HOUSE, "relation_norm", "o_name_norm").distinct()

    on_roll = [-F.coalesce(tx.digits_as_int(F.col("part_no")), F.lit(last)), -F.coalesce("serial_no", F.lit(last)), -F.col("id")]
    order = [f"r{i}" for i in range(len(on_roll))]
    other = people.where("name_norm <> ''").select(*HOUSE, *[F.col(c).alias(f"o_{c}") for c in ("id", "name", "age", "sex", "name_norm")], *[c.alias(r) for r, c in zip(order, on_roll)])
    other = _first_two(other, [*HOUSE, "o_name_norm", "o_age", "o_sex"], [F.desc(r) for r in order]).drop("place")

    near = seeker.select(*HOUSE, *wanted).distinct().join(sorted_join(names), [*HOUSE, "relation_norm"]).join(sorted_join(other), [*HOUSE, "o_name_norm"])
    score = link_score(F.col("kind"), F.col("relation"), F.col("age"), F.col("o_age"), F.col("o_sex"), F.col("relation_norm") == F.col("o_name_norm"))
    near = _first_two(near.withColumn("score", score), [*HOUSE, *wanted], [F.desc("score"), *[F.desc(r) for r in order]])
    found = F.struct("o_id", "o_name", "o_age", "o_sex")
    best = near.groupBy(*HOUSE, *wanted).agg(F.max(F.when(F.col("place") == 1, found)).alias("first"), F.max(F.when(F.col("place") == 2, found)).alias("second"))
    best = best.select(*[F.col(c).alias(f"w_{c}") for c in (*HOUSE, *wanted)], "first", "second")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"w_{c}")) if c == "age" else F.col(c) == F.col(f"w_{c}") for c in (*HOUSE, *wanted)])
    target = F.when(F.col("first.o_id") != F.col("id"), F.col("first")).otherwise(F.col("second"))
    linked = seeker.join(sorted_join(best), same).withColumn("t", target).where("t IS NOT NULL")
    return linked.select(
        *HOUSE, "id", "name", "age", "kind", "relation", F.col("t.o_id").alias("target"), F.col("t.o_name").alias("target_name"),
        F.col("t.o_age").alias("target_age"), F.col("t.o_sex").alias("target_sex"),
    )


def external_spouses(people: DataFrame, found: DataFrame) -> DataFrame:
    """Per house, electors whose named spouse isn't enrolled there."""
    lone = people.where("relation_norm <> '' AND kind = 'spouse'").join(found.select("id"), "id", "left_anti")
    return lone.groupBy(*HOUSE).agg(F.count("*").alias("external_spouses"))


def impossible(found: DataFrame) -> DataFrame:
    known = "coalesce(age, 0) <> 0 AND coalesce(target_age, 0) <> 0"
    return found.where(f"kind = 'parent' AND {known} AND target_age - age < {PARENT_GAP}")


def same_names(people: DataFrame) -> DataFrame:
    """(house, name_norm, n) of names that stand more than once in a house."""
    return people.where("name_norm <> ''").groupBy(*HOUSE, "name_norm").agg(F.count("*").alias("n")).where("n > 1")


def notes(people: DataFrame, found: DataFrame) -> DataFrame:
    """(id, note): what is odd about an elector's links."""
    odd = impossible(found)
    child = odd.select("id", F.format_string("impossible relation: parent %s is %d, elector is %d", "target_name", "target_age", "age").alias("note"))
    parent = odd.select(F.col("target").alias("id"), F.format_string("named as parent of %s (%d) while only %d", "name", "age", "target_age").alias("note"))
    sex = found.where((F.col("target_sex") != "?") & (F.col("target_sex") != wanted_sex(F.col("relation")))).select(
        "id", F.format_string("relation gender mismatch: %s is %s", "target_name", "target_sex").alias("note")
    )
    spouses = found.where("kind = 'spouse'").groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("target").alias("id"), F.format_string("named as spouse by %d electors", "n").alias("note")
    )
    twice = people.join(same_names(people), [*HOUSE, "name_norm"]).select("id", F.format_string("name stands %d times in this house", "n").alias("note"))
    return child.unionByName(parent).unionByName(sex).unionByName(spouses).unionByName(twice)


def families(people: DataFrame, found: DataFrame) -> DataFrame:
    """(house, id, family, linked): family = smallest id of the component, the own id if unlinked."""
    parts = connected_components(found, "id", "target").withColumnRenamed("node", "id")
    return people.select(*HOUSE, "id").join(parts, "id", "left").select(
        *HOUSE, "id", F.coalesce("component", "id").alias("family"), F.col("component").isNotNull().alias("linked")
    )


def signals(registry: DataFrame) -> DataFrame:
    """One row per house: counts behind the house-level findings and the findings that apply."""
    people = members(registry)
    found = links(people)
    family = families(people, found)
    sizes = family.groupBy(*HOUSE, "family").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("alone"))
    houses = sizes.groupBy(*HOUSE).agg(
        F.sum("n").alias("electors"), F.sum("alone").alias("unlinked"), F.count_if(F.col("n") >= 2).alias("families"), F.max("n").alias("largest_family"),
    )
    bad = impossible(found).groupBy(*HOUSE).agg(F.count("*").alias("impossible_links"))
    twice = same_names(people).groupBy(*HOUSE).agg(F.sum("n").alias("same_name_electors"))
    rows = houses.join(bad, HOUSE, "left").join(twice, HOUSE, "left").join(external_spouses(people, found), HOUSE, "left").fillna(0)
    told = F.filter(F.array(
        F.when(F.col("unlinked") > 0, "unlinked"), F.when(F.col("impossible_links") > 0, "impossible"), F.when(F.col("same_name_electors") > 0, "same names"),
        F.when(F.col("families") >= 4, "many families"), F.when(F.col("families") == 0, "no family"), F.when(F.col("external_spouses") > 0, "external spouses"),
    ), lambda x: x.isNotNull())
    return rows.withColumn("findings", F.array_join(told, "; "))
