"""The flag and review tables: adding, clearing, queues, verdicts and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.functions import text as tx
from rollkin.sources.scratch import sorted_join

FLAG_KEY = ["rule", "voter_id", "related_voter_id"]
PANEL = ["id", "year", "constituency_no", "part_no", "serial_no", "epic_no", "name", "relation_name", "house_number", "house_norm", "age", "gender"]


def _same_flag(old: DataFrame, new: DataFrame) -> Column:
    related = lambda d: F.coalesce(d["related_voter_id"], F.lit(-1))
    return (old["rule"] == new["rule"]) & (old["voter_id"] == new["voter_id"]) & (related(old) == related(new))


def new_flags(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` that ``stored`` doesn't have, one per key: append these. A second run adds none."""
    fresh = found.withColumn("related_voter_id", F.coalesce("related_voter_id", F.lit(-1))).dropDuplicates(FLAG_KEY)
    fresh = fresh.withColumn("related_voter_id", F.nullif(F.col("related_voter_id"), F.lit(-1).cast("long")))
    return fresh.join(sorted_join(stored), _same_flag(fresh, stored), "left_anti")


def added_by_rule(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, added): how many new flags each rule brings."""
    return new_flags(stored, found).groupBy("rule").agg(F.count("*").alias("added"))


def cleared(flags: DataFrame, registry: DataFrame, year: int | None = None) -> DataFrame:
    """Flags that stay when one year's (or all) are cleared; the year is the voter's."""
    if year is None:
        return flags.limit(0)
    gone = registry.where(F.col("year") == year).select(F.col("id").alias("voter_id"))
    return flags.join(sorted_join(gone), "voter_id", "left_anti")


def first_of_each(flags: DataFrame) -> DataFrame:
    """Old duplicates of a flag removed: the lowest id of each key stays."""
    key = Window.partitionBy("rule", "voter_id", F.coalesce("related_voter_id", F.lit(-1))).orderBy("id")
    return flags.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def without_old_format(flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Overload flags whose details lack ``house_norm`` go unless someone reviewed them."""
    reviewed = reviews.select(F.col("flag_id").alias("id")).distinct()
    old = flags.where((F.col("rule") == "house_overload") & F.get_json_object("details", "$.house_norm").isNull())
    return flags.join(old.join(sorted_join(reviewed), "id", "left_anti").select("id"), "id", "left_anti")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each flag; at one time the higher id is later."""
    last = F.max_by(F.struct("id", "verdict", "reviewer", "notes", "reviewed_at"), F.struct("reviewed_at", "id"))
    return reviews.groupBy("flag_id").agg(last.alias("r")).select(
        "flag_id", F.col("r.id").alias("review_id"), "r.verdict", "r.reviewer", "r.notes", "r.reviewed_at"
    )


def reopened(reviews: DataFrame, flag_ids: DataFrame) -> DataFrame:
    """Reviews without those of the flags that are opened again."""
    return reviews.join(flag_ids, "flag_id", "left_anti")


# What a reviewer can decide.
VERDICTS = ("confirmed", "legitimate", "needs_info")


def appended(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """``reviews`` with ``decisions`` (flag_id, verdict, reviewer, notes, reviewed_at) behind them, numbered on from the highest id.

    A flag may be decided any number of times; the latest counts. An unknown verdict
    raises. New ids go by time and flag, so that the same decisions get the same ids.
    """
    checked = decisions.withColumn("verdict", F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null"))))))
    last = reviews.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))  # one row
    order = F.row_number().over(Window.orderBy("reviewed_at", "flag_id", "verdict"))  # of one load of decisions by people
    numbered = checked.crossJoin(last).withColumn("id", F.col("_last") + order).drop("_last")
    return reviews.unionByName(numbered.select(*reviews.columns))


def with_voters(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """Flags with both records as x_a and x_b; the second may be missing."""
    a = registry.select(F.col("id").alias("voter_id"), *[F.col(c).alias(f"{c}_a") for c in PANEL[1:]])
    b = registry.select(F.col("id").alias("related_voter_id"), *[F.col(c).alias(f"{c}_b") for c in PANEL[1:]])
    return flags.join(sorted_join(a), "voter_id").join(sorted_join(b), "related_voter_id", "left")


def with_variant(flags: DataFrame) -> DataFrame:
    """Flags with their details parsed once, as ``detail``; details that aren't JSON give null.

    A stored table with this column reads single fields without parsing text again.
    """
    return flags.withColumn("detail", F.try_parse_json("details"))


def detail(path: str, kind: str = "string") -> Column:
    """A field of ``detail``, null where it is missing or not of that kind."""
    return F.try_variant_get(F.col("detail"), f"$.{path}", kind)


def severity_order() -> Column:
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)


def open_flags(flags: DataFrame, reviews: DataFrame, registry: DataFrame, rule: str | None = None, year: int | None = None, limit: int = 200) -> DataFrame:
    """The queue of flags without a review: severe first, then by score, then by id."""
    queue = with_voters(flags.join(sorted_join(reviews.select(F.col("flag_id").alias("id")).distinct()), "id", "left_anti"), registry)
    queue = queue.where(F.col("rule") == rule) if rule else queue
    queue = queue.where(F.col("year_a") == year) if year else queue
    return queue.orderBy(severity_order(), F.desc_nulls_last("score"), "id").limit(limit)


def reviewed_flags(flags: DataFrame, reviews: DataFrame, registry: DataFrame, verdict: str | None = None, limit: int = 200) -> DataFrame:
    """Reviewed flags with their latest verdict: confirmed first, newest first."""
    latest = latest_reviews(reviews).withColumnRenamed("flag_id", "id")
    found = with_voters(flags.join(sorted_join(latest), "id"), registry)
    found = found.where(F.col("verdict") == verdict) if verdict else found
    order = F.when(F.col("verdict") == "confirmed", 0).when(F.col("verdict") == "needs_info", 1).otherwise(2)
    return found.orderBy(order, F.desc("reviewed_at"), "id").limit(limit)


def page_with_more(queue: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of an ordered queue and one row beyond it, which tells whether there is more."""
    return queue.offset(offset).limit(limit + 1)


def flag_export(flags: DataFrame, reviews: DataFrame, registry: DataFrame, rule: str | None = None, year: int | None = None, constituency: str | None = None) -> DataFrame:
    """All flags with both records and the latest verdict, if any."""
    latest = latest_reviews(reviews).withColumnRenamed("flag_id", "id")
    rows = with_voters(flags, registry).join(sorted_join(latest), "id", "left")
    for wanted, column in ((rule, F.col("rule")), (year, F.col("year_a")), (constituency, tx.seat_key(F.col("constituency_no_a")))):
        rows = rows.where(column == wanted) if wanted is not None else rows
    return rows


def summary(flags: DataFrame, reviews: DataFrame) -> DataFrame:
    """Flags and reviewed flags by rule and severity; each flag counts once however often reviewed."""
    reviewed = reviews.select(F.col("flag_id").alias("id")).distinct().withColumn("seen", F.lit(1))
    return flags.join(sorted_join(reviewed), "id", "left").groupBy("rule", "severity").agg(F.count("*").alias("flags"), F.count("seen").alias("reviewed"))


def by_constituency(flags: DataFrame, reviews: DataFrame, registry: DataFrame) -> DataFrame:
    reviewed = reviews.select(F.col("flag_id").alias("id")).distinct().withColumn("seen", F.lit(1))
    seats = registry.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"))
    rows = flags.join(sorted_join(seats), "voter_id").join(sorted_join(reviewed), "id", "left")
    level = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return rows.groupBy("constituency").agg(F.count("*").alias("flags"), level("high"), level("medium"), level("low"), F.count("seen").alias("reviewed"))


def by_constituency_rule(flags: DataFrame, registry: DataFrame) -> DataFrame:
    seats = registry.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"))
    return flags.join(sorted_join(seats), "voter_id").groupBy("constituency", "rule").agg(F.count("*").alias("flags"))


def rule_matrix(flags: DataFrame, registry: DataFrame, rules: list[str]) -> DataFrame:
    """One row per constituency, one column per rule."""
    return by_constituency_rule(flags, registry).groupBy("constituency").pivot("rule", rules).agg(F.sum("flags")).fillna(0)


def entries_by_constituency_rule(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """Records that flags name, on either side: entries and distinct voters by constituency and rule."""
    sides = flags.select("rule", "voter_id").unionByName(flags.where("related_voter_id IS NOT NULL").select("rule", F.col("related_voter_id").alias("voter_id")))
    seats = registry.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"))
    return sides.join(sorted_join(seats), "voter_id").groupBy("constituency", "rule").agg(F.count("*").alias("entries"), F.count_distinct("voter_id").alias("voters"))


def entries_with_names(flags: DataFrame, registry: DataFrame, year: int | None = None) -> DataFrame:
    """``entries_by_constituency_rule`` with the seat's name: the greatest that any record named by a flag has there.

    Names come once a seat instead of once an entry, so that only the seats' rows are joined.
    """
    people = registry if year is None else registry.where(F.col("year") == year)
    seats = people.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"), "constituency_name")
    sides = flags.select("rule", "voter_id").unionByName(flags.where("related_voter_id IS NOT NULL").select("rule", F.col("related_voter_id").alias("voter_id")))
    named = sides.join(sorted_join(seats), "voter_id").groupBy("constituency", "rule").agg(F.count("*").alias("entries"), F.count_distinct("voter_id").alias("voters"), F.max("constituency_name").alias("_name"))
    return named.withColumn("constituency_name", F.max("_name").over(Window.partitionBy("constituency"))).drop("_name")  # a row for each rule


def verdict_counts(reviews: DataFrame) -> DataFrame:
    return latest_reviews(reviews).groupBy("verdict").agg(F.count("*").alias("flags"))


def overview(flags: DataFrame, reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: voters, flags by severity (unknown ones count as low), reviewed, open."""
    seen = flags.join(sorted_join(reviews.select(F.col("flag_id").alias("id")).distinct()), "id", "left_semi")
    totals = flags.agg(
        F.count("*").alias("flags"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(~F.coalesce(F.col("severity").isin("high", "medium"), F.lit(False))).alias("low"),
    )
    row = totals.crossJoin(seen.agg(F.count("*").alias("reviewed"))).crossJoin(registry.agg(F.count("*").alias("voters")))  # one row each
    return row.withColumn("open", F.greatest(F.lit(0), F.col("flags") - F.col("reviewed")))


def top_constituencies(flags: DataFrame, registry: DataFrame, n: int = 12) -> DataFrame:
    seats = registry.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"))
    return flags.join(sorted_join(seats), "voter_id").groupBy("constituency").agg(F.count("*").alias("flags")).orderBy(F.desc("flags"), "constituency").limit(n)


def seat_reports(flags: DataFrame, registry: DataFrame, rule: str | None = None, year: int | None = None) -> DataFrame:
    """The flags with their voter's seat and ``report``, the seat's place by number of flags: 1 is the largest, ties by name.

    Only the seats' totals, a row each, are ordered in one place.
    """
    people = registry if year is None else registry.where(F.col("year") == year)
    seats = people.select(F.col("id").alias("voter_id"), tx.seat_key(F.col("constituency_no")).alias("constituency"))
    rows = (flags if rule is None else flags.where(F.col("rule") == rule)).join(sorted_join(seats), "voter_id")
    totals = rows.groupBy("constituency").agg(F.count("*").alias("n_flags"))
    places = totals.withColumn("report", F.row_number().over(Window.orderBy(F.desc("n_flags"), "constituency")))
    return rows.join(places, "constituency")


def write_seat_reports(reports: DataFrame, path: str) -> None:
    """One folder per seat, named by place and seat, so that a listing shows the largest first."""
    name = F.concat(F.lpad(F.col("report").cast("string"), 5, "0"), F.lit("_"), tx.file_stem(F.col("constituency")))
    reports.withColumn("seat", name).write.partitionBy("seat").mode("overwrite").parquet(path)


def touching(flags: DataFrame, ids: DataFrame) -> DataFrame:
    """Flags with one of ``ids`` (voter_id) on either side, each once: two semi-joins instead of an OR-join."""
    first = flags.join(ids, "voter_id", "left_semi")
    second = flags.join(ids.select(F.col("voter_id").alias("related_voter_id")), "related_voter_id", "left_semi").select(*flags.columns)
    return first.select(*flags.columns).union(second).dropDuplicates(["id"])


def of_year(flags: DataFrame, registry: DataFrame, year: int, rules: list[str]) -> DataFrame:
    """Flags of some rules whose voter is in a year."""
    ids = registry.where(F.col("year") == year).select(F.col("id").alias("voter_id"))
    return flags.where(F.col("rule").isin(*rules)).join(sorted_join(ids), "voter_id", "left_semi")


def overload_members(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per occupant of each overloaded house: flag_id, year, seat, house, occupant."""
    houses = flags.where("rule = 'house_overload'").select(
        F.col("id").alias("flag_id"), F.col("voter_id"), F.get_json_object("details", "$.house_norm").alias("house_norm")
    ).join(registry.select(F.col("id").alias("voter_id"), "year", "constituency_no"), "voter_id").drop("voter_id").alias("h")
    people = registry.select("id", "year", "constituency_no", "house_norm", "name", "part_no", "serial_no").alias("p")
    same = F.expr("h.year = p.year AND coalesce(h.constituency_no, '') = coalesce(p.constituency_no, '') AND h.house_norm = p.house_norm")
    return houses.join(people, same).select("flag_id", "h.year", "h.constituency_no", "h.house_norm", "p.id", "p.name", "p.part_no", "p.serial_no")


def house_members(registry: DataFrame, constituency: str | None, house: str, year: int) -> DataFrame:
    """A house in roll order; a missing seat equals an empty one."""
    return registry.where(
        (F.coalesce("constituency_no", F.lit("")) == (constituency or "")) & (F.col("house_norm") == house) & (F.col("year") == year)
    ).orderBy(tx.digits_as_int(F.col("part_no")).asc_nulls_last(), F.asc_nulls_last("serial_no"), "id")
