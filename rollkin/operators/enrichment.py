"""Enrichment as table work: work lists, applying looked-up records, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollkin.functions import text as tx
from rollkin.sources.scratch import written

# Fields of a looked-up record and the register's columns that they go to.
PAYLOAD_FIELDS = {
    "epicName": "verified_name", "dobVerified": "verified_dob", "mobileNo": "mobile_no", "fathersOrGuardianName": "father_or_guardian_name", "mothersName": "mother_name",
    "spouseName": "spouse_name", "houseNo": "verified_house_no", "partNo": "verified_part_no", "partSerialNo": "part_serial_no", "progenyPartName": "part_name",
    "progenyAcName": "ac_name", "categoryType": "category_type", "relationType": "relation_type_code", "relationPrgyEpic": "relation_epic",
    "relationPrgyName": "relation_name_verified", "districtCd": "district_cd", "stateCd": "state_cd", "surveyChannel": "survey_channel",
    "submittedForRecommendation": "submitted_for_recommendation", "createdDttm": "enum_created_on", "modifiedDttm": "enum_modified_on",
}
AGE_FIELD = "erollAge"


#: Seats up to which their numbers are broadcast.
MOST_SEATS = 100_000


def pending(registry: DataFrame, cap: int = 100) -> DataFrame:
    """IDs to look up: one row per ID (its first seat), at most ``cap`` per seat in ID order."""
    open_rows = registry.where((F.trim("epic_no") != "") & ~F.col("lookup_status").eqNullSafe("Found"))
    one = open_rows.groupBy("epic_no").agg(F.min("constituency_no").alias("constituency_no"))
    place = F.row_number().over(Window.partitionBy("constituency_no").orderBy("epic_no"))
    return one.withColumn("place", place).where(F.col("place") <= cap)


def parse_payload(results: DataFrame, payload: str = "payload", fields: dict[str, str] | None = None) -> DataFrame:
    """Verified columns from a JSON payload by ``fields`` (payload field: column), and ``verified_age``; blanks become null."""
    fields = PAYLOAD_FIELDS if fields is None else fields
    schema = T.StructType([T.StructField(k, T.StringType()) for k in [*fields, AGE_FIELD]])
    parsed = results.withColumn("_p", F.from_json(payload, schema))
    columns = {c: tx.blank_to_null(F.col(f"_p.{k}")) for k, c in fields.items()} | {"verified_age": tx.to_int(F.col(f"_p.{AGE_FIELD}"))}
    return parsed.withColumns(columns).drop("_p", payload)


def apply_verified(registry: DataFrame, verified: DataFrame) -> DataFrame:
    """Every register row of a looked-up ID gets the whole verified record, nulls included, the status Found and the time."""
    columns = [c for c in verified.columns if c != "epic_no"]
    new = verified.select("epic_no", *[F.col(c).alias(f"_v_{c}") for c in columns], F.lit(True).alias("_hit"))
    rows = registry.join(new, "epic_no", "left")
    kept = {c: F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(F.col(c) if c in registry.columns else F.lit(None)) for c in columns}
    seen = {"lookup_status": F.lit("Found"), "lookup_at": F.current_timestamp()}
    kept |= {c: F.when(F.col("_hit"), v).otherwise(F.col(c) if c in registry.columns else F.lit(None)) for c, v in seen.items()}
    return rows.withColumns(kept).select(*dict.fromkeys([*registry.columns, *columns, *seen]))


def lookup_states(batch: DataFrame, results: DataFrame) -> DataFrame:
    """(epic_no, state) of a batch: Found, Not found, Error or Token expired, from a table of results (epic_no, code)."""
    state = (
        F.when(F.col("code") == 200, "Found").when(F.col("code") == 404, "Not found").when(F.col("code") == 401, "Token expired").otherwise("Error")
    )
    return batch.select("epic_no").distinct().join(results, "epic_no", "left").select("epic_no", state.alias("state"))


def run_stats(states: DataFrame, registry: DataFrame) -> DataFrame:
    """Per state: IDs and the register rows they stand for."""
    return states.join(registry.select("epic_no", "id"), "epic_no").groupBy("state").agg(F.count_distinct("epic_no").alias("ids"), F.count("id").alias("rows"))


def stats_by_seat(states: DataFrame, registry: DataFrame) -> DataFrame:
    """As ``run_stats``, for each seat of the register rows."""
    rows = registry.select("epic_no", "id", tx.seat_key(F.col("constituency_no")).alias("constituency"))
    return states.join(rows, "epic_no").groupBy("constituency", "state").agg(F.count_distinct("epic_no").alias("ids"), F.count("id").alias("rows"))


def progress(registry: DataFrame) -> DataFrame:
    """Per seat: distinct IDs, looked up, still to do."""
    rows = registry.where(F.trim("epic_no") != "")
    done = F.col("lookup_status").eqNullSafe("Found")
    return rows.groupBy(tx.seat_key(F.col("constituency_no")).alias("constituency")).agg(
        F.count_distinct("epic_no").alias("ids"), F.count_distinct(F.when(done, F.col("epic_no"))).alias("done"), F.count_distinct(F.when(~done, F.col("epic_no"))).alias("pending"),
    )


def route(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Each ID's result from its own seat, else from any seat (the first by name)."""
    own = results.select("epic_no", "constituency_no", F.col("payload").alias("own"))
    other = results.groupBy("epic_no").agg(F.min_by("payload", "constituency_no").alias("other"))
    return wanted.join(own, ["epic_no", "constituency_no"], "left").join(other, "epic_no", "left").select(
        "epic_no", "constituency_no", F.coalesce("own", "other").alias("payload"), F.when(F.col("own").isNotNull(), "own seat").when(F.col("other").isNotNull(), "other seat").alias("source"),
    )


def by_seat(work: DataFrame) -> DataFrame:
    """A work list with a partition for each seat, so that a task works one seat and no other.

    Seats are numbered in order and a row goes to the partition of its seat's number. A
    missing seat is one of its own.
    """
    seats = work.select(tx.seat_key(F.col("constituency_no")).alias("_seat")).distinct()
    numbered = written(seats.withColumn("_number", F.row_number().over(Window.orderBy("_seat")) - 1), "seats")  # a row for each seat
    n = numbered.count()
    rows = work.withColumn("_seat", tx.seat_key(F.col("constituency_no"))).join(F.broadcast(numbered) if n <= MOST_SEATS else numbered, "_seat")
    return rows.repartitionById(max(1, n), F.col("_number").cast("int")).drop("_seat", "_number")
