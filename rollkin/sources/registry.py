"""The register: its schema, loading and upserting, and a register derived from ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollkin.functions import text as tx
from rollkin.sources.scratch import written

NATURAL_KEY = ["year", "constituency_no", "part_no", "serial_no", "epic_no"]
TEXT_COLUMNS = ["constituency_no", "constituency_name", "part_no", "epic_no", "name", "relation_type", "relation_name", "house_number", "gender", "photo_id"]
DEFAULT_YEAR = 2025

# The columns of a result list, and the fields of a dossier with their labels. The national ID is left out.
LIST_COLUMNS = [
    "id", "year", "constituency_no", "part_no", "serial_no", "epic_no", "name", "relation_type", "relation_name", "house_number", "age", "gender", "lookup_status",
    "verified_name", "verified_dob", "mobile_no", "father_or_guardian_name", "mother_name", "part_serial_no", "ac_name", "category_type", "lookup_at",
]
REGISTER_FIELDS = {
    "Year": "year", "AC": "constituency_no", "AC name": "constituency_name", "Part": "part_no", "Serial": "serial_no", "EPIC": "epic_no", "Roll name": "name", "Relation": "relation_type",
    "Relation name": "relation_name", "House": "house_number", "Age": "age", "Gender": "gender",
}
VERIFIED_FIELDS = {
    "Verified name": "verified_name", "Verified DOB": "verified_dob", "Verified age": "verified_age", "Mobile": "mobile_no", "Father / guardian": "father_or_guardian_name",
    "Mother": "mother_name", "Spouse": "spouse_name", "Category": "category_type", "Relation type": "relation_type_code", "Relation / progeny EPIC": "relation_epic",
    "Relation / progeny name": "relation_name_verified", "Verified house": "verified_house_no", "Verified part": "verified_part_no", "Part serial": "part_serial_no",
    "Part name": "part_name", "AC name": "ac_name", "District": "district_cd", "State": "state_cd", "Survey channel": "survey_channel",
    "Submitted for recommendation": "submitted_for_recommendation", "Enum created": "enum_created_on", "Enum modified": "enum_modified_on", "Lookup officer": "lookup_officer",
    "Lookup AC": "lookup_ac_no", "Enrichment status": "lookup_status",
}

#: Columns of the derived register; k, s, t, n, b are the part's key, size, type, upper-case name and brand
#: number. The expressions mean the same in Spark SQL and in DuckDB.
DERIVED = {
    "id": "k",
    "serial_no": "k",
    "year": "2024 + k % 2",
    "constituency_no": "CASE WHEN k % 61 = 0 THEN '' ELSE concat('S', cast(s % 5 AS string)) END",
    "part_no": "cast(k % 4 AS string)",
    "epic_no": "CASE WHEN k % 53 = 0 THEN '' WHEN k % 47 = 0 THEN concat('X', cast(k AS string)) "
    "WHEN k % 41 = 0 AND k >= 2 THEN concat('ABC', lpad(cast(k - 2 AS string), 7, '0')) ELSE concat('ABC', lpad(cast(k AS string), 7, '0')) END",
    "name": "CASE WHEN k % 11 = 0 THEN replace(n, 'R', 'RR') WHEN k % 13 = 0 THEN concat('MR. ', n) ELSE n END",
    "relation_type": "CASE k % 4 WHEN 0 THEN 'Father' WHEN 1 THEN 'Husband' WHEN 2 THEN 'Mother' ELSE 'Other' END",
    "relation_name": "concat(t, ' ', chr(64 + b))",
    "house_number": "CASE WHEN k % 37 = 0 THEN '' ELSE concat(chr(65 + s % 3), '-', cast(s % 4 AS string)) END",
    "age": "CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN 110 ELSE s + 15 + k % 3 END",
    "gender": "CASE WHEN k % 7 = 0 THEN '' WHEN (k + s) % 2 = 0 THEN 'Male' ELSE 'Female' END",
    "verified_name": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 17 = 0 THEN concat(n, ' JR') ELSE n END",
    "verified_dob": "CASE WHEN k % 6 = 5 THEN NULL WHEN k % 5 = 0 THEN concat(cast(2009 - s AS string), '-01-01') "
    "ELSE concat(cast(2009 - s AS string), '-', lpad(cast(1 + s % 12 AS string), 2, '0'), '-', lpad(cast(2 + b % 27 AS string), 2, '0')) END",
    "mobile_no": "CASE WHEN k % 10 = 0 THEN '9000000000' WHEN k % 4 = 1 THEN concat('9', lpad(cast(k - k % 12 AS string), 9, '0')) END",
    "relation_epic": "CASE WHEN k % 3 = 1 THEN concat('ABC', lpad(cast(CASE WHEN k % 240 < 60 THEN k - k % 60 + 1 ELSE k - k % 14 + 1 END AS string), 7, '0')) END",
    "relation_type_code": "CASE WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'FTHR' ELSE 'GMTH' END END",
    "category_type": "CASE WHEN k % 9 = 0 THEN 'na' WHEN k % 3 = 1 THEN 'progeny' ELSE 'self' END",
    "father_or_guardian_name": "CASE WHEN k % 2 = 0 THEN concat(t, ' ', chr(65 + b % 4)) END",
    "mother_name": "CASE WHEN k % 2 = 0 THEN concat('MOTHER ', chr(65 + s % 6)) END",
    "spouse_name": "CASE WHEN k % 4 = 1 THEN concat('SPOUSE ', chr(65 + s % 5)) END",
    "verified_age": "CASE WHEN k % 6 = 1 THEN s + 14 + k % 4 END",
    "national_id_hash": "CASE WHEN k % 8 = 3 THEN concat('h', cast(k - k % 16 AS string)) END",
    "lookup_status": "CASE k % 5 WHEN 0 THEN 'Found' WHEN 1 THEN 'Not found' WHEN 2 THEN 'Error' END",
    "phash": "(k - k % 19) * 31 + s",
}
BIGINT = ("id", "phash")
INTEGER = ("serial_no", "year", "age", "verified_age")


def parts_as_base(sql_from: str = "part") -> str:
    """SQL with the part columns under the short names that ``DERIVED`` uses."""
    return f"SELECT p_partkey AS k, p_size AS s, p_type AS t, upper(p_name) AS n, cast(substr(p_brand, 7) AS int) AS b FROM {sql_from}"


def _cast(name: str, expression: str) -> str:
    kind = "bigint" if name in BIGINT else "int" if name in INTEGER else "string"
    return f"cast({expression} AS {kind}) AS {name}"


def derived_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register that a folder's ``part`` table stands for, with normalised columns.

    It is written once, as a register is stored in practice, so that rules read the
    normalised columns instead of deriving them in every branch of a plan.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey AS k", "p_size AS s", "p_type AS t", "upper(p_name) AS n", "cast(substr(p_brand, 7) AS int) AS b"
    )
    # one input file is one partition: spread the rows before any pair work
    rows = with_derived_columns(part.selectExpr(*[_cast(c, e) for c, e in DERIVED.items()]).repartition("id"))
    return written(rows, "register")


def with_derived_columns(registry: DataFrame) -> DataFrame:
    """Adds name_norm, relation_name_norm, house_norm and name_phonetic."""
    return registry.withColumns({
        "name_norm": tx.norm_name(F.col("name")), "relation_name_norm": tx.norm_name(F.col("relation_name")), "house_norm": tx.norm_house(F.col("house_number")),
    }).withColumn("name_phonetic", tx.phonetic(F.col("name_norm")))


def scan_year(registry: DataFrame, year: int, *columns: str) -> DataFrame:
    """One revision year, only the columns a rule needs; prunes partitions where stored by year."""
    return registry.where(F.col("year") == year).select(*(columns or ["*"]))


def prepare_ingest(rows: DataFrame, source_file: Column, year: int | None = None) -> DataFrame:
    """Extracted rows as register rows: clean cells, integers, year, normalised columns; rows without a name go.

    The year is the given one, else that in the file name, else the default. Of rows with
    one natural key the last (highest ``ingest_order``) stays.
    """
    clean = rows.withColumns({c: tx.clean_cell(F.col(c)) for c in TEXT_COLUMNS if c in rows.columns})
    typed = clean.withColumns({
        "source_file": source_file,
        "serial_no": tx.to_int(F.col("serial_no")), "age": tx.to_int(F.col("age")),
        "year": F.coalesce(F.lit(year).cast("int"), tx.year_of_file(source_file), F.lit(DEFAULT_YEAR)),
    }).where("name <> ''")
    last = F.row_number().over(Window.partitionBy(*NATURAL_KEY).orderBy(F.desc("ingest_order")))
    return with_derived_columns(typed.withColumn("_last", last).where("_last = 1").drop("_last"))


def upsert(old: DataFrame, new: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; null key parts are equal.

    Write the result with ``partitionBy("year")`` and dynamic overwrite, so that only
    the years in ``new`` are rewritten.
    """
    same = [old[k].eqNullSafe(new[k]) for k in key or NATURAL_KEY]
    return old.join(new, same, "left_anti").unionByName(new, allowMissingColumns=True)


def write_years(registry: DataFrame, path: str) -> None:
    """Stores a register by year; years that aren't in it stay as they are."""
    registry.write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ingest_audit(rows: DataFrame) -> DataFrame:
    """One row per source file: seat, part, row count and photo count."""
    return rows.groupBy("source_file").agg(
        F.min("constituency_no").alias("constituency_no"), F.min("part_no").alias("part_no"), F.min("year").alias("year"),
        F.count("*").alias("row_count"), F.count_if(F.coalesce(F.col("photo_id"), F.lit("")) != "").alias("photo_count"),
    )


def backfill_year(registry: DataFrame) -> DataFrame:
    return registry.withColumn("year", F.coalesce("year", F.lit(DEFAULT_YEAR)))


def attach_photos(registry: DataFrame, photos: DataFrame, order: str = "photo_order") -> DataFrame:
    """(voter_id, photo_id, phash) of the last photo that each register row's photo_id names."""
    found = registry.where("coalesce(photo_id, '') <> ''").select(F.col("id").alias("voter_id"), "photo_id").join(photos, "photo_id")
    return found.groupBy("voter_id").agg(F.max_by(F.struct("photo_id", "phash"), order).alias("p")).select("voter_id", "p.*")


def photos_of(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Photos of a set of voter ids, in one semi-join."""
    return photos.join(ids, "voter_id", "left_semi")


def documents_of(documents: DataFrame, epics: DataFrame) -> DataFrame:
    """Stored documents of a set of IDs, with their byte length."""
    return documents.join(epics, "epic_no", "left_semi").withColumn("n_bytes", F.length("image"))


def store_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What of ``incoming`` isn't stored yet, one per (epic_no, doc_type): append this to the store."""
    first = F.row_number().over(Window.partitionBy("epic_no", "doc_type").orderBy("fetched_at"))
    return incoming.join(stored, ["epic_no", "doc_type"], "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def history_of(registry: DataFrame, epics: DataFrame) -> DataFrame:
    """All years' rows of a set of IDs, newest year first within an ID."""
    return registry.join(epics, "epic_no", "left_semi").orderBy("epic_no", F.desc("year"), "id")


def trim_pages(pages: DataFrame, drop_first: int = 2, drop_last: int = 2) -> DataFrame:
    """Pages without a document's cover and summary pages; documents too short for that stay whole."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    place = F.col("page_index")
    return pages.withColumn("_n", n).where(
        (F.col("_n") <= drop_first + drop_last) | ((place >= drop_first) & (place < F.col("_n") - drop_last))
    ).drop("_n")


def page_batches(pages: DataFrame, size: int = 15, whole: int = 25) -> DataFrame:
    """``batch_id`` by page index, 0 for documents of up to ``whole`` pages; the index stays global."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return pages.withColumn("batch_id", F.when(n <= whole, 0).otherwise(F.floor(F.col("page_index") / size)).cast("int"))


def parsed_or_untrimmed(trimmed_rows: DataFrame, untrimmed_rows: DataFrame) -> DataFrame:
    """Rows parsed from trimmed pages, and all rows of documents for which trimming left none."""
    return trimmed_rows.unionByName(untrimmed_rows.join(trimmed_rows, "doc_id", "left_anti"))


def list_rows(registry: DataFrame) -> DataFrame:
    """The columns of a result list; what a register doesn't have is null."""
    return registry.select(*[F.col(c) if c in registry.columns else F.lit(None).cast("string").alias(c) for c in LIST_COLUMNS])


def all_fields(registry: DataFrame) -> DataFrame:
    """(id, block, label, value): the enrolled and the verified fields of each record that aren't blank, under their labels."""
    one = lambda block, label, c: F.struct(F.lit(block).alias("block"), F.lit(label).alias("label"), F.trim(F.col(c).cast("string")).alias("value"))
    blocks = {"register": REGISTER_FIELDS, "verified": VERIFIED_FIELDS}
    found = F.array(*[one(block, label, c) for block, fields in blocks.items() for label, c in fields.items() if c in registry.columns])
    return registry.select("id", F.explode(F.filter(found, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("f")).select("id", "f.*")


def dossier_fields(registry: DataFrame, fields: list[str]) -> DataFrame:
    """(id, label, value): the fields of each record that aren't blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("label"), F.col(f).cast("string").alias("value")) for f in fields])
    return registry.select("id", F.explode(F.filter(pairs, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("f")).select("id", "f.*")
