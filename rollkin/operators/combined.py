"""One ranked report per person: logical findings, missing category, duplicate leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.functions import dates as dt
from rollkin.functions import text as tx
from rollkin.operators import rules
from rollkin.sources import binaries
from rollkin.sources.named_files import range_name, write_named
from rollkin.sources.scratch import sorted_join, written

PARENT_RELATIONS = ("FTHR", "MTHR", "FATHER", "MOTHER", "F", "M")
CHECKS = ["progeny_overload", "father_name_conflict", "parent_age_under_15", "parent_age_over_50", "grandparent_age_le_40", "age_dob_gap"]


def progeny_counts(registry: DataFrame) -> DataFrame:
    """(year, reference, progeny): distinct IDs that name a reference."""
    rows = registry.withColumn("reference", tx.blank_to_null(F.col("relation_epic"))).where("reference IS NOT NULL")
    return rows.groupBy("year", "reference").agg(F.count_distinct(tx.blank_to_null(F.col("epic_no"))).alias("progeny"))


def _same_reference(registry: DataFrame) -> DataFrame:
    """(year, reference, id, entry) of the records that name a reference with 6 or more IDs."""
    entry = F.concat(tx.preferred_name(F.col("verified_name"), F.col("name")), F.lit(" ("), F.coalesce(F.nullif(F.col("epic_no"), F.lit("")), F.lit("no ID")), F.lit(")"))
    rows = registry.select("id", "year", tx.blank_to_null(F.col("relation_epic")).alias("reference"), entry.alias("entry"))
    return rows.join(sorted_join(progeny_counts(registry).where("progeny >= 6").select("year", "reference")), ["year", "reference"])


def siblings(registry: DataFrame) -> DataFrame:
    """(id, year, reference, others): how many others name the same reference, for references with 6 or more IDs.

    The group itself is (year, reference); ``siblings_of`` lists it for persons who are shown.
    """
    rows = _same_reference(registry).drop("entry")
    sizes = rows.groupBy("year", "reference").agg((F.count("*") - 1).alias("others"))
    return rows.join(sorted_join(sizes), ["year", "reference"]).select("id", "year", "reference", "others")


def siblings_of(registry: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, sibling, entry): a row for each sibling of the persons (id) that are shown."""
    rows = _same_reference(registry)
    shown = rows.join(persons.select("id").distinct(), "id", "left_semi").select("year", "reference", F.col("id").alias("person"))
    return rows.join(shown, ["year", "reference"]).where("id <> person").select(F.col("person").alias("id"), F.col("id").alias("sibling"), "entry")


def findings(registry: DataFrame) -> DataFrame:
    """(id, check, severity, gap): the logical checks that fire, one row each."""
    rows = registry.select(
        "id", "year", "age", tx.blank_to_null(F.col("relation_epic")).alias("reference"), F.upper(F.coalesce(F.trim("relation_type_code"), F.lit(""))).alias("code"),
        dt.best_age(F.col("verified_age"), F.col("age")).alias("own_age"), dt.real_dob(F.col("verified_dob")).alias("born"),
    )
    enrolled = rules.first_by_epic(registry).select(
        "year", "epic_no", dt.best_age(F.col("verified_age"), F.col("age")).alias("their_age"), tx.blank_to_null(F.col("relation_epic")).alias("their_reference")
    )
    parents = enrolled.select("year", F.col("epic_no").alias("reference"), F.col("their_age").alias("parent_age"), F.col("their_reference").alias("up"), F.lit(True).alias("resolved"))
    elders = enrolled.select("year", F.col("epic_no").alias("up"), F.col("their_age").alias("elder_age"))
    context = rows.join(sorted_join(progeny_counts(registry)), ["year", "reference"], "left").join(
        sorted_join(rules.reference_groups(registry).select("year", "reference", F.size("father_names").alias("fathers"))), ["year", "reference"], "left"
    ).join(sorted_join(parents), ["year", "reference"], "left").join(sorted_join(elders), ["year", "up"], "left")
    is_parent, is_elder = F.col("code").isin(*PARENT_RELATIONS), F.col("code").isin(*tx.GRANDPARENT_CODES)
    parent_gap = F.when(is_parent, F.col("parent_age") - F.col("own_age"))
    elder_gap = F.when(is_elder, F.col("parent_age")).when(is_parent, F.col("elder_age")) - F.col("own_age")
    dob_gap = F.abs(F.col("age") - dt.age_on_new_year(F.col("born"), F.col("year")))
    found = F.array(
        _finding("progeny_overload", F.col("progeny") >= 6, F.when(F.col("progeny") >= 10, "high").otherwise("medium"), F.col("progeny")),
        _finding("father_name_conflict", F.col("fathers") >= 2, F.lit("low"), F.col("fathers")),
        _finding("parent_age_under_15", parent_gap < 15, F.lit("high"), parent_gap),
        _finding("parent_age_over_50", parent_gap > 50, F.lit("medium"), parent_gap),
        _finding("grandparent_age_le_40", elder_gap <= 40, F.lit("high"), elder_gap),
        _finding("age_dob_gap", dob_gap > 5, F.when(dob_gap > 10, "high").otherwise("medium"), dob_gap),
    )
    return context.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("id", "f.check", "f.severity", "f.gap")


def _finding(name: str, fires: Column, severity: Column, gap: Column) -> Column:
    return F.when(fires, F.struct(F.lit(name).alias("check"), severity.alias("severity"), gap.cast("int").alias("gap")))


def duplicate_map(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, model, partner, score, severity): both sides of each cosine_new and fuzzy_new flag."""
    pair = F.explode(F.array(
        F.struct(F.col("voter_id").alias("id"), F.col("related_voter_id").alias("partner")), F.struct(F.col("related_voter_id").alias("id"), F.col("voter_id").alias("partner"))
    ))
    sides = flags.where("rule IN ('cosine_new', 'fuzzy_new') AND related_voter_id IS NOT NULL").select(
        F.when(F.col("rule") == "cosine_new", "cosine").otherwise("fuzzy").alias("model"), "score", "severity", pair.alias("p")
    ).select("p.id", "model", "p.partner", F.bround(F.col("score").cast("double"), 3).alias("score"), "severity")
    partners = registry.select(F.col("id").alias("partner"), F.col("epic_no").alias("partner_epic"), tx.preferred_name(F.col("verified_name"), F.col("name")).alias("partner_name"))
    return sides.join(sorted_join(partners), "partner", "left")


def lead_lists(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """``rules.lead_totals`` of stored flags, with each person's partners in one row as ``duplicates``, the best first."""
    return duplicate_map(flags, registry).groupBy("id").agg(
        F.count_if(F.col("model") == "cosine").alias("n_cosine"), F.count_if(F.col("model") == "fuzzy").alias("n_fuzzy"), F.max("score").alias("best_dup"),
        F.max(tx.severity_rank(F.col("severity"))).alias("dup_rank"),
        F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("partner"), F.col("model"), F.col("partner_epic"), F.col("partner_name"))), asc=False).alias("duplicates"),
    )


def report(registry: DataFrame, flags: DataFrame | None, constituency: str | None = None, leads: DataFrame | None = None) -> DataFrame:
    """One row per person with any signal, with severity, tier, best duplicate score and summary.

    Context (references, parents, duplicates) is of the whole year; the seat only
    chooses which persons are shown, so it is applied last. ``leads``: totals by person
    (``rules.lead_totals``) instead of ``flags``; partners aren't in the report then.
    """
    leads = lead_lists(flags, registry) if leads is None else leads
    logical = findings(registry).groupBy("id").agg(
        F.count("*").alias("n_logical"), F.max(tx.severity_rank(F.col("severity"))).alias("logical_rank"),
        F.sort_array(F.collect_list(F.struct("check", "severity", "gap"))).alias("logical"),
    )
    people = registry.select(
        "id", "year", "epic_no", tx.seat_key(F.col("constituency_no")).alias("constituency"), "part_no", "serial_no", "age", "gender",
        tx.preferred_name(F.col("verified_name"), F.col("name")).alias("name"), (F.lower(F.trim("category_type")) == "na").alias("no_mapping"),
    )
    rows = people.join(sorted_join(logical), "id", "left").join(sorted_join(leads), "id", "left").fillna(0, ["n_logical", "logical_rank", "n_cosine", "n_fuzzy", "best_dup", "dup_rank"])
    rows = rows.withColumn("no_mapping", F.coalesce("no_mapping", F.lit(False))).where("n_logical > 0 OR no_mapping OR n_cosine + n_fuzzy > 0")
    rank = F.greatest("logical_rank", "dup_rank", F.when(F.col("no_mapping"), 1).otherwise(0))
    n_dups = F.col("n_cosine") + F.col("n_fuzzy")
    times = lambda name, n: F.when(n > 0, F.concat(F.lit(name), n.cast("string")))
    checks = F.array_join(F.array_sort(F.array_distinct(F.transform("logical", lambda x: x["check"]))), ", ")
    shown = rows.withColumns({
        "severity": tx.severity_of(rank), "tier": F.when(n_dups > 0, 0).when(F.col("n_logical") > 0, 1).otherwise(2), "n_dups": n_dups,
        "summary": F.concat_ws(" · ", times("cosine×", F.col("n_cosine")), times("fuzzy×", F.col("n_fuzzy")), F.when(F.col("n_logical") > 0, F.concat(F.lit("logical: "), checks)), F.when(F.col("no_mapping"), "no-mapping (na)")),
    })
    return shown.where(F.col("constituency") == constituency) if constituency else shown


def priority() -> list[Column]:
    """Order of the report: duplicates, logical, no mapping; the strongest first; ties by id."""
    return [F.asc("tier"), F.desc("best_dup"), F.desc("n_dups"), F.desc("logical_rank"), F.desc("n_logical"), F.asc("id")]


def ranked(rows: DataFrame, per_part: int = 50) -> DataFrame:
    """``rank`` over the whole report and ``part`` of ``per_part`` persons.

    The rows are range-partitioned by priority and numbered within partitions; only the
    partitions' sizes are added up in one place.
    """
    sorted_rows = rows.repartitionByRange(*priority()).withColumn("_p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*priority()))
    numbered = written(sorted_rows.withColumn("_n", within), "ranked")  # both uses must see the same partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = numbered.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_before"))  # a row for each partition
    rank = (F.col("_n") + F.col("_before")).cast("long")
    return numbered.join(offsets, "_p").withColumn("rank", rank).withColumn("part", (F.floor((rank - 1) / per_part) + 1).cast("int")).drop("_p", "_n", "_before")


def report_summary(rows: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(
        F.count("*").alias("total"), count(F.col("tier") == 0, "tier_dup"), count(F.col("tier") == 1, "tier_logical"), count(F.col("tier") == 2, "tier_nomap"),
        count(F.col("n_cosine") > 0, "with_cosine"), count(F.col("n_fuzzy") > 0, "with_fuzzy"), count(F.col("n_logical") > 0, "with_logical"),
        count(F.col("no_mapping"), "with_nomap"), count(F.col("severity") == "high", "high"), count(F.col("severity") == "medium", "medium"), count(F.col("severity") == "low", "low"),
    )


def checks_summary(found: DataFrame) -> DataFrame:
    """Findings by check; each is in the report, whatever duplicates a person has."""
    return found.groupBy("check").agg(F.count("*").alias("n"))


def constituencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("constituency").agg(F.count("*").alias("persons")).orderBy(F.desc("persons"), "constituency")


def suspects(rows: DataFrame, constituency: str | None = None, severity: str | None = None, signal: str | None = None, min_matches: int = 0, query: str | None = None) -> DataFrame:
    """The report filtered for review; the query is looked for in ID, name, seat and part together."""
    kinds = {"cosine": F.col("n_cosine") > 0, "fuzzy": F.col("n_fuzzy") > 0, "logical": F.col("n_logical") > 0, "nomap": F.col("no_mapping")}
    rows = rows.where(F.col("constituency") == constituency) if constituency else rows
    rows = rows.where(F.col("severity") == severity) if severity else rows
    rows = rows.where(kinds[signal]) if signal else rows
    rows = rows.where(F.col("n_dups") >= min_matches)
    return rows.where(F.lower(F.concat_ws(" ", "epic_no", "name", "constituency", "part_no")).contains(query.lower())) if query else rows


def dossier(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, epic_no, person, row fields): all years' rows of each person and of every partner, the verified one marked."""
    own = rows.select("id", "epic_no", F.lit("self").alias("role"))
    partner = rows.select("id", F.explode("duplicates").alias("d")).select("id", F.col("d.partner_epic").alias("epic_no"), F.lit("partner").alias("role"))
    wanted = own.union(partner).where("coalesce(epic_no, '') <> ''").distinct()
    history = registry.select("epic_no", F.col("id").alias("row_id"), "year", "name", "age", "lookup_status")
    found = wanted.join(sorted_join(history), "epic_no")
    best = F.row_number().over(Window.partitionBy("id", "role", "epic_no").orderBy(F.when(F.col("lookup_status") == "Found", 0).otherwise(1), F.desc("year"), "row_id"))
    return found.withColumn("best", best == 1)


def _with_partners(rows: DataFrame, registry: DataFrame, by_epic: DataFrame) -> DataFrame:
    """(id, role, epic_no, item): what ``by_epic`` (epic_no, items) has for the ID of each person and of each of their partners."""
    own = rows.where("coalesce(epic_no, '') <> ''").select("id", "epic_no").distinct().join(sorted_join(by_epic), "epic_no").select("id", F.lit("self").alias("role"), "epic_no", "items")
    partner = rules.partner_items(registry, by_epic).select("id", F.lit("partner").alias("role"), "epic_no", "items")
    return own.union(partner).select("id", "role", "epic_no", F.explode("items").alias("item"))


def whole_dossier(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``dossier`` of all persons of a register's report; partners are found here, ``rows`` needn't have them."""
    best = F.row_number().over(Window.partitionBy("epic_no").orderBy(F.when(F.col("lookup_status") == "Found", 0).otherwise(1), F.desc("year"), "id")) == 1
    history = registry.where("epic_no <> ''").select("epic_no", F.struct(F.col("id").alias("row_id"), "year", "name", "age", "lookup_status", best.alias("best")).alias("item"))
    found = _with_partners(rows, registry, history.groupBy("epic_no").agg(F.collect_list("item").alias("items")))
    return found.select("id", "epic_no", "role", "item.*")


def listed_documents(rows: DataFrame, registry: DataFrame, table: str) -> DataFrame:
    """(id, role, epic_no, doc_type, n_bytes): the stored documents of all persons of a register's report and of their partners.

    Images stay where they are; ``dossier_documents`` attaches those of the persons that are shown.
    """
    stored = rows.sparkSession.table(table).where("epic_no <> ''").select("epic_no", F.struct("doc_type", F.length("image").alias("n_bytes")).alias("item"))
    found = _with_partners(rows, registry, stored.groupBy("epic_no").agg(F.collect_list("item").alias("items")))
    return found.select("id", "role", "epic_no", "item.*")


def dossier_documents(found: DataFrame, table: str) -> DataFrame:
    """(id, role, epic_no, doc_type, image, n_bytes): the stored documents of a dossier's persons and partners.

    ``found``: rows of ``dossier``; ``table``: documents that ``binaries.store`` wrote by
    epic_no. Only ids are moved to the documents.
    """
    wanted = found.select("epic_no", "id", "role").distinct()
    return binaries.attached(found.sparkSession, table, wanted, "epic_no").select("id", "role", "epic_no", "doc_type", "image", F.length("image").alias("n_bytes"))


def dossier_photos(found: DataFrame, table: str) -> DataFrame:
    """(id, role, epic_no, row_id, photo_id, image): photos of a dossier's rows; ``table`` was stored by voter_id."""
    wanted = found.select(F.col("row_id").alias("voter_id"), "id", "role", "epic_no").distinct()
    return binaries.attached(found.sparkSession, table, wanted, "voter_id").select("id", "role", "epic_no", F.col("voter_id").alias("row_id"), "photo_id", "image")


def part_files(rows: DataFrame, per_part: int = 50, folder: Column | None = None) -> DataFrame:
    """``ranked`` rows with ``file``, named by the ranks in it: ``0001-0050.csv``, in ``folder`` if there is one.

    With a folder (a seat, say) ranks and parts are counted within it, in the order of
    the whole report.
    """
    if folder is None:
        size = rows.agg(F.max("rank").alias("_most"))  # one row
        placed = rows.crossJoin(size).withColumns({"_at": F.col("rank"), "_folder": F.lit("")})
    else:
        named = rows.withColumn("_folder", F.concat(folder, F.lit("/")))
        within = Window.partitionBy("_folder").orderBy("rank")
        placed = named.withColumns({"_at": F.row_number().over(within).cast("long"), "_most": F.count("*").over(Window.partitionBy("_folder"))})
    first = F.floor((F.col("_at") - 1) / per_part) * per_part + 1
    name = F.concat("_folder", range_name(first, F.least(first + per_part - 1, "_most")), F.lit(".csv"))
    return placed.withColumns({"file": name, "file_place": F.col("_at")}).drop("_at", "_folder", "_most")


#: Columns of a report file, in order.
REPORT_FILE = ["rank", "epic_no", "name", "constituency", "part_no", "serial_no", "age", "gender", "severity", "best_dup", "n_dups", "n_logical", "summary"]


def _write(files: DataFrame, path: str) -> None:
    write_named(files.select(*REPORT_FILE, "file", "file_place"), path, F.col("file"), F.col("file_place"), drop=["file", "file_place"])


def write_parts(rows: DataFrame, path: str, per_part: int = 50) -> None:
    """The ranked report as CSV files of ``per_part`` persons, named by their ranks."""
    _write(part_files(rows, per_part), path)


def write_by_seat(rows: DataFrame, path: str, per_part: int = 50) -> None:
    """As ``write_parts``, a folder for each constituency, ranks counted within it."""
    _write(part_files(rows, per_part, tx.file_stem(F.col("constituency"))), path)


def first_persons(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` persons of the ranked report."""
    return rows.where(F.col("rank") <= n)
