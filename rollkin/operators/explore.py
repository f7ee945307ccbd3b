"""Search over the register: filters, sorts, pages, filter values, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from rollkin.functions import text as tx
from rollkin.sources import text_index
from rollkin.sources.named_files import write_named

PENDING = "Pending"
SEARCHED = ["name", "epic_no", "relation_name", "house_number", "verified_name", "mobile_no", "relation_epic", "father_or_guardian_name", "mother_name"]


@dataclass(frozen=True)
class Filters:
    """What to look for; an empty field doesn't filter."""

    year: int | None = None
    constituencies: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    age_from: int | None = None
    age_to: int | None = None
    has_mobile: bool = False
    has_photo: bool = False
    query: str = ""


def like_pattern(text: str) -> str:
    """A substring pattern in which % and _ stand for themselves."""
    for c in ("\\", "%", "_"):
        text = text.replace(c, f"\\{c}")
    return f"%{text}%"


def search(registry: DataFrame, f: Filters, photos: DataFrame | None = None) -> DataFrame:
    """Rows that satisfy all filters. ``Pending`` among the statuses stands for no status yet."""
    rows = registry
    if f.year is not None:
        rows = rows.where(F.col("year") == f.year)
    for column, values in (
        ("constituency_no", f.constituencies), ("part_no", f.parts), ("gender", f.genders), ("relation_type", f.relation_types), ("category_type", f.categories)
    ):
        rows = rows.where(F.col(column).isin(*values)) if values else rows
    if f.statuses:
        named = [s for s in f.statuses if s != PENDING]
        wanted = F.col("lookup_status").isin(*named) if named else F.lit(False)
        rows = rows.where(wanted | F.col("lookup_status").isNull() if PENDING in f.statuses else wanted)
    if f.age_from is not None:
        rows = rows.where(F.col("age") >= f.age_from)
    if f.age_to is not None:
        rows = rows.where(F.col("age") <= f.age_to)
    if f.has_mobile:
        rows = rows.where("coalesce(mobile_no, '') <> ''")
    if f.has_photo and photos is not None:
        rows = rows.join(photos.select(F.col("voter_id").alias("id")), "id", "left_semi")
    return rows.where(_mentions(f.query)) if f.query.strip() else rows


def _mentions(query: str) -> Column:
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | F.coalesce(F.col(c).ilike(like_pattern(query)), F.lit(False))
    normal = _normal(query)
    return hit | F.coalesce(F.col("name_norm").contains(normal), F.lit(False)) if normal else hit


def index_fields() -> dict[str, Column]:
    """What a text search looks at, by the names that ``indexed_search`` uses."""
    return {**{c: F.col(c) for c in SEARCHED}, "name_norm": F.col("name_norm")}


def build_index(registry: DataFrame, path: str) -> None:
    """Writes the posting index that ``indexed_search`` reads."""
    text_index.build(registry, index_fields(), path)


def indexed_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Ids that a search for ``query`` finds, from the index at ``path`` alone; a blank query finds none."""
    if not query.strip():
        return text_index.matches(spark, path, "")
    found = text_index.matches(spark, path, query, SEARCHED)
    normal = _normal(query)
    return found.union(text_index.matches(spark, path, normal, ["name_norm"])).distinct() if normal else found


def _normal(query: str) -> str:
    return " ".join("".join(x if "A" <= x <= "Z" else " " for x in query.upper()).split())


def sort_orders() -> dict[str, list[Column]]:
    """Named sorts; all end with the id, so that pages are stable."""
    part, serial = tx.digits_as_int(F.col("part_no")).asc_nulls_last(), F.asc_nulls_last("serial_no")
    return {
        "roll": [F.asc("constituency_no"), part, serial, F.asc("id")], "name": [F.asc_nulls_last("name_norm"), F.asc("id")],
        "youngest": [F.asc_nulls_last("age"), F.asc("id")], "oldest": [F.desc_nulls_last("age"), F.asc("id")],
        "id number": [F.asc_nulls_last("epic_no"), F.asc("id")], "house": [F.asc("constituency_no"), F.asc_nulls_last("house_norm"), F.asc("id")],
    }


def page(rows: DataFrame, sort: str = "roll", number: int = 1, size: int = 100) -> DataFrame:
    return rows.orderBy(*sort_orders()[sort]).offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class Key:
    """A column of a total order; nulls come last either way."""

    name: str
    column: Column
    descending: bool = False

    def order(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_last()

    def after(self, value) -> Column:
        """Rows that come later by this key alone."""
        if value is None:
            return F.lit(False)
        return (self.column < F.lit(value) if self.descending else self.column > F.lit(value)) | self.column.isNull()

    def same(self, value) -> Column:
        return self.column.isNull() if value is None else self.column == F.lit(value)


def sort_keys() -> dict[str, list[Key]]:
    """The named sorts as keys that a page can go on from."""
    seat, number = Key("constituency_no", F.col("constituency_no")), Key("id", F.col("id"))
    return {
        "roll": [seat, Key("part", tx.digits_as_int(F.col("part_no"))), Key("serial_no", F.col("serial_no")), number], "name": [Key("name_norm", F.col("name_norm")), number],
        "youngest": [Key("age", F.col("age")), number], "oldest": [Key("age", F.col("age"), True), number], "id number": [Key("epic_no", F.col("epic_no")), number],
        "house": [seat, Key("house_norm", F.col("house_norm")), number],
    }


def _ties(rows: DataFrame, keys: list[Key]) -> list[Column]:
    """The other columns of ``rows``, the name first: they order rows that all ``keys`` leave equal, as where ids repeat."""
    rest = [f.name for f in rows.schema if f.name not in {k.name for k in keys} and not isinstance(f.dataType, MapType)]
    return [F.asc_nulls_last(f"`{c}`") for c in sorted(rest, key=lambda c: c != "name")]


def page_after(rows: DataFrame, sort: str, token: list | None = None, size: int = 100) -> DataFrame:
    """The next ``size`` rows after those up to ``token``, which ``token_of`` gives for the last row seen.

    However deep the page, only the first ``size`` rows beyond the token are kept while
    sorting, and a table that is stored in the order of the sort (``cluster_by``) is read
    from the files that can hold them on: the first key's bound stands by itself. Rows
    that are equal in all keys are counted, so that a page may end among them.
    """
    keys, seen = sort_keys()[sort], 0
    if token is not None:
        *values, seen = token
        later, equal = F.lit(False), F.lit(True)
        for key, value in zip(keys, values, strict=True):
            later, equal = later | (equal & key.after(value)), equal & key.same(value)
        first = keys[0]
        if values[0] is None:
            rows = rows.where(first.column.isNull()).where(later | equal)
        else:  # a range by itself, so that files before it are skipped; rows without a first key come after all others
            known = first.column <= F.lit(values[0]) if first.descending else first.column >= F.lit(values[0])
            rows = rows.where(known).where(later | equal).union(rows.where(first.column.isNull()))
    return rows.orderBy(*[k.order() for k in keys], *_ties(rows, keys)).offset(seen).limit(size)


def token_of(rows: DataFrame, sort: str, before: list | None = None) -> list | None:
    """Where the page after ``rows`` (one page) goes on; None after an empty page.

    A token is the last row's keys and how many rows with these keys were seen. ``before`` is
    the token that the page itself began at: it counts where all of a page is equal in the keys.
    """
    keys = sort_keys()[sort]
    shown = [list(r) for r in rows.select(*[k.column.alias(k.name) for k in keys]).collect()]  # one page
    if not shown:
        return None
    seen = shown.count(shown[-1])
    return [*shown[-1], seen + (before[-1] if before and before[:-1] == shown[-1] else 0)]


def cluster_by(rows: DataFrame, sort: str, path: str) -> None:
    """Stores ``rows`` range-partitioned and sorted as the named sort has them."""
    order = [k.order() for k in sort_keys()[sort]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def export_rows(rows: DataFrame, sort: str = "roll", limit: int = 5000) -> DataFrame:
    """The first rows of a search, in order, for a CSV file."""
    return rows.orderBy(*sort_orders()[sort]).limit(limit)


def write_csv(rows: DataFrame, folder: str, file: str = "export.csv", sort: str = "roll", limit: int = 5000) -> None:
    """The first rows of a search as one CSV file of that name, in order, with a header."""
    first = export_rows(rows, sort, limit)
    place = F.row_number().over(Window.orderBy(*[k.order() for k in sort_keys()[sort]]))  # of at most ``limit`` rows
    write_named(first.withColumn("_at", place), folder, F.lit(file), F.col("_at"), drop=["_at"])


def filter_values(registry: DataFrame) -> DataFrame:
    """(field, value): the distinct values that filters offer."""
    fields = ["constituency_no", "gender", "relation_type", "category_type", "lookup_status"]
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("v")
    return registry.select(pair).select("v.*").where("coalesce(value, '') <> ''").distinct()


def age_range(registry: DataFrame) -> DataFrame:
    return registry.agg(F.coalesce(F.min("age"), F.lit(0)).alias("min_age"), F.coalesce(F.max("age"), F.lit(120)).alias("max_age"))


def parts(registry: DataFrame, constituencies: list[str] | None = None) -> DataFrame:
    """Distinct parts in numeric order."""
    rows = registry.where(F.col("constituency_no").isin(*constituencies)) if constituencies else registry
    return rows.select("part_no").where("coalesce(part_no, '') <> ''").distinct().orderBy(tx.digits_as_int(F.col("part_no")).asc_nulls_last(), "part_no")


def years(registry: DataFrame) -> DataFrame:
    return registry.select("year").distinct().orderBy(F.desc("year"))


def profile(registry: DataFrame, flags: DataFrame, epic: str) -> tuple[DataFrame, DataFrame]:
    """All rows of one ID, newest first, and the flags that touch any of them."""
    from rollkin.operators.flags import touching

    rows = registry.where(F.col("epic_no") == epic).orderBy(F.desc("year"), "id")
    return rows, touching(flags, rows.select(F.col("id").alias("voter_id")))


def profile_documents(spark: SparkSession, table: str, epic: str) -> DataFrame:
    """The stored documents of one ID, newest first; ``table`` was stored by epic_no, and one bucket of it is read."""
    return spark.table(table).where(F.col("epic_no") == epic).orderBy(F.desc("fetched_at"), "doc_type").withColumn("n_bytes", F.length("image"))
