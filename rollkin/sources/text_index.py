"""A posting index for substring search over several text columns.

A posting is (gram, id, field, value): each three characters of a lower-cased value, with
the record and the value itself. Postings are range-partitioned and sorted by gram, so the
files' statistics tell a reader which of them can hold a gram; a hot gram spreads over
several files. A search reads the list of the one gram of the query that the fewest
postings have, and checks the whole query on the values in it: the register isn't read.

Values are padded at the end, so that a query of one or two characters is the beginning
of some gram of every value that holds it; such a search reads a range of lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Stands after the end of a value; no value or query that is searched for holds it.
END = "\x00"


def folded(value: Column) -> Column:
    return F.lower(value)


def postings(rows: DataFrame, fields: dict[str, Column], key: str = "id") -> DataFrame:
    """(gram, id, field, value) of all fields that aren't null or empty, each gram of a value once."""
    values = F.array(*[F.struct(F.lit(name).alias("field"), folded(c).alias("value")) for name, c in fields.items()])
    long = rows.select(F.col(key).alias("id"), F.explode(values).alias("v")).select("id", "v.*").where("value <> ''")
    padded = F.concat(F.col("value"), F.lit(END * (GRAM - 1)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substr(padded, i, F.lit(GRAM))))
    return long.select(F.explode(grams).alias("gram"), "id", "field", "value")


def build(rows: DataFrame, fields: dict[str, Column], path: str, key: str = "id") -> None:
    """Writes the postings of ``rows`` and the number of postings of each gram to ``path``."""
    lists = postings(rows, fields, key)
    lists.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{path}/lists")
    stored = rows.sparkSession.read.parquet(f"{path}/lists")
    stored.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def _rarest(spark: SparkSession, path: str, query: str) -> tuple[str, int]:
    """The gram of ``query`` with the fewest postings, and their number; a row for each gram of the query is read."""
    grams = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(*grams)).collect()}
    return min(((g, counts.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))


def matches(spark: SparkSession, path: str, query: str, fields: list[str] | None = None) -> DataFrame:
    """Distinct ids of records with a field (of ``fields``, by default any) that holds ``query``, whatever the case.

    An empty query, or one with the character that stands for a value's end, matches nothing.
    """
    wanted = query.lower()
    lists = spark.read.parquet(f"{path}/lists")
    if not wanted or END in wanted:
        return lists.where("false").select("id")
    if len(wanted) >= GRAM:
        gram, n = _rarest(spark, path, wanted)
        found = lists.where(F.col("gram") == gram) if n else lists.where("false")
    else:
        found = lists.where(F.col("gram").startswith(wanted))
    found = found.where(F.col("value").contains(wanted))
    return (found.where(F.col("field").isin(*fields)) if fields else found).select("id").distinct()
