"""Page text made from the register, in the layouts that rolls are printed in.

One document per year, part and block of 8000 keys; up to six keys a page; the layout
changes from page to page. Parsing must give back what was rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollkin.plans import expected_sql as ref
from rollkin.sources import registry as rg

DOC = "concat('D', cast(year AS string), '-', part_no, '-', cast(id - id % 8000 AS string))"
PAGE = "cast(id % 8000 - (id % 8000) % 6 AS int)"
SERIAL = "cast(1 + id % 8000 AS int)"
WHERE = "age IS NOT NULL AND epic_no LIKE 'ABC%'"

SQL = f"""{ref.BASE},
recs AS (SELECT {DOC} AS doc_id, {PAGE} AS page_index, {SERIAL} AS serial, part_no, epic_no, trim(regexp_replace(name, '^[ :.,-]+', '')) AS name, relation_type, relation_name, house_number, age, gender FROM reg WHERE {WHERE}),
pages0 AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1)::INT AS page_index FROM (SELECT DISTINCT doc_id, page_index FROM recs))"""
RECORDS = "SELECT doc_id, CAST(serial AS VARCHAR) AS serial_no, epic_no, name, relation_type, relation_name, house_number, CAST(age AS VARCHAR) AS age, gender FROM recs"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_index, text): normal, transposed and supplement layouts in turn."""
    rows = rg.derived_registry(spark, sf_dir).where(WHERE).selectExpr(
        f"{DOC} AS doc_id", f"{PAGE} AS page_index", f"{SERIAL} AS serial", "part_no", "epic_no", "name", "relation_type", "relation_name", "house_number", "age", "gender"
    )
    body = F.format_string(
        "Name : %s %ss Name: %s House Number : %s Age : %d Gender : %s", "name", "relation_type", "relation_name", "house_number", "age", "gender"
    )
    row = F.struct("serial", "epic_no", body.alias("body"))
    page = rows.groupBy("doc_id", "page_index", "part_no").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    join = lambda f, sep: F.array_join(F.transform("rows", f), sep)
    bar, serial = F.lit(" | "), lambda x: x["serial"].cast("string")
    normal = join(lambda x: F.concat(F.lit("| **"), serial(x), F.lit("** "), x["body"], bar, x["epic_no"], F.lit(" |")), "\n")
    names = F.concat(F.lit("| "), join(lambda x: x["body"], " | "), F.lit(" |"))
    crossed = F.concat(F.lit("| "), join(lambda x: F.concat(serial(x), bar, x["epic_no"]), " | "), F.lit(" |\n"), names)
    added = F.concat(F.lit("| "), join(lambda x: F.concat(serial(x), F.lit(" | 1 | "), x["epic_no"]), " | "), F.lit(" |\n"), names)
    text = F.when(F.col("page_index") % 18 == 0, normal).when(F.col("page_index") % 18 == 6, crossed).otherwise(added)
    head = F.concat(F.lit("Assembly Constituency No and Name : 7-EXAMPLETON\nPart No. : "), F.col("part_no"), F.lit("\n"))
    return page.select("doc_id", "page_index", F.concat(head, text).alias("text"))


def numbered(found: DataFrame) -> DataFrame:
    """Pages with consecutive indexes from 0 in each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1
    return found.withColumn("page_index", place)
