"""Line dedup by distinct-site spread, in DataFrame functions only.

A line that stands on many sites is boilerplate, however often any one site repeats
it. A HyperLogLog sketch of the sites is kept for each line hash; sketches merge by
aggregation. Lines whose estimate is so near to the threshold that the sketch's error
could decide get an exact distinct count. Lines above it are removed from all texts.

A text that is copied to many sites puts all its lines there, though none of them is
boilerplate, and would become empty. Each line's distinct texts are therefore sketched
and counted in the same way, and must reach the threshold too; copies of whole texts are
left to near-duplicate removal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkin.sources.scratch import discard, written

LG_K = 12
#: Affected texts and their line hashes up to which they are broadcast.
SMALL_TEXTS, SMALL_LINES = 500_000, 2_000_000
BLANKS = " \t\n\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _hashed_lines(docs: DataFrame, site_col: str) -> DataFrame:
    """(k1, k2, site, h): hashes of each text and of each of its lines that isn't blank."""
    line = F.explode(F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), line_hash
    )))
    return docs.select(*_text_key("text"), F.col(site_col).cast("string").alias("site"), line.alias("h"))


def _text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes ``h`` of the lines in ``lines`` (k1, k2, site, h) that at least ``min_sites`` distinct sites and as many distinct texts have."""
    margin = max(2.0, 4 * 1.04 / math.sqrt(1 << LG_K) * min_sites)
    estimate = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K)))
    fewest = F.least("sites", "texts")
    estimates = written(lines.groupBy("h").agg(estimate("site").alias("sites"), estimate("k1").alias("texts")).where(fewest >= min_sites - margin), "spread")
    near = estimates.where(fewest <= min_sites + margin)
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites"), F.count_distinct("k1", "k2").alias("texts"))
    far = estimates.where(fewest > min_sites + margin)
    return far.select("h").union(exact.where(fewest >= min_sites).select("h"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, site_col: str = "source") -> DataFrame:
    """``docs`` without the lines that ``min_sites`` distinct sites or more and as many distinct texts have.

    All rows and columns stay; ``text`` is the remaining lines, joined by line feeds,
    and the columns ``n_lines`` and ``n_removed`` (replaced if there already) are
    added. Lines are compared without blanks at their ends; blank lines stay. A null
    text stays null with 0 lines, an empty text has 1. A text of which all lines go
    becomes empty. A null site adds to no line's spread, but its lines go as others do.
    Rows that repeat, and copies of a text, count as one text and get equal results; an
    empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed", "k1", "k2", "bad_lines")
    lines = written(_hashed_lines(docs.where("text IS NOT NULL"), site_col), "lines")
    spread = written(spread_lines(lines, min_sites), "boilerplate")
    # Written, so that the join below has no aggregation on its side and a hot text can be split.
    bad = written(lines.join(spread, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("bad_lines")), "affected")
    discard(lines)
    held = bad.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("bad_lines")), F.lit(0)).alias("lines")).first()
    if held["texts"] <= SMALL_TEXTS and held["lines"] <= SMALL_LINES:
        bad = F.broadcast(bad)
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains("bad_lines", line_hash(x)) | (F.btrim(x, F.lit(BLANKS)) == ""))
    columns = docs.columns
    joined = docs.withColumns({k: c for k, c in zip(("k1", "k2"), _text_key("text"))}).join(bad, ["k1", "k2"], "left")
    joined = joined.withColumn("kept_lines", F.when(F.col("bad_lines").isNotNull(), kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    return joined.select(
        *[
            F.when(F.col("kept_lines").isNotNull(), F.array_join("kept_lines", "\n")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`")
            for c in columns
        ],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("kept_lines").isNotNull(), F.size(parts) - F.size("kept_lines")).otherwise(0).cast("long").alias("n_removed"),
    )


def oracle_sql(min_sites: int = 10) -> str:
    """DuckDB SQL for ``remove_boilerplate`` over ``documents``: doc_id, text, n_lines, n_removed."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH l AS (SELECT doc_id, source, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
           FROM documents WHERE text IS NOT NULL),
b AS (SELECT trim(line, {blanks}) AS body FROM l WHERE trim(line, {blanks}) <> '' GROUP BY 1 HAVING least(count(DISTINCT source), count(DISTINCT whole)) >= {min_sites}),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (body IS NULL) AS text, count(*) AS n_lines, count(body) AS n_removed
      FROM l LEFT JOIN b ON trim(line, {blanks}) = body GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""
