"""Trigram similarity of texts, for many pairs at once.

Vectors are exploded rows (id, gram, weight). The cosine of pairs is then two joins
and a sum, which shuffles and spills as any other job does; a pair that shares no
gram isn't in the result and has cosine 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import sorted_join


def profile(*fields: Column) -> Column:
    """Fields joined by single spaces, blanks kept as empty fields, ends trimmed."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))


def grams_of(text: Column) -> Column:
    """Overlapping trigrams of a text that is padded by two blanks in front and one behind."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def vectors(texts: DataFrame, key: str = "key", text: str = "text", weight: Column | None = None) -> DataFrame:
    """(key, gram, weight) of the trigram counts of each text; ``weight`` scales a row's counts."""
    named = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    rows = named.select(F.col("k").alias("key"), F.explode(grams_of(F.col("t"))).alias("gram"), "w")
    return rows.groupBy("key", "gram").agg(F.sum("w").alias("weight"))


def cosines(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) of keys whose vectors share a gram."""
    right = left if right is None else right
    norm = lambda v: v.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    va = left.select(F.col("key").alias("a"), "gram", F.col("weight").alias("wa"))
    vb = right.select(F.col("key").alias("b"), "gram", F.col("weight").alias("wb"))
    na = norm(left).select(F.col("key").alias("a"), F.col("norm").alias("na"))
    nb = norm(right).select(F.col("key").alias("b"), F.col("norm").alias("nb"))
    dots = pairs.join(sorted_join(va), "a").join(sorted_join(vb), ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return dots.join(sorted_join(na), "a").join(sorted_join(nb), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def rare_grams(vectors: DataFrame, threshold: float) -> DataFrame:
    """(key, gram): the rarer grams of each vector, one of which any two vectors share whose cosine reaches ``threshold``.

    The commonest grams of a vector that hold less than ``threshold`` of its length can't
    reach the threshold by themselves, so the rarest gram that two such vectors share is
    among the others on both sides.
    """
    held = sorted_join(vectors).join(vectors.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    square, own = F.col("weight") * F.col("weight"), Window.partitionBy("key")
    mass = F.sum(square).over(own.orderBy(F.desc("n"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rarer = held.withColumns({"mass": mass, "all": F.sum(square).over(own)}).where(F.col("mass") >= F.col("all") * (threshold**2 * 0.999999))
    return rarer.select("key", "gram")


def text_cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of distinct pairs of texts ``a`` and ``b``, which are their own keys."""
    pairs = pairs.where("a <> '' AND b <> ''").select("a", "b").distinct()
    own = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    return cosines(pairs, vectors(own, text="key"))


def word_grams(c: Column) -> Column:
    """The set of trigrams of each lower-case word, padded as PostgreSQL's pg_trgm does."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, grams_of)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def status(similarity: Column) -> Column:
    """Word for a similarity: exact, strong, partial, weak, differ, or a dash for null."""
    return (
        F.when(similarity.isNull(), "—").when(similarity >= 0.995, "exact").when(similarity >= 0.85, "strong")
        .when(similarity >= 0.62, "partial").when(similarity > 0, "weak").otherwise("differ")
    )
