"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed into cells of (source, language, topic). The cells' token weights
are raked to the target share of every source, language and topic in turn until all
three agree; a cell's new weight over its old one says how likely its documents are to
be drawn. One factor, set so that the expected tokens meet the budget, turns these
into probabilities, and a hash of the document decides.

The topic is a column of the caller's, or a cluster of key words: key words are those that
a fair part, but not most, of the different texts hold, and they are clustered by the key
words that they stand together with in all of these texts. A text's topic is the cluster
that most of its key words are of.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import broadcast_if_small, discard, written

DIMS = ("source", "lang", "topic")
NONE = "\x00none"
SMALL_CELLS = 200_000
GRID = 64
#: Number of key words, and the part of the different texts that holds one.
KEY_WORDS, SPREAD = 600, (0.004, 0.15)
#: Hashes of texts with copies up to which they are broadcast.
SMALL_COPIES = 1_000_000
#: Clusters of key words, rounds in which they settle, and key words that a word's vector has a place for.
TOPICS, LLOYD_ROUNDS, CONTEXTS = 24, 4, 200
#: Rounds of raking after which the gap is looked at.
AT_ONCE = 8
BLANKS = r"[\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The words of a text, a word being a run without space and U+0009 to U+000D; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def key_words(docs: DataFrame, n_words: int = KEY_WORDS) -> DataFrame:
    """(h, word, held): the key words of each different text ``h`` of ``docs``, and the number of different texts that hold the word.

    Key words are the ``n_words`` that most texts hold, of words of four letters and more in
    no more than ``SPREAD`` of them. All texts count, each once however many copies it has.
    """
    texts = docs.select("text", F.xxhash64("text").alias("h")).where("text IS NOT NULL")
    # only hashes are shuffled to find the copies; each of m copies counts as one m-th of a text
    times = written(texts.groupBy("h").agg(F.count("*").alias("m")), "texts")
    n = times.count()
    copies = broadcast_if_small(times.where("m > 1"), SMALL_COPIES)
    of_text = texts.join(copies, "h", "left").select((1 / F.coalesce("m", F.lit(1))).alias("part"), F.explode(F.array_distinct(words_in(F.col("text")))).alias("word"))
    counts = of_text.where((F.length("word") >= 4) & F.regexp_like("word", F.lit(r"^\pL{4,}$"))).groupBy("word").agg(F.round(F.sum("part")).cast("long").alias("held"))
    most = counts.where(F.col("held").between(n * SPREAD[0], n * SPREAD[1])).orderBy(F.desc("held"), "word").limit(n_words)
    keys = written(most, "keys")
    known = [r["word"] for r in keys.select("word").collect()]  # at most n_words
    held = texts.select("h", F.explode(F.filter(words_in(F.col("text")), lambda w: w.isin(known))).alias("word")).distinct()
    return written(held.join(F.broadcast(keys), "word").select("h", "word", "held"), "key_words")


def word_clusters(found: DataFrame, topics: int = TOPICS, rounds: int = LLOYD_ROUNDS) -> list[tuple[str, list[str]]]:
    """The key words in clusters, as (name, words): a cluster's name is the word of it that most texts hold.

    A word's vector has, for each of the ``CONTEXTS`` commonest key words, the share of the
    word's texts that hold that one too, over how often any text does: what is common says
    little. Centres start at the ``topics`` commonest words; in each round words go to the
    centre with the largest cosine, and centres to their words' mean. A word that stands
    with none of the contexts goes to the first cluster. All sums run over all texts.
    """
    held = written(found.groupBy("word").agg(F.first("held").alias("held")), "word_counts")
    commonest = lambda n: held.orderBy(F.desc("held"), "word").limit(n).select("word")
    names = [r["word"] for r in held.orderBy(F.desc("held"), "word").select("word").collect()]  # the key words
    places = F.broadcast(found.sparkSession.createDataFrame(list(enumerate(names)), "place int, word string"))
    # the contexts are picked once a text, not again for each of its words
    of_text = found.join(places, "word").groupBy("h").agg(F.collect_list("place").alias("places"), F.collect_list(F.when(F.col("place") < CONTEXTS, F.col("place"))).alias("near"))
    # a pair of words is one number, so that the many pairs of all texts are counted cheaply; at most KEY_WORDS * CONTEXTS are left
    pairs = of_text.select("near", F.explode("places").alias("own")).select("own", F.explode("near").alias("other")).groupBy((F.col("own") * CONTEXTS + F.col("other")).alias("pair")).agg(F.count("*").alias("n"))
    number = lambda c, name: F.broadcast(held.join(places, "word").select(F.col("place").alias(c), F.col("word").alias(name), F.col("held").alias(f"{name}_held")))
    split = pairs.select(F.floor(F.col("pair") / CONTEXTS).cast("int").alias("own"), (F.col("pair") % CONTEXTS).alias("at"), "n")
    raw = split.join(number("own", "word"), "own").join(number("at", "other"), "at").select("word", "other", (F.col("n") / F.sqrt(F.col("word_held") * F.col("other_held"))).alias("x"))
    raw = written(raw, "pairs")
    norms = raw.groupBy("word").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    vectors = written(raw.join(norms, "word").select("word", "other", (F.col("x") / F.col("norm")).alias("x")), "word_vectors")
    centres = vectors.join(F.broadcast(commonest(topics)), "word", "left_semi").select(F.col("word").alias("cluster"), "other", "x")
    near = None
    for _ in range(max(1, rounds)):
        length = centres.groupBy("cluster").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        alike = vectors.join(centres.withColumnRenamed("x", "c"), "other").groupBy("word", "cluster").agg(F.sum(F.col("x") * F.col("c")).alias("dot")).join(length, "cluster")
        best = F.max_by("cluster", F.struct(F.round(F.col("dot") / F.col("length"), 9), F.col("cluster")))
        last, near = near, written(alike.groupBy("word").agg(best.alias("cluster")), "nearest")
        if last is not None:
            discard(last)
        centres = vectors.join(near, "word").groupBy("cluster", "other").agg(F.avg("x").alias("x"))
    rows = held.join(near, "word", "left").orderBy(F.desc("held"), "word").collect()  # at most KEY_WORDS
    clusters: dict[str, list[str]] = {}
    for r in rows:
        clusters.setdefault(r["cluster"] or rows[0]["cluster"], []).append(r["word"])
    return [(words[0], words) for words in clusters.values()]


def _among(own: list[str]):
    return lambda w: w.isin(own)


def topic_of(words: Column, clusters: list[tuple[str, list[str]]]) -> Column:
    """The cluster that most of ``words`` are of, of equal ones the first; "other" without any, "none" without words."""
    if not clusters:
        return F.when(F.size(words) > 0, "other").otherwise("none")
    known = [w for _, own in clusters for w in own]

    def best(held: Column) -> Column:
        counted = [F.struct(F.size(F.filter(held, _among(own))).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("key")) for i, (name, own) in enumerate(clusters)]
        return F.when(F.size(held) > 0, F.array_max(F.array(*counted))["key"]).otherwise("other")

    # the words of a cluster are looked up in a lambda's variable, which is worked out once
    found = F.transform(F.array(F.filter(words, lambda w: w.isin(known))), best)[0]
    return F.when(F.size(words) > 0, found).otherwise("none")


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens of each (source, lang, topic) of ``docs`` (with n_tokens), null values as a value of their own."""
    return docs.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares (value, share) of a dimension: its token shares to a power, normalised.

    A power under 1 moves weight from large values to small ones.
    """
    raw = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raw")).where("raw > 0")
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("value", (F.col("raw") / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], max_rounds: int = 96, tolerance: float = 1e-4) -> tuple[DataFrame, bool]:
    """``cells`` with ``weight``, raked so that each dimension's sums meet its target shares; and whether they do.

    ``targets``: by dimension, (value, share) with shares that sum to 1. Values without
    a target get weight 0. Ends when no sum is off by more than ``tolerance`` of its
    target. Targets that exclude each other never agree: when rounds hardly bring the
    largest gap down any more, or after ``max_rounds``, the last weights come back with
    False.

    The gap is looked at after every ``AT_ONCE`` rounds. Up to ``SMALL_CELLS`` cells these
    are one query in one task, by windows that need no exchange; beyond that, each is
    done by aggregations and joins.
    """
    start = cells.where("tokens > 0").withColumn("weight", F.col("tokens"))
    for d, goal in targets.items():
        start = start.join(broadcast_if_small(goal.select(F.col("value").alias(d), F.col("share").alias(f"_{d}_share")), SMALL_CELLS), d, "left").fillna(0.0, [f"_{d}_share"])
    fitted, gap = written(start, "cells"), float("inf")
    small = fitted.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    at_once, converged = min(AT_ONCE, max_rounds), False
    for _ in range(0, max_rounds, at_once):
        before = gap
        for _ in range(1 if small else at_once):
            last = fitted
            fitted = written(_rounds(fitted.coalesce(1), list(targets), at_once) if small else _one_round(fitted, list(targets)), "raked")
            discard(last)
        gap = _largest_gap(fitted, list(targets))
        converged = gap <= tolerance
        if converged or gap > 0.98**at_once * before:
            break
    return fitted.drop(*[f"_{d}_share" for d in targets]), converged


def _rounds(fitted: DataFrame, dims: list[str], rounds: int) -> DataFrame:
    for dim in dims * rounds:
        have = F.sum("weight").over(Window.partitionBy(dim))
        fitted = fitted.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"_{dim}_share") / have).otherwise(0.0))
    return fitted


def _one_round(fitted: DataFrame, dims: list[str]) -> DataFrame:
    for dim in dims:
        sums = fitted.groupBy(dim).agg(F.sum("weight").alias("_have"))
        step = F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_{dim}_share") / F.col("_have")).otherwise(0.0)
        fitted = written(fitted.join(written(sums, "sums"), dim).withColumn("weight", step).drop("_have"), "step")
    return fitted


def _largest_gap(fitted: DataFrame, dims: list[str]) -> float:
    """The largest part of its target by which a sum is off, over all dimensions."""
    gaps = [
        fitted.groupBy(d).agg(F.sum("weight").alias("have"), F.first(f"_{d}_share").alias("share")).where("share > 0").select(F.abs(F.col("have") / F.col("share") - 1).alias("gap"))
        for d in dims
    ]
    return (reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0] or 0.0) if gaps else 0.0


def rates(fitted: DataFrame, budget: float) -> DataFrame:
    """``fitted`` with ``rate``: the probability of a cell's documents, expected tokens = ``budget`` of all.

    rate = min(1, s * weight / tokens). The factor s is found by evaluating a whole grid
    of candidates in one aggregation and narrowing it, so any number of cells is fine.
    Where even s without bound can't reach the budget, all cells with weight have 1.
    """
    ratio = F.col("weight") / F.col("tokens")
    ends = fitted.where("weight > 0").agg(F.sum("tokens").alias("all"), F.min(ratio).alias("low"), F.max(ratio).alias("high")).first()
    total = fitted.agg(F.sum("tokens").alias("total")).first()["total"]
    if not ends["all"]:
        return fitted.withColumn("rate", F.lit(0.0))
    low, high = min(budget, 1.0) * 1e-3 / ends["high"], 1.0 / ends["low"]
    for _ in range(5):
        grid = [low * (high / low) ** (i / (GRID - 1)) for i in range(GRID)]
        got = fitted.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * s)).alias(f"g{i}") for i, s in enumerate(grid)]).first()
        above = next((i for i in range(GRID) if got[i] >= budget * total), None)
        if above is None:
            low = high
            break
        low, high = grid[max(0, above - 1)], grid[above]
    return fitted.withColumn("rate", F.least(F.lit(1.0), ratio * high))


def mix(
    docs: DataFrame, budget: float = 0.5, powers: Mapping[str, float] | None = None, targets: Mapping[str, DataFrame] | None = None, seed: int = 17, topic_col: str | None = None
) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, more) with topic, n_tokens, rate, kept and converged.

    ``targets``: shares by dimension; where none are given, token shares to the power in
    ``powers`` (source 0.5, lang 0.7, topic 0.7). ``budget``: expected share of all
    tokens that is kept. ``topic_col``: a column of ``docs`` to take for the topic, which
    is a cluster of key words otherwise. ``converged``: whether the fit met the targets.

    All rows and columns stay; input columns with the names of the five are replaced.
    Null source, lang or topic count as values of their own (text without a word: topic
    "none", 0 tokens). Documents without a word are kept: they have no weight to rake.
    Rows that repeat are kept or dropped together. An empty table gives an empty result.
    """
    powers = {"source": 0.5, "lang": 0.7, "topic": 0.7} | dict(powers or {})
    keep = [c for c in docs.columns if c not in ("topic", "n_tokens", "rate", "kept", "converged")]
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    clusters = word_clusters(key_words(docs)) if topic_col is None else []
    step = lambda *x: F.explode(F.array(F.struct(*x))).alias("_x")  # noqa: E731  unlike a projection, not worked out again for each use
    full = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"), *([F.col(f"`{topic_col}`").cast("string").alias("_topic")] if topic_col else []))
    full = full.select("*", step(words_in(F.col("_text")).alias("words")))
    if topic_col is None:
        full = full.withColumn("_topic", topic_of(F.col("_x.words"), clusters))
    # written, so that topics and tokens are worked out once, in the pass that reads the texts
    full = written(full.withColumns({"_tokens": F.size("_x.words").cast("long"), "_drawn": drawn}).drop("_x", "_text"), "tokens")
    cell = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("_topic")}
    keyed = full.withColumns({f"_{d}_key": F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in cell.items()})
    cells = written(cells_of(keyed.select(*[F.col(f"_{d}_key").alias(d) for d in DIMS], F.col("_tokens").alias("n_tokens"))), "cells")
    goals = {d: (targets or {}).get(d) or tempered(cells, d, powers[d]) for d in DIMS}
    fitted, converged = rake(cells, goals)
    rated = written(rates(fitted, budget), "rates").select(*[F.col(d).alias(f"_{d}_key") for d in DIMS], F.col("rate").alias("_rate"))
    rate = F.when(F.col("_tokens") == 0, 1.0).otherwise(F.coalesce("_rate", F.lit(0.0)))
    return keyed.join(broadcast_if_small(rated, SMALL_CELLS), [f"_{d}_key" for d in DIMS], "left").select(
        *[F.col(f"`{c}`") for c in keep], F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), rate.alias("rate"), (F.col("_drawn") < rate).alias("kept"), F.lit(converged).alias("converged")
    )
