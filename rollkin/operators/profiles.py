"""The pair models as matrices and arrays inside the groups of ``blocks.streamed_pairs``.

What a model makes of a pair depends on the two records only, so a group gives its flags,
or its totals by person, and no pair is stored, shuffled or joined. The numbers are those
that the plans over joined pairs in ``rules`` give, added up in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkin.operators import blocks

#: Distinct texts of a column up to which all of them are compared at once.
WHOLE = 700


def rounded(x: np.ndarray) -> np.ndarray:
    """To three digits as Spark's ``bround`` does: by the shortest decimal number, ties to even."""
    scaled = x * 1000
    out = np.rint(scaled) / 1000
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal("0.001"), ROUND_HALF_EVEN))
    return out


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as floats, null as NaN."""
    return column.combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


class Texts:
    """A text column by distinct values; null counts as empty."""

    def __init__(self, column: pa.ChunkedArray):
        found = column.combine_chunks().fill_null("").dictionary_encode()
        self.codes, self.texts = found.indices.to_numpy(), found.dictionary.to_pylist()
        self.blank = np.array([t == "" for t in self.texts], dtype=bool)
        self._all: np.ndarray | None = None

    def there(self, i: np.ndarray) -> np.ndarray:
        return ~self.blank[self.codes[i]]

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.codes[i] == self.codes[j]) & self.there(i)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.codes[i] != self.codes[j]) & self.there(i) & self.there(j)

    def cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Trigram cosines of the texts of two lists of codes."""
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = blocks._counts([self.texts[c] for c in used], blocks.text_grams)
        return blocks.cosine_similarities(counts[place[: len(a)]], counts[place[len(a) :]])

    def cosine(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places, not rounded."""
        (a, to_a), (b, to_b) = np.unique(self.codes[i], return_inverse=True), np.unique(self.codes[j], return_inverse=True)
        return self.cosines(a, b)[to_a, to_b]

    def _likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.cosines(a, b)
        found[a[:, None] == b] = 1.0
        found[self.blank[a]] = found[:, self.blank[b]] = np.nan
        return rounded(found)

    def _between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matrix, places of ``a``, places of ``b``) of the likeness of two lists of codes."""
        if len(self.texts) <= WHOLE:
            if self._all is None:
                every = np.arange(len(self.texts))
                self._all = self._likeness(every, every)
            return self._all, a, b
        (ua, to_a), (ub, to_b) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        return self._likeness(ua, ub), to_a, to_b

    def alike(self, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
        """The matrix over places ``p`` and ``q``: whether their likeness reaches ``threshold``."""
        found, a, b = self._between(self.codes[p], self.codes[q])
        return (found >= threshold)[a][:, b]

    def likeness(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places: 1 if equal, else the cosine to three digits; NaN where one is empty."""
        found, a, b = self._between(self.codes[i], self.codes[j])
        return found[a, b]


class Vectors:
    """Weighted trigram vectors over several text columns; ``weights`` have one digit behind the point at most."""

    def __init__(self, fields: dict[str, Texts], weights: dict[str, float]):
        self.weights = [round(weights[k] * 10) for k in fields]
        self.fields, self.number = fields, {}
        self.grams = [self._numbered(k, t) for k, t in fields.items()]
        self.codes = np.zeros(len(next(iter(fields.values())).codes), np.int64)
        for t in fields.values():  # one number for each combination of values
            self.first, self.codes = np.unique(self.codes * len(t.texts) + t.codes, return_index=True, return_inverse=True)[1:]

    def _numbered(self, name: str, column: Texts) -> list[np.ndarray]:
        number = self.number
        return [np.array([number.setdefault(g, len(number)) for g in blocks.text_grams(f"{name}:{t}")] if t else [], np.int64) for t in column.texts]

    def cosines(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of places. The weights are whole numbers here, so sums are exact."""
        (a, to_a), (b, to_b) = np.unique(self.codes[i], return_inverse=True), np.unique(self.codes[j], return_inverse=True)
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        rows = self.first[used]
        listed = [grams[c] for grams, t in zip(self.grams, self.fields.values()) for c in t.codes[rows]]
        lengths = np.fromiter(map(len, listed), np.int64, len(listed))
        weight = np.repeat(np.repeat(np.array(self.weights, np.float64), len(rows)), lengths)
        row, gram = np.repeat(np.tile(np.arange(len(rows)), len(self.weights)), lengths), np.concatenate(listed)
        there = np.zeros(len(self.number), bool)
        there[gram] = True
        gram, wide = (np.cumsum(there) - 1)[gram], int(there.sum())
        found = np.bincount(row * wide + gram, weight, len(rows) * wide).reshape(len(rows), wide)
        squares = (found**2).sum(1)
        if squares.max(initial=0) < 2**24:  # no product of two rows is larger, so 32-bit floats are exact
            found = found.astype(np.float32)
        dots = (found[place[: len(a)]] @ found[place[len(a) :]].T).astype(np.float64)
        norms = np.sqrt(squares)
        return dots[to_a, to_b] / (norms[place[to_a]] * norms[place[len(a) + to_b]])


# comparison models ----------------------------------------------------------------------

#: Attributes with a similarity, in the order of the columns sim_x.
ATTRIBUTES = ["name", "dob", "father", "mother", "spouse", "reference", "reference_name", "age", "category", "relation_type", "house", "gender"]
_TEXTS = ["name_key", "father", "mother", "spouse", "relation_name_best", "dob", "reference", "category", "relation_code", "sex", "house_norm"]


def _key(c: str, where: str = "true") -> Column:
    return F.when(F.expr(f"coalesce({c}, '') <> '' AND {where}"), F.xxhash64(c))


def _of_blocks(view: DataFrame) -> DataFrame:
    """``view`` with the keys of the blocks and IDs as hashes; null: not in the block."""
    return view.withColumns({
        "by_sound": _key("name_phonetic"), "by_reference": _key("relation_epic"), "by_dob": _key("verified_dob", "verified_dob NOT LIKE '%-01-01'"), "by_national_id": _key("national_id_hash"),
        "epic": F.when(F.col("epic_no").isNotNull(), F.xxhash64("epic_no")),
    })


class Keys:
    """Which block first holds a pair: ``order`` has the key column and the ages' window, if any, of each."""

    def __init__(self, rows: pa.Table, order: list[tuple[str, int | None]]):
        self.order, self.block, self.age = order, rows["block"].to_numpy(), rows["age"].to_numpy()
        self.keys = [blocks.codes(rows[key]) for key, _ in order]
        self.epic = blocks.codes(rows["epic"])

    def holds(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The matrix of pairs of their own block that aren't in one before it and whose IDs differ."""
        found = self.epic[p][:, None] != self.epic[q]
        own = self.block[p][:, None]
        for n, ((_, years), key) in enumerate(zip(self.order, self.keys)):
            if (self.block[p] < n).all():
                break
            inside = (key[p][:, None] == key[q]) & (key[p] >= 0)[:, None]
            if years is not None:
                inside &= np.abs(self.age[p][:, None] - self.age[q]) <= years
            found &= np.where(own == n, inside, (own < n) | ~inside)
        return found


class Profiles:
    """The rows of some groups, as the comparison models read them."""

    def __init__(self, rows: pa.Table, order: list[tuple[str, int | None]], vector_weights: dict[str, float], vector_columns: dict[str, str]):
        self.rows, self.keys = rows, Keys(rows, order)
        self.text = {c: Texts(rows[c]) for c in _TEXTS}
        self.best_age = numbers(rows["best_age"])
        dates = self.text["dob"].texts
        self.placeholder = np.array([t.endswith("-01-01") for t in dates], bool)
        self.born = np.unique(np.array([t[:4] for t in dates], dtype=object).astype(str), return_inverse=True)[1]
        self.loose = np.isin(np.array(self.text["category"].texts, dtype=object).astype(str), ["SELF", "NA", ""])
        self._vectors, self.vector_weights, self.vector_columns = None, vector_weights, vector_columns

    @property
    def vectors(self) -> Vectors:
        if self._vectors is None:
            self._vectors = Vectors({k: self.text[c] for k, c in self.vector_columns.items()}, self.vector_weights)
        return self._vectors

    def pairs(self, only: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the blocks whose genders don't conflict and that are tied by an anchor."""
        text, dob = self.text, self.text["dob"]
        real = dob.there(slice(None)) & ~self.placeholder[dob.codes]
        wanted = self.rows[only].to_numpy() if only else None

        def holds(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            found, sex = self.keys.holds(p, q), text["sex"]
            if only:
                found &= wanted[p][:, None] | wanted[q]
            found &= (sex.codes[p][:, None] == sex.codes[q]) | ~sex.there(p)[:, None] | ~sex.there(q)
            if not found.any():
                return found
            reference = text["reference"]
            tied = (dob.codes[p][:, None] == dob.codes[q]) & real[p][:, None]
            tied |= (reference.codes[p][:, None] == reference.codes[q]) & reference.there(p)[:, None]
            for c in ("father", "mother", "spouse"):
                tied |= text[c].alike(p, q, 0.85)
            return found & tied

        return blocks.tiles(self.rows, holds)

    def similarities(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """A similarity, or NaN, for each attribute of pairs of places."""
        text, dob = self.text, self.text["dob"]
        both = lambda c: text[c].there(i) & text[c].there(j)
        equal = lambda c: np.where(both(c), (text[c].codes[i] == text[c].codes[j]).astype(np.float64), np.nan)
        a, b = dob.codes[i], dob.codes[j]
        dates = np.where(a == b, np.where(self.placeholder[a], 0.6, 1.0), np.where(self.born[a] == self.born[b], 0.5, 0.0))
        years = np.abs(self.best_age[i] - self.best_age[j])
        return {
            "name": text["name_key"].likeness(i, j), "dob": np.where(both("dob"), dates, np.nan), "father": text["father"].likeness(i, j), "mother": text["mother"].likeness(i, j),
            "spouse": text["spouse"].likeness(i, j), "reference": equal("reference"), "reference_name": text["relation_name_best"].likeness(i, j),
            "age": np.where(both("dob"), np.nan, np.maximum(0.0, 1 - years / 10.0)), "category": equal("category"), "relation_type": equal("relation_code"),
            "house": equal("house_norm"), "gender": equal("sex"),
        }

    def without_reference(self, i: np.ndarray) -> np.ndarray:
        return ~self.text["reference"].there(i) | self.loose[self.text["category"].codes[i]]


def comparisons(view: DataFrame, age_window: int, mean_weights: dict[str, float], vector_weights: dict[str, float], vector_columns: dict[str, str], models: tuple[str, ...], strict: bool, give: Callable, schema: str, carried: tuple[str, ...] = (), only: str | None = None) -> DataFrame:
    """What ``give`` makes of the pairs that ``models`` (fuzzy, cosine) flag.

    ``give`` takes the rows of some groups and parts of their pairs (i, j, scores, compared,
    similarities), where the scores of a model that doesn't flag a pair are NaN, and yields
    tables of ``schema``; ``carried``: further columns of ``view`` that it reads; ``only``: a boolean one that is true for a record of each pair.
    """
    order = [("by_sound", age_window), ("by_reference", None), ("by_dob", None)]
    columns = [*_TEXTS, "best_age", "epic", *(k for k, _ in order), *carried]
    shown = ["name", "dob", "father", "mother", "spouse", "category", "relation_type", "reference", "house", "age", "gender"]

    def flagged(of: Profiles) -> Iterator[tuple]:
        for i, j in of.pairs(only):
            sims = of.similarities(i, j)
            there = {k: ~np.isnan(x) for k, x in sims.items()}
            loose = of.without_reference(i) | of.without_reference(j) | (not strict)
            scores, compared = {}, {}
            if "fuzzy" in models:
                total = weight = np.zeros(len(i))
                n = np.zeros(len(i), np.int32)
                for k, w in mean_weights.items():
                    total, weight, n = total + np.where(there[k], sims[k], 0.0) * w, weight + there[k] * w, n + there[k]
                score = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
                kept = there["name"] & (n >= 3) & (score >= np.where(loose, 0.66, 0.72))
                scores["fuzzy"], compared["fuzzy"] = np.where(kept, score, np.nan), n
            if "cosine" in models:
                n = sum(there[k].astype(np.int32) for k in shown)
                gated = (sims["name"] >= 0.85) & (n >= 3) & ~(sims["dob"] <= 0)
                score = np.full(len(i), np.nan)
                if gated.any():
                    score[gated] = of.vectors.cosines(i[gated], j[gated])
                bar = np.where(of.without_reference(i) | of.without_reference(j), 0.74, 0.80)
                scores["cosine"], compared["cosine"] = np.where(score >= bar, score, np.nan), n
            kept = np.logical_or.reduce([~np.isnan(x) for x in scores.values()])
            take = lambda found, kept=kept: {k: x[kept] for k, x in found.items()}
            yield i[kept], j[kept], take(scores), take(compared), take(sims)

    def score(rows: pa.Table) -> Iterator[pa.Table]:
        yield from give(rows, flagged(Profiles(rows, order, vector_weights, vector_columns)))

    return blocks.streamed_pairs(_of_blocks(view), order, columns, score, schema)


def compared_flags(rows: pa.Table, flagged: Iterator[tuple]) -> Iterator[pa.Table]:
    """A row for each flag: model, a, b, score, n and the similarities."""
    ids = rows["id"].to_numpy()
    for i, j, scores, compared, sims in flagged:
        for model, score in scores.items():
            at = ~np.isnan(score)
            found = {k: pa.array(x[at], mask=np.isnan(x[at])) for k, x in sims.items()}
            yield pa.table({
                "model": pa.array([model] * int(at.sum()), pa.string()), "a": ids[i[at]], "b": ids[j[at]], "score": score[at], "n": compared[model][at],
                **{f"sim_{k}": found[k] for k in ATTRIBUTES},
            })


#: Scores from which on a flag is a severe one.
HIGH = {"cosine": 0.90, "fuzzy": 0.88}
FLAGS_SCHEMA = "model string, a long, b long, score double, n int, " + ", ".join(f"sim_{k} double" for k in ATTRIBUTES)


def lead_totals(rows: pa.Table, flagged: Iterator[tuple]) -> Iterator[pa.Table]:
    """A row for each person of the groups with a flag, on either side: flags of each model, the best score, whether one is high."""
    ids, place = np.unique(rows["id"].to_numpy(), return_inverse=True)
    n, best, high = {m: np.zeros(len(ids), np.int64) for m in HIGH}, np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)
    for i, j, scores, _, _ in flagged:
        for model, score in scores.items():
            at = ~np.isnan(score)
            for x in (place[i[at]], place[j[at]]):
                n[model] += np.bincount(x, minlength=len(ids))
                high += np.bincount(x, score[at] >= HIGH[model], len(ids)).astype(np.int64)
                np.maximum.at(best, x, score[at])
    some = best >= 0
    yield pa.table({"id": ids[some], "n_cosine": n["cosine"][some], "n_fuzzy": n["fuzzy"][some], "best": best[some], "high": high[some] > 0})


TOTALS_SCHEMA = "id long, n_cosine long, n_fuzzy long, best double, high boolean"


def lead_rows(carried: tuple[str, ...]) -> Callable:
    """Gives (id, model, partner, score) of both sides of each flag, with the partner's ``carried`` columns."""

    def give(rows: pa.Table, flagged: Iterator[tuple]) -> Iterator[pa.Table]:
        ids = rows["id"].to_numpy()
        for i, j, scores, _, _ in flagged:
            for model, score in scores.items():
                at = ~np.isnan(score)
                for x, y in ((i[at], j[at]), (j[at], i[at])):
                    other = rows.select(list(carried)).take(y)
                    yield pa.table({"id": ids[x], "model": pa.array([model] * len(x), pa.string()), "partner": ids[y], "score": score[at], **{c: other[c] for c in carried}})

    return give


def partner_rows(where: str, carried: tuple[str, ...]) -> Callable:
    """Gives (id, carried) for both sides of each pair with a flag whose partner has ``where``."""

    def give(rows: pa.Table, flagged: Iterator[tuple]) -> Iterator[pa.Table]:
        ids, wanted = rows["id"].to_numpy(), rows[where].to_numpy()
        for i, j, *_ in flagged:
            for x, y in ((i, j), (j, i)):
                at = wanted[y]
                other = rows.select(list(carried)).take(y[at])
                yield pa.table({"id": ids[x[at]], **{c: other[c] for c in carried}})

    return give


#: Partners held before they are given as lists.
HELD = 500_000
LISTS_SCHEMA = "id long, start long, gaps array<int>, fuzzy array<short>, cosine array<short>"


def partner_lists(rows: pa.Table, flagged: Iterator[tuple]) -> Iterator[pa.Table]:
    """Lists of a person's partners, as gaps between their sorted ids, with both models' scores in thousandths, 0 for no flag."""
    ids, held = rows["id"].to_numpy(), []
    marked = lambda x: np.where(np.isnan(x), 0, np.rint(rounded(np.nan_to_num(x)) * 1000)).astype(np.int16)
    for i, j, scores, _, _ in flagged:
        marks = [marked(scores[m]) for m in ("fuzzy", "cosine")]
        held += [(ids[i], ids[j], *marks), (ids[j], ids[i], *marks)]
        if sum(len(x[0]) for x in held) >= HELD:
            yield _listed(*(np.concatenate(x) for x in zip(*held)))
            held = []
    if held:
        yield _listed(*(np.concatenate(x) for x in zip(*held)))


def _listed(ids: np.ndarray, partners: np.ndarray, *marks: np.ndarray) -> pa.Table:
    order = np.lexsort((partners, ids))
    ids, partners = ids[order], partners[order]
    gaps = np.diff(partners, prepend=partners[:1])
    first = (ids != np.concatenate([ids[:1] - 1, ids[:-1]])) | (gaps >= 2**31)
    gaps[first] = 0
    offsets = pa.array(np.append(np.flatnonzero(first), len(ids)), pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
    lists = {"gaps": listed(gaps.astype(np.int32)), **{k: listed(x[order]) for k, x in zip(("fuzzy", "cosine"), marks)}}
    return pa.table({"id": ids[first], "start": partners[first], **lists})


def partners_in_order(lists: DataFrame) -> DataFrame:
    """(id, place, partner, model, score): the partners in ``partner_lists``, the best first, later ids first among equals. A person's are ordered in one place."""
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks._whole_groups(batches):
            yield from _ordered(rows).to_batches(max_chunksize=HELD)

    return lists.withColumnRenamed("id", "group").repartition(parts, "group").sortWithinPartitions("group").mapInArrow(run, "id long, place int, partner long, model string, score double")


def _ordered(rows: pa.Table) -> pa.Table:
    column = {c: rows[c].combine_chunks() for c in ("gaps", "fuzzy", "cosine")}
    lengths = column["gaps"].value_lengths().to_numpy()
    flat = {c: x.flatten().to_numpy() for c, x in column.items()}
    so_far = np.cumsum(flat["gaps"], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    partner = np.repeat(rows["start"].to_numpy() - so_far[starts], lengths) + so_far
    person = np.repeat(rows["group"].to_numpy(), lengths)
    at = np.concatenate([np.flatnonzero(flat[c]) for c in ("fuzzy", "cosine")])
    fuzzy = np.arange(len(at)) < np.count_nonzero(flat["fuzzy"])
    mark = np.where(fuzzy, flat["fuzzy"][at], flat["cosine"][at])
    order = np.lexsort((~fuzzy, -partner[at], -mark.astype(np.int32), person[at]))
    at, fuzzy, mark = at[order], fuzzy[order], mark[order]
    ids = person[at]
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    place = np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids)))) + 1
    return pa.table({"id": ids, "place": place.astype(np.int32), "partner": partner[at], "model": pa.array(np.where(fuzzy, "fuzzy", "cosine")), "score": mark / 1000})


# evidence model -------------------------------------------------------------------------

_AGREE = ["sound_key", "national_id_hash", "mobile_no", "reference", "father", "mother", "spouse", "house", "sex"]
EVIDENCE_SCHEMA = "a long, b long, points double, fired int, shown_name_a string, shown_name_b string, epic_no_a string, epic_no_b string"


class Evidence:
    """The rows of some groups, as the evidence model reads them."""

    def __init__(self, rows: pa.Table, order: list[tuple[str, int | None]], points: dict[str, float]):
        self.rows, self.keys, self.points, self.signals = rows, Keys(rows, order), points, list(points)
        self.name, self.dob, self.best_age = Texts(rows["name_key"]), Texts(rows["dob"]), numbers(rows["best_age"])
        self.codes = {c: blocks.codes(rows[c]) for c in _AGREE}
        self.shared = rows["mobile_shared"].to_numpy()
        dates = self.dob.texts
        self.placeholder = np.array([t.endswith("-01-01") for t in dates], bool)
        self.born = np.unique(np.array([t[:4] for t in dates], dtype=object).astype(str), return_inverse=True)[1]

    def plain(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """The signals of pairs of places that aren't of names, in the order in which points are added."""
        a, b = self.dob.codes[i], self.dob.codes[j]
        same_date, other_date = self.dob.same(i, j), self.dob.differ(i, j)
        holder = self.placeholder[a] | self.placeholder[b]
        years = np.where(self.dob.there(i) & self.dob.there(j), np.nan, np.abs(self.best_age[i] - self.best_age[j]))
        pair = {c: (x[i], x[j]) for c, x in self.codes.items()}
        same = {c: (x == y) & (x >= 0) for c, (x, y) in pair.items()}
        differ = {c: (x != y) & (x >= 0) & (y >= 0) for c, (x, y) in pair.items()}
        return {
            "dob_exact": same_date & ~self.placeholder[a], "dob_placeholder": same_date & self.placeholder[a], "dob_year": other_date & holder & (self.born[a] == self.born[b]),
            "dob_conflict": other_date & ~holder, "age_exact": years == 0, "age_close": (years >= 1) & (years <= 2), "age_far": years >= 8,
            "national_id": same["national_id_hash"], "national_id_conflict": differ["national_id_hash"], "mobile": same["mobile_no"] & ~self.shared[i], "mobile_shared": same["mobile_no"] & self.shared[i],
            "relation_epic": same["reference"], "relation_conflict": differ["reference"], "father_name_match": same["father"], "mother_name_match": same["mother"], "spouse_name_match": same["spouse"],
            "same_house": same["house"], "gender_same": same["sex"], "gender_diff": differ["sex"],
        }

    def named(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        """The signals of names."""
        differ, sound = self.name.differ(i, j), self.codes["sound_key"]
        sounds, cosine = (sound[i] == sound[j]) & (sound[i] >= 0), np.zeros(len(i))
        if differ.any():
            cosine[differ] = self.name.cosine(i[differ], j[differ])
        weak = differ & (cosine < 0.85)
        return {
            "name_exact": self.name.same(i, j), "name_strong": differ & (cosine >= 0.85), "name_phonetic": weak & sounds, "name_weak": weak & ~sounds & (cosine >= 0.62),
            "name_conflict": weak & ~sounds & (cosine < 0.62),
        }

    def total(self, fired: dict[str, np.ndarray], n: int) -> np.ndarray:
        total = np.zeros(n)
        for signal, at in fired.items():
            total += np.where(at, self.points[signal], 0.0)
        return total

    def flagged(self, threshold: float) -> Iterator[pa.Table]:
        ids, most, named = self.rows["id"].to_numpy(), max(self.points["name_strong"], self.points["name_phonetic"], self.points["name_weak"]), ["shown_name", "epic_no"]
        for i, j in blocks.tiles(self.rows, self.keys.holds):
            fired = self.plain(i, j)
            reach = self.total(fired, len(i)) + np.where(self.name.same(i, j), self.points["name_exact"], np.where(self.name.differ(i, j), most, 0.0)) >= threshold - 1e-6
            i, j = i[reach], j[reach]
            fired = {**self.named(i, j), **{k: x[reach] for k, x in fired.items()}}
            total = np.round(self.total(fired, len(i)), 6)
            bits = np.zeros(len(i), np.int32)
            for signal, at in fired.items():
                bits |= at.astype(np.int32) << self.signals.index(signal)
            kept = total >= threshold
            i, j = i[kept], j[kept]
            sides = {f"{c}_{x}": t[c] for x, t in (("a", self.rows.select(named).take(i)), ("b", self.rows.select(named).take(j))) for c in named}
            yield pa.table({"a": ids[i], "b": ids[j], "points": total[kept], "fired": bits[kept], **{c: sides[c] for c in ("shown_name_a", "shown_name_b", "epic_no_a", "epic_no_b")}})


def evidence(view: DataFrame, age_window: int, points: dict[str, float], threshold: float, most_shared: int = 4) -> DataFrame:
    """Pairs (a, b) of the evidence model's five blocks that reach ``threshold``, with their points, names and IDs.

    ``fired`` has a bit for each signal, in the order of ``points``. ``view`` has
    ``mobile_n``, how many IDs of the year have the record's number.
    """
    order = [("by_sound", age_window), ("by_national_id", None), ("by_reference", None), ("by_dob", None), ("by_mobile", None)]
    shared = F.coalesce("mobile_n", F.lit(1)) > most_shared
    keyed = _of_blocks(view).withColumns({
        "by_mobile": F.when(~shared, _key("mobile_no")), "mobile_shared": shared,
        "house": F.when(F.col("house_norm") != "", F.xxhash64("house_norm", F.coalesce("constituency_no", F.lit("")))),
    })
    records = keyed.withColumns({c: _key(c) for c in _AGREE if c != "house"})
    columns = ["name_key", "dob", "best_age", *_AGREE, "mobile_shared", "epic", *(k for k, _ in order), "shown_name", "epic_no"]

    def score(rows: pa.Table) -> Iterator[pa.Table]:
        return Evidence(rows, order, points).flagged(threshold)

    return blocks.streamed_pairs(records, order, columns, score, EVIDENCE_SCHEMA)
