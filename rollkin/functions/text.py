"""Normalisers of names, houses, numbers and codes, as Column expressions.

Steps that are ordered text replacements are kept as data, so that the SQL the queries
are checked with can be made from the same list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

HONORIFIC = r"^(SMT|SHRI|SRI|MR|MRS|MS|DR|LATE)\.?\s+"
NAME_STEPS = [("[^A-Z ]", " "), (r"\s+", " ")]

PARENT_CODES = ("F", "M", "FTHR", "MTHR", "FATHER", "MOTHER")
SPOUSE_CODES = ("H", "W", "HSBN", "HUSBAND", "WIFE")
GRANDPARENT_CODES = ("GFTH", "GMTH")

# The published Metaphone rules as replacements over upper-case words.
# Lower case marks what is coded already; capitals left at the end are silent.
PHONETIC_STEPS = [
    *[(f"{c}{c}+", c) for c in "ABDEFGHIJKLMNOPQRSTUVWXYZ"],
    (r"\b[KGP]N", "N"), (r"\bAE", "E"), (r"\bWR", "R"), (r"\bX", "S"), (r"\bWH", "W"),
    (r"\bA", "a"), (r"\bE", "e"), (r"\bI", "i"), (r"\bO", "o"), (r"\bU", "u"),
    (r"MB\b", "m"),
    ("SCH", "sk"), ("CIA", "xIA"), ("TCH", "x"), ("CH", "x"), ("SC([IEY])", r"s\1"), ("C([IEY])", r"s\1"), ("CK", "k"),
    ("DG([EIY])", r"j\1"), (r"\bGH", "k"), ("GH([AEIOUaeiou])", r"k\1"), ("GH", ""), (r"GN\b", "n"), (r"GNED\b", "nt"), ("G([IEY])", r"j\1"),
    ("TI([AO])", r"xI\1"), ("TH", "0"), ("PH", "f"), ("SH", "x"), ("SI([AO])", r"xI\1"), ("X", "ks"),
    ("W([AEIOUaeiou])", r"w\1"), ("Y([AEIOUaeiou])", r"y\1"), ("H([AEIOUaeiou])", r"h\1"),
]
PHONETIC_LETTERS = ("BCDFGJKLMNPQRSTVZ", "bktfkjklmnpkrstfs")


def replaced(c: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to.replace("\\1", "$1"))
    return c


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clean_cell(c: Column) -> Column:
    """A loaded cell: null and ``nan`` become empty, the rest is trimmed."""
    text = F.trim(c.cast("string"))
    return F.coalesce(F.when(F.lower(text) != "nan", text), F.lit(""))


def norm_name(c: Column) -> Column:
    """Capitals A-Z and single spaces only, without one leading honorific; null gives empty."""
    plain = F.trim(replaced(F.upper(F.trim(c)), NAME_STEPS))
    return F.coalesce(F.trim(F.regexp_replace(plain, HONORIFIC, "")), F.lit(""))


def norm_house(c: Column) -> Column:
    """Capitals and digits only, so that ``E-72`` and ``e 72`` agree; null gives empty."""
    return F.coalesce(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def phonetic(norm: Column) -> Column:
    """Metaphone of each word of a normalised name, joined by spaces."""
    coded = F.translate(replaced(norm, PHONETIC_STEPS), *PHONETIC_LETTERS)
    return F.upper(F.trim(F.regexp_replace(coded, "[A-Z]", "")))


def to_int(c: Column) -> Column:
    """The text as an integer, else null."""
    return F.trim(c.cast("string")).try_cast("int")


def digits_as_int(c: Column) -> Column:
    """The digits of a part label as a number, null without digits."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("int")


def year_of_file(name: Column) -> Column:
    """The first 19xx or 20xx in a file name, else null."""
    return F.nullif(F.regexp_extract(name, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")


def initial(c: Column) -> Column:
    """First letter in upper case, empty for null."""
    return F.coalesce(F.upper(F.substring(F.trim(c), 1, 1)), F.lit(""))


def sex(c: Column) -> Column:
    """M, F or ?."""
    return F.when(initial(c).isin("M", "F"), initial(c)).otherwise("?")


def relation_kind(c: Column) -> Column:
    """parent, spouse or empty, from the relation's code or word."""
    code = F.upper(F.trim(c))
    return F.when(code.isin(*PARENT_CODES), "parent").when(code.isin(*SPOUSE_CODES), "spouse").otherwise("")


def preferred_name(verified: Column, roll: Column) -> Column:
    """The verified name if there is one, else the roll's."""
    return F.coalesce(F.nullif(F.trim(verified), F.lit("")), F.trim(roll), F.lit(""))


def name_source(verified: Column, roll: Column) -> Column:
    """Which record the preferred name is from."""
    return F.when(F.trim(verified) != "", "verified").when(F.trim(roll) != "", "roll").otherwise("none")


def seat_key(c: Column) -> Column:
    """Constituency, ``(unknown)`` if blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(unknown)"))


def file_stem(*parts: Column) -> Column:
    """A safe file or partition name."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9_-]+", "_")


def image_type(data: Column) -> Column:
    """jpg, png, pdf or bin, from the first bytes."""
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E47"), "png").when(head.startswith("25504446"), "pdf").otherwise("bin")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def severity_of(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def household_name_match(a: Column, b: Column) -> Column:
    """Names of one person in a house: equal, or the shorter's words all in the longer.

    A name of a single word matches only the other's first word and needs four letters.
    """
    wa, wb = F.split(a, " "), F.split(b, " ")
    swap = F.size(wa) > F.size(wb)
    small, big = F.when(swap, wb).otherwise(wa), F.when(swap, wa).otherwise(wb)
    inside = (F.size(small) >= 2) & (F.size(F.array_except(small, big)) == 0)
    given = (F.size(small) == 1) & (F.length(F.element_at(small, 1)) >= 4) & (F.element_at(small, 1) == F.element_at(big, 1))
    return (a != "") & (b != "") & ((a == b) | inside | given)
