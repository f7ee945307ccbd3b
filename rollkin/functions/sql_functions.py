"""The normalisers and similarities as SQL functions of a session, for rules written as SQL text.

They are SQL expressions that Spark puts in place of the call, so a rule in SQL is planned
and compiled as its DataFrame form is; nothing runs row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rollkin.functions import text as tx


def _raw(text: str) -> str:
    """A SQL literal in which backslashes stand for themselves."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' not in text:
        return f'r"{text}"'
    raise ValueError(f"a pattern with both kinds of quotes: {text}")


def _replaced(x: str, steps) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, {_raw(pattern)}, {_raw(to.replace(chr(92) + '1', '$1'))})"
    return x


def _grams(word: str) -> str:
    padded = f"concat('  ', {word}, ' ')"
    return f"transform(sequence(1, length({padded}) - 2), i -> substr({padded}, i, 3))"


def definitions() -> dict[str, tuple[str, str, str]]:
    """By name: parameters, type and body."""
    name = f"trim({_replaced('upper(trim(x))', tx.NAME_STEPS)})"
    words = "filter(split(lower(coalesce(x, '')), '[^a-z0-9]+'), w -> w <> '')"
    return {
        "norm_name": ("x STRING", "STRING", f"coalesce(trim(regexp_replace({name}, {_raw(tx.HONORIFIC)}, '')), '')"),
        "norm_house": ("x STRING", "STRING", "coalesce(regexp_replace(upper(x), '[^A-Z0-9]', ''), '')"),
        "phonetic": ("x STRING", "STRING", f"upper(trim(regexp_replace(translate({_replaced('x', tx.PHONETIC_STEPS)}, '{tx.PHONETIC_LETTERS[0]}', '{tx.PHONETIC_LETTERS[1]}'), '[A-Z]', '')))"),
        "word_grams": ("x STRING", "ARRAY<STRING>", f"array_distinct(flatten(transform({words}, w -> {_grams('w')})))"),
        "word_similarity_of": (
            "x ARRAY<STRING>, y ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(x, y)) > 0 THEN size(array_intersect(x, y)) / size(array_union(x, y)) ELSE 0.0 END"
        ),
        "age_gap": ("x INT, y INT", "INT", "abs(coalesce(x, 0) - coalesce(y, 0))"),
        "is_placeholder": ("x STRING", "BOOLEAN", "coalesce(endswith(x, '-01-01'), false)"),
        "seat_key": ("x STRING", "STRING", "coalesce(nullif(trim(x), ''), '(unknown)')"),
        "preferred_name": ("verified STRING, roll STRING", "STRING", "coalesce(nullif(trim(verified), ''), trim(roll), '')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and gives their names; doing so again changes nothing."""
    made = definitions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(made)
