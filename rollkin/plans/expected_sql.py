"""DuckDB SQL pieces that the named queries are checked with."""

from __future__ import annotations

from rollkin.functions import text as tx
from rollkin.operators import rules
from rollkin.sources import registry as rg


def name_sql(x: str) -> str:
    inner = f"upper(trim({x}))"
    for pattern, to in tx.NAME_STEPS:
        inner = f"regexp_replace({inner}, '{pattern}', '{to}', 'g')"
    return f"coalesce(trim(regexp_replace(trim({inner}), '{tx.HONORIFIC}', '')), '')"


def house_sql(x: str) -> str:
    return f"coalesce(regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g'), '')"


def phonetic_sql(x: str) -> str:
    for pattern, to in tx.PHONETIC_STEPS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    source, to = tx.PHONETIC_LETTERS
    return f"upper(trim(regexp_replace(translate({x}, '{source}', '{to}'), '[A-Z]', '', 'g')))"


def seat_sql(x: str = "constituency_no") -> str:
    return f"coalesce(nullif(trim({x}), ''), '(unknown)')"


BASE = f"""p AS ({rg.parts_as_base()}),
reg0 AS (SELECT {', '.join(rg._cast(c, e) for c, e in rg.DERIVED.items())} FROM p),
reg1 AS (SELECT *, {name_sql('name')} AS name_norm, {name_sql('relation_name')} AS relation_name_norm, {house_sql('house_number')} AS house_norm FROM reg0),
keys AS (SELECT name_norm, {phonetic_sql('name_norm')} AS name_phonetic FROM (SELECT DISTINCT name_norm FROM reg1)),
reg AS (SELECT reg1.*, keys.name_phonetic FROM reg1 JOIN keys USING (name_norm))"""


def pairs_sql(on: str) -> str:
    return f"FROM reg a JOIN reg b ON a.year = b.year AND a.id < b.id AND {on}"


def gap(n: int) -> str:
    return f"abs(coalesce(a.age, 0) - coalesce(b.age, 0)) <= {n}"


def _pair_rule(rule: str, severity: str, score: str, on: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {score} AS score, a.id AS voter_id, b.id AS related_voter_id {pairs_sql(on)}"


def _single_rule(rule: str, severity: str, score: str, where: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {score} AS score, id AS voter_id, NULL::BIGINT AS related_voter_id FROM reg WHERE {where}"


def grams_sql(x: str) -> str:
    return f"list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3))"


def pg_grams_sql(x: str) -> str:
    words = f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: {grams_sql('w')})))"


RULES = {
    "dup_epic": _pair_rule("dup_epic", "high", "1.0", "a.epic_no = b.epic_no AND a.epic_no <> ''"),
    "dup_identity": _pair_rule(
        "dup_identity", "high", "0.9",
        f"a.name_norm = b.name_norm AND a.house_norm = b.house_norm AND a.constituency_no = b.constituency_no AND a.name_norm <> '' AND a.house_norm <> '' AND {gap(1)} AND a.epic_no <> b.epic_no",
    ),
    "cross_part_dup": _pair_rule(
        "cross_part_dup", "medium", "0.7",
        f"a.name_norm = b.name_norm AND a.relation_name_norm = b.relation_name_norm AND a.name_norm <> '' AND a.relation_name_norm <> '' AND {gap(1)} AND a.part_no <> b.part_no",
    ),
    "phonetic_dup": _pair_rule(
        "phonetic_dup", "medium", "0.6",
        f"a.name_phonetic = b.name_phonetic AND a.name_phonetic <> '' AND a.house_norm = b.house_norm AND a.house_norm <> '' AND a.constituency_no = b.constituency_no AND {gap(2)} AND a.name_norm <> b.name_norm",
    ),
    "photo_reuse": _pair_rule("photo_reuse", "high", "0.95", "a.phash = b.phash AND a.epic_no <> b.epic_no"),
    "house_overload": "SELECT 'house_overload' AS rule, 'medium' AS severity, least(0.9, 0.5 + count(*) / 100.0) AS score, min(id) AS voter_id, NULL::BIGINT AS related_voter_id "
    "FROM reg WHERE house_norm <> '' GROUP BY year, constituency_no, house_norm HAVING count(*) > 15",
    "age_outlier": _single_rule("age_outlier", "low", "0.4", "age < 18 OR age > 105"),
    "epic_malformed": _single_rule("epic_malformed", "low", "0.3", "epic_no <> '' AND NOT regexp_full_match(epic_no, '[A-Z]{3}[0-9]{7}')"),
}

#: The flag and review tables that adjudication queries run on.
NUMBERS = {"dup_epic": 1, "dup_identity": 2, "cross_part_dup": 3, "photo_reuse": 4, "house_overload": 5, "age_outlier": 6, "epic_malformed": 7, "phonetic_dup": 8}
_NUMBER = "CASE rule " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in NUMBERS.items()) + " END"
FLAG_ID = f"(voter_id * 1000000 + coalesce(related_voter_id, 0)) * 10 + {_NUMBER}"
REVIEW_COLUMNS = [
    ["id * 2 AS review_key", "id AS flag_id", "CASE voter_id % 4 WHEN 0 THEN 'confirmed' WHEN 2 THEN 'needs_info' ELSE 'legitimate' END AS verdict", "date_add(DATE '2025-01-01', cast(voter_id % 20 AS int)) AS reviewed_at"],
    ["id * 2 + 1 AS review_key", "id AS flag_id", "'confirmed' AS verdict", "date_add(DATE '2025-01-01', cast(voter_id % 20 + CASE WHEN voter_id % 12 = 0 THEN 0 ELSE 1 END AS int)) AS reviewed_at"],
]
_DUCK_REVIEWS = [", ".join(c).replace("date_add(DATE '2025-01-01', cast(", "(DATE '2025-01-01' + cast(") for c in REVIEW_COLUMNS]
FLAGS = f"""{BASE},
flags0 AS ({' UNION ALL '.join(RULES[r] for r in NUMBERS)}),
flags AS (SELECT {FLAG_ID} AS id, * FROM flags0),
reviews AS (SELECT {_DUCK_REVIEWS[0]} FROM flags WHERE voter_id % 3 = 0 UNION ALL SELECT {_DUCK_REVIEWS[1]} FROM flags WHERE voter_id % 6 = 0),
latest AS (SELECT flag_id, arg_max(verdict, (reviewed_at, review_key)) AS verdict, max(reviewed_at) AS reviewed_at FROM reviews GROUP BY flag_id)"""

_OTHER = "a.epic_no IS DISTINCT FROM b.epic_no"
MOBILES = "SELECT year, mobile_no, count(DISTINCT epic_no) AS n FROM reg WHERE coalesce(mobile_no, '') <> '' GROUP BY year, mobile_no"
BLOCKS = {
    "national_id": f"SELECT a.id AS a, b.id AS b {pairs_sql(f'''a.national_id_hash = b.national_id_hash AND a.national_id_hash <> '' AND {_OTHER}''')}",
    "dob": f"SELECT a.id AS a, b.id AS b {pairs_sql(f'''a.verified_dob = b.verified_dob AND a.verified_dob NOT LIKE '%-01-01' AND {_OTHER}''')}",
    "mobile": f"SELECT a.id AS a, b.id AS b {pairs_sql(f'a.mobile_no = b.mobile_no AND {_OTHER}')} WHERE NOT EXISTS (SELECT 1 FROM ({MOBILES}) m WHERE m.n > 4 AND m.year = a.year AND m.mobile_no = a.mobile_no)",
    "reference": f"SELECT a.id AS a, b.id AS b {pairs_sql(f'''a.relation_epic = b.relation_epic AND a.relation_epic <> '' AND {_OTHER}''')}",
    "sound": f"SELECT a.id AS a, b.id AS b {pairs_sql(f'''a.name_phonetic = b.name_phonetic AND a.name_phonetic <> '' AND {gap(8)} AND {_OTHER}''')}",
}


def cosine_cte(name: str, texts: str, pairs: str, prefix: str = "") -> str:
    """CTEs that end in ``name``(a, b, cosine) for the pairs; ``texts`` selects key, text, w."""
    return f"""{name}_g AS (SELECT key, g, sum(w) AS w FROM (SELECT key, w, unnest({grams_sql('text')}) AS g FROM ({texts})) GROUP BY key, g),
{name}_n AS (SELECT key, sqrt(sum(w * w)) AS n FROM {name}_g GROUP BY key),
{name} AS (SELECT q.a, q.b, sum(x.w * y.w) / any_value(nx.n * ny.n) AS cosine FROM ({pairs}) q JOIN {name}_g x ON x.key = q.a JOIN {name}_g y ON y.key = q.b AND y.g = x.g
  JOIN {name}_n nx ON nx.key = q.a JOIN {name}_n ny ON ny.key = q.b GROUP BY q.a, q.b)"""


VIEW = f"""view AS (SELECT *, coalesce(nullif(trim(verified_name), ''), trim(name), '') AS shown_name,
  {name_sql("coalesce(nullif(trim(verified_name), ''), trim(name), '')")} AS name_key, coalesce(trim(verified_dob), '') AS dob, coalesce(verified_age, age) AS best_age,
  coalesce(trim(relation_epic), '') AS reference, {name_sql('father_or_guardian_name')} AS father, {name_sql('mother_name')} AS mother, {name_sql('spouse_name')} AS spouse,
  coalesce(upper(substr(trim(gender), 1, 1)), '') AS sex, upper(coalesce(trim(category_type), '')) AS category, upper(coalesce(trim(relation_type_code), '')) AS relation_code FROM reg),
sound AS (SELECT name_key, {phonetic_sql('name_key')} AS sound_key FROM (SELECT DISTINCT name_key FROM view))"""


def evidence_sql() -> str:
    w = rules.POINTS
    both = lambda x: f"(a.{x} <> '' AND b.{x} <> '')"
    same = lambda x: f"(coalesce(a.{x}, '') <> '' AND a.{x} = b.{x})"
    differ = lambda x: f"({both(x)} AND a.{x} <> b.{x})"
    holder = "(a.dob LIKE '%-01-01' OR b.dob LIKE '%-01-01')"
    name = (
        f"CASE WHEN NOT {both('name_key')} THEN 0 WHEN a.name_key = b.name_key THEN {w['name_exact']} WHEN coalesce(cosine, 0) >= 0.85 THEN {w['name_strong']} "
        f"WHEN sa.sound_key <> '' AND sa.sound_key = sb.sound_key THEN {w['name_phonetic']} WHEN coalesce(cosine, 0) >= 0.62 THEN {w['name_weak']} ELSE {w['name_conflict']} END"
    )
    born = (
        f"CASE WHEN {same('dob')} THEN CASE WHEN a.dob LIKE '%-01-01' THEN {w['dob_placeholder']} ELSE {w['dob_exact']} END "
        f"WHEN {both('dob')} THEN CASE WHEN {holder} AND substr(a.dob, 1, 4) = substr(b.dob, 1, 4) THEN {w['dob_year']} WHEN NOT {holder} THEN {w['dob_conflict']} ELSE 0 END "
        f"WHEN a.best_age = b.best_age THEN {w['age_exact']} WHEN abs(a.best_age - b.best_age) <= 2 THEN {w['age_close']} WHEN abs(a.best_age - b.best_age) >= 8 THEN {w['age_far']} ELSE 0 END"
    )
    rest = [
        f"CASE WHEN {same('national_id_hash')} THEN {w['national_id']} WHEN {differ('national_id_hash')} THEN {w['national_id_conflict']} ELSE 0 END",
        f"CASE WHEN {same('mobile_no')} THEN CASE WHEN coalesce(m.n, 1) > 4 THEN {w['mobile_shared']} ELSE {w['mobile']} END ELSE 0 END",
        f"CASE WHEN {same('reference')} THEN {w['relation_epic']} WHEN {differ('reference')} THEN {w['relation_conflict']} ELSE 0 END",
        *[f"CASE WHEN {same(x)} THEN 0.6 ELSE 0 END" for x in ("father", "mother", "spouse")],
        f"CASE WHEN {same('house_norm')} AND coalesce(a.constituency_no, '') = coalesce(b.constituency_no, '') THEN {w['same_house']} ELSE 0 END",
        f"CASE WHEN {same('sex')} THEN {w['gender_same']} WHEN {differ('sex')} THEN {w['gender_diff']} ELSE 0 END",
    ]
    names = "SELECT DISTINCT x.name_key AS a, y.name_key AS b FROM cand JOIN view x ON x.id = cand.a JOIN view y ON y.id = cand.b WHERE x.name_key <> y.name_key AND x.name_key <> '' AND y.name_key <> ''"
    return f"""WITH {BASE}, {VIEW}, cand AS ({' UNION '.join(BLOCKS[k] for k in ('national_id', 'dob', 'mobile', 'reference', 'sound'))}), nm AS ({names}),
{cosine_cte('c', 'SELECT DISTINCT name_key AS key, name_key AS text, 1.0::DOUBLE AS w FROM view', 'SELECT * FROM nm')},
scored AS (SELECT a.id AS voter_id, b.id AS related_voter_id, round({name} + {born} + {' + '.join(rest)}, 6)::DOUBLE AS points FROM cand JOIN view a ON a.id = cand.a JOIN view b ON b.id = cand.b
  JOIN sound sa ON sa.name_key = a.name_key JOIN sound sb ON sb.name_key = b.name_key LEFT JOIN c ON c.a = a.name_key AND c.b = b.name_key
  LEFT JOIN ({MOBILES}) m ON m.year = a.year AND m.mobile_no = a.mobile_no)
SELECT 'new_model_1' AS rule, CASE WHEN points >= 6 THEN 'high' ELSE 'medium' END AS severity, round_even(least(1.0, points / 8), 3) AS score, voter_id, related_voter_id FROM scored WHERE points >= 4"""


def _compared() -> str:
    named = ["name_key", "father", "mother", "spouse", "relation_name_norm"]
    union = " UNION ".join(f"SELECT x.{c} AS a, y.{c} AS b FROM cand JOIN view x ON x.id = cand.a JOIN view y ON y.id = cand.b WHERE x.{c} <> y.{c} AND x.{c} <> '' AND y.{c} <> ''" for c in named)
    texts = "SELECT DISTINCT t AS key, t AS text, 1.0::DOUBLE AS w FROM (" + " UNION ".join(f"SELECT {c} AS t FROM view" for c in named) + ") WHERE t <> ''"
    like = lambda c, i: f"CASE WHEN a.{c} = '' OR b.{c} = '' THEN NULL WHEN a.{c} = b.{c} THEN 1.0 ELSE coalesce(round_even(c{i}.cosine, 3), 0) END"
    equal = lambda c: f"CASE WHEN coalesce(a.{c}, '') <> '' AND coalesce(b.{c}, '') <> '' THEN CASE WHEN a.{c} = b.{c} THEN 1.0 ELSE 0.0 END END"
    joins = " ".join(f"LEFT JOIN c c{i} ON c{i}.a = a.{c} AND c{i}.b = b.{c}" for i, c in enumerate(named))
    out = ["s_name", "s_father", "s_mother", "s_spouse", "s_refname"]
    return f"""{BASE}, {VIEW}, cand AS ({' UNION '.join(BLOCKS[k] for k in ('sound', 'reference', 'dob'))}),
{cosine_cte('c', texts, union)},
cmp AS (SELECT a.id AS a, b.id AS b, {', '.join(f'{like(c, i)} AS {o}' for i, (c, o) in enumerate(zip(named, out)))},
  CASE WHEN a.dob <> '' AND b.dob <> '' THEN CASE WHEN a.dob = b.dob THEN CASE WHEN a.dob LIKE '%-01-01' THEN 0.6 ELSE 1.0 END WHEN substr(a.dob, 1, 4) = substr(b.dob, 1, 4) THEN 0.5 ELSE 0.0 END END AS s_dob,
  {equal('reference')} AS s_ref, {equal('category')} AS s_cat, {equal('relation_code')} AS s_code, {equal('house_norm')} AS s_house, {equal('sex')} AS s_sex,
  CASE WHEN NOT (a.dob <> '' AND b.dob <> '') THEN greatest(0.0, 1 - abs(a.best_age - b.best_age) / 10.0) END AS s_age_raw,
  CASE WHEN NOT (a.dob <> '' AND b.dob <> '') AND a.best_age IS NOT NULL AND b.best_age IS NOT NULL THEN greatest(0.0, 1 - abs(a.best_age - b.best_age) / 10.0) END AS s_age,
  (a.reference = '' OR a.category IN ('SELF', 'NA', '') OR b.reference = '' OR b.category IN ('SELF', 'NA', '')) AS loose
  FROM cand JOIN view a ON a.id = cand.a JOIN view b ON b.id = cand.b {joins} WHERE NOT (a.sex <> '' AND b.sex <> '' AND a.sex <> b.sex)),
anchored AS (SELECT * FROM cmp WHERE coalesce(s_father >= 0.85, false) OR coalesce(s_mother >= 0.85, false) OR coalesce(s_spouse >= 0.85, false) OR coalesce(s_dob >= 0.995, false) OR coalesce(s_ref >= 0.995, false))"""


def fuzzy_new_sql() -> str:
    w = {"s_name": 0.34, "s_dob": 0.20, "s_father": 0.14, "s_mother": 0.12, "s_ref": 0.10, "s_refname": 0.06, "s_spouse": 0.02, "s_age": 0.02}
    total = " + ".join(f"coalesce({k}, 0) * {v}::DOUBLE" for k, v in w.items())
    weight = " + ".join(f"({k} IS NOT NULL)::INT * {v}::DOUBLE" for k, v in w.items())
    n = " + ".join(f"({k} IS NOT NULL)::INT" for k in w)
    return f"""WITH {_compared()}, s AS (SELECT *, ({total}) / nullif({weight}, 0) AS sc, {n} AS n FROM anchored WHERE s_name IS NOT NULL)
SELECT 'fuzzy_new' AS rule, CASE WHEN sc >= 0.88 THEN 'high' ELSE 'medium' END AS severity, round_even(sc, 3) AS score, a AS voter_id, b AS related_voter_id
FROM s WHERE n >= 3 AND sc >= CASE WHEN loose THEN 0.66 ELSE 0.72 END"""


def cosine_new_sql() -> str:
    shown = ["s_name", "s_dob", "s_father", "s_mother", "s_spouse", "s_cat", "s_code", "s_ref", "s_house", "s_age", "s_sex"]
    n = " + ".join(f"({k} IS NOT NULL)::INT" for k in shown)
    texts = " UNION ALL ".join(f"SELECT id AS key, '{k}:' || {c} AS text, {rules.VECTOR_WEIGHTS[k]}::DOUBLE AS w FROM view WHERE {c} <> ''" for k, c in rules.VECTOR_COLUMNS.items())
    return f"""WITH {_compared()}, gated AS (SELECT * FROM anchored WHERE s_name >= 0.85 AND {n} >= 3 AND coalesce(s_dob > 0, true)),
{cosine_cte('v', texts, 'SELECT a, b FROM gated')}
SELECT 'cosine_new' AS rule, CASE WHEN cosine >= 0.90 THEN 'high' ELSE 'medium' END AS severity, round_even(cosine, 3) AS score, v.a AS voter_id, v.b AS related_voter_id
FROM gated JOIN v USING (a, b) WHERE cosine >= CASE WHEN loose THEN 0.74 ELSE 0.80 END"""


def cosine_dup_sql() -> str:
    texts = "SELECT id AS key, trim(concat_ws(' ', coalesce(name_norm, ''), coalesce(relation_name_norm, ''), coalesce(house_norm, ''), coalesce(age::VARCHAR, ''), coalesce(gender, ''))) AS text, 1.0::DOUBLE AS w FROM reg"
    pairs = f"SELECT a.id AS a, b.id AS b {pairs_sql(f'''a.name_phonetic = b.name_phonetic AND a.name_phonetic <> '' AND {gap(8)}''')}"
    return f"""WITH {BASE}, {cosine_cte('c', texts, pairs)}
SELECT 'cosine_dup' AS rule, 'medium' AS severity, round_even(cosine, 3) AS score, a AS voter_id, b AS related_voter_id FROM c WHERE cosine >= 0.80"""


def fuzzy_dup_sql() -> str:
    alike = lambda x: f"coalesce(len(list_intersect(x.{x}, y.{x})) / nullif(len(list_distinct(list_concat(x.{x}, y.{x}))), 0)::DOUBLE, 0)"
    return f"""WITH {BASE}, t AS (SELECT id, {pg_grams_sql('name_norm')} AS g, {pg_grams_sql('relation_name_norm')} AS r FROM reg),
s AS (SELECT a.id AS voter_id, b.id AS related_voter_id, (0.45::DOUBLE * {alike('g')} + 0.20::DOUBLE * {alike('r')}
  + 0.15::DOUBLE * CASE WHEN a.house_norm <> '' AND a.house_norm = b.house_norm THEN 1.0 ELSE 0.0 END + 0.10::DOUBLE * greatest(0.0, 1 - abs(coalesce(a.age, 0) - coalesce(b.age, 0)) / 10.0::DOUBLE)
  + 0.10::DOUBLE * (a.gender = b.gender)::INT)::FLOAT AS score {pairs_sql(f'''a.name_phonetic = b.name_phonetic AND a.name_phonetic <> '' AND {gap(8)}''')} JOIN t x ON x.id = a.id JOIN t y ON y.id = b.id)
SELECT 'fuzzy_dup' AS rule, 'medium' AS severity, round(score::DOUBLE, 3) AS score, voter_id, related_voter_id FROM s WHERE score::DOUBLE >= 0.70"""


CLUSTERS = """clusters AS (SELECT year, reference, count(DISTINCT father) FILTER (father <> '') AS names, list_sort(list_distinct(list(father) FILTER (father <> ''))) AS fathers, count(*) AS children FROM view WHERE reference <> '' GROUP BY year, reference)"""


def family_ctes() -> str:
    """CTEs ``sib`` and ``refs``; father names that differ at all are compared by a recursive fold."""
    return f"""{BASE}, {VIEW},
kids AS (SELECT id, year, father, mother, CASE WHEN dob <> '' AND dob NOT LIKE '%-01-01' THEN try_cast(dob AS DATE) END AS born FROM view WHERE father <> '' AND mother <> ''),
gaps AS (SELECT x.year, x.father, x.mother, count(*) AS gaps FROM kids x JOIN kids y ON x.year = y.year AND x.father = y.father AND x.mother = y.mother AND x.id < y.id AND abs(x.born - y.born) BETWEEN 1 AND 270 GROUP BY ALL),
sib AS (SELECT k.year, k.father, k.mother, count(*) AS children, min(id) AS rep, coalesce(any_value(g.gaps), 0) AS gaps FROM kids k LEFT JOIN gaps g USING (year, father, mother) GROUP BY k.year, k.father, k.mother HAVING count(*) >= 6 OR any_value(g.gaps) > 0),
fa AS (SELECT DISTINCT year, reference, father FROM view WHERE reference <> '' AND father <> ''),
fr AS (SELECT *, row_number() OVER (PARTITION BY year, reference ORDER BY father) AS i FROM fa),
{cosine_cte('fc', "SELECT DISTINCT father AS key, father AS text, 1.0::DOUBLE AS w FROM fa", "SELECT DISTINCT x.father AS a, y.father AS b FROM fa x JOIN fa y ON x.year = y.year AND x.reference = y.reference AND x.father < y.father")},
fold(year, reference, i, kept) AS (SELECT year, reference, 1::BIGINT, [father] FROM fr WHERE i = 1 UNION ALL
  SELECT f.year, f.reference, fr.i, CASE WHEN EXISTS (SELECT 1 FROM fc WHERE fc.b = fr.father AND list_contains(f.kept, fc.a) AND fc.cosine >= 0.6) THEN f.kept ELSE list_append(f.kept, fr.father) END
  FROM fold f JOIN fr ON fr.year = f.year AND fr.reference = f.reference AND fr.i = f.i + 1),
fathers AS (SELECT year, reference, max(len(kept)) AS n FROM fold GROUP BY year, reference),
first_epic AS (SELECT year, trim(epic_no) AS epic, min(id) AS id FROM reg WHERE trim(epic_no) <> '' GROUP BY ALL),
parent AS (SELECT f.year, f.epic AS reference, r.id AS parent, coalesce(r.verified_age, r.age) AS parent_age, nullif(trim(r.relation_epic), '') AS up FROM first_epic f JOIN reg r ON r.id = f.id),
ages AS (SELECT v.year, v.reference, count(*) FILTER (parent_age - best_age < 15) AS under_15, count(*) FILTER (parent_age - best_age > 50) AS over_50 FROM view v JOIN parent p ON p.year = v.year AND p.reference = v.reference AND p.parent <> v.id GROUP BY ALL),
refs AS (SELECT c.year, c.reference, c.children, coalesce(f.n, 0) AS father_names, coalesce(under_15, 0) AS under_15, coalesce(over_50, 0) AS over_50
  FROM (SELECT year, reference, count(*) AS children FROM view WHERE reference <> '' GROUP BY ALL) c LEFT JOIN fathers f USING (year, reference) LEFT JOIN ages a USING (year, reference))"""


def family_logic_sql() -> str:
    score = "CASE severity WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.4 END"
    return f"""WITH RECURSIVE {family_ctes()},
f AS (SELECT CASE WHEN gaps > 0 OR children >= 10 THEN 'high' ELSE 'medium' END AS severity, rep FROM sib UNION ALL
  SELECT CASE WHEN under_15 > 0 THEN 'high' WHEN over_50 > 0 THEN 'medium' ELSE 'low' END, r.rep FROM refs JOIN
  (SELECT year, reference, min(id) AS rep FROM view WHERE reference <> '' AND id NOT IN (SELECT rep FROM sib) GROUP BY ALL) r USING (year, reference) WHERE father_names >= 2 OR under_15 > 0 OR over_50 > 0)
SELECT 'family_logic' AS rule, severity, {score} AS score, rep AS voter_id, NULL::BIGINT AS related_voter_id FROM f"""


def findings_ctes() -> str:
    return f"""{family_ctes()},
prog AS (SELECT year, reference, count(DISTINCT nullif(trim(epic_no), '')) AS progeny FROM view WHERE reference <> '' GROUP BY ALL),
ctx AS (SELECT v.id, v.year, v.age, v.best_age, v.relation_code AS code, CASE WHEN v.dob <> '' AND v.dob NOT LIKE '%-01-01' THEN try_cast(v.dob AS DATE) END AS born, g.progeny, rf.father_names, p.parent_age, e.parent_age AS elder_age
  FROM view v LEFT JOIN prog g USING (year, reference) LEFT JOIN refs rf USING (year, reference) LEFT JOIN parent p USING (year, reference) LEFT JOIN parent e ON e.year = v.year AND e.reference = p.up),
ctx2 AS (SELECT *, CASE WHEN code IN ('FTHR','MTHR','FATHER','MOTHER','F','M') THEN parent_age - best_age END AS pg,
  CASE WHEN code IN ('GFTH','GMTH') THEN parent_age WHEN code IN ('FTHR','MTHR','FATHER','MOTHER','F','M') THEN elder_age END - best_age AS eg, abs(age - (year - year(born) - 1)) AS dg FROM ctx),
finds AS (SELECT id, 'progeny_overload' AS "check", CASE WHEN progeny >= 10 THEN 'high' ELSE 'medium' END AS severity, progeny::INT AS gap FROM ctx2 WHERE progeny >= 6
  UNION ALL SELECT id, 'father_name_conflict', 'low', father_names FROM ctx2 WHERE father_names >= 2
  UNION ALL SELECT id, 'parent_age_under_15', 'high', pg FROM ctx2 WHERE pg < 15 UNION ALL SELECT id, 'parent_age_over_50', 'medium', pg FROM ctx2 WHERE pg > 50
  UNION ALL SELECT id, 'grandparent_age_le_40', 'high', eg FROM ctx2 WHERE eg <= 40 UNION ALL SELECT id, 'age_dob_gap', CASE WHEN dg > 10 THEN 'high' ELSE 'medium' END, dg FROM ctx2 WHERE dg > 5)"""


def report_ctes() -> str:
    rank = lambda c: f"CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
    return f"""{findings_ctes()},
lead_flags AS MATERIALIZED (SELECT * FROM ({cosine_new_sql()}) UNION ALL SELECT * FROM ({fuzzy_new_sql()})),
leads AS (SELECT rule, severity, score, voter_id AS id, related_voter_id AS partner FROM lead_flags UNION ALL SELECT rule, severity, score, related_voter_id, voter_id FROM lead_flags),
lg AS (SELECT id, count(*) AS n_logical, max({rank('severity')}) AS lr, string_agg(DISTINCT "check", ', ' ORDER BY "check") AS checks FROM finds GROUP BY id),
dl AS (SELECT id, count(*) FILTER (rule = 'cosine_new') AS n_cosine, count(*) FILTER (rule = 'fuzzy_new') AS n_fuzzy, max(score) AS best_dup, max({rank('severity')}) AS dr FROM leads GROUP BY id),
rep0 AS (SELECT v.id, v.year, v.epic_no, {seat_sql('v.constituency_no')} AS constituency, v.part_no, v.shown_name AS name, coalesce(lower(trim(v.category_type)) = 'na', false) AS no_mapping, coalesce(n_logical, 0) AS n_logical, coalesce(lr, 0) AS logical_rank,
  coalesce(n_cosine, 0) AS n_cosine, coalesce(n_fuzzy, 0) AS n_fuzzy, coalesce(best_dup, 0) AS best_dup, coalesce(dr, 0) AS dup_rank, checks FROM view v LEFT JOIN lg USING (id) LEFT JOIN dl USING (id)),
rep AS (SELECT *, n_cosine + n_fuzzy AS n_dups, CASE WHEN n_cosine + n_fuzzy > 0 THEN 0 WHEN n_logical > 0 THEN 1 ELSE 2 END AS tier,
  CASE greatest(logical_rank, dup_rank, no_mapping::INT) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  concat_ws(' · ', CASE WHEN n_cosine > 0 THEN 'cosine×' || n_cosine END, CASE WHEN n_fuzzy > 0 THEN 'fuzzy×' || n_fuzzy END, CASE WHEN n_logical > 0 THEN 'logical: ' || checks END, CASE WHEN no_mapping THEN 'no-mapping (na)' END) AS summary
  FROM rep0 WHERE n_logical > 0 OR no_mapping OR n_cosine + n_fuzzy > 0)"""


def household_ctes() -> str:
    kind = "CASE WHEN upper(trim(relation_type)) IN ('F','M','FTHR','MTHR','FATHER','MOTHER') THEN 'parent' WHEN upper(trim(relation_type)) IN ('H','W','HSBN','HUSBAND','WIFE') THEN 'spouse' ELSE '' END"
    small = "CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END"
    big = "CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END"
    match = f"(rel = o_norm OR (len({small}) >= 2 AND list_has_all({big}, {small})) OR (len({small}) = 1 AND length(({small})[1]) >= 4 AND ({small})[1] = ({big})[1]))"
    want = "CASE relation WHEN 'F' THEN 'M' WHEN 'H' THEN 'M' WHEN 'M' THEN 'F' WHEN 'W' THEN 'F' END"
    return f"""{BASE}, hreg AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN (SELECT min(n) FROM p WHERE k % 11 <> 0 AND k % 13 <> 0) ELSE relation_name END AS relation_name) FROM reg),
mem AS (SELECT year, constituency_no, house_norm, id, name, age, CASE WHEN upper(substr(trim(gender), 1, 1)) IN ('M', 'F') THEN upper(substr(trim(gender), 1, 1)) ELSE '?' END AS sex, name_norm, {name_sql('relation_name')} AS rel,
  {kind} AS kind, upper(substr(trim(relation_type), 1, 1)) AS relation FROM hreg WHERE house_norm <> ''),
near AS (SELECT * FROM (SELECT a.*, b.id AS o_id, b.age AS o_age, b.sex AS o_sex, b.name_norm AS o_norm, string_split(a.rel, ' ') AS ta, string_split(b.name_norm, ' ') AS tb FROM mem a JOIN mem b
  ON a.year = b.year AND a.constituency_no = b.constituency_no AND a.house_norm = b.house_norm AND a.id <> b.id WHERE a.rel <> '' AND a.kind <> '' AND b.name_norm <> '') WHERE {match}),
ranked AS (SELECT *, CASE WHEN {want} = o_sex THEN 2 ELSE 0 END + CASE WHEN coalesce(age, 0) <> 0 AND coalesce(o_age, 0) <> 0 THEN
  CASE WHEN kind = 'parent' THEN CASE WHEN o_age - age BETWEEN 13 AND 60 THEN 2 WHEN o_age - age >= 13 THEN 1 ELSE -2 END ELSE CASE WHEN abs(o_age - age) <= 20 THEN 1 ELSE -1 END END ELSE 0 END + CASE WHEN rel = o_norm THEN 1 ELSE 0 END AS sc FROM near),
link AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY id ORDER BY sc DESC, (o_id % 4) , o_id) = 1),
edge AS (SELECT id AS x, o_id AS y FROM link UNION SELECT o_id, id FROM link),
reach(id, node) AS (SELECT x, x FROM edge UNION SELECT reach.id, edge.y FROM reach JOIN edge ON edge.x = reach.node),
comp AS (SELECT id, min(node) AS family FROM reach GROUP BY id)"""
