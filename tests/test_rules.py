"""Rules at their thresholds, on micro registers."""

import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkin.functions import dates as dt
from rollkin.functions import similarity as sim
from rollkin.functions import sql_functions
from rollkin.functions import text as tx
from rollkin.operators import candidates, combined, flags, household, rules
from rollkin.sources import registry as rg
from rollkin.sources.scratch import written

COLUMNS = {
    "id": "long", "year": "int", "constituency_no": "string", "part_no": "string", "serial_no": "int", "epic_no": "string", "name": "string", "relation_type": "string",
    "relation_name": "string", "house_number": "string", "age": "int", "gender": "string", "verified_name": "string", "verified_dob": "string", "verified_age": "int", "mobile_no": "string",
    "relation_epic": "string", "relation_type_code": "string", "category_type": "string", "father_or_guardian_name": "string", "mother_name": "string", "spouse_name": "string",
    "national_id_hash": "string", "lookup_status": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


@pytest.fixture
def register(spark):
    def make(*rows):
        base = {"year": 2024, "constituency_no": "S1", "part_no": "1", "name": "ALPHA BETA", "relation_name": "GAMMA", "house_number": "A-1", "age": 40, "gender": "Male"}
        full = [{**dict.fromkeys(COLUMNS), **base, "id": i, "serial_no": i, "epic_no": f"ABC{i:07d}", **r} for i, r in enumerate(rows, 1)]
        return rg.with_derived_columns(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in full], SCHEMA))

    return make


def pairs(found):
    return sorted((r["voter_id"], r["related_voter_id"]) for r in found.collect())


def test_exact_rules(register):
    rows = register({"epic_no": "ABC0000009"}, {"epic_no": "ABC0000009", "age": 41}, {"age": 42, "part_no": "2"}, {"age": 99, "year": 2025})
    assert pairs(rules.dup_epic(rows)) == [(1, 2)]
    assert pairs(rules.dup_identity(rows)) == [(2, 3)]  # equal IDs don't count, ages two apart don't, years don't mix
    assert pairs(rules.cross_part_dup(rows)) == [(2, 3)]
    assert pairs(rules.phonetic_dup(register({"name": "RED WIDGET"}, {"name": "RRED WIDGET", "age": 42}, {"name": "RED WIDGET", "age": 43}))) == [(1, 2), (2, 3)]


def test_null_and_blank_ids_in_dup_identity(register):
    assert pairs(rules.dup_identity(register({"epic_no": None}, {}, {"epic_no": ""}))) == [(2, 3)]


@pytest.mark.parametrize(("n", "flagged"), [(15, 0), (16, 1)])
def test_house_overload(register, n, flagged):
    found = rules.house_overload(register(*[{"name": f"N{i}"} for i in range(n)])).collect()
    assert len(found) == flagged and all(r["voter_id"] == 1 and r["related_voter_id"] is None for r in found)


def test_single_record_rules(register):
    rows = register(*[{"age": a} for a in (17, 18, 105, 106, None)], {"epic_no": "AB12"}, {"epic_no": ""}, {"epic_no": "ABC1234567"})
    assert [v for v, _ in pairs(rules.age_outlier(rows))] == [1, 4]
    assert [v for v, _ in pairs(rules.epic_malformed(rows))] == [6]


def test_fuzzy_dup_float_cutoff_and_null_gender(register):
    # names and relations alike, other house, ages 5 apart, other gender: .45 + .20 + .05 = .70, which as a float is below
    assert pairs(rules.fuzzy_dup(register({}, {"house_number": "B-2", "age": 45, "gender": "Female"}))) == []
    assert pairs(rules.fuzzy_dup(register({}, {"house_number": "B-2", "age": 44, "gender": "Female"}))) == [(1, 2)]
    assert pairs(rules.fuzzy_dup(register({}, {"gender": None}))) == []


def test_banded_join_equals_the_plain_one(register):
    rows = register(*[{"age": a} for a in (None, 0, 7, 8, 9, 16, 17, 18, 25, 26, 40, 48, 49)])
    banded = sorted((r["id_a"], r["id_b"]) for r in rules.banded_pairs(rows, "name_phonetic", []).collect())
    assert banded == sorted((r["id_a"], r["id_b"]) for r in rules.pairs_on(rows, ["name_phonetic"], ["age"], rules.age_gap(8)).collect())


def test_shared_mobile_cap(register):
    rows = register(*[{"mobile_no": "9", "name": f"P{chr(65 + i)}"} for i in range(5)], *[{"mobile_no": "8", "name": f"Q{chr(65 + i)}"} for i in range(4)])
    assert [r["mobile_no"] for r in rules.shared_mobiles(rows).collect()] == ["9"]
    assert all(r["a"] > 5 and r["b"] > 5 for r in rules.same_mobile(rows).collect())


def signals(register, a, b):
    base = {"verified_dob": "1980-05-05"}
    row = rules.evidence(register({**base, **a}, {**base, **b})).first()
    return row and (row["points"], {s["signal"] for s in row["signals"]})


def test_evidence_signals(register):
    points, found = signals(register, {}, {})
    assert found == {"name_exact", "dob_exact", "same_house", "gender_same"} and points == pytest.approx(6.35)
    _, found = signals(register, {"national_id_hash": "x"}, {"national_id_hash": "x", "gender": "Female", "name": "ZULU"})
    assert {"national_id", "gender_diff", "name_conflict"} <= found
    _, found = signals(register, {"verified_dob": "1980-01-01", "relation_epic": "R1"}, {"verified_dob": "1980-01-01", "relation_epic": "R1"})
    assert {"dob_placeholder", "relation_epic"} <= found
    _, found = signals(register, {"verified_dob": None}, {"age": 48})
    assert "age_far" in found and "dob_exact" not in found


def test_evidence_threshold_and_reason(register):
    weak = {"house_number": "B-9", "gender": None, "verified_dob": None}
    rows = register({**weak, "age": 40, "mobile_no": "7"}, {**weak, "age": 41, "mobile_no": "7"})  # 2.5 + .4 + 1.8 = 4.7
    row = rules.new_model_1(rows).first()
    assert row["severity"] == "medium" and "name exact" in row["details"] and "Points for one identity" in row["details"]
    assert rules.new_model_1(register({**weak, "name": "ALPHA BETA"}, {**weak, "age": 43})).count() == 0


def test_comparison_models_need_an_anchor(register):
    same = {"verified_dob": "1980-05-05", "father_or_guardian_name": "DELTA", "category_type": "progeny", "relation_epic": "R1"}
    assert pairs(rules.fuzzy_new(register(same, same))) == [(1, 2)] and pairs(rules.cosine_new(register(same, same))) == [(1, 2)]
    bare = {"category_type": "progeny"}
    assert pairs(rules.fuzzy_new(register(bare, bare))) == []
    assert pairs(rules.fuzzy_new(register(same, {**same, "gender": "Female"}))) == []
    assert pairs(rules.cosine_new(register(same, {**same, "verified_dob": "1991-06-06"}))) == []


def test_looser_bar_without_a_reference(register):
    a = {"verified_dob": "1980-05-05", "category_type": "progeny", "relation_epic": "R1", "father_or_guardian_name": "DELTA", "mother_name": "ECHO"}
    b = {**a, "mother_name": "QQQQQQ", "relation_epic": "R2", "father_or_guardian_name": "DELTX"}
    score = {r["voter_id"]: r["score"] for r in rules.fuzzy_new(register(a, b), strict=False).collect()}
    assert pairs(rules.fuzzy_new(register(a, b))) == ([] if score.get(1, 0) < 0.72 else [(1, 2)])


def test_families(register):
    kids = [{"father_or_guardian_name": "DAD", "mother_name": "MUM", "verified_dob": d, "name": f"K{chr(65 + i)}"} for i, d in enumerate(["2000-02-02", "2000-02-02", "2000-10-29", "1990-03-03", "1980-01-01"])]
    group = rules.sibling_groups(register(*kids)).first()
    assert (group["children"], group["gaps"], group["severity"]) == (5, 2, "high")  # 270 days apart counts, equal days don't
    assert rules.sibling_groups(register(*kids[:2], {**kids[3], "verified_dob": "2000-10-30"})).count() == 0  # 271 days
    six = rules.sibling_groups(register(*[{**kids[4], "name": f"N{i}"} for i in range(6)])).first()
    assert six["severity"] == "medium" and six["rep"] == 1


@pytest.mark.parametrize(("gap", "under", "over"), [(14, 1, 0), (15, 0, 0), (50, 0, 0), (51, 0, 1)])
def test_parent_age(register, gap, under, over):
    rows = register({"epic_no": "ABC0000001", "age": 20 + gap}, {"relation_epic": "ABC0000001", "age": 20})
    got = rules.reference_groups(rows).first()
    assert (got["under_15"], got["over_50"]) == (under, over)


def test_father_name_clusters(register):
    rows = register(*[{"relation_epic": "R", "father_or_guardian_name": f, "name": f"C{i}"} for i, f in enumerate(["RAM KUMAR", "RAM KUMARR", "SHYAM LAL", None])])
    assert rules.reference_groups(rows).first()["father_names"] == ["RAM KUMAR", "SHYAM LAL"]


def cosine(a, b):
    x, y = (Counter(f"  {t} "[i : i + 3] for i in range(len(t) + 1)) for t in (a, b))
    norm = lambda v: sum(n * n for n in v.values()) ** 0.5
    return sum(x[g] * y[g] for g in x) / (norm(x) * norm(y))


@pytest.mark.parametrize("few", [20_000, 3])
def test_father_name_clusters_equal_a_plain_fold(spark, monkeypatch, few):
    """Each name in the order of the alphabet is kept unless a kept one is similar; chains and a hot reference included."""
    monkeypatch.setattr(rules, "FEW_PAIRS", few)
    monkeypatch.setattr(rules, "ROUND_NAMES", 25)
    parts = ["RAM", "KUMAR", "SHYAM", "LAL", "RAMA", "KUMARI", "DEV", "DEVI"]
    names = sorted({f"{a} {b}" for a in parts for b in parts} | {"A", "AB", "ABC", "ABCD", "ABCDE", "ABCDEF", "ABCDEFG", "AAAA", "AAAAAA"})
    rows = [(2024, "hot", n) for n in names] + [(2024, f"R{i % 9}", n) for i, n in enumerate(names)] + [(2025, "one", "RAM")]

    want = {}
    for year, reference, n in sorted(rows):
        kept = want.setdefault((year, reference), [])
        if all(cosine(n, k) < 0.6 for k in kept):
            kept.append(n)
    got = rules.name_clusters(spark.createDataFrame(rows, "year int, reference string, father string")).collect()
    assert sorted(map(tuple, got)) == sorted((*k, n) for k, v in want.items() for n in v)
    assert rules.name_clusters(spark.createDataFrame([], "year int, reference string, father string")).count() == 0


def test_a_long_chain_of_names_takes_few_rounds(spark, monkeypatch):
    word = "".join(np.random.default_rng(5).choice(list(string.ascii_uppercase), 3020))
    names = sorted({word[i : i + 12] for i in range(0, 3000, 3)})
    kept = []
    for n in names:
        if all(cosine(n, k) < 0.6 for k in kept):
            kept.append(n)
    tables = []
    monkeypatch.setattr(rules, "written", lambda df, name: tables.append(name) or written(df, name))
    got = rules.name_clusters(spark.createDataFrame([(2024, "R", n) for n in names], "year int, reference string, father string")).collect()
    assert sorted(r["father"] for r in got) == kept and len(kept) < len(names) and len(tables) < 12


def test_composite_keys_lose_no_pair():
    """Every choice of signals that reaches the threshold shares all values of one of the keys."""
    keys = [set(k) for k in candidates.composite_keys(candidates.EVIDENCE_GROUPS, rules.POINTS, rules.EVIDENCE_THRESHOLD)]
    sets = list(candidates.signal_sets(candidates.EVIDENCE_GROUPS, rules.POINTS, rules.EVIDENCE_THRESHOLD, candidates.BLOCK_SIGNALS, "name_phonetic"))
    assert len(sets) > 5000 and len(keys) < 40
    assert all(any(k <= s | ({"sound_key"} if "name_key" in s else set()) for k in keys) for s in sets)
    assert all(len(k) > 1 or k == {"national_id_hash"} for k in keys)


def test_evidence_pairs_are_those_that_reach_the_threshold(register):
    """Against scoring all pairs of five blocks: nothing above the threshold is lost, and what can't reach it isn't made."""
    r = np.random.default_rng(8)
    pick = lambda *x: x[r.integers(len(x))]
    rows = register(*[{
        "name": pick("RAM KUMAR", "RAM KUMARI", "RAMA KUMAR", "SITA", "GEETA LAL"), "verified_dob": pick("1980-05-05", "1981-06-06", "1980-01-01", None), "mobile_no": pick("1", "2", "3", None),
        "relation_epic": pick("R1", "R2", None), "father_or_guardian_name": pick("DEV", "LAL", None), "mother_name": pick("UMA", None), "spouse_name": None, "house_number": pick("1", "2", None),
        "gender": pick("Male", "Female", None), "age": int(r.integers(30, 45)), "national_id_hash": pick("x", None, None, None),
    } for _ in range(90)])
    view = rules.written(rules.identity_view(rows), "view")
    bounded = {tuple(x) for x in candidates.evidence_pairs(view, rules.mobile_counts(rows), rules.POINTS, rules.EVIDENCE_THRESHOLD, rules.AGE_WINDOW).collect()}
    whole = {tuple(x) for x in rules.identity_candidates(rows).collect()}
    flagged = {(x["voter_id"], x["related_voter_id"]) for x in rules.new_model_1(rows).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(candidates, "evidence_pairs", lambda *_: rules.identity_candidates(rows))
        wanted = {(x["voter_id"], x["related_voter_id"]) for x in rules.new_model_1(rows).collect()}
    assert flagged == wanted and wanted and flagged <= bounded <= whole and len(bounded) < 0.8 * len(whole)


def test_anchored_pairs_are_all_that_the_models_can_flag(register):
    r = np.random.default_rng(9)
    pick = lambda *x: x[r.integers(len(x))]
    rows = register(*[{
        "name": pick("RAM KUMAR", "RAM KUMARR", "SITA"), "verified_dob": pick("1980-05-05", "1980-01-01", None), "relation_epic": pick("R1", None, None), "category_type": "progeny",
        "father_or_guardian_name": pick("DEVENDRA SINGH", "DEVENDRA SINGHH", "LAL", None), "mother_name": pick("UMA DEVI", "UMA DEVII", None), "gender": pick("Male", None), "age": int(r.integers(30, 40)),
    } for _ in range(70)])
    flagged = {(x["rule"], x["voter_id"], x["related_voter_id"]) for x in rules.duplicate_leads(rows).collect()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(candidates, "anchored_sound_pairs", lambda *_: rules.same_sound(rows).select("a", "b"))
        assert flagged == {(x["rule"], x["voter_id"], x["related_voter_id"]) for x in rules.duplicate_leads(rows).collect()} and flagged


def test_sql_functions_equal_the_column_functions(spark):
    values = [" Mr. Ram  kumar-Rao", "SHRI O'NEIL", "", None, "E-72/b", "Knight Thompson", "éclair 9", "DR DR X", "1980-01-01"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    sql_functions.register(spark)
    want = df.select("v", tx.norm_name(F.col("v")), tx.norm_house(F.col("v")), tx.phonetic(tx.norm_name(F.col("v"))), sim.word_grams(F.col("v")), dt.is_placeholder(F.col("v")), tx.seat_key(F.col("v")))
    got = spark.sql("SELECT v, norm_name(v), norm_house(v), phonetic(norm_name(v)), word_grams(v), is_placeholder(v), seat_key(v) FROM {df}", df=df)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_rules_as_sql_beside_the_others(register):
    rows = register({"age": 17}, {}, {"epic_no": "ABC0000002", "name": "OTHER"})
    young = "SELECT 'low' AS severity, 0.4 AS score, id AS voter_id, named_struct('age', age) AS details FROM {register} WHERE age < 18"
    found = rules.run_rules(rows, ["age_outlier", "too_young"], sql={"too_young": young, "not_selected": "SELECT 1"})
    assert sorted((r["rule"], r["voter_id"], r["related_voter_id"], r["details"]) for r in found.collect()) == [("age_outlier", 1, None, '{"age":17}'), ("too_young", 1, None, '{"age":17}')]
    twice = rules.run_rules(rows, ["pair"], sql={"pair": "SELECT 'high' AS severity, 1 AS score, 3 AS voter_id, 2 AS related_voter_id, 'x' AS extra"}).collect()
    assert [(r["voter_id"], r["related_voter_id"], r["details"]) for r in twice] == [(2, 3, "{}")]
    with pytest.raises(ValueError, match="there already"):
        rules.run_rules(rows, sql={"dup_epic": young})
    with pytest.raises(ValueError, match="gives no score"):
        rules.sql_rule(rows, "bad", "SELECT 1 AS voter_id, 'low' AS severity")


def test_siblings_of_shown_persons(register):
    rows = register(*[{"relation_epic": "R", "epic_no": f"ABC000000{i}", "name": f"N{i}"} for i in range(6)], {"relation_epic": "S", "epic_no": "ABC0000010"})
    assert {(r["id"], r["others"]) for r in combined.siblings(rows).collect()} == {(i, 5) for i in range(1, 7)}
    shown = combined.siblings_of(rows, rows.where("id IN (2, 7)").select("id")).collect()
    assert {(r["id"], r["sibling"]) for r in shown} == {(2, i) for i in (1, 3, 4, 5, 6)} and shown[0]["entry"].endswith(")")


@pytest.mark.parametrize(("gap", "checks"), [(5, set()), (6, {("age_dob_gap", "medium")}), (10, {("age_dob_gap", "medium")}), (11, {("age_dob_gap", "high")})])
def test_age_against_birth_date(register, gap, checks):
    rows = register({"verified_dob": "1983-06-06", "age": 40 + gap})  # 40 on 1 January 2024
    assert {(r["check"], r["severity"]) for r in combined.findings(rows).collect()} == checks


@pytest.mark.parametrize(("gap", "fires"), [(40, True), (41, False)])
def test_grandparents(register, gap, fires):
    rows = register({"epic_no": "E1", "age": 20 + gap}, {"epic_no": "E2", "age": 38, "relation_epic": "E1"}, {"relation_epic": "E2", "relation_type_code": "FTHR", "age": 20})
    assert any(r["check"] == "grandparent_age_le_40" for r in combined.findings(rows).where("id = 3").collect()) is fires


def test_report_order_and_filter(register):
    rows = register({"category_type": "na"}, {"verified_dob": "1950-06-06"}, {}, {"age": 41})
    leads = rules.dup_identity(rows).withColumn("rule", F.lit("cosine_new"))
    report = combined.report(rows, leads)
    ranked = {r["id"]: (r["rank"], r["tier"]) for r in combined.ranked(report, per_part=2).collect()}
    assert [ranked[i][1] for i in (1, 2, 3, 4)] == [0, 0, 0, 0] and sorted(r for r, _ in ranked.values()) == [1, 2, 3, 4]
    assert combined.report(rows, leads, "nowhere").count() == 0


def test_household_graph(register):
    rows = register(
        {"name": "FATHER ONE", "age": 60}, {"name": "SON ONE", "relation_type": "Father", "relation_name": "FATHER ONE", "age": 30},
        {"name": "WIFE ONE", "relation_type": "Husband", "relation_name": "SON", "age": 28, "gender": "Female"},
        {"name": "WIFE TWO", "relation_type": "Husband", "relation_name": "SON ONE", "age": 27, "gender": "Female"},
        {"name": "CHILD", "relation_type": "Father", "relation_name": "SON ONE", "age": 25}, {"name": "LONE", "age": 50}, {"name": "LONE", "relation_type": "Wife", "relation_name": "NOBODY", "age": 51},
    )
    people = household.members(rows)
    found = household.links(people)
    assert {r["id"]: r["target"] for r in found.collect()} == {2: 1, 4: 2, 5: 2}  # "SON" has three letters
    family = {r["id"]: r["family"] for r in household.families(people, found).collect()}
    assert family == {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 6, 7: 7}
    notes = sorted((r["id"], r["note"].split(":")[0].split(" of ")[0]) for r in household.notes(people, found).collect())
    assert notes == [(2, "named as parent"), (5, "impossible relation"), (6, "name stands 2 times in this house"), (7, "name stands 2 times in this house")]
    house = household.signals(rows).first()
    assert (house["electors"], house["unlinked"], house["families"], house["largest_family"], house["external_spouses"]) == (7, 3, 1, 4, 2)
    assert "impossible" in house["findings"]


def test_flags_are_added_once_and_latest_review_wins(spark, register):
    rows = register({}, {"age": 41}, {"age": 10})
    found = rules.run_rules(rows, ["dup_identity", "age_outlier", "no such rule"])
    assert flags.new_flags(found.limit(0), found.union(found)).count() == 2
    assert flags.new_flags(found, found).count() == 0
    reviews = spark.createDataFrame([(1, 7, "confirmed", "2024-01-01"), (2, 7, "legitimate", "2024-01-01"), (3, 8, "needs_info", "2024-02-01")], "id long, flag_id long, verdict string, reviewed_at string")
    reviews = reviews.withColumns({"reviewer": F.lit("r"), "notes": F.lit("")})
    assert {r["flag_id"]: r["verdict"] for r in flags.latest_reviews(reviews).collect()} == {7: "legitimate", 8: "needs_info"}
    opened = flags.reopened(reviews, spark.createDataFrame([(7,)], "flag_id long"))
    assert [r["flag_id"] for r in flags.latest_reviews(opened).collect()] == [8]


def test_upsert_replaces_whole_rows_and_null_serials(register):
    old = register({"serial_no": None, "name": "OLD"}, {"name": "STAYS"})
    new = register({"serial_no": None, "name": "NEW"})
    assert sorted((r["name"], r["name_norm"]) for r in rg.upsert(old, new).collect()) == [("NEW", "NEW"), ("STAYS", "STAYS")]
    assert rg.upsert(rg.upsert(old, new), new).count() == 2


def test_seat_reports_come_largest_first(register, tmp_path):
    rows = register(*[{"constituency_no": s, "age": a} for s, a in (("S9", 110), ("S1", 110), ("S1", 17), (None, 110), ("S2", 30))])
    found = rules.age_outlier(rows).withColumn("id", F.col("voter_id"))
    got = flags.seat_reports(found, rows)
    assert {(r["id"], r["constituency"], r["n_flags"], r["report"]) for r in got.collect()} == {(4, "(unknown)", 1, 2), (1, "S9", 1, 3), (2, "S1", 2, 1), (3, "S1", 2, 1)}
    flags.write_seat_reports(got, f"{tmp_path}/reports")
    folders = sorted(p.name for p in (tmp_path / "reports").iterdir() if p.is_dir())
    assert [f[:11] for f in folders] == ["seat=00001_", "seat=00002_", "seat=00003_"] and folders[0].endswith("S1")
    assert flags.seat_reports(found, rows, rule="dup_epic").count() == 0 and flags.seat_reports(found, rows, year=2025).count() == 0


def _most_rows(spark, df):
    """The rows that ``df`` has, and the most that any operator of its plan gave."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = len(df.collect())
        left, most = [df._jdf.queryExecution().executedPlan()], 0
        while left:
            node = left.pop()
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            left += [node.children().apply(i) for i in range(node.children().size())]
        return n, most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_house_of_one_name_makes_no_pairs(spark):
    rows = [(2025, "S1", "A1", i, "ANN LEE", 30 + i % 3, "F", "ANN LEE", "ANN LEE", "parent", "M", "1", i) for i in range(300)]
    people = spark.createDataFrame(rows, "year int, constituency_no string, house_norm string, id long, name string, age int, sex string, name_norm string, relation_norm string, kind string, relation string, part_no string, serial_no int")
    n, most = _most_rows(spark, household.links(people))
    assert n == 300 and most <= 1200
    assert {r["id"]: r["target"] for r in household.links(people).where("id < 3").collect()} == {0: 1, 1: 0, 2: 0}
