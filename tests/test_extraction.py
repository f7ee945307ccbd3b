"""Page layouts with invented values."""

import pytest

from rollkin.operators import extraction as ex
from rollkin.sources import registry as rg

HEAD = "Assembly Constituency No and Name : 7-EXAMPLETON\nPart No. : 3\n"
BODY = "Name : ALPHA BETA Fathers Name: GAMMA BETA House Number : H-1 Age : 40 Gender : Male"
NORMAL = HEAD + f"| **11** {BODY} | ABC0000011 |\n| 12 Name : PHOTOX DELTA Mothers Name: EPSILON DELTA House Number : H-2 Age : 39 Gender : F | ABC0000012 |"
CROSSED = HEAD + "| 21 | ABC0000021 | 22 | ABC0000022 |\n" + f"| {BODY} | Name : ZETA Husbands’ Name : ETA House No : 5 Age : 50 Gender : Female |"
STACKED = f"21\nABC0000021\n{BODY}\n22\nABC0000022\n{BODY.replace('ALPHA', 'THETA')}"
ADDED = "| 31 | 1 | ABC0000031 | 32 | 1 | ABC0000032 |\n" + f"| {BODY} | {BODY.replace('ALPHA', 'IOTA')} |"


@pytest.fixture
def pages(spark):
    return lambda *texts: spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, page_index int, text string")


def got(records, *fields):
    return sorted(tuple(r[f] for f in fields) for r in records.collect())


def test_normal_layout(pages):
    rows = ex.parse_strict(pages(NORMAL))
    assert got(rows, *ex.FIELDS) == [
        ("11", "ABC0000011", "ALPHA BETA", "Father", "GAMMA BETA", "H-1", "40", "Male"), ("12", "ABC0000012", "PHOTOX DELTA", "Mother", "EPSILON DELTA", "H-2", "39", "Female")
    ]


@pytest.mark.parametrize(("text", "want"), [
    (CROSSED, [("21", "ABC0000021", "ALPHA BETA"), ("22", "ABC0000022", "ZETA")]), (STACKED, [("21", "ABC0000021", "ALPHA BETA"), ("22", "ABC0000022", "THETA BETA")]),
    (ADDED, [("31", "ABC0000031", "ALPHA BETA"), ("32", "ABC0000032", "IOTA BETA")]), (NORMAL, [("11", "ABC0000011", "ALPHA BETA"), ("12", "ABC0000012", "PHOTOX DELTA")]),
])
def test_every_layout_gives_the_right_id_to_the_right_person(pages, text, want):
    assert got(ex.extract(pages(text)), "serial_no", "epic_no", "name") == want


def test_full_width_colon_and_lenient(pages):
    rows = ex.parse_lenient(pages("41 text ABC0000041 Name： KAPPA Age： 33 Gender： M"))
    assert got(rows, "serial_no", "epic_no", "name", "age", "gender") == [("41", "ABC0000041", "KAPPA", "33", "Male")]


def quality(pages, text):
    row = ex.page_quality(pages(text)).first()
    return row["ok"], row["score"]


def test_page_quality(pages):
    assert quality(pages, NORMAL) == (True, 2.0)
    assert quality(pages, HEAD) == (True, 0.0)
    assert quality(pages, NORMAL.replace("ABC0000012", ""))[0] is False
    ok, score = quality(pages, " ".join(f"| {i} {BODY} |" for i in (1, 2, 3)))
    assert not ok and score < 0
    assert quality(pages, "| 7 Name : NU Fathers Name: XI House Number : Age : 39 Gender : Male | ABC0000007 |") == (True, 1.0)


def test_copies_merge_into_the_most_complete(spark):
    blank = dict.fromkeys(ex.FIELDS, "")
    rows = [{**blank, "serial_no": "5", "name": "A", "age": "40"}, {**blank, "serial_no": "5", "name": "A B", "epic_no": "ABC0000005", "gender": "Male"}, {**blank, "name": "NO SERIAL"}]
    df = spark.createDataFrame([("d", 1, i, *[r[f] for f in ex.FIELDS]) for i, r in enumerate(rows)], "doc_id string, page int, pos int, " + ", ".join(f"{f} string" for f in ex.FIELDS))
    assert got(ex.best_by_serial(df, ["doc_id"]), "serial_no", "name", "epic_no", "age") == [("", "NO SERIAL", "", ""), ("5", "A B", "ABC0000005", "40")]


def test_gaps_and_where_to_read_again(pages):
    text = NORMAL + f"\n| 14 {BODY} | ABC0000014 |"
    found = pages(HEAD, text)
    records = ex.extract(found)
    issue = ex.issues(records).first()
    assert (issue["extracted"], issue["min_serial"], issue["expected_max_serial"], issue["missing_serials"]) == (3, 11, 14, [13])
    assert [(r["serial"], r["page"]) for r in ex.pages_to_read_again(records, found).collect()] == [(13, 2)]
    assert ex.with_headers(records, found).select("constituency_no", "constituency_name", "part_no").distinct().collect() == [("7", "EXAMPLETON", "3")]


def test_best_rendition_takes_the_first_good_one(spark):
    rows = [("d", 0, 0, NORMAL.replace("ABC0000012", "")), ("d", 0, 1, NORMAL), ("d", 0, 2, NORMAL + f"| 13 {BODY} | ABC0000013 |"), ("d", 1, 0, HEAD)]
    best = ex.best_rendition(spark.createDataFrame(rows, "doc_id string, page_index int, attempt int, text string"))
    assert got(best, "page_index", "attempt") == [(0, 1), (1, 0)]


def test_images_match_records_in_order(spark, pages):
    images = spark.createDataFrame([("d", 1, 0, "a.png"), ("d", 1, 1, "b.png")], "doc_id string, page int, image_index int, image_id string")
    assert got(ex.match_images(ex.parse_strict(pages(NORMAL)), images), "serial_no", "image_id") == [("11", "a.png"), ("12", "b.png")]


def test_trimming_pages(spark):
    rows = [("long", i, "") for i in range(6)] + [("short", i, "") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, text string")
    assert got(rg.trim_pages(df), "doc_id", "page_index") == [("long", 2), ("long", 3)] + [("short", i) for i in range(4)]
    many = spark.createDataFrame([("d", i, "") for i in range(31)], "doc_id string, page_index int, text string")
    assert sorted({(r["batch_id"]) for r in rg.page_batches(many).collect()}) == [0, 1, 2]
