"""Register records out of page text: tokens, three readings of them, repair, quality and gap reports.

Pages are rows (doc_id, page_index, text). A page is cut once into typed tokens: a label
("Name :", "Age :", a cell bar, ...) and the text up to the next one. Everything else
looks at the array of tokens:

* a *strict* record begins at a name label with a number right before it,
* *positional* records are the page's serials, IDs and names side by side, if there are
  equally many of each, whatever the layout,
* a *lenient* record begins at any name label.

All three are array columns of one pass over the page; records are exploded once, and
whole documents never meet in one task before they are records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollkin.sources.scratch import sorted_join

FIELDS = ["serial_no", "epic_no", "name", "relation_type", "relation_name", "house_number", "age", "gender"]
CORE = ["serial_no", "epic_no", "name", "relation_type", "relation_name", "age", "gender"]
RECORD = ["doc_id", "page", "pos", *FIELDS]
RELATIONS = ["father", "husband", "mother", "wife", "other"]

#: Labels: what is captured is the token's kind. "No and Name" is the header's, not a person's.
COLON = r"\s*[:\uFF1A]"
LABELS = "|".join([
    rf"({'|'.join(RELATIONS)})s?['\u2019]?(?:\s*name)?{COLON}", rf"(house)\s*(?:number|no\.?){COLON}", rf"(age){COLON}", rf"(gender){COLON}",
    rf"(no\s+and)\s+name{COLON}", rf"(name){COLON}", r"\b(photo)\b", r"(\|)",
])
BEGIN, END = "\x01", "\x02"
ID = r"\b[A-Z]{2,4}[0-9O]{6,8}\b"
NUMBER_BEFORE = r"(?:^|[^\w*])\**(\d{1,4})\**\s*$"


def clean(c: Column) -> Column:
    """A value without markdown debris, spaces collapsed, ends free of punctuation."""
    return F.btrim(F.regexp_replace(c, r"[*|#\s]+", " "), F.lit(" :\uFF1A.,-"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it in its own lambdas."""
    return F.transform(F.array(value), then)[0]


def _marked(text: Column) -> Column:
    """The text with every label replaced by BEGIN kind END."""
    groups = "".join(f"${i}" for i in range(1, 9))
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i)(?:{LABELS})", f"{BEGIN}{groups}{END}")


def tokens(text: Column) -> Column:
    """array<struct<kind, value>>: the labels of a text in order, each with what follows it; the first has no kind."""
    pieces = F.split(F.concat(F.lit(END), _marked(text)), BEGIN)
    return F.transform(pieces, lambda p: F.struct(F.lower(F.substring_index(p, END, 1)).alias("kind"), F.substring_index(p, END, -1).alias("value")))


def _text_of(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: t["value"]), " ")


def _first(part: Column, kinds: list[str]) -> Column:
    return F.get(F.filter(part, lambda t: t["kind"].isin(kinds)), F.lit(0))


def _number_before(part: Column, at: Column) -> Column:
    """The number right before token ``at``, else empty."""
    return F.regexp_extract(F.get(part, at - 1)["value"], NUMBER_BEFORE, 1)


def _names(part: Column) -> Column:
    """Positions of the name labels."""
    every = F.filter(F.transform(part, lambda t, i: F.when(t["kind"] == "name", i)), lambda i: i.isNotNull())
    return every


def _values(own: Column) -> dict[str, Column]:
    """The fields of a record from its tokens, which begin with the name."""
    relation, gender = _first(own, RELATIONS), F.upper(F.coalesce(_first(own, ["gender"])["value"], F.lit("")))
    text = lambda t: F.coalesce(clean(t["value"]), F.lit(""))
    sex = F.regexp_extract(gender, r"^\s*(MALE|FEMALE|THIRD\s*GENDER|M\b|F\b)", 1)
    return {
        "name": text(F.get(own, F.lit(0))), "relation_type": F.initcap(F.coalesce(relation["kind"], F.lit(""))), "relation_name": text(relation), "house_number": text(_first(own, ["house"])),
        "age": F.coalesce(F.regexp_extract(_first(own, ["age"])["value"], r"^\s*(\d{1,3})", 1), F.lit("")),
        "gender": F.when(sex == "M", "Male").when(sex == "F", "Female").otherwise(F.initcap(F.regexp_replace(sex, r"\s+", " "))),
    }


def _record(serial: Column, epic: Column, own: Column) -> Column:
    values = _values(own) | {"serial_no": serial, "epic_no": F.coalesce(epic, F.lit(""))}
    return F.struct(*[values[f].alias(f) for f in FIELDS])


def _spans(part: Column, starts: Column) -> Column:
    """array<struct<at, own>>: the tokens from each start up to the next, without a next record's number at the end."""
    def span(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(part))
        own = F.slice(part, at + 1, stop - at)
        return F.struct(at.alias("at"), F.transform(own, lambda t, i: F.struct(
            t["kind"].alias("kind"), F.when((i == stop - at - 1) & (stop < F.size(part)), F.regexp_replace(t["value"], NUMBER_BEFORE, " ")).otherwise(t["value"]).alias("value")
        )).alias("own"))

    return F.transform(starts, span)


def _ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({ID})"))


def _strict(part: Column) -> Column:
    starts = F.filter(_names(part), lambda i: _number_before(part, i) != "")
    record = lambda s: _record(_number_before(part, s["at"]), F.get(_ids(_text_of(s["own"])), F.lit(0)), s["own"])
    return _let(starts, lambda known: F.transform(_spans(part, known), record))


def _opening(text: Column) -> Column:
    """Serials that open a cell or a line and lead, over further numbers, to an ID or a name; in order."""
    cells = F.split(_marked(text), f"[\n{BEGIN}]")

    def coded(c: Column) -> Column:
        plain, body = ~c.contains(END) | c.startswith("|"), F.btrim(F.regexp_replace(F.substring_index(c, END, -1), r"\*", ""), F.lit(" \t\r"))
        code = (
            F.when(F.lower(c).startswith(f"name{END}"), "N").when(~plain, "o").when(body == "", "").when(body.rlike(r"^\d{1,4}$"), "d")
            .when(body.rlike(rf"^\d{{1,4}}\s+{ID}"), "x").when(body.rlike(f"^{ID}"), "e").otherwise("o")
        )
        return F.struct(code.alias("code"), F.regexp_extract(body, r"^(\d{1,4})", 1).alias("number"))

    told = F.filter(F.transform(cells, coded), lambda c: c["code"] != "")
    # a number that leads a row of numbers to an ID or a name stands out as D
    lead = lambda known: F.regexp_replace(F.array_join(F.transform(known, lambda c: c["code"]), ""), "(?<!d)d(?=d*[eN])", "D")
    opens = lambda known, codes: F.transform(known, lambda c, i: F.when((c["code"] == "x") | (F.substring(codes, i + 1, F.lit(1)) == "D"), c["number"]))
    return F.filter(_let(told, lambda known: _let(lead(known), lambda codes: opens(known, codes))), lambda n: n.isNotNull())


def _positional(part: Column, serials: Column, ids: Column) -> Column:
    def read(spans: Column) -> Column:
        level = (F.size(spans) > 0) & (F.size(serials) == F.size(ids)) & (F.size(ids) == F.size(spans))
        return F.transform(F.filter(spans, lambda s: level), lambda s, k: _record(F.get(serials, k), F.get(ids, k), s["own"]))

    return _let(_names(part), lambda names: _let(_spans(part, names), read))


def _lenient(part: Column) -> Column:
    def record(names: Column, s: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get(names, k - 1)).otherwise(F.lit(0))
        before = _text_of(F.slice(part, start + 1, s["at"] - start))
        serial = F.coalesce(F.try_element_at(F.regexp_extract_all(before, F.lit(r"\b(\d{1,4})\b")), F.lit(-1)), F.lit(""))
        return _record(serial, F.coalesce(F.get(_ids(_text_of(s["own"])), F.lit(0)), F.get(_ids(before), F.lit(0))), s["own"])

    return _let(_names(part), lambda names: F.transform(_spans(part, names), lambda s, k: record(names, s, k)))


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, worked out once: unlike a projection, an explode isn't folded into the next step."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_s")).select(*df.columns, "_s.*")


def _read(pages: DataFrame, *wanted: str, where: Column | None = None) -> DataFrame:
    """Pages (doc_id, page, text) with the array columns in ``wanted``, of strict, positional and lenient; and markers, opening, ids.

    With ``where``, a condition on the strict reading, only pages that satisfy it (then
    ``weak``) are read in the other ways, and leniently only if those found nothing.
    """
    base = _step(pages.select("doc_id", (F.col("page_index") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text")), part=tokens(F.col("text")))
    base = _step(base, ids=_ids(F.col("text")), markers=_markers(F.col("part")))
    part = F.col("part")
    found = lambda c: F.filter(c, lambda r: r["name"] != "")
    if "strict" in wanted or where is not None:
        base = _step(base, strict=found(_strict(part)))
    base = _step(base, weak=F.lit(True) if where is None else where)
    none = F.array().cast(base.schema["strict"].dataType) if where is not None else None
    only = lambda condition, c: c if where is None else F.when(condition, c).otherwise(none)
    base = _step(base, opening=_opening(F.col("text")) if where is None else F.when(F.col("weak"), _opening(F.col("text"))).otherwise(F.array().cast("array<string>")))
    if "positional" in wanted:
        base = _step(base, positional=only(F.col("weak"), found(_positional(part, F.col("opening"), F.col("ids")))))
    if "lenient" in wanted:
        empty = (F.size("strict") == 0) & (F.size("positional") == 0) if where is not None else F.lit(True)
        base = _step(base, lenient=only(F.col("weak") & empty, found(_lenient(part))))
    return base


def _rows(found: DataFrame, column: str) -> DataFrame:
    return found.select("doc_id", "page", F.posexplode(column).alias("pos", "r")).select("doc_id", "page", "pos", "r.*").select(*RECORD)


def parse_strict(pages: DataFrame) -> DataFrame:
    """Records that begin with ``<serial> Name :``."""
    return _rows(_read(pages, "strict"), "strict")


def parse_positional(pages: DataFrame) -> DataFrame:
    """Serials, IDs and names side by side in reading order, where there are equally many."""
    return _rows(_read(pages, "positional"), "positional")


def parse_lenient(pages: DataFrame) -> DataFrame:
    """Any person's ``Name :``, with the nearest number before it as serial."""
    return _rows(_read(pages, "lenient"), "lenient")


def _markers(part: Column) -> Column:
    found = F.filter(F.transform(_names(part), lambda i: _number_before(part, i)), lambda n: n != "")
    return F.array_distinct(F.transform(found, lambda n: n.cast("int")))


def markers(text: Column) -> Column:
    """Distinct serials of the ``<serial> Name :`` markers in a text."""
    return _markers(tokens(text))


def _valid(opening: Column, marked: Column) -> Column:
    return F.array_union(opening, F.transform(marked, lambda x: x.cast("string")))


def valid_serials(text: Column) -> Column:
    """Serials that really stand on a page, as text."""
    return _valid(_opening(text), markers(text))


def has_records(text: Column) -> Column:
    """Whether a page holds records at all: an ID or a marker. Cover pages have neither."""
    return text.rlike(ID) | (F.size(markers(text)) > 0)


def completeness(record: Column) -> Column:
    return reduce(lambda x, y: x + y, [(record[f] != "").cast("int") for f in FIELDS])


def merged(a: Column, b: Column) -> Column:
    """Two readings of one record: the fuller one (the first at a tie), its blanks filled from the other."""
    swap = completeness(b) > completeness(a)
    best, rest = (lambda f: F.when(swap, b[f]).otherwise(a[f])), (lambda f: F.when(swap, a[f]).otherwise(b[f]))
    return F.struct(best("page").alias("page"), *[F.when(best(f) == "", rest(f)).otherwise(best(f)).alias(f) for f in FIELDS])


def best_by_serial(records: DataFrame, keys: list[str], source: str | None = None) -> DataFrame:
    """One record per serial (or, without one, per name and page): copies merged in source order."""
    who = F.when(F.col("serial_no").rlike(r"^\d+$"), F.col("serial_no")).otherwise(F.concat_ws(":", F.lit("n"), "name", F.col("page").cast("string")))
    record = F.struct(F.col("page"), *[F.col(f) for f in FIELDS])
    order = [F.col("page"), F.col(source) if source else F.lit(0), F.col("pos")]
    copies = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], record.alias("record"))))
    grouped = records.withColumn("_who", who).groupBy(*keys, "_who").agg(copies.alias("copies"))
    records_only = F.transform("copies", lambda x: x["record"])
    one = F.aggregate(F.slice(records_only, 2, F.size(records_only)), F.element_at(records_only, 1), merged)
    return grouped.select(*keys, F.element_at("copies", 1)["o2"].alias("pos"), one.alias("r")).select(*keys, "pos", "r.*")


def _repaired(found: DataFrame, weak: Column) -> Column:
    """array<struct<source, pos, r>> of a page: where it is ``weak`` positional over strict, lenient only where both
    found nothing, without serials that aren't on the page; else strict."""
    numbered = lambda c, source: F.transform(c, lambda r, i: F.struct(F.lit(source).alias("source"), i.alias("pos"), r.alias("r")))
    both = F.concat(numbered("positional", 0), numbered("strict", 1))
    all_found = F.when(F.size(both) > 0, both).otherwise(numbered("lenient", 2))
    valid = _valid(F.col("opening"), F.col("markers"))
    there = F.filter(all_found, lambda x: (F.size(valid) == 0) | F.array_contains(valid, x["r"]["serial_no"]))
    return F.when(weak, there).otherwise(numbered("strict", 1))


def _weak() -> Column:
    """Markers that weren't parsed, blank fields, fewer rows than markers, or none on a page that holds records."""
    got = F.transform("strict", lambda r: r["serial_no"].cast("int"))
    blank = F.exists("strict", lambda r: completeness(r) < len(FIELDS))
    missing = F.size(F.array_except("markers", got)) > 0
    held = (F.size("ids") > 0) | (F.size("markers") > 0)
    return missing | blank | (F.size("strict") < F.size("markers")) | ((F.size("strict") == 0) & held)


def _chosen(pages: DataFrame, weak: Column) -> DataFrame:
    found = _read(pages, "strict", "positional", "lenient", where=weak)
    rows = found.select("doc_id", "page", F.explode(_repaired(found, F.col("weak"))).alias("x"))
    return rows.select("doc_id", "page", F.col("x.source").alias("source"), F.col("x.pos").alias("pos"), "x.r.*")


def repair(pages: DataFrame) -> DataFrame:
    """The records of pages that strict reading isn't enough for, one per serial of a page."""
    merged = best_by_serial(_chosen(pages, F.lit(True)).withColumn("at", F.col("page")), ["doc_id", "at"], "source")
    return merged.drop("at").select(*RECORD)


def needs_repair(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index) of the pages that strict reading isn't enough for."""
    return _read(pages, "strict").where(_weak()).select("doc_id", (F.col("page") - 1).alias("page_index"))


def extract(pages: DataFrame) -> DataFrame:
    """Records of whole documents: strict where that suffices, else repaired, then one per serial."""
    return best_by_serial(_chosen(pages, _weak()), ["doc_id"], "source")


def _serial_order() -> list[Column]:
    number = F.col("serial_no").try_cast("int")
    return [number.isNull(), number, F.col("page"), F.col("pos")]


def in_order(records: DataFrame) -> DataFrame:
    """Records as they are put out: by document and serial number, those without a number last."""
    return records.orderBy("doc_id", *_serial_order())


def with_places(records: DataFrame) -> DataFrame:
    """Records with ``place``, their place in their document's output, from 1."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*_serial_order())))


def preview(records: DataFrame, n: int = 50) -> DataFrame:
    """The first records of an extraction, in order."""
    return in_order(records).limit(n)


def headers(pages: DataFrame) -> DataFrame:
    """(doc_id, constituency_no, constituency_name, part_no): the first found in page order.

    The seat stands behind the first "No and Name" label of a line that tells of the
    assembly, as number, dash and name.
    """
    seat = F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.when(F.lower(x).contains("assembly"), F.get(F.filter(tokens(x), lambda t: t["kind"].startswith("no")), F.lit(0))["value"])), lambda v: v.isNotNull()), F.lit(0))
    part = F.regexp_extract("text", r"(?i)\bpart\s+no\b[^\d\n]*(\d+)", 1)
    name = F.regexp_replace(F.regexp_extract(seat, r"^\s*\d+\s*[-\u2013]\s*([\p{L} ().]+)", 1), r"[ .]+$", "")
    found = pages.select("doc_id", "page_index", *[
        F.nullif(c, F.lit("")).alias(n) for n, c in {"constituency_no": F.regexp_extract(seat, r"^\s*(\d+)", 1), "constituency_name": name, "part_no": part}.items()
    ])
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_index"))), F.lit("")).alias(c)
    return found.groupBy("doc_id").agg(*[first(c) for c in ("constituency_no", "constituency_name", "part_no")])


def with_headers(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Output rows: each record with its document's header."""
    return records.join(headers(pages), "doc_id")


def page_quality(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, ok, score): a point for each complete record, 5 off for a serial that comes again, 2 for a record that does.

    A page is ok if all its records are complete and nothing comes again. One without
    records is ok with 0 points, one whose records can't be read has -1.
    """
    who = F.struct("name", "relation_name", "house_number", "age")
    full = F.forall(F.array(*[F.col(f) != "" for f in CORE]), lambda x: x)
    sums = repair(pages).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.count_if(full).alias("full"), F.count_distinct("serial_no").alias("serials"), F.count_distinct(who).alias("people")
    )
    rows = pages.withColumn("page", F.col("page_index") + 1).join(sums, ["doc_id", "page"], "left")
    holds, read = has_records(F.col("text")), F.col("n").isNotNull()
    score = F.col("full") - 5 * (F.col("n") - F.col("serials")) - 2 * (F.col("n") - F.col("people"))
    return rows.select(
        "doc_id", "page_index", (~holds | (read & (F.least("full", "serials", "people") == F.col("n")))).alias("ok"),
        F.when(holds & read, score).when(holds, -1).otherwise(0).cast("double").alias("score"),
    )


def best_rendition(pages: DataFrame) -> DataFrame:
    """Of several attempts at a page, the best-scored up to and including the first good one; the earliest wins ties.

    ``pages``: (doc_id, page_index, attempt, text).
    """
    one = pages.withColumn("doc", F.col("doc_id")).withColumn("doc_id", F.concat_ws("\x1f", "doc_id", F.col("attempt").cast("string")))
    graded = one.join(page_quality(one.select("doc_id", "page_index", "text")), ["doc_id", "page_index"])
    page = Window.partitionBy("doc", "page_index")
    first_good = F.min(F.when(F.col("ok"), F.col("attempt"))).over(page)
    tried = graded.withColumn("_good", first_good).where("_good IS NULL OR attempt <= _good")
    best = F.row_number().over(page.orderBy(F.desc("score"), "attempt"))
    return tried.withColumn("_n", best).where("_n = 1").select(F.col("doc").alias("doc_id"), "page_index", "attempt", "text", "ok", "score")


def issues(records: DataFrame) -> DataFrame:
    """Per document: records, lowest and highest serial, missing serials, incomplete records."""
    serial = F.col("serial_no").try_cast("int")
    blank = F.filter(F.array(*[F.when(F.col(f) == "", F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    rows = records.withColumns({"serial": serial, "missing": blank})
    found = rows.groupBy("doc_id").agg(
        F.count("*").alias("extracted"), F.coalesce(F.min("serial"), F.lit(0)).alias("min_serial"), F.coalesce(F.max("serial"), F.lit(0)).alias("expected_max_serial"),
        F.collect_set("serial").alias("serials"), F.collect_list(F.when(F.size("missing") > 0, F.struct("serial_no", "name", "missing"))).alias("incomplete_rows"),
    )
    gaps = F.when(F.size("serials") > 0, F.array_except(F.sequence("min_serial", "expected_max_serial"), "serials")).otherwise(F.array().cast("array<int>"))
    return found.withColumn("missing_serials", gaps).drop("serials")


def pages_to_read_again(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, serial, page): for each missing serial the page with its own or a neighbour's marker."""
    missing = issues(records).select("doc_id", F.explode("missing_serials").alias("serial"))
    near = missing.select("doc_id", "serial", F.explode(F.array(*[
        F.struct(F.lit(i).alias("order"), (F.col("serial") + d).alias("marker")) for i, d in enumerate((0, -1, 1))
    ])).alias("m")).select("doc_id", "serial", "m.*")
    on_page = pages.select("doc_id", (F.col("page_index") + 1).alias("page"), F.explode(F.transform(valid_serials(F.col("text")), lambda x: x.cast("int"))).alias("marker"))
    hits = near.join(sorted_join(on_page), ["doc_id", "marker"])
    return hits.groupBy("doc_id", "serial").agg(F.min_by("page", F.struct("order", "page")).alias("page"))


def match_images(records: DataFrame, images: DataFrame) -> DataFrame:
    """Images and records of a page matched by their order on it. ``images``: (doc_id, page, image_index, image_id)."""
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    image_order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("image_index"))
    return records.withColumn("rn", order).join(images.withColumn("rn", image_order), ["doc_id", "page", "rn"]).select(*RECORD, "image_id")
