"""URL verdicts from rules, carried over to aliases along redirects and canonical links.

Hosts are matched by exploding a host into its parent domains and joining them with
the rules, so a list of millions of domains is an ordinary join. Pages that redirect
to, or name as canonical, the same address form one component; what a rule blocks
there blocks the pages without a rule of their own, unless a rule allows one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkin.operators.components import connected_components
from rollkin.sources.scratch import broadcast_if_small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
COMMENT = r"(?s)<!--.*?(-->|$)"
CANONICAL = r"(?is)<link\b[^>]*\srel\s*=\s*([\"'][^\"'>]*?(?<![\w-])|)canonical(?![\w-])[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\shttp-equiv\s*=\s*[\"']?refresh(?![\w-])[^>]*>"
HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TO = r"(?is)\burl\s*=\s*'?((?:&#?\w+;|[^\"'\s>;])+)"
BASE = r"(?is)<base\b[^>]*\shref\b[^>]*>"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ENTITY = r"(?s)^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);(.*)$"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
SMALL_RULES = 1_000_000

#: (host, path prefix, verdict)
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def address_key(url: Column) -> Column:
    """An address as a node: without scheme, the port that is usual for it, fragment, trailing slashes and ``utm_`` parameters; null without a host."""
    scheme, host = F.lower(F.substring_index(url, "://", 1)), host_of(url)
    usual = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when(
        (scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")
    ).otherwise(host)
    query = F.regexp_replace(F.regexp_extract(url, ADDRESS, 3), r"(?<=[?&])utm_[a-z]+=[^&]*&?", "")
    key = F.concat(usual, F.regexp_replace(path_of(url), "/+$", ""), F.regexp_replace(query, r"[?&]+$", ""))
    return F.when(host != "", key)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def decoded(value: Column) -> Column:
    """An attribute's value with numeric entities and those of ``ENTITIES`` decoded, once."""
    def plain(piece: Column) -> Column:
        name, rest = F.regexp_extract(piece, ENTITY, 1), F.regexp_extract(piece, ENTITY, 2)
        digits = F.regexp_extract(name, "^#[xX]?(.+)$", 1)
        point = F.when(F.lower(name).startswith("#x"), F.conv(digits, 16, 10)).when(name.startswith("#"), digits).try_cast("long")
        point = F.when(point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF), point)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        for known, text in ENTITIES.items():
            char = F.coalesce(char, F.when(name == known, F.lit(text)))
        return F.coalesce(F.concat(char, rest), piece)

    return F.array_join(F.transform(F.split(value, "(?=&)"), plain), "")


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: (
        F.when(part == ".", done).when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.array_append(done, part))
    ))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, to: Column) -> Column:
    """The address that ``to`` names on the page ``base``; null if it isn't one with a host."""
    scheme, path = F.substring_index(base, "://", 1), path_of(base)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    own, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.when(path.startswith("/"), "").otherwise("/"), F.regexp_replace(path, "[^/]*$", ""))
    full = (
        F.when(to.rlike(SCHEME + "//"), to)
        .when(to.rlike(SCHEME), F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
    )
    full = F.when(full.isNotNull(), F.concat(F.substring_index(full, "://", 1), F.lit("://"), host_of(full), without_dots(path_of(full)), F.regexp_extract(full, ADDRESS, 3)))
    local = (
        F.when(to.rlike(SCHEME) | to.startswith("//"), F.lit(None))
        .when(to.startswith("#"), base)
        .when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("/"), F.concat(site, without_dots(own), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )
    return F.coalesce(full, F.when(host_of(base) != "", local))


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of canonical links and refreshes in the pages' HTML, made absolute.

    A relative target is taken from the page's ``<base href>`` if it has one, else from
    its address. What stands in comments doesn't count; ``rel`` may name several kinds.
    """
    html, url = F.regexp_replace("html", COMMENT, ""), F.col("url")
    found = pages.where(url.isNotNull() & F.regexp_like("html", F.lit(r"(?i)canonical|refresh"))).select(
        url.alias("from_url"), F.regexp_extract(F.regexp_extract(html, BASE, 0), HREF, 1).alias("base"),
        F.explode(F.array(
            F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1),
            F.regexp_extract(F.regexp_extract(html, REFRESH, 0), REFRESH_TO, 1),
        )).alias("to"),
    ).where("to <> ''")
    step = lambda *x: F.explode(F.array(F.struct(*x))).alias("x")  # noqa: E731  unlike a projection, not folded into the next one
    plain = found.select("from_url", step(decoded(F.col("base")).alias("base"), decoded(F.col("to")).alias("to"))).select("from_url", "x.*")
    own = F.when(F.col("base") != "", resolved(F.col("from_url"), F.col("base")))
    based = plain.select("from_url", step(F.coalesce(own, F.col("from_url")).alias("base"), F.col("to").alias("to"))).select("from_url", "x.*")
    return based.select("from_url", step(resolved(F.col("base"), F.col("to")).alias("to_url"))).select("from_url", "x.to_url").where("to_url IS NOT NULL")


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` values -> (url, rule, rule_verdict) of the longest rule that fits; URLs without one are absent.

    Of rules that fit and are equally long, an allow rule wins.
    """
    labels = F.split(F.col("host"), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    fits = parts.withColumn("rule_host", F.explode(domains)).join(broadcast_if_small(rules, SMALL_RULES), "rule_host").where(
        F.col("path").startswith(F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("rule_verdict") == "allow", 1).otherwise(0).alias("allow"), rule.alias("rule"), "rule_verdict"))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, decided_by.

    ``redirects``: further (from_url, to_url) edges, such as a crawler's log. A page's
    own rule decides first. Without one: allow if a rule allows an address of its
    component, else block if a rule blocks one, else allow.

    A null url, or one without ``://``, has empty host and path, no rule, and is
    allowed. Null html has no links. Null ids stay, repeated rows give a row each,
    other columns aren't read, no rows give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    links = written(links.select(
        "to_url", address_key(F.col("from_url")).alias("src"), address_key(F.col("to_url")).alias("dst")
    ).where("src IS NOT NULL AND dst IS NOT NULL"), "links")
    urls = pages.select("url").union(links.select(F.col("to_url").alias("url"))).where("url IS NOT NULL").distinct()
    judged = written(
        urls.join(rule_verdicts(urls, rules), "url", "left").withColumn("key", address_key(F.col("url"))), "judged"
    )
    components = connected_components(links)
    by_component = judged.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    decided = by_component.where("rule IS NOT NULL AND component IS NOT NULL").groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed")
    )
    verdict = (
        F.when(F.col("rule").isNotNull(), F.col("rule_verdict"))
        .when(F.col("allowed").isNull() | F.col("allowed"), "allow")
        .otherwise("block")
    )
    by_url = by_component.join(decided, "component", "left").select(
        "url", "rule", verdict.alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("allowed").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
    return pages.select("page_id", "url").join(by_url, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("decided_by", F.lit("default")).alias("decided_by"),
    )


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _key_sql(url: str) -> str:
    """An address as a node, in DuckDB SQL."""
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    usual = f"CASE WHEN {url} ILIKE 'http://%' THEN regexp_replace({host}, ':80$', '') WHEN {url} ILIKE 'https://%' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    query = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*(\\??[^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '([?&])((utm_[a-z]+=[^&]*(&|$))+)', '\\1', 'g'), '[?&]+$', '')"
    return f"CASE WHEN {host} <> '' THEN ({usual}) || regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') || {query} END"


def _decoded_sql(value: str) -> str:
    """The named entities of ``ENTITIES``, ``&amp;`` last; numeric ones aren't decoded."""
    for name, text in [*list(ENTITIES.items())[1:], ("amp", "&")]:
        value = f"replace({value}, '&{name};', '{text.replace(chr(39), chr(39) * 2)}')"
    return value


def _resolved_sql(base: str, to: str) -> str:
    """The address that ``to`` names on ``base``, its dot segments still in place."""
    scheme, site = f"regexp_extract({base}, '(?s)^(.*?)://', 1)", f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)"
    path = f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    folder = f"CASE WHEN {path} LIKE '/%' THEN '' ELSE '/' END || regexp_replace({path}, '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({to}, '{_SCHEME}//') THEN {to} WHEN regexp_matches({to}, '{_SCHEME}') THEN NULL
      WHEN {to} LIKE '//%' THEN {scheme} || ':' || {to} WHEN {site} = '' THEN NULL WHEN {to} LIKE '#%' THEN {base}
      WHEN {to} LIKE '?%' THEN {site} || {path} || {to} WHEN {to} LIKE '/%' THEN {site} || {to} ELSE {site} || {folder} || {to} END"""


ORACLE_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)<!--.*?(-->|$)', '', 'g') AS html,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
h AS (SELECT url, regexp_extract(regexp_extract(html, '(?is)<base\b[^>]*\shref\b[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS base,
        unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\srel\s*=\s*(?:["''](?:[^"''>]*[^\w"''>-])?|)canonical(?:["''\s/][^>]*)?>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1),
                regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["'']?refresh(?:["''\s/][^>]*)?>'), '(?is)\burl\s*=\s*''?((?:&#?\w+;|[^"''\s>;])+)', 1)]) AS t
      FROM p WHERE url IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')),
h1 AS (SELECT url, {_decoded_sql("base")} AS base, {_decoded_sql("t")} AS t FROM h WHERE t <> ''),
h2 AS (SELECT url, coalesce(CASE WHEN base <> '' THEN {_resolved_sql("url", "base")} END, url) AS base, t FROM h1),
h3 AS (SELECT url, {_resolved_sql("base", "t")} AS far FROM h2),
seg(url, far, head, done, todo, tail) AS (
  SELECT url, far, regexp_extract(far, '(?s)^(.*?://[^/?#]*)', 1), []::VARCHAR[], string_split(regexp_extract(far, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/'), regexp_extract(far, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1)
  FROM h3 WHERE far IS NOT NULL
  UNION ALL SELECT url, far, head,
    CASE WHEN todo[1] = '.' AND len(todo) = 1 OR todo[1] = '..' AND len(todo) = 1 AND len(done) <= 1 THEN list_append(done, '')
         WHEN todo[1] = '.' THEN done WHEN todo[1] = '..' AND len(todo) = 1 THEN list_append(done[:-2], '')
         WHEN todo[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[:-2] ELSE done END ELSE list_append(done, todo[1]) END,
    todo[2:], tail FROM seg WHERE len(todo) > 0),
l AS (SELECT url AS from_url, head || array_to_string(done, '/') || tail AS to_url FROM seg WHERE len(todo) = 0),
m AS (SELECT {_key_sql("from_url")} AS src, {_key_sql("to_url")} AS dst, to_url FROM l),
e AS (SELECT src, dst FROM m WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM m WHERE src IS NOT NULL AND dst IS NOT NULL),
u AS (SELECT DISTINCT url, {_key_sql("url")} AS key FROM (SELECT url FROM p WHERE url IS NOT NULL UNION ALL SELECT to_url FROM m WHERE src IS NOT NULL AND dst IS NOT NULL)),
reach(key, node) AS (SELECT DISTINCT key, key FROM u WHERE key IS NOT NULL UNION SELECT reach.key, e.dst FROM reach JOIN e ON e.src = reach.node),
c AS (SELECT key, min(node) AS component FROM reach GROUP BY key),
f AS (SELECT url, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
      FROM (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u) JOIN r
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url),
d AS (SELECT component, bool_or(rule_verdict = 'allow') AS allowed FROM u JOIN c USING (key) JOIN f USING (url) GROUP BY component)
SELECT page_id, p.host, p.path, rule,
       CASE WHEN rule IS NOT NULL THEN rule_verdict WHEN allowed IS NULL OR allowed THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM p LEFT JOIN u USING (url) LEFT JOIN c USING (key) LEFT JOIN f USING (url) LEFT JOIN d USING (component)
"""
