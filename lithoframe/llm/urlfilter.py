"""URL filter: domain rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter has 256-bit blocks of eight 32-bit words; a URL sets one bit in each word of one block, and blocks are as
many as the list asks for. A filter of MAX_BLOCKS or fewer is broadcast; a larger one meets the pages by ranges of
blocks in a shuffle. Possible hits then go to an exact hash join, which removes every false positive; it broadcasts a
list of MAX_LISTED bytes or fewer and shuffles a larger one. In both shuffles rows that can't be hits lie anywhere, and
the rows of one URL are spread over SALTS tasks. Cases: a null URL or one without
`://` has an empty host and path, fits no rule, is never listed and so is allowed; repeated rows are judged
each; an empty list blocks nothing; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

WORDS = 8
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 18  # 8 MiB of filter that are broadcast, at most
MAX_LISTED = 8 << 20  # bytes of listed URLs that are broadcast, at most
SALTS = 32
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Verdict, host, path; fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without closing slashes, sorted parameters without tracking; null without `://`."""
    params = F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise("")
    return F.when(F.locate("://", url) > 0, F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""), query))


def fitting_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _bits(url: Column) -> list[Column]:
    h = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31).cast("bigint")).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed(canonical) -> block, w0..w7: n_blocks rows at most."""
    return (
        listed.select(F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def blocks_for(n: int) -> int:
    """A power of two of blocks, BITS_PER_URL bits a URL or more."""
    return 1 << max(0, -(-n * BITS_PER_URL // (32 * WORDS)) - 1).bit_length()


def _looked_up(rows: DataFrame, keyed: DataFrame, key: str, asks: Column, small: bool) -> DataFrame:
    """rows with the columns of keyed, which has a row a key, where asks holds; broadcast if small, else in a salted shuffle."""
    wanted = F.when(asks, F.col(key))
    if small:
        return rows.withColumn("__key", wanted).join(F.broadcast(keyed.withColumnRenamed(key, "__key")), "__key", "left").drop("__key")
    salt = F.xxhash64("page_id", "canonical")
    left = rows.withColumns({"__key": wanted, "__salt": F.when(asks, F.pmod(salt, F.lit(SALTS))).otherwise(salt)})
    right = keyed.withColumnRenamed(key, "__key").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, ["__key", "__salt"], "left").drop("__key", "__salt")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url), listed(canonical) -> page_id, host, path, rule, verdict, listed."""
    listed = settle(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct())
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical") + 16), F.lit(0))).first()
    n_blocks = blocks_for(n)
    url = F.col("canonical")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(n_blocks)))
    rows = _looked_up(rows, bloom_filter(listed, n_blocks), "block", url.isNotNull(), n_blocks <= MAX_BLOCKS)
    may = url.isNotNull() & F.col("w0").isNotNull()
    for i, b in enumerate(_bits(url)):
        may = may & (F.col(f"w{i}").bitwiseAND(b) == b)
    rows = rows.select("page_id", "host", "path", "fit", "canonical", F.coalesce(may, F.lit(False)).alias("may"))
    rows = _looked_up(rows, listed.withColumn("listed", F.lit(True)), "canonical", F.col("may"), size <= MAX_LISTED)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def tracked(pages: DataFrame) -> DataFrame:
    """The list that op8 uses: canonical URLs that some page carries together with a tracking parameter."""
    params = F.split(F.regexp_extract(_rest(F.col("url")), r"^[^?#]*\?([^#]*)", 1), "&")
    return pages.where(F.exists(params, lambda p: p.rlike(TRACKING))).select(canonical(F.col("url")).alias("canonical"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, tracked(pages))


QUERIES = {"op8_urlfilter": op8_urlfilter}
ORACLE_SQL = {
    "op8_urlfilter": r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&') AS params FROM a),
c AS (SELECT *, list_sort(list_filter(params, lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept,
        len(list_filter(params, lambda p: regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) > 0 AS tracked FROM b),
d AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
        CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM d WHERE tracked),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, arg_max(r.verdict, length(h || p)) AS verdict, arg_max(h || p, length(h || p)) AS rule
      FROM (SELECT DISTINCT page_id, host, path FROM d) x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT d.page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM d LEFT JOIN l USING (canonical) LEFT JOIN m USING (page_id)
"""
}
