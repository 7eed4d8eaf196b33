"""Secret scan: three base patterns, and tokens that a character Markov model finds more random than identifier-like.

Two first-order models over a fixed alphabet, one of random strings and one of ordinary identifiers, are fitted
on labelled samples; a token whose log-likelihood ratio passes the threshold is a `markov` span, unless it
overlaps a base span. DataFrame functions only; work grows in proportion to a text's length, also where one token or
very many spans fill it. Positions are code points, ends exclusive. Cases: a null or empty text has no spans; a row is scanned on its own, so repeated rows come out alike; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import recounted, table

#: Base kinds in the order they are listed; fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
MARKOV = 3
MIN_VALUE = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}"
SAMPLE_DOCS = 2000  # documents that ordinary identifiers are drawn from, about
SAMPLE_RANDOM = 4000  # random strings, half as long a list for each of three alphabets
MIN_RATIO = 14.0  # nats by which the random model must be likelier
MIN_PER_CHAR = 0.35
REDACTED = "[SECRET]"
SPAN = "struct<start:int,kind:int,end:int>"
BLOCK = 64  # items of an array that are folded at a time


def bound(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, kind: str, step) -> Column:
    """The states step(state, item) after each item. Blocks of items keep the copying of the growing array short."""
    none = F.array().cast(f"array<{kind}>")

    def block(last: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(last.alias("last"), none.alias("out")), lambda a, x: bound(step(a["last"], x), lambda v: F.struct(v.alias("last"), F.concat(a["out"], F.array(v)).alias("out"))))

    def blocks(all_: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")),
            F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out")),
            lambda a, b: bound(block(a["last"], F.slice(all_, b * BLOCK + 1, BLOCK)), lambda r: F.struct(r["last"].alias("last"), F.concat(a["out"], F.array(r["out"])).alias("out"))),
            lambda a: F.flatten(a["out"]),
        )

    return bound(items, lambda all_: F.when(F.size(all_) > 0, blocks(all_)).otherwise(none))


def _located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the pattern's matches: their starts follow from the pieces between them. keep(matches, spans) filters."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        steps = F.zip_with(gaps, found, lambda gap, m: F.struct((gap + F.length(m)).alias("move"), F.length(m).alias("m")))
        ends = running(steps, F.lit(0), "int", lambda at, x: at + x["move"])
        spans = F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return keep(found, spans) if keep else spans

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _long_values(text: Column):
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    return lambda found, spans: bound(values, lambda sizes: F.filter(spans, lambda s, i: F.get(sizes, i) >= MIN_VALUE))


def base_spans(text: Column) -> Column:
    """Sorted by start, then kind as listed."""
    return F.array_sort(F.concat(_located(text, ASSIGN, 0, _long_values(text)), _located(text, ACCESS, 1), _located(text, HEX, 2)))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, is_secret): made-up random strings, and words of about SAMPLE_DOCS documents without their base spans."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    made = spark.range(0, SAMPLE_RANDOM, 1, 1).select(F.explode(F.array(F.substring(digest, 1, 40), F.translate(F.base64(F.unhex(digest)), "=", ""), F.translate(F.substring(F.base64(F.unhex(F.sha2(digest, 256))), 1, 24), "+/=", ""))).alias("token"), F.lit(True).alias("is_secret"))
    n = docs.count()
    drawn = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(min(1 << 30, (SAMPLE_DOCS << 30) // max(n, 1)))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = drawn.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_.=-]{6,}"), F.lit(0))).alias("token"), F.lit(False).alias("is_secret"))
    return made.unionByName(words)


def fit(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios random : ordinary by (char, next char); row 0 is a token's start. About 70 x 69 numbers."""
    k = len(ALPHABET)
    place = lambda i: F.call_function("locate", F.col("token").substr(i, F.lit(1)), F.lit(ALPHABET))
    pairs = samples.select("is_secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.when(i == 1, 0).otherwise(place(i - 1)) * (k + 1) + place(i))).alias("pair"))
    counts = {(r.is_secret, r.pair): r.n for r in pairs.groupBy("is_secret", "pair").agg(F.count("*").alias("n")).collect()}
    out = [0.0] * (k + 1) ** 2
    for a in range(k + 1):
        totals = {s: sum(counts.get((s, a * (k + 1) + b), 0) for b in range(1, k + 1)) + smooth * k for s in (True, False)}
        for b in range(1, k + 1):
            out[a * (k + 1) + b] = round(math.log((counts.get((True, a * (k + 1) + b), 0) + smooth) / totals[True]) - math.log((counts.get((False, a * (k + 1) + b), 0) + smooth) / totals[False]), 4)
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, whose characters are taken apart once."""
    k = len(ALPHABET)
    table_ = F.lit(model)
    return F.aggregate(
        F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET))),
        F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
        lambda a, at: F.struct(at.alias("last"), (a["sum"] + F.get(table_, a["last"] * (k + 1) + at)).alias("sum")),
        lambda a: a["sum"],
    )


def apart(spans: Column, base: Column) -> Column:
    """Spans that overlap none of base, by a sweep in either direction over both in order."""

    def swept(all_: Column) -> Column:
        is_base = lambda s: s["kind"] < MARKOV
        ends = running(all_, F.lit(0), "int", lambda end, s: F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end))
        starts = running(F.reverse(all_), F.lit((1 << 31) - 1), "int", lambda start, s: F.when(is_base(s), F.least(start, s["start"])).otherwise(start))
        open_ = lambda e, n: F.filter(all_, lambda s, i: ~is_base(s) & (F.get(e, i) <= s["start"]) & (F.get(n, F.size(all_) - 1 - i) >= s["end"]))
        return bound(ends, lambda e: bound(starts, lambda n: open_(e, n)))

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), bound(F.array_sort(F.concat(spans, base)), swept)).otherwise(spans)


def markov_spans(text: Column, base: Column, model: list[float], min_ratio: float = MIN_RATIO, min_per_char: float = MIN_PER_CHAR) -> Column:
    def unlike(found: Column, spans: Column) -> Column:
        return F.filter(spans, lambda s, i: ratio(F.get(found, i), model) >= F.greatest(F.lit(min_ratio), min_per_char * (s["end"] - s["start"])))

    return bound(_located(text, CANDIDATE, MARKOV, unlike), lambda spans: apart(spans, base))


def scan(docs: DataFrame, model: list[float], **how) -> DataFrame:
    """docs plus __base and __spans, both arrays of (start, kind, end) in order; kind is a place in KINDS."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("__base", base_spans(text))
    return docs.withColumn("__spans", F.array_sort(F.concat("__base", markov_spans(text, F.col("__base"), model, **how))))


def written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with REDACTED for each stretch of spans; what lies between is cut from one piece of text a block of spans."""

    def joined(ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        gaps = F.filter(F.transform(spans, lambda s, i: F.struct(before(i).alias("start"), s["start"].alias("end"))), lambda g: g["start"] <= g["end"])
        cut = lambda some: bound(
            text.substr(some[0]["start"] + 1, F.element_at(some, -1)["end"] - some[0]["start"]),
            lambda piece: F.transform(some, lambda g: F.concat(piece.substr(g["start"] - some[0]["start"] + 1, g["end"] - g["start"]), F.lit(REDACTED))),
        )
        parts = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: bound(F.slice(all_, b * BLOCK + 1, BLOCK), lambda some: F.array_join(cut(some), "")))
        return F.concat(F.array_join(bound(gaps, parts), ""), text.substr(F.element_at(ends, -1) + 1, F.length(text)))

    ends = running(spans, F.lit(0), "int", lambda end, s: F.greatest(end, s["end"]))
    return F.when(F.size(spans) > 0, bound(ends, joined)).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its secrets replaced."""
    found = scan(docs, fit(labelled_samples(docs)))
    return recounted(found.withColumn("text", redacted(F.col("text"), F.col("__spans"))).select(*docs.columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(labelled_samples(docs)))
    n = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("__base")), 256).alias("base_sha256"), written(F.col("__spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
