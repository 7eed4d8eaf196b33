"""Percentile variants, summaries and text metrics over sample columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024

#: Name, kind and help text of each metric line.
METRICS = (
    ("blocks", "gauge", "Stored blocks"),
    ("segments", "gauge", "Segment files"),
    ("disk_bytes", "gauge", "Bytes of all segments"),
    ("warm_blocks", "gauge", "Blocks in the warm tier"),
    ("warm_bytes", "gauge", "Bytes in the warm tier"),
    ("warm_budget_bytes", "gauge", "Byte budget of the warm tier"),
    ("pinned_blocks", "gauge", "Pinned blocks"),
    ("pinned_bytes", "gauge", "Pinned bytes"),
    ("warm_hits_total", "counter", "Reads that the warm tier served"),
    ("warm_misses_total", "counter", "Reads from disk"),
    ("gc_runs_total", "counter", "Compaction runs"),
    ("gc_blocks_dropped_total", "counter", "Blocks that compaction dropped"),
    ("gc_bytes_reclaimed_total", "counter", "Bytes that compaction reclaimed"),
    ("log_term", "gauge", "Term of the log"),
    ("log_last_index", "gauge", "Last log index"),
    ("log_applied_index", "gauge", "Last applied index"),
    ("agents", "gauge", "Registered agents"),
    ("bindings", "gauge", "Bound keys"),
    ("leases", "gauge", "Upload leases"),
)


def percentile_linear(x: Column, p: float) -> Column:
    """Interpolated at (n - 1) * p; exact."""
    return F.percentile(x, F.lit(p))


def rounded_place(p: float):
    """Index round((n - 1) * p), halves up."""
    return lambda n: F.floor((n - 1) * F.lit(p) + 0.5)


def truncated_place(p: float):
    """Index floor(n * p) - 1; index -1 is the last value."""
    return lambda n: F.when(F.floor(n * F.lit(p)) == 0, n - 1).otherwise(F.floor(n * F.lit(p)) - 1)


def ranked(df: DataFrame, x: str, by: list[str], places: dict) -> DataFrame:
    """by and, for each name of places, the value whose index in its group's order is place(n).

    Equal values are counted before any order is made, and running counts find the place, so no group meets in a row.
    """
    key = [F.lit(0).alias("__all")] if not by else [F.col(c) for c in by]
    counts = df.where(F.col(x).isNotNull()).groupBy(*key, F.col(x).alias("__x")).agg(F.count("*").alias("__k"))
    names = by or ["__all"]
    upto = Window.partitionBy(*names).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"__upto": F.sum("__k").over(upto), "__n": F.sum("__k").over(Window.partitionBy(*names))})
    return placed.groupBy(*names).agg(*[F.min(F.when(F.col("__upto") > place(F.col("__n")), F.col("__x"))).alias(name) for name, place in places.items()]).drop("__all")


def summarize(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    c = F.col(x)
    stats = [F.count(c).alias("n"), *[F.round(percentile_linear(c, p / 100), 3).alias(f"p{p}") for p in (50, 95, 99)], F.round(F.mean(c), 3).alias("mean"), F.round(F.max(c), 3).alias("max")]
    return df.groupBy(*(by or [])).agg(*stats)


def throughput(n_bytes: Column, n_blocks: Column, seconds: Column) -> Column:
    return F.struct(F.try_divide(n_bytes / MIB, seconds).alias("mib_per_s"), F.try_divide(n_blocks.cast("double"), seconds).alias("blocks_per_s"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Null where nothing was read."""
    return F.try_divide(hits.cast("double"), (hits + misses).cast("double"))


def metric_lines(stats: DataFrame, prefix: str = "engine") -> DataFrame:
    """A one-row stats table with columns named as METRICS -> position, line (text exposition format); absent columns are left out."""
    mine = [(i, m) for i, m in enumerate(METRICS) if m[0] in stats.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(m[0]).alias("name"), F.lit(m[1]).alias("kind"), F.lit(m[2]).alias("help"), F.col(m[0]).cast("bigint").alias("value")) for i, m in mine]))
    name = F.concat(F.lit(prefix + "_"), "m.name")
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), name, "m.help"), F.concat_ws(" ", F.lit("# TYPE"), name, "m.kind"), F.concat_ws(" ", name, F.col("m.value").cast("string")))
    return stats.select(rows.alias("m")).select("m.at", F.posexplode(lines).alias("no", "line")).select((F.col("at") * 3 + F.col("no")).alias("position"), "line")
