"""Warm-tier figures and plans. Spark's own storage memory does the caching; these say what a tier would hold."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin_greedy(candidates: DataFrame, warm_budget: int) -> DataFrame:
    """candidates(tier, pos, block_id, payload_len) -> with fits: pinned in order into a quarter of the budget.

    A block that doesn't fit is passed over and later ones may still fit, which makes this a fold; a pinned one stays so.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        free, pinned, fits = warm_budget // 4, set(), []
        for block, size in frame.sort_values("pos")[["block_id", "payload_len"]].itertuples(index=False):
            if block not in pinned and size <= free:
                pinned.add(block)
                free -= size
            fits.append(block in pinned)
        return frame.sort_values("pos").assign(fits=fits)[["tier", "pos", "block_id", "payload_len", "fits"]]

    return candidates.groupBy("tier").applyInPandas(run, "tier string, pos bigint, block_id string, payload_len bigint, fits boolean")


def simulate(accesses: DataFrame, warm_budget: int) -> DataFrame:
    """accesses(tier, pos, block_id, payload_len, pinned, quarantined) -> tier, pos, outcome: error, hit or miss.

    Recency decides what stays; a block larger than the whole budget is never warmed.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        warm: OrderedDict[str, int] = OrderedDict()
        used, out = 0, []
        for r in frame.sort_values("pos").itertuples(index=False):
            if r.quarantined:
                used -= warm.pop(r.block_id, 0)
                out.append("error")
            elif r.pinned or r.block_id in warm:
                out.append("hit")
                if r.block_id in warm:
                    warm.move_to_end(r.block_id)
            else:
                out.append("miss")
                if r.payload_len <= warm_budget:
                    warm[r.block_id] = r.payload_len
                    used += r.payload_len
                    while used > warm_budget:
                        used -= warm.popitem(last=False)[1]
        return frame.sort_values("pos").assign(outcome=out)[["tier", "pos", "block_id", "outcome"]]

    return accesses.groupBy("tier").applyInPandas(run, "tier string, pos bigint, block_id string, outcome string")


def tier_stats(outcomes: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("outcome") == k)
    hits, misses = count("hit"), count("miss")
    return outcomes.groupBy("tier").agg(hits.alias("hits"), misses.alias("misses"), count("error").alias("errors"), F.try_divide(hits.cast("double"), (hits + misses).cast("double")).alias("hit_rate"))


def quarantine(store: DataFrame, verified: DataFrame) -> DataFrame:
    """Blocks of the warm tier to evict: those whose cold copy is damaged."""
    return store.select("block_id").join(verified.where("state <> 'intact'").select("block_id"), "block_id", "left_semi")


def repair(damaged: DataFrame, candidates: DataFrame, id_of) -> DataFrame:
    """A good payload for each damaged block, to be appended as a new record that replaces the old location."""
    good = candidates.where(id_of(F.col("payload")) == F.col("block_id"))
    return damaged.select("block_id").distinct().join(good.groupBy("block_id").agg(F.any_value("payload").alias("payload")), "block_id")
