"""Quality rules whose cutoffs carry a risk guarantee.

Fixed measures of a text are compared with cutoffs; a document over a cutoff of its stratum (language) is rejected. A
fifth of the labelled documents lays out, for each stratum, a sequence of ever lower cutoffs of all rules together: each
step takes the one that adds most bad documents for the good ones it costs. The other labels are the holdout. In the
order of the sequence an exact binomial test on the holdout's good documents must reject that all rules together falsely
reject more than MAX_FALSE_REJECTION of them, and the first test that fails ends the sequence (fixed-sequence testing, so
the steps share one level). RISK is divided over the strata whose holdout is large enough for any test to succeed, and
a stratum that gets through its sequence passes its level on to the others, as Holm's procedure does. The last
certified step gives the cutoffs; with probability 1 - RISK no stratum breaks its bound. A stratum with too few labels
rejects nothing beyond the base rules.

Cutoffs are fitted on all labelled documents of all strata. These are counted by the cutoffs that they are over, so what a
task plans a stratum from is bounded by the grid, not by the rows; the driver gets a stratum's sequence and how many of
the holdout's good documents each of its steps adds. Only strata whose holdout is large enough for a test get there.

Cases: a null or empty text has no words and fails the base rules; several labels of a document count once, as the
lowest; a null label counts nowhere; a null language is a stratum; repeated rows are measured and judged each, and
labelled ones count once if their measures are equal; without labels no cutoff is used; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
MAX_FALSE_REJECTION = 0.02  # of good documents in a stratum, by all rules together
RISK = 0.05  # that any stratum breaks its bound
TUNING = 5  # one labelled document in so many lays out the sequences, the others test them
STEPS = 24
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def steps(low: float, high: float, n: int = STEPS) -> tuple[float, ...]:
    return tuple(low * (high / low) ** (i / (n - 1)) for i in range(n))


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Score (a document over the cutoff is rejected) and ascending cutoffs of each rule."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "long_words": (F.col("word_chars") / words, steps(5, 40)),
        "short_words": (words / F.greatest(F.col("word_chars"), F.lit(1)), steps(0.15, 1)),
        "symbols": (F.col("n_symbols") / words, steps(0.01, 3)),
        "dup_lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), steps(0.02, 1)),
        "repeated_words": (F.col("n_repeat_words") / words, steps(0.02, 1)),
    }


def measured(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows of three, lines with a word."""
    words = text.encode().split()  # at ASCII white space only
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    repeated = 0
    if len(a) > 2:
        k = len(ids)
        if k < 2_000_000:
            key = (a[:-2] * k + a[1:-1]) * k + a[2:]
            _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        else:
            _, where, n = np.unique(np.stack([a[:-2], a[1:-1], a[2:]], 1), axis=0, return_inverse=True, return_counts=True)
        again = n[where.reshape(-1)] > 1
        inside = np.zeros(len(a), bool)
        for i in range(3):
            inside[i : len(a) - 2 + i] |= again
        repeated = int(inside.sum())
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def base_measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measured(t or "") for t in b.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *cols], names=[x.split()[0] for x in BASE.split(", ")])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, BASE)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def tail(n: int, share: float, k: int) -> float:
    """P(X <= k) of X ~ Binomial(n, share)."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = n * math.log1p(-share) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + (math.log(share) - math.log1p(-share)))])
    return min(1.0, float(math.exp(logs.max()) * np.exp(logs - logs.max()).sum()))


def upper_bound(n: int, k: int, level: float) -> float:
    """Clopper-Pearson: the least share that k of n rules out at this level."""
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(n, mid, k) > level else (low, mid)
    return high


def rejected(steps_: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which rows pass a cutoff; steps_ says how many cutoffs of each rule a row is over, cuts which one is used (STEPS: none)."""
    return (steps_ > cuts).any(1)


def sequence(good: np.ndarray, n_good: np.ndarray, bad: np.ndarray, n_bad: np.ndarray) -> list[np.ndarray]:
    """Ever lower cutoffs of all rules, by labelled steps and how many documents have them; each step pays on these."""
    cuts, out = np.full(good.shape[1], STEPS), []

    def over(steps_: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many of these rows are over each cutoff of a rule."""
        return np.bincount(steps_, n, STEPS + 1)[::-1].cumsum()[::-1][1:].astype(np.int64)

    while True:
        fine, missed = ~rejected(good, cuts), ~rejected(bad, cuts)
        best = None
        for rule in range(len(cuts)):
            costs, gains = over(good[fine, rule], n_good[fine]), over(bad[missed, rule], n_bad[missed])
            for at in range(cuts[rule] - 1, -1, -1):
                cost, gain = costs[at], gains[at]
                worth = gain * max(1, n_good.sum()) / (max(1, n_bad.sum()) * (cost + 0.5))
                if gain and worth > 1 and (best is None or (worth, gain) > best[0]):
                    best = (worth, gain), rule, at
        if best is None:
            return out
        cuts = cuts.copy()
        cuts[best[1]] = best[2]
        out.append(cuts)


def certified(tests: dict, share: float = MAX_FALSE_REJECTION, risk: float = RISK) -> dict:
    """stratum -> (steps, holdout's good steps, how many have them) -> stratum -> (last certified cuts, bound of their false rejections)."""
    able = {k: t for k, t in tests.items() if t[0] and (1 - share) ** int(t[2].sum()) <= risk}
    level = {k: risk / len(able) for k in able}
    done, open_ = dict.fromkeys(able, 0), set(able)
    moved = True
    while moved:
        moved = False
        for k in sorted(open_, key=str):
            path, good, n = able[k]
            while done[k] < len(path) and tail(int(n.sum()), share, int(n[rejected(good, path[done[k]])].sum())) <= level[k]:
                done[k] += 1
            if done[k] == len(path):
                open_.discard(k)
                for other in open_:
                    level[other] += level[k] / len(open_)
                moved = bool(open_)
    out = {}
    for k, n_done in done.items():
        if n_done:
            path, good, n = able[k]
            cuts = path[n_done - 1]
            out[k] = cuts, upper_bound(int(n.sum()), int(n[rejected(good, cuts)].sum()), level[k])
    return out


def certify(measures: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, risk: float = RISK) -> dict[str | None, tuple[dict[str, float], float]]:
    """Cutoffs by rule, and the bound on false rejections that they carry, by stratum."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    grid = {name: cuts for name, (_, cuts) in rules().items()}

    def step(score: Column, cuts: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: score > c))

    names = [f"s{i}" for i in range(len(grid))]
    passed = [step(*rule).alias(n) for n, rule in zip(names, rules().values(), strict=True)]
    known = measures.where(~base_failed()).join(marks, "doc_id").select("doc_id", "lang", "good", *passed).distinct()
    tuning = F.crc32(F.col("doc_id").cast("string")) % TUNING == 0
    counts = known.groupBy("lang", "good", tuning.alias("tuning"), *names).agg(F.count("*").alias("n"))

    def plan(t: pa.Table) -> pa.Table:
        """A stratum's sequence, and the holdout's good rows by how many steps they pass, with the cutoffs that one of them is over."""
        over, n = np.stack([t[c].to_numpy() for c in names], 1), t["n"].to_numpy()
        good, tunes = (t[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "tuning"))
        fine, bad, held = good & tunes, ~good & tunes, good & ~tunes
        path = sequence(over[fine], n[fine], over[bad], n[bad]) if (1 - max_false_rejection) ** int(n[held].sum()) <= risk else []
        over, n = over[held], n[held]
        at = np.zeros(len(n), np.int64)
        for cuts in path:
            at += ~rejected(over, cuts)
        kinds, some, of = np.unique(at, return_index=True, return_inverse=True)
        rows = [(False, i, c.tolist(), 0) for i, c in enumerate(path)]
        if path:
            rows += [(True, int(i), over[j].tolist(), int(m)) for i, j, m in zip(kinds, some, np.bincount(of.reshape(-1), n), strict=True)]
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.int64()))]
        return pa.table([pa.array([t["lang"][0].as_py()] * len(rows), pa.string()), *cols], ["lang", "held", "at", "steps", "n"])

    planned: dict[str | None, tuple[list, list]] = {}
    for r in sorted(counts.groupBy("lang").applyInArrow(plan, "lang string, held boolean, at int, steps array<int>, n bigint").collect(), key=lambda r: r.at):
        planned.setdefault(r.lang, ([], []))[r.held].append(r)
    tests = {lang: ([np.array(r.steps) for r in path], np.array([r.steps for r in held]), np.array([r.n for r in held])) for lang, (path, held) in planned.items()}
    found = certified(tests, max_false_rejection, risk)
    return {lang: ({name: cuts[at] for (name, cuts), at in zip(grid.items(), chosen, strict=True) if at < STEPS}, bound) for lang, (chosen, bound) in found.items()}


def judge(measures: DataFrame, cutoffs: dict[str | None, tuple[dict[str, float], float]]) -> DataFrame:
    """measures with base_failed, rejected_by (names of rules), kept, and the stratum's cutoffs and bound, null without any."""
    names = list(rules())
    kinds = ["__of string", *(f"__{name} double" for name in names), "cutoffs string", "false_rejection_bound double"]
    rows = [(lang, *map(own.get, names), ",".join(f"{k}>{v:.6g}" for k, v in own.items()), bound) for lang, (own, bound) in cutoffs.items()]
    strata = F.broadcast(measures.sparkSession.createDataFrame(rows, ", ".join(kinds)))  # those with a certified step
    both = measures.join(strata, F.col("lang").eqNullSafe(F.col("__of")), "left")
    by = F.array_compact(F.array(*[F.when(score > F.col(f"__{name}"), F.lit(name)) for name, (score, _) in rules().items()]))
    judged = both.withColumns({"base_failed": base_failed(), "rejected_by": by})
    return judged.select(*measures.columns, "base_failed", "rejected_by", "cutoffs", "false_rejection_bound", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = settle(base_measures(table(spark, sf_dir, "documents")))
    found = judge(measures, certify(measures, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"), "cutoffs", "false_rejection_bound")


QUERIES = {"op6_quality": op6_quality}
