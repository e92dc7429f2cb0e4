"""Mixing sources to target weights by entropy balancing.

Every distinct text d of a source s gets a rate w between 0 and the source's cap m, tilted exponentially by
its token count t: w = m * sigma(lambda_s * t / mean_t), the solution of least relative entropy under the
token constraint sum w t = target. The convex dual in the lambdas is solved by Newton steps whose gradient
and Hessian are sums over all texts. Rates are then rounded to whole copies by one threshold per source
on a hash-random order, found from token histograms, so that each source's tokens meet its target
to within the tokens of a text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.tokenize import encode
from fieldloom.session import materialize, table

#: Newton steps end when every source is this close to its target, relatively
CLOSE, STEPS = 1e-9, 60
#: cells of a histogram of thresholds, and how often its hit cell is refined
CELLS, REFINE = 1024, 4


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, first): first marks the least doc_id of each text; only it may be used, so that no
    text is used more often than its source allows, be it repeated within or across sources.

    Rows with a null source or a null or empty text are left out: they can't add tokens to a source.
    """
    kept = docs.where("source is not null and text is not null and text <> ''")
    rows = encode(kept.withColumn("_h1", F.xxhash64("text")).withColumn("_h2", F.xxhash64(F.lit(1), "text")), "doc_id", "text", path, carry=("source", "_h1", "_h2"), count_only=True)
    rows = materialize(rows)
    firsts = rows.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    return materialize(rows.join(firsts, "doc_id", "left").select("doc_id", "source", F.col("n_tokens").alias("tokens"), F.coalesce("first", F.lit(False)).alias("first")))


def _solve(texts: DataFrame, goals: dict[str, tuple[float, int]], mean: float) -> dict[str, float]:
    """The dual variable of each source: Newton steps, kept inside a bracket because the dual is flat far out."""
    lam = dict.fromkeys(goals, 0.0)
    low, high = dict.fromkeys(goals, -math.inf), dict.fromkeys(goals, math.inf)
    open_ = {s for s, (goal, _) in goals.items()}
    for _ in range(STEPS):
        if not open_:
            break
        at = F.create_map(*(F.lit(v) for s in sorted(open_) for v in (s, lam[s])))
        x = F.col("tokens") / mean
        p = 1 / (1 + F.exp(-at[F.col("source")] * x))
        sums = texts.where(F.col("source").isin(*open_)).groupBy("source").agg(F.sum(F.col("tokens") * p).alias("g"), F.sum(F.col("tokens") * x * p * (1 - p)).alias("h")).collect()
        for r in sums:  # one row per source with a target
            goal, cap = goals[r.source]
            miss = cap * r.g - goal
            if abs(miss) <= CLOSE * goal or high[r.source] - low[r.source] < 1e-12:
                open_.discard(r.source)
                continue
            (high if miss > 0 else low)[r.source] = lam[r.source]
            a, b = low[r.source], high[r.source]
            step = lam[r.source] - miss / (cap * r.h) if r.h > 0 else math.nan
            if not a < step < b or abs(step) > 1e4:
                step = (a + b) / 2 if math.isfinite(a + b) else (max(1.0, 2 * abs(lam[r.source])) if miss < 0 else -max(1.0, 2 * abs(lam[r.source])))
            lam[r.source] = step
    return lam


def _thresholds(keyed: DataFrame, needs: dict[str, float]) -> dict[str, float]:
    """For each source the threshold v below which texts get one copy more, so that their tokens come closest to the need from below."""
    span = {s: (-1.0, 1.0) for s in needs}
    rest = dict(needs)
    for _ in range(REFINE):
        lo = F.create_map(*(F.lit(v) for s in needs for v in (s, span[s][0])))[F.col("source")]
        hi = F.create_map(*(F.lit(v) for s in needs for v in (s, span[s][1])))[F.col("source")]
        cell = F.floor((F.col("v") - lo) / (hi - lo) * CELLS)
        bars = keyed.where((F.col("v") >= lo) & (F.col("v") < hi)).groupBy("source", cell.alias("cell")).agg(F.sum("tokens").alias("tokens")).collect()  # at most CELLS rows a source
        for s in needs:
            a, b = span[s]
            c = 0
            for cell_no, tokens in sorted((r.cell, r.tokens) for r in bars if r.source == s):
                if tokens > rest[s]:
                    c = cell_no
                    break
                rest[s] -= tokens
                c = cell_no + 1
            c = min(c, CELLS)
            span[s] = (a + (b - a) * c / CELLS, a + (b - a) * min(c + 1, CELLS + 1) / CELLS)
    return {s: a for s, (a, _) in span.items()}


def mixture(counts: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: (doc_id, source, tokens, rate, copies) of every text of a source that has a target;
    shares: one row per target with the shares wanted and reached.

    total: tokens of the mixture; None takes the most that all targets allow together. Where a source has fewer tokens
    than its share of a given total even at its cap, it is used up and its share falls short, visibly. Sources
    without texts reach 0, and the other targets keep their proportions.
    """
    spark = counts.sparkSession
    wanted = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").collect()}
    texts = counts.where(F.col("first") & F.col("source").isin(*wanted))
    have = {r.source: (r.tokens, r.n) for r in texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    wanted_rows = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    if not have:
        empty = counts.select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
        return empty, wanted_rows.select("source", "target_share", F.lit(0.0).alias("actual_share"), F.lit(0).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("texts"), F.lit(0).cast("bigint").alias("copies"), "max_repeats")
    shares = {s: wanted[s][0] / sum(wanted[x][0] for x in have) for s in have}
    most = min(wanted[s][1] * have[s][0] / shares[s] for s in have)
    size = most if total is None else float(total)
    goals = {s: (min(size * shares[s], wanted[s][1] * have[s][0]), wanted[s][1]) for s in have}
    full = {s for s, (goal, cap) in goals.items() if goal >= cap * have[s][0] * (1 - 1e-9)}
    inner = {s: g for s, g in goals.items() if s not in full}
    mean = sum(t for t, _ in have.values()) / sum(n for _, n in have.values())
    lam = _solve(texts, inner, mean) if inner else {}
    const = lambda d: F.create_map(*(F.lit(v) for s, x in d.items() for v in (s, x)))[F.col("source")]
    cap = const({s: float(wanted[s][1]) for s in have})
    tilt = cap / (1 + F.exp(-const({s: lam.get(s, 0.0) for s in have}) * F.col("tokens") / mean))
    rated = texts.withColumn("rate", F.when(F.col("source").isin(*full), cap).otherwise(tilt) if full else tilt)
    # a number in [0, 1) of each text, the same in every run; texts below rate's fraction are nearest to one copy more
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    keyed = materialize(rated.withColumn("base", F.floor("rate")).withColumn("v", u - (F.col("rate") - F.floor("rate"))))
    based = {r.source: r.t for r in keyed.groupBy("source").agg(F.sum(F.col("base") * F.col("tokens")).alias("t")).collect()}
    cut = _thresholds(keyed.where(F.col("base") < cap), {s: goals[s][0] - based[s] for s in inner}) if inner else {}
    more = F.when(F.col("base") >= cap, 0).when(F.col("v") < const({s: cut.get(s, -2.0) for s in have}), 1).otherwise(0)
    rows = keyed.select("doc_id", "source", "tokens", "rate", (F.col("base") + more).cast("int").alias("copies"))
    used = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("texts"), F.sum("copies").alias("copies"))
    all_ = used.agg(F.sum("tokens").alias("all"))
    report = wanted_rows.join(F.broadcast(used), "source", "left").crossJoin(F.broadcast(all_))  # one row per target, one row in all
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows, report.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), none("tokens"), none("texts"), none("copies"), "max_repeats")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined set: each text that is used, and how many times."""
    return mixture(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0].where("copies > 0")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]
