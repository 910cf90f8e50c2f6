"""Evaluation of answer logs: accuracy, agreement, intervals, paired tests, retrieval quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high); zeros for no trials."""
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    zero = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return F.when(n == 0, zero).otherwise(F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def accuracy(results: DataFrame) -> DataFrame:
    """By category and system, and over all categories: results(qid, cat, system, ok, tok, lat, err)."""
    return results.rollup("system", "cat").agg(
        F.count_if(F.col("ok").isNotNull()).alias("n"),
        F.count_if("ok").alias("right"),
        F.round(F.avg(F.when(F.col("ok").isNotNull(), F.col("tok"))), 6).alias("avg_tokens"),
        F.count_if(F.col("err").isNotNull()).alias("errors"),
    ).where("system IS NOT NULL")


def categories(results: DataFrame) -> DataFrame:
    """Questions whose id ends in _abs are a category of their own."""
    return results.withColumn("cat", F.when(F.endswith("qid", F.lit("_abs")), "abstention").otherwise(F.col("cat")))


def latencies(results: DataFrame) -> DataFrame:
    """Per system the nearest-rank p50 and p95 of the scored answers' seconds."""
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY lat)")
    return results.where("ok IS NOT NULL").groupBy("system").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"))


def system_metrics(results: DataFrame) -> DataFrame:
    """Per system: errors, and of the others scored questions, accuracy in percent and mean tokens."""
    fine = F.col("err").isNull() & F.col("ok").isNotNull()
    n = F.count_if(fine)
    return results.groupBy("system").agg(
        n.alias("n"), F.count_if(F.col("err").isNotNull()).alias("errors"),
        F.coalesce(F.round(100.0 * F.count_if(fine & F.col("ok")) / F.nullif(n, F.lit(0)), 9), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.round(F.avg(F.when(fine, F.coalesce("tok", F.lit(0)))), 9), F.lit(0.0)).alias("avg_tokens"),
    )


def lost_in_the_middle(results: DataFrame, lean: str, full: str) -> DataFrame:
    """How the full context errs: abstentions among its errors, and where the lean one is right; results has pred."""
    from palimpsest.functions.text import looks_abstaining

    x = results.where(F.col("system") == lean).select("qid", F.coalesce("ok", F.lit(False)).alias("a"))
    y = results.where(F.col("system") == full).select("qid", F.coalesce("ok", F.lit(False)).alias("b"), looks_abstaining(F.col("pred"), more=True).alias("quiet"))
    both = x.join(y, "qid")
    only = F.col("a") & ~F.col("b")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("b")).alias("errors"), F.count_if(~F.col("b") & F.col("quiet")).alias("errors_abstained"),
        F.count_if(only).alias("only_lean"), F.count_if(only & F.col("quiet")).alias("only_lean_abstained"), F.count_if(only & ~F.col("quiet")).alias("only_lean_wrong_value"),
    )


def backbone_gaps(results: DataFrame, lean: str, full: str) -> DataFrame:
    """results with backbone: accuracy of both systems in percent, the gap, and how many times the tokens the full one takes."""
    per = system_metrics(results.withColumn("system", F.struct("backbone", "system")))
    side = lambda s, a, t: per.where(F.col("system.system") == s).select(F.col("system.backbone").alias("backbone"), F.col("accuracy").alias(a), F.col("avg_tokens").alias(t))
    both = side(lean, "lean", "_l").join(side(full, "full", "_f"), "backbone")
    ratio = F.when(F.col("_l") > 0, F.round(F.col("_f") / F.col("_l"), 6)).otherwise(0.0)
    return both.select("backbone", "lean", "full", F.round(F.col("lean") - F.col("full"), 9).alias("gap"), ratio.alias("token_ratio"))


def ablation(results: DataFrame, base: str) -> DataFrame:
    """Each variant against the base on the questions of both: hits, the difference in points, gains and losses, and
    whether the difference lies within the noise of the changed questions (two standard deviations of a fair coin)."""
    b = results.where(F.col("system") == base).select("qid", F.coalesce("ok", F.lit(False)).alias("_b"))
    both = results.where(F.col("system") != base).join(b, "qid").withColumn("_o", F.coalesce("ok", F.lit(False)))
    out = both.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_o").alias("hits"), F.count_if("_b").alias("base_hits"),
        F.count_if(F.col("_o") & ~F.col("_b")).alias("gained"), F.count_if(~F.col("_o") & F.col("_b")).alias("lost"),
    )
    gap = F.col("gained") - F.col("lost")
    return out.withColumns({"delta": F.round(100.0 * gap / F.col("n"), 6), "noise": F.pow(gap, 2) <= 4 * (F.col("gained") + F.col("lost"))})


def best_weights(recalls: DataFrame) -> DataFrame:
    """The row of weight_grid with the best recall, ties to the smaller id."""
    return recalls.orderBy(F.desc("recall"), "grid_id").limit(1)


def relevant_facts(facts: DataFrame, episodes: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, fact_id): facts some episode of which lies in a session that gold(qid, session_id) names."""
    told = facts.select("fact_id", F.explode("provenance").alias("episode_id")).join(episodes.select("episode_id", "session_id"), "episode_id")
    return told.join(gold, "session_id").select("qid", "fact_id").distinct()


def service_metrics(log: DataFrame, window: int = 512) -> DataFrame:
    """log(op, at, seconds): per operation all calls, and percentiles of the last ``window``, in milliseconds."""
    w = W.partitionBy("op").orderBy(F.desc("at"))
    last = log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    tail = lambda q, name: percentiles(last, "seconds", q, ["op"]).select("op", F.round(F.col("nearest_up") * 1000, 2).alias(name))
    sums = last.groupBy("op").agg(F.round(F.avg("seconds") * 1000, 2).alias("avg_ms"), F.round(F.max("seconds") * 1000, 2).alias("max_ms"), F.count(F.lit(1)).alias("window"))
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("n")).join(sums, "op").join(tail(0.5, "p50_ms"), "op").join(tail(0.95, "p95_ms"), "op")


# fixed values: what the first rung asks of coverage and of the median lag in seconds
TARGET_COVERAGE, TARGET_LAG_S = 0.90, 60.0


def coverage_report(sessions: DataFrame, weekly: DataFrame, outcomes: DataFrame, per_tick: int = 25, tick_s: float = 900.0) -> DataFrame:
    """One row on whether a memory is fed and used.

    sessions(session_id, source, finished, closed, facts, lag_s), weekly(week, recall) with the current week,
    outcomes(live, superseded) of one row. Rates are 0 where there is nothing to divide by; L1 asks for
    coverage and a low median lag, L2 for recalls this week that are no fewer than in the one before.
    """
    done = sessions.where("finished")
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    n, closed, full = F.count(F.lit(1)), F.count_if("closed"), F.count_if(F.col("closed") & (F.col("facts") > 0))
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY lag_s)")
    one = done.agg(
        n.alias("finished"), closed.alias("closed"), rate(closed, n).alias("coverage"), full.alias("distilled"), rate(full, closed).alias("yield"),
        (n - closed).alias("backlog"), F.round(F.ceil((n - closed) / per_tick) * tick_s / 3600, 1).alias("drain_eta_h"), disc(0.5).alias("lag_p50_s"), disc(0.95).alias("lag_p95_s"),
    )
    last = weekly.agg(F.max_by(F.struct("recall"), "week").alias("now"), F.max("week").alias("week"))
    before = weekly.join(F.broadcast(last.select(F.col("week").alias("_w"))), F.col("week") < F.col("_w")).agg(F.max_by("recall", "week").alias("was"))  # one row
    used = last.select(F.col("now.recall").alias("recall_week")).crossJoin(F.broadcast(before))  # of one row each
    out = one.crossJoin(F.broadcast(used)).crossJoin(F.broadcast(outcomes.limit(1)))
    met = lambda c: F.when(F.coalesce(c, F.lit(False)), "met").otherwise("not_met")
    retold = rate(F.col("superseded"), F.col("live") + F.col("superseded"))
    return out.select(
        *one.columns, "recall_week", retold.alias("supersession_rate"), met((F.col("live") > 0) & (F.col("finished") > 0)).alias("L0"),
        met((F.col("coverage") >= TARGET_COVERAGE) & (F.col("lag_p50_s") < TARGET_LAG_S)).alias("L1"),
        met((F.col("recall_week") > 0) & (F.col("was").isNull() | (F.col("recall_week") >= F.col("was")))).alias("L2"),
        F.when(retold == 0, "not_met").otherwise("not_measurable").alias("L3"),
    )


def accuracy_pivot(results: DataFrame, systems: list[str]) -> DataFrame:
    return results.groupBy("cat").pivot("system", systems).agg(F.round(F.avg(F.col("ok").cast("double")), 6))


def paired(results: DataFrame, a: str, b: str) -> DataFrame:
    """Questions that both systems have a verdict for."""
    x = results.where((F.col("system") == a) & F.col("ok").isNotNull()).select("qid", F.col("ok").alias("a"))
    y = results.where((F.col("system") == b) & F.col("ok").isNotNull()).select("qid", F.col("ok").alias("b"))
    return x.join(y, "qid")


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
        F.count_if(F.col("a") | F.col("b")).alias("any_right"),
    )


def mcnemar(table: DataFrame) -> DataFrame:
    """chi2 with continuity correction and the exact two-sided p of the discordant counts, in log space."""
    b, c = F.col("only_a"), F.col("only_b")
    n = b + c
    log_sum = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    log_choose = lambda i: log_sum(n) - log_sum(i) - log_sum(n - i)
    tail = F.aggregate(F.sequence(F.lit(0), F.least(b, c).cast("int")), F.lit(0.0), lambda s, i: s + F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    exact = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
    chi2 = F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, 2) / n)
    return table.withColumns({"chi2": F.round(chi2, 9), "p_exact": F.round(exact, 9)})


def bootstrap_gap(pairs: DataFrame, samples: int = 20000, seed: int = 20260605, tasks: int = 16) -> tuple[float, float]:
    """95 % interval of the gap in accuracy over resampled questions.

    A resample depends on the counts of the four outcomes only, so tasks draw from a
    multinomial of those and not from the questions.
    """
    g = agreement(pairs).first()
    n = g["n"]
    if not n:
        return 0.0, 0.0
    odds = [g["only_a"] / n, g["only_b"] / n, (g["both"] + g["neither"]) / n]

    def draw(parts):
        for p in parts:
            for part, k in zip(p["id"], p["k"], strict=True):
                x = np.random.default_rng([seed, int(part)]).multinomial(n, odds, int(k))
                yield pd.DataFrame({"gap": (x[:, 0] - x[:, 1]) / n})

    spark = pairs.sparkSession
    todo = spark.range(0, tasks, numPartitions=tasks).withColumn("k", F.lit(samples // tasks))
    lo, hi = todo.mapInPandas(draw, "gap double").agg(F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).first()["q"]
    return float(lo), float(hi)


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, hit, recall): ranked(qid, id, rank) against gold(qid, id)."""
    need = gold.groupBy("qid").agg(F.collect_set("id").alias("need"))
    got = ranked.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias("got"))
    both = need.join(got, "qid", "left").withColumn("n", F.size(F.array_intersect("need", F.coalesce("got", F.expr("cast(array() as array<bigint>)")))))
    return both.select("qid", *hit_and_recall(F.col("n"), F.size("need")))


def hit_and_recall(n: Column, need: Column) -> list[Column]:
    return [(n > 0).cast("int").alias("hit"), (n / need).alias("recall")]


def percentiles(rows: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """Three rules: nearest rank rounded half to even, rounded half up, and by ceiling.

    Equal values are counted first; a running count over the distinct ones finds the places.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    seen = counts.withColumns({"_n": F.sum("_c").over(w), "_to": upto})
    n = F.col("_n")
    places = {"nearest_even": F.rint(q * (n - 1)), "nearest_up": F.floor(q * (n - 1) + 0.5), "ceiling": F.ceil(q * n) - 1}
    at = lambda i: F.greatest(F.lit(0), F.least(n - 1, i.cast("long")))
    hit = lambda i: (at(i) < F.col("_to")) & (at(i) >= F.col("_to") - F.col("_c"))
    return seen.groupBy(*by).agg(*[F.max(F.when(hit(i), F.col(value))).alias(name) for name, i in places.items()])


def validate(results: DataFrame, expected: int | None = None) -> DataFrame:
    """(problem, n): duplicate questions, missing verdicts, wrong row counts."""
    dup = results.groupBy("qid", "system").agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_qid").alias("problem"), "n")
    gap = results.where("ok IS NULL AND err IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_verdict").alias("problem"), "n")
    out = dup.unionByName(gap)
    if expected is not None:
        rows = results.agg(F.abs(F.countDistinct("qid") - expected).alias("n")).select(F.lit("row_count").alias("problem"), "n")
        out = out.unionByName(rows)
    return out.where("n > 0")


def majority(votes: DataFrame) -> DataFrame:
    """(qid, answer): the most frequent answer, of equals the one seen first, in its longest spelling."""
    norm = F.trim(F.regexp_replace(F.lower("answer"), "[^a-z0-9 ]", ""))
    g = votes.withColumn("_k", norm).groupBy("qid", "_k").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("s"), F.max_by("answer", F.struct(F.length("answer"), -F.col("seq"))).alias("a"))
    return g.groupBy("qid").agg(F.max_by("a", F.struct("n", -F.col("s"))).alias("answer"))


def failed_questions(results: DataFrame, system: str) -> DataFrame:
    return results.where((F.col("system") == system) & (F.col("ok") == False)).select("qid").distinct()  # noqa: E712


def fused_heads(ranked: DataFrame, grid: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(grid_id, qid, id, rank): the first k of each weighting; ``grid`` (grid_id, signal, weight) is small and joined by signal."""
    fused = ranked.join(F.broadcast(grid), "signal").groupBy("grid_id", "qid", "id").agg(F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("s"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("grid_id", "qid").orderBy(F.desc("s"), "id"))).where(F.col("rank") <= k).drop("s")


def head_depth(weights: list[float], k: int, rrf_k: int = 60) -> int:
    """How many of each signal's first rows hold the first k of the fusion: the k first of the heaviest signal have at
    least its weight / (rrf_k + k), and what is in no head has less. Every signal ranks every row."""
    return math.floor(sum(weights) * (rrf_k + k) / max(weights)) - rrf_k


def mean_recall(hits: DataFrame, need: DataFrame) -> DataFrame:
    """(grid_id, recall): hits(grid_id, qid, n) of need(qid, need), 0 for questions without hits."""
    questions = need.agg(F.count(F.lit(1)).alias("q"))
    each = hits.join(need, "qid").groupBy("grid_id").agg(F.sum(F.col("n") / F.col("need")).alias("s"))
    return each.crossJoin(F.broadcast(questions)).select("grid_id", F.round(F.col("s") / F.col("q"), 9).alias("recall"))


def weight_grid(ranked: DataFrame, grid: DataFrame, gold: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Mean recall of each weighting."""
    hits = fused_heads(ranked, grid, k, rrf_k).join(gold, ["qid", "id"]).groupBy("grid_id", "qid").agg(F.count(F.lit(1)).alias("n"))
    return mean_recall(hits, gold.groupBy("qid").agg(F.count(F.lit(1)).alias("need")))


def weekly_counts(calls: DataFrame) -> DataFrame:
    """Tool calls per ISO week, each call id once: calls(call_id, ts, tool)."""
    one = calls.dropDuplicates(["call_id"])
    week = F.concat_ws("-W", F.expr("extract(YEAROFWEEK FROM ts)"), F.lpad(F.weekofyear("ts"), 2, "0"))
    return one.groupBy(week.alias("week"), "tool").agg(F.count(F.lit(1)).alias("calls"))


def regression(runs: DataFrame) -> DataFrame:
    """Runs with what got worse than the run before of the same window: coverage by five points,
    lag doubled, a lower rung, or recall gone from the week."""
    w = W.partitionBy("window_days").orderBy("run_id")
    prev = lambda c: F.lag(c).over(w)
    bad = F.filter(
        F.array(
            F.when(F.col("coverage") < prev("coverage") - 5, F.lit("coverage")),
            F.when(F.col("lag_s") > 2 * prev("lag_s"), F.lit("lag")),
            F.when(F.col("rung") < prev("rung"), F.lit("rung")),
            F.when((F.col("recall_week") == 0) & (prev("recall_week") > 0), F.lit("recall")),
        ),
        lambda x: x.isNotNull(),
    )
    return runs.withColumn("worse", bad)
