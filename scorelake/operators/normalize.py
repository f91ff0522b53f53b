"""Scores of any metric to 0..100 with a confidence.

Facts: score_id, model_name, leaderboard, category, benchmark, metric, value, higher_is_better, scraped_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.scalars import cascade, contains_any
from scorelake.operators.ordered import GATHERED, order_statistics, usable


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """c within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def detect_score_type(value: Column, metric: Column, benchmark: Column, leaderboard: Column) -> Column:
    """struct(type, confidence) from words anywhere in the three names, then from the value's range."""
    text = F.lower(F.concat_ws(" ", metric, benchmark, leaderboard))
    kind = lambda t, c: F.struct(F.lit(t).alias("type"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    sure = lambda low, high, a, b: F.when(value.between(low, high), a).otherwise(b)
    unit = value.between(0, 1)
    return cascade(
        [
            (contains_any(text, ("elo", "rating", "arena", "rank")), kind("elo_rating", sure(800, 1600, 0.95, 0.7))),
            (contains_any(text, ("cost", "price", "dollar", "$")), kind("cost_metric", 0.9)),
            (contains_any(text, ("time", "latency", "seconds", "speed")), kind("time_metric", 0.9)),
            (contains_any(text, ("token", "length", "count")), kind("token_count", 0.85)),
            (contains_any(text, ("accuracy", "pass", "rate", "percent")), kind("percentage", sure(0, 100, 0.95, 0.7))),
            (unit & (F.lower(leaderboard).contains("helm") | text.contains("academic")), kind("academic_score", 0.9)),
            (unit, kind("decimal_score", 0.8)),
            (value.between(0, 100), kind("percentage", 0.6)),
        ],
        kind("unknown", 0.3),
    )


#: Rating range of each domain.
ELO_RANGES = {"math": (1200.0, 1450.0), "coding": (1150.0, 1400.0), "general": (1100.0, 1450.0)}


def elo_domain(category: Column, leaderboard: Column) -> Column:
    text = F.lower(F.concat_ws(" ", category, leaderboard))
    return cascade([(text.contains("math"), "math"), (text.contains("cod") | text.contains("programming"), "coding")], "general")


def _pair(score: Column, confidence: Column | float) -> Column:
    return F.struct(score.alias("score"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))


def norm_elo(value: Column, domain: Column) -> Column:
    low = cascade([(domain == d, r[0]) for d, r in ELO_RANGES.items()], ELO_RANGES["general"][0])
    high = cascade([(domain == d, r[1]) for d, r in ELO_RANGES.items()], ELO_RANGES["general"][1])
    sure = cascade([(value.between(low, high), 0.95), (value.between(low - 100, high + 100), 0.8)], 0.6)
    return _pair(clamp((value - low) / (high - low) * 100), sure)


def norm_percentage(value: Column) -> Column:
    return _pair(clamp(value), F.when(value.between(0, 100), 0.95).otherwise(0.7))


def norm_academic(value: Column) -> Column:
    return _pair(clamp(value * 100), F.when(value.between(0, 1), 0.95).otherwise(0.6))


def norm_cost(value: Column) -> Column:
    """Free is 100, a dollar 0, on a logarithmic scale between a tenth of a cent and a dollar."""
    return _pair(cascade([(value.isNull(), F.lit(None).cast("double")), (value <= 0, 100.0), (value >= 1, 0.0)], F.lit(100.0) * F.log(F.lit(1.0) / F.greatest(value, F.lit(0.001))) / F.log(F.lit(1000.0))), 0.85)


def norm_time(value: Column) -> Column:
    return _pair(cascade([(value <= 0.1, 100.0), (value >= 60, 0.0)], (1 - value / 60) * 100), 0.85)


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with c, computed once a row however often it is used: generated, so neither is it copied into its uses nor are filters on it moved
    below."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def normalize_scores(facts: DataFrame) -> DataFrame:
    """facts with normalized_value, confidence_score (the lower of detection's and algorithm's) and normalization_method."""
    v = F.col("value")
    domain = elo_domain(F.col("category"), F.col("leaderboard"))
    df = once(facts, "_found", F.struct(detect_score_type(v, F.col("metric"), F.col("benchmark"), F.col("leaderboard")).alias("kind"), domain.alias("domain")))
    kind = F.col("_found.kind.type")
    other = F.when(v.between(0, 100), norm_percentage(v)).otherwise(_pair(clamp(v), 0.3))
    done = cascade(
        [
            (kind == "elo_rating", norm_elo(v, F.col("_found.domain"))),
            (kind == "percentage", norm_percentage(v)),
            (kind.isin("academic_score", "decimal_score"), norm_academic(v)),
            (kind == "cost_metric", norm_cost(v)),
            (kind == "time_metric", norm_time(v)),
        ],
        other,
    )
    method = F.when(kind.isin("token_count", "unknown"), F.when(v.between(0, 100), "percentage").otherwise("fallback_clamp")).otherwise(kind)
    df = once(df, "_done", F.struct(done.alias("pair"), method.alias("method")))
    return df.select(*(F.col(f"`{c}`") for c in facts.columns), F.col("_done.pair.score").alias("normalized_value"), F.least("_done.pair.confidence", "_found.kind.confidence").alias("confidence_score"), F.col("_done.method").alias("normalization_method"))


def normalize_new(facts: DataFrame, existing: DataFrame, key: str = "score_id") -> DataFrame:
    """Only facts that have no normalised row yet."""
    return normalize_scores(facts.join(existing.select(key), key, "left_anti"))


def normalize_report(facts: DataFrame, existing: DataFrame, key: str = "score_id") -> DataFrame:
    """One row on an incremental run: facts in all, those that had a row, those processed, those of them that failed (no value, so no
    normalised one), and the mean confidence of the others."""
    new = normalize_new(facts, existing, key)
    ok = F.col("normalized_value").isNotNull()
    return facts.agg(F.count("*").alias("total")).crossJoin(new.agg(F.count("*").alias("processed"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col("confidence_score"))).alias("avg_confidence"))).select(
        "total", (F.col("total") - F.col("processed")).alias("skipped"), (F.col("processed") - F.col("failed")).alias("processed"), "failed", "avg_confidence"
    )  # one row each


def normalization_stats(norm: DataFrame) -> DataFrame:
    """One row: counts and confidence levels."""
    c = F.col("confidence_score")
    part = lambda cond, name: [F.count_if(cond).alias(name), F.round(F.count_if(cond) * 100 / F.count("*"), 2).alias(f"{name}_pct")]
    return norm.agg(
        F.count("*").alias("total"), F.round(F.avg(c), 6).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
        *part(c >= 0.9, "high"), *part((c >= 0.7) & (c < 0.9), "medium"), *part(c < 0.7, "low"),
    )


def method_histogram(norm: DataFrame) -> DataFrame:
    return norm.groupBy("normalization_method").agg(F.count("*").alias("n"))


def validate_normalization(norm: DataFrame) -> DataFrame:
    """One row: violations over all rows and a quality of 0..1."""
    n, c, v = F.col("normalized_value"), F.col("confidence_score"), F.col("value")
    out = norm.agg(F.count("*").alias("total"), F.count_if((n < 0) | (n > 100)).alias("range_violations"), F.count_if(c < 0.5).alias("low_confidence"), F.count_if((v == n) & (v > 100)).alias("suspicious"), F.avg(c).alias("mean"))
    share = lambda k: F.col(k) / F.col("total")
    quality = clamp(F.col("mean") - 0.3 * share("range_violations") - 0.2 * share("low_confidence") - 0.2 * share("suspicious"), 0.0, 1.0)
    return out.select("total", "range_violations", "low_confidence", "suspicious", F.round("mean", 6).alias("avg_confidence"), F.round(quality, 6).alias("quality"))


def distribution_confidence(norm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: mean detection confidence, lowered by spread and by the share of outliers."""
    flagged = flag_outliers(norm, keys, "normalized_value")
    g = flagged.groupBy(*keys).agg(F.avg("confidence_score").alias("d"), F.coalesce(F.stddev_samp("normalized_value"), F.lit(0.0)).alias("sd"), F.avg("normalized_value").alias("mean"), F.avg(F.col("is_outlier").cast("double")).alias("out"))
    spread = F.greatest(F.lit(0.5), 1 - F.col("sd") / F.greatest("mean", F.lit(1.0)))
    return g.select(*keys, F.round(clamp(F.col("d") * spread * (1 - F.col("out")), 0.1, 1.0), 6).alias("confidence"))


def quartiles(df: DataFrame, keys: Sequence[str], col: str, gathered: int = GATHERED) -> DataFrame:
    """keys, n, q1 and q3: the values at the places n/4 and 3n/4 in order, exact, over values that are neither null nor NaN."""
    return order_statistics(df, keys, col, {"q1": lambda n: n / 4, "q3": lambda n: n * 3 / 4}, gathered)


def flag_outliers(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """df with is_outlier: outside 1.5 interquartile ranges, the quartiles being the values at places n/4 and 3n/4 in order; groups of
    fewer than four values have none, nor are nulls and NaN. A key's rows never meet in one task: see order_statistics; the result has a row a
    key and is joined."""
    q = quartiles(df, keys, col).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("n").alias("_n"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    both = df.join(q, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    iqr = (F.col("_q3") - F.col("_q1")) * 1.5
    out = (F.col("_n") >= 4) & usable(F.col(col)) & ((F.col(col) < F.col("_q1") - iqr) | (F.col(col) > F.col("_q3") + iqr))
    return both.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(out, F.lit(False)).alias("is_outlier"))


#: The listed metrics' ranges. (All others have 0 to 100, but for those named after ratings.)
RANGES = {
    "elo_rating": (800.0, 1400.0),
    "daily_requests": (0.0, 500000.0),
    "hallucination_rate": (0.0, 20.0),
    "accuracy": (0.0, 100.0),
    "pass@1": (0.0, 100.0),
    "win_rate": (0.0, 100.0),
    "composite_score": (0.0, 100.0),
    "eq_score": (0.0, 100.0),
    "average": (0.0, 100.0),
    "humaneval": (0.0, 100.0),
    "humaneval_pass@1": (0.0, 100.0),
    "mbpp": (0.0, 100.0),
    "mbpp_pass@1": (0.0, 100.0),
    "apps": (0.0, 100.0),
    "humaneval+": (0.0, 100.0),
    "mbpp+": (0.0, 100.0),
    "multipl-e": (0.0, 100.0),
    "pass_rate": (0.0, 100.0),
    "gsm8k": (0.0, 100.0),
    "math": (0.0, 100.0),
    "aime_2024": (0.0, 100.0),
    "gpqa_diamond": (0.0, 100.0),
    "mmlu": (0.0, 100.0),
    "arc": (0.0, 100.0),
    "arc_challenge": (0.0, 100.0),
    "hellaswag": (0.0, 100.0),
    "truthfulqa": (0.0, 100.0),
    "winogrande": (0.0, 100.0),
    "medqa": (0.0, 100.0),
    "medmcqa": (0.0, 100.0),
    "pubmedqa": (0.0, 100.0),
    "mmlu_medical": (0.0, 100.0),
    "legalbench": (0.0, 100.0),
    "bar_exam": (0.0, 100.0),
    "finqa": (0.0, 100.0),
    "financial_sentiment": (0.0, 100.0),
    "multilingual_mmlu": (0.0, 100.0),
    "xquad": (0.0, 100.0),
    "c_eval": (0.0, 100.0),
    "mt_bench": (0.0, 10.0),
    "bigbench_hard": (0.0, 100.0),
    "eq_bench": (0.0, 100.0),
    "klu_index": (0.0, 100.0),
    "tokens_served": (0.0, 1e11),
    "usage_percentage": (0.0, 100.0),
    "cost_per_token": (0.0, 0.1),
}
#: Metrics of which less is better, whatever the fact says.
LOWER_IS_BETTER = ("hallucination_rate", "perplexity", "loss", "error")


def normalize_by_range(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """facts with range_value: the place in the metric's range (metric, lo, hi), inverted where less is better."""
    m = F.lower("metric")
    both = facts.join(ranges.select(F.lower("metric").alias("_m"), "lo", "hi"), m == F.col("_m"), "left")
    rated = m.contains("elo") | m.contains("rating")
    lo = F.coalesce("lo", F.when(rated, 800.0).otherwise(0.0))
    hi = F.coalesce("hi", F.when(rated, 1400.0).otherwise(100.0))
    raw = F.when(hi > lo, (F.col("value") - lo) / (hi - lo) * 100).otherwise(F.col("value"))
    return both.select(*facts.columns, clamp(F.when(~F.col("higher_is_better") | m.isin(*LOWER_IS_BETTER), 100 - raw).otherwise(raw)).alias("range_value"))


def normalize_simple(value: Column, metric: Column, source: Column) -> Column:
    """The rule of the update job: ratings by their range, percentages clamped, unit maths scores scaled, all else clamped."""
    m = F.lower(metric)
    rated = (F.lower(source).contains("arena") | m.contains("score")) & value.between(800, 1600)
    return cascade(
        [(rated, clamp((value - 800) / 8)), (contains_any(metric, ("accuracy", "percent", "%", "rate")), clamp(value)), (m.contains("math") & value.between(0, 1), value * 100), (value.between(0, 100), value)],
        clamp(value),
    )


def normalize_job(value: Column, metric: Column, variant: str = "simple") -> Column:
    """Rules of single jobs: context lengths against 128000, costs against 100; the other variant clamps, and doubles the hardest exam."""
    m = F.lower(metric)
    if variant == "simple":
        return cascade([(m == "context_length", clamp(value / 128000 * 100)), (m.contains("cost"), clamp(100 - value))], value)
    return cascade([(m == "humanity_last_exam", clamp(value * 2))], clamp(value))


def z_score(df: DataFrame, keys: Sequence[str], col: str, higher: Column) -> DataFrame:
    """df with z, signed so that better is higher; 0 where a group has no spread. Means and deviations are aggregated, a row a group, and
    joined, so rows aren't moved where the groups are few."""
    g = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.avg(col).alias("_m"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("_sd"))
    both = df.join(g, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    d = F.when(higher, F.col(col) - F.col("_m")).otherwise(F.col("_m") - F.col(col))
    return both.select(*(F.col(f"`{c}`") for c in df.columns), F.when(F.col("_sd") == 0, 0.0).otherwise(d / F.nullif("_sd", F.lit(0.0))).alias("z"))


def z_composite(df: DataFrame) -> DataFrame:
    """Per model: the mean over categories of the mean z."""
    return df.groupBy("model_name", "category").agg(F.avg("z").alias("c")).groupBy("model_name").agg(F.avg("c").alias("composite"))
