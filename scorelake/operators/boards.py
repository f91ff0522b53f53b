"""Leaderboards, rankings, summaries and upserts over score facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.scalars import cascade, ellipsize, fix_known_name, is_artifact_name, is_usable_entry, round_exact
from scorelake.operators.normalize import normalize_by_range
from scorelake.sources.shared import stored


def top_n(df: DataFrame, keys: Sequence[str], score: str, n: int, tie: str = "model_name", ascending: bool = False) -> DataFrame:
    """The n best rows of each key, with their rank. Spark limits each group before the shuffle."""
    order = F.asc(score) if ascending else F.desc(score)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie)).cast("long")).where(F.col("rank") <= n)


def latest(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The value of the latest scrape of each key; of equals the highest score_id."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct("scraped_at", "score_id")).alias(value))


def model_benchmarks(facts: DataFrame, model: str, category: str | None = None) -> DataFrame:
    """All facts of a model, or of those of one category, in order of category and benchmark."""
    df = facts.where(F.col("model_name") == model)
    df = df if category is None else df.where(F.col("category") == category)
    return df.orderBy("category", "benchmark", "score_id")


#: Page names of categories.
CATEGORY_SLUGS = {"coding": "software_engineering", "research": "academic", "general": "comprehensive"}


def category_breakdown(norm: DataFrame, category: str, n: int) -> DataFrame:
    """The n best models of a category by the mean of their benchmarks' latest values, with a map of them."""
    df = norm.where(F.col("category") == CATEGORY_SLUGS.get(category, category))
    one = latest(df, ["model_name", "benchmark"], "normalized_value")
    entry = F.struct("benchmark", F.round("normalized_value", 4).alias("v"))
    g = one.groupBy("model_name").agg(F.round(F.avg("normalized_value"), 4).alias("average"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("benchmarks"))
    return g.orderBy(F.desc("average"), "model_name").limit(n)


#: Parts of a leaderboard's name and the column of a coding board that they stand for, in order of trial.
CODING_KEYS = {
    "Aider": "Aider.chat",
    "SWE-Bench": "SWE-Bench",
    "BigCode": "BigCode",
    "EvalPlus": "EvalPlus",
    "Can-AI-Code": "Can-AI-Code",
    "Convex": "Convex",
    "LiveBench": "LiveBench",
    "LM Arena WebDev": "LM Arena WebDev",
    "ProllM": "ProllM StackEval",
    "StackEval": "ProllM StackEval",
    "CruxEval": "CruxEval",
    "ClassEval": "ClassEval",
    "CodeTLingua": "CodeTLingua",
    "DS-1000": "DS-1000",
    "DS1000": "DS-1000",
    "EvoEval": "EvoEval",
    "TabbyML": "TabbyML",
}


def coding_leaderboard(old: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """Two sources as one board: file-like names dropped, and of the second also known mistakes and scores of 0; known typos mended, one value a
    board and model, their mean, the n best."""
    old = old.where(~is_artifact_name(F.col("model_name")))
    new = new.where(is_usable_entry(F.col("model_name"), F.col("normalized_value")))
    kept = old.unionByName(new, allowMissingColumns=True).withColumn("model_name", fix_known_name(F.col("model_name"))).where("model_name is not null")
    board, metric = F.col("leaderboard"), F.lower("benchmark")
    plus = cascade([(metric.contains("humaneval"), "HumanEval"), (metric.contains("mbpp"), "MBPP")], "EvalPlus")
    key = cascade([(board.contains(k), plus if v == "EvalPlus" else v) for k, v in CODING_KEYS.items()], F.when(F.lower(board).contains("lmarena"), "LM Arena WebDev").otherwise(F.col("benchmark")))
    one = latest(kept.withColumn("key", key), ["model_name", "key"], "normalized_value")
    g = one.groupBy("model_name").agg(F.round(F.avg("normalized_value"), 4).alias("average_score"), F.count("*").alias("n_benchmarks"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))
    return g.orderBy(F.desc("average_score"), "model_name").limit(n)


def upsert_latest(current: DataFrame, batch: DataFrame, newest: bool = False) -> DataFrame:
    """Current state by model and benchmark, with the batch's latest values put in; is_new marks keys that weren't there. With `newest` a value
    that is older than the current one is left out, so batches may come in any order."""
    keys = ["model_name", "benchmark"]
    inner = batch.groupBy(*keys).agg(F.max_by(F.struct("value", F.col("scraped_at").alias("updated_at")), F.struct("scraped_at", "score_id")).alias("b"))
    both = current.select(*keys, F.struct("value", "updated_at").alias("c")).join(inner, keys, "full_outer")
    stays = F.col("b").isNull() | (F.lit(newest) & F.coalesce(F.col("c.updated_at") > F.col("b.updated_at"), F.lit(False)))
    won = F.when(stays, F.col("c")).otherwise(F.col("b"))
    return both.select(*keys, won.alias("w"), F.col("c").isNull().alias("is_new")).select(*keys, "w.value", "w.updated_at", "is_new")


def model_table(facts: DataFrame, ranges: DataFrame, categories: Sequence[str], n: int | None = 100) -> DataFrame:
    """Ranked models: mean range-normalised score, adjusted for how many scores and categories it rests on, and a mean a category."""
    df = normalize_by_range(facts, ranges)
    g = df.groupBy("model_name").agg(F.avg("range_value").alias("_base"), F.count("*").alias("n_scores"), F.countDistinct("category").alias("n_categories"), *(F.round(F.avg(F.when(F.col("category") == c, F.col("range_value"))), 2).alias(c) for c in categories))
    few = cascade([(F.col("n_scores") < 10, 0.8 + F.col("n_scores") / 50), (F.col("n_scores") >= 20, 1 + F.least(F.lit(0.05), (F.col("n_scores") - 20) / 200))], 1.0)
    score = F.least(F.lit(100.0), F.col("_base") * few * (1 + F.least(F.lit(0.05), F.col("n_categories") / 20)))
    out = g.select("model_name", F.round(score, 2).alias("score"), "n_scores", "n_categories", *categories)
    out = out.orderBy(F.desc("score"), "model_name")
    return with_rank(out if n is None else out.limit(n), "score")


def with_rank(df: DataFrame, score: str, tie: str = "model_name") -> DataFrame:
    """df with its rank over all rows. For results whose size a limit bounds; large ones use global_rank."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), tie)).cast("long"))


def global_rank(df: DataFrame, score: str, tie: str = "model_name", keys: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """df with its rank over all rows, or over those of each key, however many: range-sorted over all tasks and written once, numbered in each
    part, and the parts' sizes summed up. Only a count a part and key goes through one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.asc(score) if ascending else F.desc(score), F.asc(tie)]
    part = stored(df.repartitionByRange(n, *(F.asc(k) for k in keys), *own).withColumn("_p", F.spark_partition_id()), "ranked")
    inside = F.row_number().over(W.partitionBy("_p", *keys).orderBy(*own))
    sums = part.groupBy("_p", *keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = sums.select(F.col("_p").alias("_q"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), before.alias("_first"))
    on = [F.col("_p") == F.col("_q"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    return part.withColumn("_in", inside).join(first, on).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_first") + F.col("_in")).alias("rank"))


def model_detail(facts: DataFrame, ranges: DataFrame, categories: Sequence[str], model: str) -> DataFrame:
    """A model's facts with their range-normalised values, its plain mean, and its rank if it is among the best 100."""
    own = normalize_by_range(facts.where(F.col("model_name") == model), ranges)
    mean = own.agg(F.round(F.avg("range_value"), 2).alias("mean_score"))
    rank = model_table(facts, ranges, categories).where(F.col("model_name") == model).select("rank")
    return own.select("model_name", "benchmark", "metric", "value", F.round("range_value", 4).alias("range_value"), "score_id").crossJoin(mean).join(rank, F.lit(True), "left")


def model_table_v2(scores: DataFrame) -> DataFrame:
    """Models by their stored overall composite, else the mean of their category composites, else the mean of their values (0 as missing)."""
    b, v = F.col("benchmark"), F.coalesce(F.nullif("normalized_value", F.lit(0.0)), F.col("value"))
    overall, part = b == "overall_composite", b.endswith("_composite") & (b != "overall_composite")
    g = scores.groupBy("model_name").agg(F.max(F.when(overall, v)).alias("o"), F.avg(F.when(part, v)).alias("c"), F.avg(F.when(~overall & ~part, v)).alias("m"), F.count_if(~overall & ~part).alias("n_scores"))
    return g.select("model_name", F.round(F.coalesce("o", "c", "m"), 4).alias("score"), "n_scores")


def category_list(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.countDistinct("benchmark").alias("n_benchmarks")).select("category", F.initcap(F.translate("category", "_", " ")).alias("title"), "n_benchmarks")


def quality_level(confidence: Column) -> Column:
    return cascade([(confidence >= 0.9, "HIGH"), (confidence >= 0.7, "MEDIUM")], "LOW")


def normalized_models(norm: DataFrame, n: int) -> DataFrame:
    """The n best models by mean normalised score, with rank, quality level and latest update."""
    g = norm.groupBy("model_name").agg(F.count("*").alias("n_scores"), F.round(F.avg("normalized_value"), 4).alias("avg_score"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence"), F.max("scraped_at").alias("last_update"))
    top = g.withColumn("quality", quality_level(F.col("avg_confidence"))).orderBy(F.desc("avg_score"), "model_name").limit(n)
    return with_rank(top, "avg_score")


def model_quality(norm: DataFrame) -> DataFrame:
    """Per model: mean confidence, lowered by the share of doubtful scores, raised a little by their number; 0..1."""
    c = F.col("confidence_score")
    q = F.avg(c) - 0.2 * F.avg((c < 0.7).cast("double")) + F.least(F.lit(0.1), F.count("*") / 100)
    return norm.groupBy("model_name").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 6).alias("quality"))


def win_rates(battles: DataFrame, min_battles: int = 50) -> DataFrame:
    """Per model: battles, wins and win rate; a tie counts as a battle only. Both sides come from one row, so no self-join."""
    side = F.explode(F.array(F.struct(F.col("model_a").alias("model_name"), (F.col("winner") == "model_a").alias("won")), F.struct(F.col("model_b").alias("model_name"), (F.col("winner") == "model_b").alias("won"))))
    g = battles.select(side.alias("s")).select("s.*").groupBy("model_name").agg(F.count("*").alias("battles"), F.count_if("won").alias("wins"))
    return g.where(F.col("battles") >= min_battles).withColumn("win_rate", F.round(F.col("wins") * 100 / F.col("battles"), 4))


def category_overview(facts: DataFrame) -> DataFrame:
    """Per category: rows, and the best model and score."""
    return facts.groupBy("category").agg(F.count("*").alias("n"), F.max_by("model_name", F.struct("value", F.col("score_id") * -1)).alias("top_model"), F.max("value").alias("top_score"))


def cross_category(facts: DataFrame, min_cats: int, n: int) -> DataFrame:
    """Models of many categories: mean score, and the category, score and rank where they rank best."""
    best = facts.groupBy("category", "model_name").agg(F.max("value").alias("score"))
    ranked = global_rank(best, "score", keys=["category"])
    g = ranked.groupBy("model_name").agg(F.count("*").alias("n_categories"), F.round(F.avg("score"), 4).alias("avg_score"), F.min(F.struct("rank", "category", "score")).alias("b"))
    kept = g.where(F.col("n_categories") >= min_cats).select("model_name", "n_categories", "avg_score", F.col("b.category").alias("best_category"), F.col("b.rank").cast("long").alias("best_rank"), F.col("b.score").alias("best_score"))
    return kept.orderBy(F.desc("avg_score"), "model_name").limit(n)


def summary(facts: DataFrame) -> DataFrame:
    """One row of totals, and the model of most categories (of equals the one of the higher mean, then the first by name), with their number."""
    per = facts.groupBy("model_name").agg(F.countDistinct("category").alias("c"), F.avg("value").alias("v"))
    most = per.orderBy(F.desc("c"), F.desc("v"), "model_name").limit(1).select(F.col("model_name").alias("most_comprehensive"), F.col("c").alias("most_categories"))
    return totals(facts).join(most, F.lit(True), "left")  # one row each


def totals(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("models"), F.countDistinct("category").alias("categories"), F.countDistinct("benchmark").alias("benchmarks"))


def top_by_group(df: DataFrame, key: str, score: str = "value") -> DataFrame:
    return df.groupBy(key).agg(F.max_by("model_name", F.struct(score, F.col("score_id") * -1)).alias("model_name"), F.max(score).alias("score"), F.count("*").alias("n"))


#: Bounds of rating tiers and of bands of a histogram, in order.
RATING_TIERS = (("Elite (1400+)", 1400.0), ("High (1350-1399)", 1350.0), ("Good (1300-1349)", 1300.0), ("Average (1200-1299)", 1200.0))
RATING_BANDS = (("1400+", 1400.0), ("1300-1399", 1300.0), ("1200-1299", 1200.0), ("1100-1199", 1100.0), ("1000-1099", 1000.0))


def tier_of(score: Column, bounds: Sequence[tuple[str, float]], default: str) -> Column:
    """The first tier whose bound the score reaches."""
    return cascade([(score >= b, t) for t, b in bounds], default)


def score_tiers(df: DataFrame, bounds: Sequence[tuple[str, float]], score: str = "value", default: str = "other") -> DataFrame:
    """Rows by tier: their number and mean."""
    return df.groupBy(tier_of(F.col(score), bounds, default).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("avg_score"))


def top_of_tiers(df: DataFrame, bounds: Sequence[tuple[str, float]], n: int = 3, score: str = "value", default: str = "other", tie: str = "model_name") -> DataFrame:
    """The n best rows of each tier, with their rank in it."""
    return top_n(df.withColumn("tier", tier_of(F.col(score), bounds, default)), ["tier"], score, n, tie)


def score_histogram(df: DataFrame, bounds: Sequence[tuple[str, float]] = RATING_BANDS, score: str = "value", default: str = "Below 1000") -> DataFrame:
    """Rows in each band, those without a row too, in the bands' order."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, t) for i, (t, _) in enumerate([*bounds, (default, 0.0)])], "place int, band string")
    g = df.where(F.col(score).isNotNull()).groupBy(tier_of(F.col(score), bounds, default).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(g, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n"))


#: A category's difficulty by its mean rating.
DIFFICULTY = (("Easy", 1380.0), ("Medium", 1320.0), ("Hard", 1260.0))


def category_difficulty(facts: DataFrame) -> DataFrame:
    g = facts.groupBy("category").agg(F.round(F.avg("value"), 4).alias("avg_score"), F.max("value").alias("max_score"), F.min("value").alias("min_score"), F.count("*").alias("n"))
    return g.withColumn("difficulty", cascade([(F.col("avg_score") >= b, t) for t, b in DIFFICULTY], "Very Hard"))


def verify_load(facts: DataFrame, leaderboard: str, benchmark: str | None = None) -> DataFrame:
    """Counts of one leaderboard's rows: in all, models, benchmarks, scores a model, and those of a sample benchmark."""
    one = F.count_if(F.col("benchmark") == benchmark) if benchmark is not None else F.lit(0)
    return facts.where(F.col("leaderboard") == leaderboard).agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("models"), F.countDistinct("benchmark").alias("benchmarks"), F.round(F.count("*") / F.countDistinct("model_name"), 4).alias("per_model"), one.cast("long").alias("of_benchmark"))


def top_by_metric(facts: DataFrame, leaderboard: str, metric: str, n: int = 5) -> DataFrame:
    """The n best rows of a leaderboard by one metric; of equals the first by name and id."""
    own = facts.where((F.col("leaderboard") == leaderboard) & (F.col("metric") == metric))
    return own.orderBy(F.desc("value"), "model_name", "score_id").limit(n).select("model_name", "value", "score_id")


def distinct_benchmarks(facts: DataFrame, category: str | None = None) -> DataFrame:
    """benchmark: every name, or those of a category."""
    own = facts if category is None else facts.where(F.col("category") == category)
    return own.select("benchmark").where("benchmark is not null").distinct()


def report_top(facts: DataFrame, key: str, n: int) -> DataFrame:
    """A report's lists: the n best rows of each key with rank, shortened name, and how many more there are. The counts are a row a key."""
    more = facts.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    top = top_n(facts, [key], "value", n, "score_id").join(more, F.col(key) == F.col("_key"))
    return top.select(key, "rank", ellipsize(F.col("model_name"), 40 + 3).alias("model_name"), "value", F.greatest(F.col("_n") - n, F.lit(0)).alias("n_more"))


def quick_stats(facts: DataFrame, aliases: DataFrame, composites: DataFrame, boards: DataFrame) -> DataFrame:
    """One row: distinct models, canonical names, composites, and categories of leaderboards."""
    return (
        facts.agg(F.countDistinct("model_name").alias("total_models")).crossJoin(aliases.agg(F.countDistinct("canonical_name").alias("canonical_models")))
        .crossJoin(composites.agg(F.count("*").alias("composite_scores"))).crossJoin(boards.agg(F.countDistinct("category").alias("domains")))
    )  # one row each


def store_stats(scores: DataFrame, updated: str = "updated_at") -> DataFrame:
    """One row on the latest-only store: models, benchmarks, scores, latest update."""
    return scores.agg(F.countDistinct("model_name").alias("total_models"), F.countDistinct("benchmark").alias("total_benchmarks"), F.count("*").alias("total_scores"), F.max(updated).alias("latest_update"))


def scores_by_category(scores: DataFrame) -> DataFrame:
    return scores.groupBy("category").agg(F.count("*").alias("n"))


def top_composites(scores: DataFrame, n: int = 10, benchmark: str = "overall_composite") -> DataFrame:
    """The n models of the highest overall composite."""
    return scores.where(F.col("benchmark") == benchmark).orderBy(F.desc("normalized_value"), "model_name").limit(n).select("model_name", F.col("normalized_value").alias("score"))


def category_summaries(norm: DataFrame) -> DataFrame:
    """Per model and category: means, confidence and count, as they are."""
    return norm.groupBy("model_name", "category").agg(F.avg("normalized_value").alias("average"), F.avg("confidence_score").alias("confidence"), F.count("*").alias("n"), F.avg("value").alias("raw_average"))


def exact_mean(c: str) -> Column:
    """The mean of doubles below a million by their sum as decimals of 18 places, so it doesn't hang on the order of rows."""
    return F.avg(F.col(c).try_cast("decimal(24,18)")).cast("double")


def normalized_detail(norm: DataFrame, model: str) -> DataFrame:
    """One row on a model: means, quality, number of benchmarks, rank among all models by mean, latest update, and its facts and categories as
    lists in order. Only the one model's rows are gathered; the rank is the number of models before it, so nothing is sorted. Means are of exact
    sums, so equal ones tie and halves round the same whatever the order of rows."""
    own = norm.where(F.col("model_name") == model)
    facts = F.struct("score_id", "leaderboard", "benchmark", "metric", F.col("value").alias("raw_score"), F.round("normalized_value", 2).alias("normalized_score"), F.round("confidence_score", 3).alias("confidence"), "normalization_method", "category")
    head = own.agg(round_exact(exact_mean("normalized_value"), 2).alias("overall_normalized"), round_exact(exact_mean("confidence_score"), 3).alias("overall_confidence"), F.count("*").alias("total_benchmarks"), F.array_sort(F.collect_list(facts)).alias("benchmark_details"), F.max("scraped_at").alias("last_update"))
    cats = category_summaries(own).agg(F.array_sort(F.collect_list(F.struct("category", "average", "confidence", "n", "raw_average"))).alias("category_summaries"))
    means = norm.groupBy("model_name").agg(exact_mean("normalized_value").alias("m"))
    mine = means.where(F.col("model_name") == model).select(F.col("m").alias("own"))
    rank = means.crossJoin(mine).agg((F.count_if((F.col("m") > F.col("own")) | ((F.col("m") == F.col("own")) & (F.col("model_name") < model))) + 1).alias("global_rank"))
    return head.where("total_benchmarks > 0").crossJoin(cats).crossJoin(rank).crossJoin(model_quality(own).select("quality")).select(F.lit(model).alias("model_name"), "*")  # one row each


def sort_table(df: DataFrame, key: str, ascending: bool = False, missing: float = 0.0) -> DataFrame:
    """By any column: text in any case, missing numbers as `missing`."""
    c = F.lower(key) if dict(df.dtypes)[key] == "string" else F.coalesce(F.col(key), F.lit(missing))
    return df.orderBy(c.asc() if ascending else c.desc(), "model_name")


def union_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def category_coverage(facts: DataFrame, categories: DataFrame, samples: int = 5) -> DataFrame:
    """Every listed category, also those without a benchmark, with the number of its benchmarks and some of their names."""
    names = facts.select("category", "benchmark").distinct().withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy("benchmark")))
    g = names.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.col("benchmark")))), ",").alias("samples"))
    return categories.join(g, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))
