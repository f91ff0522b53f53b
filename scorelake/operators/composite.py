"""Domain scores and composites by professional profile.

Normalised facts carry normalized_value and confidence_score; aliases are (alias, canonical_name); profiles are (profile_id, name, a weight
column <domain>_weight each).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.functions.scalars import cascade, round_exact

DOMAINS = ("software_engineering", "reasoning", "academic", "medical", "legal", "comprehensive")
SHOWN_DOMAINS = (*DOMAINS, "safety", "finance")


def canonicalize(facts: DataFrame, aliases: DataFrame, col: str = "model_name") -> DataFrame:
    """facts with the alias's canonical name in `col`, where there is one. Spark broadcasts the aliases below its size threshold."""
    names = aliases.groupBy(F.col("alias").alias("_a")).agg(F.min("canonical_name").alias("_c"))
    return facts.join(names, F.col(col) == F.col("_a"), "left").select(*(F.coalesce("_c", col).alias(c) if c == col else c for c in facts.columns))


def domain_scores(norm: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Per model and domain: confidence-weighted mean score, confidence, count. Without any confidence: plain mean, 0.5."""
    df = canonicalize(norm, aliases) if aliases is not None else norm
    v, c = F.col("normalized_value"), F.col("confidence_score")
    g = df.groupBy("model_name", F.col("category").alias("domain")).agg(F.sum(v * c).alias("_vc"), F.sum(c).alias("_c"), F.avg(v).alias("_v"), F.avg(c).alias("_m"), F.count("*").alias("n"))
    has = F.col("_c") > 0
    return g.select("model_name", "domain", F.when(has, F.try_divide("_vc", "_c")).otherwise(F.col("_v")).alias("score"), F.when(has, F.col("_m")).otherwise(0.5).alias("confidence"), "n")


def profile_weights(profiles: DataFrame) -> DataFrame:
    """profile_id, profile, domain, weight."""
    cols = [c for c in profiles.columns if c.endswith("_weight")]
    return profiles.select("profile_id", F.col("name").alias("profile"), F.explode(F.array(*(F.struct(F.lit(c.removesuffix("_weight")).alias("domain"), F.col(c).cast("double").alias("weight")) for c in cols))).alias("w")).select("profile_id", "profile", "w.*")


def composite_scores(scores: DataFrame, profiles: DataFrame, unknown_domain: str = "ignore") -> DataFrame:
    """Per model and profile: composite_score (2 places), confidence_score (3), domain_coverage, missing_domains, method.

    Weights of the domains that a model has are rescaled to 1. The weights are a row a profile and domain, so the join multiplies facts by
    the number of profiles only. A domain outside the profile is ignored, or, with unknown_domain="error_row", makes a zero row.
    """
    weights = profile_weights(profiles)
    total = weights.groupBy("profile_id").agg(F.count("*").alias("_all"), F.collect_set("domain").alias("_domains"))
    got = scores.join(weights, "domain").groupBy("model_name", "profile_id", "profile").agg(
        F.sum(F.col("score") * F.col("weight")).alias("_s"), F.sum(F.col("confidence") * F.col("weight")).alias("_c"), F.sum("weight").alias("_w"), F.count("*").alias("n"), F.collect_set("domain").alias("_has")
    )
    df = got.join(total, "profile_id")
    ok = F.col("_w") > 0
    if unknown_domain == "error_row":
        known = weights.select("domain").distinct()
        bad = scores.join(known, "domain", "left_anti").select("model_name").distinct().withColumn("_bad", F.lit(True))
        df = df.join(bad, "model_name", "left")
    else:
        df = df.withColumn("_bad", F.lit(None).cast("boolean"))
    bad = F.coalesce("_bad", F.lit(False))
    ok = ok & ~bad
    full = F.col("n") == F.col("_all")
    method = cascade([(bad, "calculation_error"), (~ok, "no_data_available"), (full, "full_coverage"), (F.col("n") >= 4, "high_coverage"), (F.col("n") >= 2, "moderate_coverage")], "low_coverage")
    return df.select(
        "model_name", "profile_id", "profile",
        F.when(ok, round_exact(F.try_divide("_s", "_w"), 2)).otherwise(0.0).alias("composite_score"),
        F.when(ok, round_exact(F.try_divide("_c", "_w") * F.col("n") / F.col("_all"), 3)).otherwise(0.0).alias("confidence_score"),
        F.when(bad, 0).otherwise(F.col("n")).cast("long").alias("domain_coverage"),
        F.array_sort(F.array_except("_domains", "_has")).alias("missing_domains"),
        method.alias("method"),
    )


def composites_all(scores: DataFrame, profiles: DataFrame, profile_id: int | None = None) -> DataFrame:
    """All composites, best first in each profile."""
    df = composite_scores(scores, profiles if profile_id is None else profiles.where(F.col("profile_id") == profile_id))
    return df.orderBy("profile_id", F.desc("composite_score"), "model_name")


def validate_composites(scores: DataFrame) -> DataFrame:
    """Per model: what speaks against its composite, or ok."""
    g = scores.groupBy("model_name").agg(F.count("*").alias("n"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.avg("confidence").alias("c"))
    return g.select("model_name", cascade([(F.col("n") < 2, "too_few_domains"), ((F.col("sd") < 2) & (F.col("n") > 2), "uniform_scores"), (F.col("c") < 0.3, "low_confidence")], "ok").alias("finding"))


def score_distribution(comp: DataFrame, keys: Sequence[str] = ("profile",)) -> DataFrame:
    """Per key: mean, median, spread and range of scores above 0, mean confidence above 0, and coverage counts."""
    s, c, n = F.col("composite_score"), F.col("confidence_score"), F.col("domain_coverage")
    pos = F.when(s > 0, s)
    return comp.groupBy(*keys).agg(
        F.round(F.avg(pos), 4).alias("mean"), F.median(pos).alias("median"), F.round(F.coalesce(F.stddev_samp(pos), F.lit(0.0)), 4).alias("stdev"), F.min(pos).alias("min"), F.max(pos).alias("max"),
        F.round(F.avg(F.when(c > 0, c)), 4).alias("mean_confidence"), F.round(F.avg(n), 4).alias("mean_coverage"), F.count_if(n == 6).alias("full"), F.count_if(n >= 4).alias("high"), F.count_if(n < 2).alias("low"),
    )


def composite_stats(comp: DataFrame) -> DataFrame:
    """Per profile: models, and average, highest and lowest score."""
    return comp.groupBy("profile").agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("models"), F.round(F.avg("composite_score"), 4).alias("avg_score"), F.max("composite_score").alias("max_score"), F.min("composite_score").alias("min_score"))


def pivot_domains(scores: DataFrame, domains: Sequence[str] = SHOWN_DOMAINS) -> DataFrame:
    """Per model a column of its mean score in each domain. The values are given, so no extra pass looks for them."""
    return scores.groupBy("model_name").pivot("domain", list(domains)).agg(F.avg("score"))


def domain_means_with_fallback(norm: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """Per name and domain the mean through aliases; names for which those give nothing take the facts of their own name."""
    mean = lambda df, key: df.groupBy(F.col(key).alias("model_name"), F.col("category").alias("domain")).agg(F.avg("normalized_value").alias("score"))
    through = mean(norm.join(aliases.select(F.col("alias").alias("model_name"), "canonical_name").distinct(), "model_name"), "canonical_name")
    through = through.join(names, "model_name", "left_semi")
    rest = names.join(through.select("model_name").distinct(), "model_name", "left_anti")
    return through.unionByName(mean(norm, "model_name").join(rest, "model_name", "left_semi"))


def composite_leaderboard(comp: DataFrame, norm: DataFrame, aliases: DataFrame, profile: str, n: int) -> DataFrame:
    """The n best of a profile (its name in any case) with their domain means."""
    top = comp.where(F.lower("profile") == profile.lower()).orderBy(F.desc("composite_score"), "model_name").limit(n)
    means = pivot_domains(domain_means_with_fallback(norm, aliases, top.select("model_name")))
    return top.join(means, "model_name", "left").select("model_name", "composite_score", "confidence_score", "domain_coverage", *SHOWN_DOMAINS)


def model_breakdown(scores: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per model, profile and domain: score, confidence, count, weight and unscaled contribution; absent domains have nulls."""
    grid = scores.select("model_name").distinct().crossJoin(F.broadcast(profile_weights(profiles)))  # a row a profile and domain: small
    df = grid.join(scores, ["model_name", "domain"], "left")
    return df.select("model_name", "profile", "domain", "score", "confidence", "n", "weight", (F.col("score") * F.col("weight")).alias("contribution"), F.col("score").isNull().alias("is_missing"))


def compare_profiles(comp: DataFrame, profiles: Sequence[str], n: int, first: str) -> DataFrame:
    """The n best models of each profile, side by side, ordered by the first."""
    w = W.partitionBy("profile").orderBy(F.desc("composite_score"), "model_name")
    top = comp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    wide = top.groupBy("model_name").pivot("profile", list(profiles)).agg(F.max("composite_score"))
    return wide.orderBy(F.desc(F.coalesce(F.col(first), F.lit(0.0))), "model_name").limit(n)


def domain_coverage(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models by number of domains, models of each domain)."""
    per = scores.groupBy("model_name").agg(F.countDistinct("domain").alias("d"))
    band = cascade([(F.col("d") >= 6, "complete"), (F.col("d") >= 4, "high"), (F.col("d") >= 2, "moderate")], "low")
    return per.groupBy(band.alias("coverage")).agg(F.count("*").alias("models")), scores.groupBy("domain").agg(F.countDistinct("model_name").alias("models"))


def overall_composite(scores: DataFrame, own: str = "overall_composite") -> DataFrame:
    """Per model the mean of its values, composite rows aside."""
    return scores.where(F.col("benchmark") != own).groupBy("model_name").agg(F.round(F.avg("normalized_value"), 4).alias("overall"), F.count("*").alias("n"))


def weighted_composite(scores: DataFrame, weights: Mapping[str, float], default: float = 1.0) -> DataFrame:
    """Per model the mean weighted by benchmark."""
    w: Column = cascade([(F.col("benchmark") == b, x) for b, x in weights.items()], default)
    return scores.groupBy("model_name").agg(F.round(F.sum(F.col("normalized_value") * w) / F.sum(w), 4).alias("composite"))


#: Domains of a category page's score; the first that a model has counts.
CATEGORY_KEYS = {
    "coding": ("software_engineering",),
    "research": ("academic", "reasoning"),
    "medical": ("medical",),
    "legal": ("legal",),
    "finance": ("finance",),
    "general": ("comprehensive",),
    "creative": ("comprehensive",),
    "chat": ("comprehensive",),
    "business": ("comprehensive",),
}


def category_eligible(slug: str) -> Column:
    """Whether a model, with a column a domain and composite_score, is shown on a category's page."""
    there = lambda c: F.coalesce(c != 0, F.lit(False))
    if slug in ("general", "creative", "chat", "business"):
        return F.lit(True)
    if slug == "coding":
        return F.coalesce("software_engineering", "reasoning", "academic", "comprehensive").isNotNull() | there(F.col("composite_score"))
    own = there(category_score(slug))
    return own if slug in ("medical", "legal") else own | there(F.col("composite_score"))


def category_score(slug: str) -> Column:
    """Coding mixes engineering and reasoning; other categories take the first of their domains that isn't null."""
    se, reason = F.col("software_engineering"), F.col("reasoning")
    if slug == "coding":
        return F.coalesce(0.7 * se + 0.3 * reason, se, 0.8 * reason)
    keys = CATEGORY_KEYS.get(slug, ())
    return F.coalesce(*keys) if keys else F.lit(None).cast("double")


def category_view(wide: DataFrame, slug: str, shown_cols: Sequence[str] = ()) -> DataFrame:
    """Eligible models with the category's score, else their composite; the mean of the shown columns instead, where it is within 5 points.
    wide: model_name, composite_score and a column a domain."""
    score = F.coalesce(F.nullif(category_score(slug), F.lit(0.0)), F.col("composite_score"))
    shown = F.array_compact(F.array(*(F.col(c).cast("double") for c in shown_cols))) if shown_cols else F.array().cast("array<double>")
    mean = F.aggregate(shown, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(shown), F.lit(0))
    own = F.when(F.abs(mean - score) < 5, mean).otherwise(score)
    return wide.where(category_eligible(slug)).select("model_name", F.round(own, 4).alias("category_score"))


def impute_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls replaced by the row's mean, and is_estimated."""
    there = F.array_compact(F.array(*(F.col(c).cast("double") for c in cols)))
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    return df.select(*(F.round(F.coalesce(F.col(c), mean), 4).alias(c) if c in cols else c for c in df.columns), (F.size(there) < len(cols)).alias("is_estimated"))


def strengths_weaknesses(wide: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Per model the names of its excellent (80), strong (70) and weak (below 50) domains, and its missing ones in a list."""
    pairs = F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("s")) for d in domains))
    pick = lambda f: F.array_join(F.transform(F.filter(pairs, f), lambda x: x["d"]), ", ")
    return wide.select("model_name", pick(lambda x: x["s"] >= 80).alias("excellent"), pick(lambda x: (x["s"] >= 70) & (x["s"] < 80)).alias("strong"), pick(lambda x: x["s"] < 50).alias("weak"), pick(lambda x: x["s"].isNull()).alias("missing"))


def pros_and_cons(wide: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """model_name and lists of texts for and against each model. wide: model_name, confidence_score and a column a domain.

    For: a text an excellent (80) or strong (70) domain, a confidence of 0.8, all domains covered; general ones if there is none. Against: the
    missing domains in one text, a confidence below 0.6, a text a weak (below 50) domain.
    """
    name = {d: d.replace("_", " ") for d in domains}
    each = lambda rule: [rule(F.col(d), name[d]) for d in domains]
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(d).isNull(), d) for d in domains))), ", ")
    c = F.col("confidence_score")
    good = each(lambda s, n: F.when(s >= 80, f"Excellent {n} performance").when(s >= 70, f"Strong {n} capabilities"))
    pros = F.array_compact(F.array(*good, F.when(c >= 0.8, "Highly reliable and consistent results"), F.when(missing == "", "Complete domain coverage across all areas")))
    bad = each(lambda s, n: F.when(s < 50, f"Weaker {n} performance"))
    cons = F.array_compact(F.array(F.when(missing != "", F.concat(F.lit("Limited coverage in "), missing, F.lit(" domains"))), F.when(c < 0.6, "Lower confidence in some evaluations"), *bad))
    plain = F.array(F.lit("Well-rounded AI assistant"), F.lit("Tested across multiple benchmarks"))
    return wide.select("model_name", F.when(F.size(pros) == 0, plain).otherwise(pros).alias("pros"), cons.alias("cons"))
