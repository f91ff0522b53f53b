"""A query for every operator, over the given tables, with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import scalars as S
from scorelake.operators import boards as B
from scorelake.operators import composite as C
from scorelake.operators import monitor as M
from scorelake.operators import names as N
from scorelake.operators import normalize as Z
from scorelake.plans import facts as P
from scorelake.plans.facts import CATEGORIES, with_sql
from scorelake.sources import pages as H
from scorelake.sources import tables as T
from scorelake.sources.shared import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def norm(spark: SparkSession, d: str) -> DataFrame:
    return Z.normalize_scores(P.facts(spark, d))


def domains(spark: SparkSession, d: str) -> DataFrame:
    return C.domain_scores(norm(spark, d), P.aliases(spark, d))


def composites(spark: SparkSession, d: str) -> DataFrame:
    return C.composite_scores(domains(spark, d), P.profiles(spark))


def rounded(df: DataFrame, *cols: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def when_text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")



def as_of() -> F.Column:
    return F.lit(P.AS_OF).cast("timestamp")


#: Ranges of the metrics of facts, as rows.
def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *r) for m, r in Z.RANGES.items()], "metric string, lo double, hi double")


RANGES_SQL = "ranges AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in Z.RANGES.items()) + ") v(metric, lo, hi))"
RANGED_SQL = (
    "ranged AS (SELECT f.*, greatest(0, least(100, CASE WHEN NOT higher_is_better OR lower(f.metric) IN ('hallucination_rate', 'perplexity', 'loss', 'error') THEN 100 - raw ELSE raw END)) AS range_value FROM "
    "(SELECT f.*, (value - coalesce(lo, CASE WHEN contains(f.metric, 'elo') OR contains(f.metric, 'rating') THEN 800 ELSE 0 END)) / (coalesce(hi, CASE WHEN contains(f.metric, 'elo') OR contains(f.metric, 'rating') THEN 1400 ELSE 100 END) - coalesce(lo, CASE WHEN contains(f.metric, 'elo') OR contains(f.metric, 'rating') THEN 800 ELSE 0 END)) * 100 AS raw "
    "FROM facts f LEFT JOIN ranges r ON lower(f.metric) = r.metric) f)"
)


# Normalisation


@query(with_sql("norm", "SELECT score_id, model_name, normalization_method, round(normalized_value, 4) AS normalized_value, confidence_score FROM norm"))
def f8_normalize(spark, d):
    return rounded(norm(spark, d), "normalized_value").select("score_id", "model_name", "normalization_method", "normalized_value", "confidence_score")


@query(with_sql("typed", "SELECT ty.replace('percentage2', 'percentage') AS score_type, count(*) AS n FROM typed GROUP BY 1"))
def f1_score_types(spark, d):
    return P.facts(spark, d).groupBy(Z.detect_score_type(F.col("value"), F.col("metric"), F.col("benchmark"), F.col("leaderboard"))["type"].alias("score_type")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(100, (1000 + l_quantity * 10 - 1100) / 350 * 100)) AS elo, greatest(0, least(100, l_discount * 100)) AS academic, round(CASE WHEN l_discount <= 0 THEN 100 WHEN l_discount >= 1 THEN 0 ELSE 100 * ln(1 / greatest(l_discount, 0.001)) / ln(1000) END, 4) AS cost, CASE WHEN l_quantity >= 60 THEN 0 ELSE (1 - l_quantity / 60) * 100 END AS seconds, greatest(0, least(100, l_extendedprice / 1000)) AS percentage FROM lineitem")
def f2_f7_single_scales(spark, d):
    q, x = F.col("l_quantity"), F.col("l_discount")
    return P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", Z.norm_elo(1000 + q * 10, F.lit("general"))["score"].alias("elo"), Z.norm_academic(x)["score"].alias("academic"), F.round(Z.norm_cost(x)["score"], 4).alias("cost"),
        Z.norm_time(q)["score"].alias("seconds"), Z.norm_percentage(F.col("l_extendedprice") / 1000)["score"].alias("percentage"),
    )


@query(with_sql("norm", "SELECT count(*) AS n, round(avg(confidence_score), 4) AS avg_confidence FROM norm WHERE score_id % 5 <> 0"))
def f9_normalize_new(spark, d):
    f = P.facts(spark, d)
    return Z.normalize_new(f, f.where("score_id % 5 = 0")).agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence"))


@query(with_sql("norm", "SELECT count(*) AS total, round(avg(confidence_score), 6) AS avg_confidence, min(confidence_score) AS min_confidence, max(confidence_score) AS max_confidence, count(*) FILTER (confidence_score >= 0.9) AS high, round(count(*) FILTER (confidence_score >= 0.9) * 100 / count(*), 2) AS high_pct, count(*) FILTER (confidence_score >= 0.7 AND confidence_score < 0.9) AS medium, round(count(*) FILTER (confidence_score >= 0.7 AND confidence_score < 0.9) * 100 / count(*), 2) AS medium_pct, count(*) FILTER (confidence_score < 0.7) AS low, round(count(*) FILTER (confidence_score < 0.7) * 100 / count(*), 2) AS low_pct FROM norm"))
def f10_stats(spark, d):
    return Z.normalization_stats(norm(spark, d))


@query(with_sql("norm", "SELECT normalization_method, count(*) AS n FROM norm GROUP BY 1"))
def f10_methods(spark, d):
    return Z.method_histogram(norm(spark, d))


@query(with_sql("norm", "SELECT total, range_violations, low_confidence, suspicious, round(mean, 6) AS avg_confidence, round(greatest(0, least(1, mean - 0.3 * range_violations / total - 0.2 * low_confidence / total - 0.2 * suspicious / total)), 6) AS quality FROM (SELECT count(*) AS total, count(*) FILTER (normalized_value < 0 OR normalized_value > 100) AS range_violations, count(*) FILTER (confidence_score < 0.5) AS low_confidence, count(*) FILTER (value = normalized_value AND value > 100) AS suspicious, avg(confidence_score) AS mean FROM norm)"))
def f11_validate(spark, d):
    return Z.validate_normalization(norm(spark, d))


_FLAGS = "flags AS (SELECT *, n >= 4 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS is_outlier FROM (SELECT *, max(v) FILTER (r = n // 4) OVER (PARTITION BY k) AS q1, max(v) FILTER (r = 3 * n // 4) OVER (PARTITION BY k) AS q3 FROM (SELECT *, normalized_value AS v, category AS k, row_number() OVER (PARTITION BY category ORDER BY normalized_value) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM norm)))"


@query(with_sql("norm", f"SELECT * FROM (WITH {_FLAGS} SELECT k AS category, count(*) AS n, count(*) FILTER (is_outlier) AS outliers FROM flags GROUP BY k)"))
def f13_outliers(spark, d):
    return Z.flag_outliers(norm(spark, d), ["category"], "normalized_value").groupBy("category").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"))


@query(with_sql("norm", f"SELECT * FROM (WITH {_FLAGS} SELECT k AS category, round(greatest(0.1, least(1, avg(confidence_score) * greatest(0.5, 1 - coalesce(stddev_samp(v), 0) / greatest(avg(v), 1)) * (1 - avg(is_outlier::INT::DOUBLE)))), 6) AS confidence FROM flags GROUP BY k)"))
def f12_distribution_confidence(spark, d):
    return Z.distribution_confidence(norm(spark, d), ["category"])


@query(with_sql("facts", f"SELECT * FROM (WITH {RANGES_SQL}, {RANGED_SQL} SELECT score_id, round(range_value, 4) AS range_value FROM ranged)"))
def f14_by_range(spark, d):
    return Z.normalize_by_range(P.facts(spark, d), ranges(spark)).select("score_id", F.round("range_value", 4).alias("range_value"))


@query(with_sql("facts", "SELECT score_id, CASE WHEN (contains(lower(leaderboard), 'arena') OR contains(metric, 'score')) AND value BETWEEN 800 AND 1600 THEN (value - 800) / 8 WHEN contains(metric, 'accuracy') OR contains(metric, 'percent') OR contains(metric, 'rate') THEN greatest(0, least(100, value)) WHEN value BETWEEN 0 AND 100 THEN value ELSE greatest(0, least(100, value)) END AS simple, CASE WHEN contains(metric, 'cost') THEN greatest(0, least(100, 100 - value)) ELSE value END AS job, greatest(0, least(100, value)) AS clamped FROM facts"))
def f15_f16_simple_rules(spark, d):
    v, m = F.col("value"), F.col("metric")
    return P.facts(spark, d).select("score_id", Z.normalize_simple(v, m, F.col("leaderboard")).alias("simple"), Z.normalize_job(v, m).alias("job"), Z.normalize_job(v, m, "clamp").alias("clamped"))


@query(with_sql("facts", "SELECT model_name, round(avg(c), 4) AS composite FROM (SELECT model_name, category, avg(z) AS c FROM (SELECT *, coalesce((value - avg(value) OVER w) * (CASE WHEN higher_is_better THEN 1 ELSE -1 END) / nullif(stddev_samp(value) OVER w, 0), 0) AS z FROM facts WINDOW w AS (PARTITION BY benchmark)) GROUP BY ALL) GROUP BY 1"))
def f17_f18_z_composite(spark, d):
    return rounded(C_z(spark, d), "composite")


def C_z(spark, d):
    return Z.z_composite(Z.z_score(P.facts(spark, d), ["benchmark"], "value", F.col("higher_is_better")))


# Joins


@query(with_sql("facts", "SELECT leaderboard, category, count(*) AS n, round(sum(value), 2) AS total FROM facts GROUP BY ALL"))
def g1_join_boards(spark, d):
    f = P.facts(spark, d).drop("category")
    return f.join(P.boards(spark), "leaderboard").groupBy("leaderboard", "category").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(with_sql("norm", "SELECT f.score_id, round(CASE WHEN f.score_id % 5 = 0 THEN f.value ELSE f.normalized_value END, 4) AS effective FROM norm f"))
def g3_effective_score(spark, d):
    n = norm(spark, d).where("score_id % 5 <> 0").select("score_id", "normalized_value")
    return P.facts(spark, d).join(n, "score_id", "left").select("score_id", F.round(F.coalesce("normalized_value", "value"), 4).alias("effective"))


@query(with_sql("facts", "SELECT 'Empty Board' AS leaderboard, 0 AS n UNION ALL SELECT leaderboard, count(*) AS n FROM facts GROUP BY 1"))
def g4_boards_with_facts(spark, d):
    return P.boards(spark).join(P.facts(spark, d).select("leaderboard", "score_id"), "leaderboard", "left").groupBy("leaderboard").agg(F.count("score_id").alias("n"))


@query(with_sql("norm aliases", "SELECT model_name, domain, score FROM (SELECT canonical_name AS model_name, category AS domain, avg(normalized_value) AS score FROM norm n JOIN (SELECT DISTINCT alias, canonical_name FROM aliases) a ON n.model_name = a.alias GROUP BY ALL UNION ALL SELECT model_name, category, avg(normalized_value) FROM norm WHERE model_name NOT IN (SELECT canonical_name FROM aliases) GROUP BY ALL)"))
def g5_domain_means_with_fallback(spark, d):
    a = P.aliases(spark, d)
    names = P.facts(spark, d).select("model_name").union(a.select("canonical_name")).distinct()
    return C.domain_means_with_fallback(norm(spark, d), a, names)


@query(with_sql("facts aliases", "SELECT coalesce(a.canonical_name, f.model_name) AS model_name, count(*) AS n FROM facts f LEFT JOIN aliases a ON f.model_name = a.alias GROUP BY 1"))
def g6_canonicalize(spark, d):
    return C.canonicalize(P.facts(spark, d), P.aliases(spark, d)).groupBy("model_name").agg(F.count("*").alias("n"))


@query(with_sql("facts aliases", "SELECT count(DISTINCT f.model_name) AS models, count(DISTINCT a.canonical_name) AS canonicals FROM facts f LEFT JOIN aliases a ON f.model_name = a.alias"))
def g11_mapped_counts(spark, d):
    f, a = P.facts(spark, d), P.aliases(spark, d)
    return f.join(a, f["model_name"] == a["alias"], "left").agg(F.countDistinct("model_name").alias("models"), F.countDistinct("canonical_name").alias("canonicals"))


@query("SELECT r_name AS category, s_name AS model_name, count(*) AS n, round(avg(100 * l_discount), 4) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND l_quantity >= 10 GROUP BY ALL")
def g9_star_join(spark, d):
    t = lambda n: P.table(spark, d, n)
    l = t("lineitem").where("l_quantity >= 10").select("l_orderkey", "l_suppkey", "l_discount")  # noqa: E741
    o = t("orders").where("o_orderstatus = 'F'").select("o_orderkey")
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.groupBy(F.col("r_name").alias("category"), F.col("s_name").alias("model_name")).agg(F.count("*").alias("n"), F.round(F.avg(100 * F.col("l_discount")), 4).alias("score"))


# Composites


@query(with_sql("doms", "SELECT model_name, domain, round(score, 4) AS score, round(confidence, 4) AS confidence, n FROM doms"))
def h1_domain_scores(spark, d):
    return rounded(domains(spark, d), "score", "confidence")


@query(with_sql("comp", "SELECT * FROM comp"))
def h2_composites(spark, d):
    return composites(spark, d).drop("missing_domains")


@query(with_sql("doms", "SELECT model_name, CASE WHEN n < 2 THEN 'too_few_domains' WHEN sd < 2 AND n > 2 THEN 'uniform_scores' WHEN c < 0.3 THEN 'low_confidence' ELSE 'ok' END AS finding FROM (SELECT model_name, count(*) AS n, coalesce(stddev_samp(score), 0) AS sd, avg(confidence) AS c FROM doms GROUP BY 1)"))
def h3_validate_composites(spark, d):
    return C.validate_composites(domains(spark, d))


@query(with_sql("comp", "SELECT * FROM comp WHERE profile_id = 2"))
def h4_one_profile(spark, d):
    return C.composites_all(domains(spark, d), P.profiles(spark), 2).drop("missing_domains")


@query(with_sql("comp", "SELECT profile, round(avg(composite_score) FILTER (composite_score > 0), 4) AS mean, median(composite_score) FILTER (composite_score > 0) AS median, round(coalesce(stddev_samp(composite_score) FILTER (composite_score > 0), 0), 4) AS stdev, min(composite_score) FILTER (composite_score > 0) AS min, max(composite_score) FILTER (composite_score > 0) AS max, round(avg(confidence_score) FILTER (confidence_score > 0), 4) AS mean_confidence, round(avg(domain_coverage), 4) AS mean_coverage, count(*) FILTER (domain_coverage = 6) AS \"full\", count(*) FILTER (domain_coverage >= 4) AS high, count(*) FILTER (domain_coverage < 2) AS low FROM comp GROUP BY 1"))
def h5_distribution(spark, d):
    return C.score_distribution(composites(spark, d))


@query(with_sql("comp", "SELECT profile, count(*) AS n, count(DISTINCT model_name) AS models, round(avg(composite_score), 4) AS avg_score, max(composite_score) AS max_score, min(composite_score) AS min_score FROM comp GROUP BY 1"))
def h6_composite_stats(spark, d):
    return C.composite_stats(composites(spark, d))


@query(with_sql("comp", "SELECT t.*, software_engineering, NULL::DOUBLE AS reasoning, academic, medical, legal, comprehensive, NULL::DOUBLE AS safety, NULL::DOUBLE AS finance FROM (SELECT model_name, composite_score, confidence_score, domain_coverage FROM comp WHERE profile = 'General' ORDER BY composite_score DESC, model_name LIMIT 50) t LEFT JOIN (SELECT model_name, " + ", ".join(f"avg(score) FILTER (domain = '{c}') AS {c}" for c in CATEGORIES) + " FROM (SELECT canonical_name AS model_name, category AS domain, avg(normalized_value) AS score FROM norm n JOIN aliases a ON n.model_name = a.alias GROUP BY ALL UNION ALL SELECT model_name, category, avg(normalized_value) FROM norm GROUP BY ALL) GROUP BY 1) m USING (model_name)"))
def h7_leaderboard(spark, d):
    return C.composite_leaderboard(composites(spark, d), norm(spark, d), P.aliases(spark, d), "general", 50)


@query(with_sql("doms weights", "SELECT model_name, profile, domain, score, confidence, n, weight, score * weight AS contribution, score IS NULL AS is_missing FROM (SELECT DISTINCT model_name FROM doms) CROSS JOIN weights LEFT JOIN doms USING (model_name, domain)"))
def h8_breakdown(spark, d):
    return C.model_breakdown(domains(spark, d), P.profiles(spark))


@query(with_sql("comp", "SELECT model_name, max(composite_score) FILTER (profile = 'General') AS \"General\", max(composite_score) FILTER (profile = 'Developer') AS \"Developer\", max(composite_score) FILTER (profile = 'Clinician') AS \"Clinician\" FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY composite_score DESC, model_name) AS r FROM comp) WHERE r <= 20 GROUP BY 1 ORDER BY coalesce(\"General\", 0) DESC, model_name LIMIT 20"))
def h9_compare_profiles(spark, d):
    return C.compare_profiles(composites(spark, d), ["General", "Developer", "Clinician"], 20, "General")


@query(with_sql("doms", "SELECT CASE WHEN k >= 6 THEN 'complete' WHEN k >= 4 THEN 'high' WHEN k >= 2 THEN 'moderate' ELSE 'low' END AS coverage, count(*) AS models FROM (SELECT model_name, count(DISTINCT domain) AS k FROM doms GROUP BY 1) GROUP BY 1"))
def h10_coverage(spark, d):
    return C.domain_coverage(domains(spark, d))[0]


@query(with_sql("doms", "SELECT domain, count(DISTINCT model_name) AS models FROM doms GROUP BY 1"))
def h10_popularity(spark, d):
    return C.domain_coverage(domains(spark, d))[1]


@query(with_sql("norm", "SELECT model_name, round(avg(normalized_value), 4) AS overall, count(*) AS n FROM norm GROUP BY 1"))
def h16_overall(spark, d):
    return C.overall_composite(norm(spark, d))


@query(with_sql("norm", "SELECT model_name, round(sum(normalized_value * w) / sum(w), 4) AS composite FROM (SELECT *, CASE benchmark WHEN 'click_1' THEN 1.5 WHEN 'view_2' THEN 2.0 ELSE 1.0 END AS w FROM norm) GROUP BY 1"))
def h17_weighted(spark, d):
    return C.weighted_composite(norm(spark, d), {"click_1": 1.5, "view_2": 2.0})


WIDE_SQL = "wide AS (SELECT model_name, " + ", ".join(f"avg(score) FILTER (domain = '{c}') AS {c}" for c in C.DOMAINS) + " FROM doms GROUP BY 1)"


def wide(spark, d):
    w = C.pivot_domains(domains(spark, d), C.DOMAINS)
    return w.join(composites(spark, d).where("profile_id = 1").select("model_name", "composite_score"), "model_name", "left")


@query(with_sql("doms", "SELECT model_name, " + ", ".join(f"avg(score) FILTER (domain = '{c}') AS {c}" for c in C.SHOWN_DOMAINS) + " FROM doms GROUP BY 1"))
def b10_pivot_domains(spark, d):
    return C.pivot_domains(domains(spark, d))


@query(with_sql("comp", "SELECT w.model_name, round(CASE WHEN abs(mean - score) < 5 THEN mean ELSE score END, 4) AS category_score FROM (SELECT *, coalesce(nullif(se, 0), composite_score) AS score, (se + ac) / 2 AS both_mean, coalesce((se + ac) / 2, se, ac) AS mean FROM (SELECT model_name, avg(score) FILTER (domain = 'software_engineering') AS se, avg(score) FILTER (domain = 'academic') AS ac, count(*) FILTER (domain IN ('software_engineering', 'academic', 'comprehensive')) AS k FROM doms GROUP BY 1) LEFT JOIN (SELECT model_name, composite_score FROM comp WHERE profile_id = 1) USING (model_name)) w WHERE k > 0 OR composite_score <> 0"))
def h25_category_view(spark, d):
    return C.category_view(wide(spark, d), "coding", ("software_engineering", "academic"))


@query(with_sql("doms", f"SELECT * FROM (WITH {WIDE_SQL}, m AS (SELECT *, list_filter([software_engineering, academic, medical, legal, comprehensive], lambda x: x IS NOT NULL) AS l FROM wide) SELECT model_name, " + ", ".join(f"round(coalesce({c}, list_avg(l)), 4) AS {c}" for c in CATEGORIES) + ", len(l) < 5 AS is_estimated FROM m)"))
def h26_impute(spark, d):
    w = domains(spark, d).groupBy("model_name").pivot("domain", CATEGORIES).agg(F.avg("score"))
    return C.impute_missing(w, CATEGORIES).select("model_name", *CATEGORIES, "is_estimated")


@query(with_sql("doms", "SELECT model_name, " + ", ".join(f"coalesce(string_agg(domain, ', ' ORDER BY domain) FILTER ({cond}), '') AS {n}" for n, cond in (("excellent", "score >= 80"), ("strong", "score >= 70 AND score < 80"), ("weak", "score < 50"))) + " FROM doms GROUP BY 1"))
def b16_strengths(spark, d):
    return C.strengths_weaknesses(C.pivot_domains(domains(spark, d), sorted(CATEGORIES)), sorted(CATEGORIES)).drop("missing")


@query(with_sql("names", "SELECT model_name, CASE WHEN contains(n, 'gpt-4') OR contains(n, 'claude') THEN '$$$' WHEN contains(n, 'gemini') OR contains(n, 'sonnet') THEN '$$' ELSE '$' END AS cost_tier, CASE WHEN contains(n, 'mini') OR contains(n, 'flash') THEN 'Very Fast' WHEN contains(n, 'pro') OR contains(n, 'max') THEN 'Fast' ELSE 'Standard' END AS speed_tier, CASE WHEN score_id % 10 > 8 THEN 'Excellent' WHEN score_id % 10 > 6 THEN 'Good' ELSE 'Fair' END AS reliability FROM (SELECT *, lower(model_name) AS n FROM names)"))
def b15_tiers(spark, d):
    t = S.add_tiers(F.col("model_name"), F.col("score_id") % 10 / 10)
    return P.names(spark, d).select("model_name", *(t[c].alias(c) for c in ("cost_tier", "speed_tier", "reliability")))


# Boards


@query(with_sql("facts", "SELECT category, benchmark, score_id, round(value, 4) AS value FROM facts WHERE model_name = 'model-7'"))
def h11_model_benchmarks(spark, d):
    return rounded(B.model_benchmarks(P.facts(spark, d), "model-7"), "value").select("category", "benchmark", "score_id", "value")


_LATEST = "(SELECT model_name, benchmark, arg_max(normalized_value, (scraped_at, score_id)) AS v FROM norm WHERE category = '{}' GROUP BY ALL)"


@query(with_sql("norm", f"SELECT model_name, round(avg(v), 4) AS average, count(*) AS n FROM {_LATEST.format('software_engineering')} GROUP BY 1 ORDER BY average DESC, model_name LIMIT 25"))
def h12_category_breakdown(spark, d):
    return B.category_breakdown(norm(spark, d), "coding", 25).select("model_name", "average", F.size("benchmarks").cast("long").alias("n"))


#: A board of each kind that the coding board knows, and one that it doesn't, dealt to the facts by their ids.
CODING_BOARDS = [*B.CODING_KEYS, "LMArena x", "Other"]
_KEYS = ", ".join(f"({i}, '{b}')" for i, b in enumerate(CODING_BOARDS))
_KEY = "CASE WHEN contains(board, 'EvalPlus') THEN CASE WHEN contains(bench, 'humaneval') THEN 'HumanEval' WHEN contains(bench, 'mbpp') THEN 'MBPP' ELSE 'EvalPlus' END " + " ".join(f"WHEN board = '{k}' THEN '{v}'" for k, v in B.CODING_KEYS.items() if k != "EvalPlus") + " WHEN board = 'LMArena x' THEN 'LM Arena WebDev' ELSE bench END"


@query(with_sql("norm", f"SELECT model_name, average_score, n_benchmarks, keys FROM (WITH boards(i, board) AS (VALUES {_KEYS}), k AS (SELECT model_name, {_KEY} AS key, scraped_at, score_id, normalized_value AS v FROM (SELECT *, CASE score_id % 3 WHEN 0 THEN 'humaneval+' WHEN 1 THEN 'mbpp' ELSE benchmark END AS bench FROM norm JOIN boards ON i = score_id % {len(CODING_BOARDS)}) WHERE score_id % 2 = 0 OR normalized_value > 0), o AS (SELECT model_name, key, arg_max(v, (scraped_at, score_id)) AS v FROM k GROUP BY ALL) SELECT model_name, round(avg(v), 4) AS average_score, count(*) AS n_benchmarks, string_agg(key, ',' ORDER BY key) AS keys FROM o GROUP BY 1) ORDER BY average_score DESC, model_name LIMIT 30"))
def h13_coding_leaderboard(spark, d):
    board = F.element_at(F.array(*map(F.lit, CODING_BOARDS)), (F.pmod("score_id", F.lit(len(CODING_BOARDS))) + 1).cast("int"))
    bench = F.when(F.col("score_id") % 3 == 0, "humaneval+").when(F.col("score_id") % 3 == 1, "mbpp").otherwise(F.col("benchmark"))
    n = norm(spark, d).withColumn("leaderboard", board).withColumn("benchmark", bench)
    return B.coding_leaderboard(n.where("score_id % 2 = 0"), n.where("score_id % 2 = 1"), 30)


@query(with_sql("facts", "SELECT * FROM (SELECT benchmark, model_name, score_id, round(value, 4) AS value, row_number() OVER (PARTITION BY benchmark ORDER BY value DESC, model_name) AS rank FROM (SELECT benchmark, model_name, score_id, value FROM facts QUALIFY row_number() OVER (PARTITION BY benchmark, model_name ORDER BY value DESC, score_id) = 1)) WHERE rank <= 10"))
def h14_top_per_benchmark(spark, d):
    best = N.dedup_max(P.facts(spark, d).select("benchmark", "model_name", "score_id", "value"), ["benchmark", "model_name"], "value")
    return rounded(B.top_n(best, ["benchmark"], "value", 10), "value")


@query(with_sql("facts", "SELECT model_name, benchmark, round(arg_max(value, (scraped_at, score_id)), 4) AS value, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS updated_at, NOT bool_or(old) AS is_new FROM (SELECT *, scraped_at < '2024-01-20' AS old FROM facts) GROUP BY ALL"))
def h15_upsert(spark, d):
    f = P.facts(spark, d)
    empty = f.select("model_name", "benchmark", "value", F.col("scraped_at").alias("updated_at")).limit(0)
    cut = F.lit("2024-01-20").cast("timestamp")
    current = B.upsert_latest(empty, f.where(F.col("scraped_at") < cut)).drop("is_new")
    out = B.upsert_latest(current, f.where(F.col("scraped_at") >= cut))
    return rounded(out, "value").withColumn("updated_at", when_text("updated_at"))


_TABLE = "SELECT model_name, round(least(100, base * CASE WHEN n < 10 THEN 0.8 + n / 50 WHEN n >= 20 THEN 1 + least(0.05, (n - 20) / 200) ELSE 1 END * (1 + least(0.05, k / 20))), 2) AS score, n AS n_scores, k AS n_categories, " + ", ".join(CATEGORIES) + " FROM (SELECT model_name, avg(range_value) AS base, count(*) AS n, count(DISTINCT category) AS k, " + ", ".join(f"round(avg(range_value) FILTER (category = '{c}'), 2) AS {c}" for c in CATEGORIES) + " FROM ranged GROUP BY 1) ORDER BY score DESC, model_name LIMIT 100"


@query(with_sql("facts", f"SELECT *, row_number() OVER (ORDER BY score DESC, model_name) AS rank FROM (WITH {RANGES_SQL}, {RANGED_SQL} {_TABLE})"))
def h18_model_table(spark, d):
    return B.model_table(P.facts(spark, d), ranges(spark), CATEGORIES)


@query(with_sql("facts", f"SELECT * FROM (WITH {RANGES_SQL}, {RANGED_SQL}, t AS (SELECT model_name, row_number() OVER (ORDER BY score DESC, model_name) AS rank FROM ({_TABLE})) SELECT r.model_name, benchmark, metric, value, round(range_value, 4) AS range_value, score_id, (SELECT round(avg(range_value), 2) FROM ranged WHERE model_name = 'model-7') AS mean_score, (SELECT rank FROM t WHERE model_name = 'model-7') AS rank FROM ranged r WHERE r.model_name = 'model-7')"))
def h19_model_detail(spark, d):
    return B.model_detail(P.facts(spark, d), ranges(spark), CATEGORIES, "model-7")


@query(with_sql("norm", "SELECT model_name, round(avg(coalesce(nullif(normalized_value, 0), value)), 4) AS score, count(*) AS n_scores FROM norm GROUP BY 1"))
def h20_model_table_v2(spark, d):
    return B.model_table_v2(norm(spark, d))


@query(with_sql("facts", "SELECT category, CASE category WHEN 'software_engineering' THEN 'Software Engineering' ELSE upper(category[1]) || category[2:] END AS title, count(DISTINCT benchmark) AS n_benchmarks FROM facts GROUP BY 1"))
def h21_category_list(spark, d):
    return B.category_list(P.facts(spark, d))


_MODELS = "SELECT model_name, count(*) AS n_scores, round(avg(normalized_value), 4) AS avg_score, round(avg(confidence_score), 4) AS avg_confidence, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_update FROM norm GROUP BY 1"


@query(with_sql("norm", f"SELECT *, CASE WHEN avg_confidence >= 0.9 THEN 'HIGH' WHEN avg_confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS quality, row_number() OVER (ORDER BY avg_score DESC, model_name) AS rank FROM ({_MODELS} ORDER BY avg_score DESC, model_name LIMIT 40)"))
def h22_normalized_models(spark, d):
    return B.normalized_models(norm(spark, d), 40).withColumn("last_update", when_text("last_update"))


@query(with_sql("norm", "SELECT model_name, category, avg(normalized_value) AS average, avg(confidence_score) AS confidence, count(*) AS n, avg(value) AS raw_average FROM norm GROUP BY ALL"))
def h22_model_categories(spark, d):
    return B.category_summaries(norm(spark, d))


@query(with_sql("norm", "SELECT model_name, round(greatest(0, least(1, avg(confidence_score) - 0.2 * avg((confidence_score < 0.7)::INT) + least(0.1, count(*) / 100))), 6) AS quality FROM norm GROUP BY 1"))
def h23_model_quality(spark, d):
    return B.model_quality(norm(spark, d))


@query(with_sql("norm", "SELECT score_id, round(v, 4) AS v, row_number() OVER (ORDER BY v DESC, score_id) AS rank FROM (SELECT score_id, normalized_value AS v FROM norm)"))
def h24_global_rank(spark, d):
    return rounded(B.global_rank(norm(spark, d).select("score_id", F.col("normalized_value").alias("v")), "v", "score_id"), "v")


@query(with_sql("comp", "SELECT model_name, composite_score FROM comp WHERE profile_id = 1"))
def h27_sort_table(spark, d):
    return B.sort_table(composites(spark, d).where("profile_id = 1").select("model_name", "composite_score"), "composite_score")


def battles(spark, d):
    return battles_of(P.table(spark, d, "events"))


def battles_of(e):
    who = lambda k: F.concat(F.lit("m"), F.pmod(k, F.lit(25)))
    return e.select(who(F.col("user_id")).alias("model_a"), who(F.col("user_id") * 7 + F.col("event_id")).alias("model_b"), F.when(F.col("value") > 60, "model_a").when(F.col("value") > 20, "model_b").otherwise("tie").alias("winner"))


BATTLES_SQL = "WITH battles AS (SELECT 'm' || (user_id % 25) AS a, 'm' || ((user_id * 7 + event_id) % 25) AS b, CASE WHEN value > 60 THEN 'a' WHEN value > 20 THEN 'b' ELSE 't' END AS w FROM events) SELECT model_name, count(*) AS battles, count(*) FILTER (won) AS wins, round(count(*) FILTER (won) * 100 / count(*), 4) AS win_rate FROM (SELECT a AS model_name, w = 'a' AS won FROM battles UNION ALL SELECT b, w = 'b' FROM battles) GROUP BY 1 HAVING count(*) >= 50"


@query(BATTLES_SQL)
def h28_win_rates(spark, d):
    return B.win_rates(battles(spark, d))


@query(with_sql("facts", "SELECT category, count(*) AS n, arg_max(model_name, (value, -score_id)) AS top_model, round(max(value), 4) AS top_score FROM facts GROUP BY 1"))
def h29_category_overview(spark, d):
    return rounded(B.category_overview(P.facts(spark, d)), "top_score")


@query(with_sql("facts", "WITH best AS (SELECT category, model_name, max(value) AS score FROM facts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, model_name) AS k FROM best) SELECT model_name, count(*) AS n_categories, round(avg(score), 4) AS avg_score, arg_min(category, (k, category)) AS best_category, min(k) AS best_rank, arg_min(score, (k, category)) AS best_score FROM r GROUP BY 1 HAVING count(*) >= 3 ORDER BY avg_score DESC, model_name LIMIT 10").replace(") WITH best", "), best", 1))
def h30_cross_category(spark, d):
    return B.cross_category(P.facts(spark, d), 3, 10)


@query(with_sql("facts", "SELECT * FROM (SELECT count(*) AS n, count(DISTINCT model_name) AS models, count(DISTINCT category) AS categories, count(DISTINCT benchmark) AS benchmarks FROM facts) CROSS JOIN (SELECT model_name AS most_comprehensive, count(DISTINCT category) AS most_categories FROM facts GROUP BY 1 ORDER BY 2 DESC, avg(value) DESC, 1 LIMIT 1)"))
def h31_summary(spark, d):
    return B.summary(P.facts(spark, d))


@query(with_sql("facts", "SELECT leaderboard, arg_max(model_name, (value, -score_id)) AS model_name, round(max(value), 4) AS score, count(*) AS n FROM facts GROUP BY 1"))
def h32_top_by_group(spark, d):
    return rounded(B.top_by_group(P.facts(spark, d), "leaderboard"), "score")


@query(with_sql("norm", "SELECT CASE WHEN normalized_value >= 80 THEN 'top' WHEN normalized_value >= 50 THEN 'middle' ELSE 'rest' END AS tier, count(*) AS n, round(avg(normalized_value), 4) AS avg_score FROM norm GROUP BY 1"))
def h32_tiers(spark, d):
    return B.score_tiers(norm(spark, d), [("top", 80), ("middle", 50)], "normalized_value", "rest")


@query(with_sql("facts", "SELECT *, CASE WHEN avg_score >= 1380 THEN 'Easy' WHEN avg_score >= 1320 THEN 'Medium' WHEN avg_score >= 1260 THEN 'Hard' ELSE 'Very Hard' END AS difficulty FROM (SELECT category, round(avg(value), 4) AS avg_score, max(value) AS max_score, min(value) AS min_score, count(*) AS n FROM facts GROUP BY 1)"))
def h33_difficulty(spark, d):
    return B.category_difficulty(P.facts(spark, d))


@query(with_sql("facts", "SELECT count(*) AS n, count(DISTINCT model_name) AS models, count(DISTINCT benchmark) AS benchmarks, round(count(*) / count(DISTINCT model_name), 4) AS per_model, count(*) FILTER (benchmark = 'view_3') AS of_benchmark FROM facts WHERE leaderboard = 'HELM Views'"))
def h34_verify_load(spark, d):
    return B.verify_load(P.facts(spark, d), "HELM Views", "view_3")


@query(with_sql("facts", "SELECT category, count(*) AS n, string_agg(benchmark, ',' ORDER BY benchmark) FILTER (r <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY benchmark) AS r FROM (SELECT DISTINCT category, benchmark FROM facts)) GROUP BY 1 UNION ALL SELECT 'finance', 0, ''"))
def h35_category_coverage(spark, d):
    return B.category_coverage(P.facts(spark, d), P.boards(spark).select("category"))


@query(with_sql("facts", "SELECT model_name, metric, round(value, 4) AS value, NULL::VARCHAR AS note FROM facts WHERE score_id % 2 = 0 UNION ALL SELECT model_name, NULL, round(value, 4), 'old' FROM facts WHERE score_id % 2 = 1"))
def h37_union_sources(spark, d):
    f = rounded(P.facts(spark, d), "value")
    return B.union_sources(f.where("score_id % 2 = 0").select("model_name", "metric", "value"), f.where("score_id % 2 = 1").select("model_name", "value", F.lit("old").alias("note")))


# Names


@query(with_sql("names", "SELECT model_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model_name)), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-v?\\d*$', ''), '-') AS model_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model_name)), '\\([^)]*\\)', '', 'g'), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS benchmark_id, regexp_replace(lower(model_name), '[\\s\\-_]+', '', 'g') AS squashed, regexp_extract(model_name, '[^/]*$') AS last_part FROM names"))
def e1_e2_canonical_ids(spark, d):
    n = F.col("model_name")
    return P.names(spark, d).select(n, S.canonical_model(n).alias("model_id"), S.canonical_benchmark(n).alias("benchmark_id"), S.squashed(n).alias("squashed"), S.drop_provider(n).alias("last_part"))


@query(with_sql("names", "SELECT model_name, CASE WHEN starts_with(lower(model_name), 'o3') THEN 'o3-mini' WHEN contains(lower(model_name), 'gpt-4o') THEN 'GPT-4o' WHEN contains(lower(model_name), 'gpt-4') THEN 'GPT-4' WHEN contains(lower(model_name), 'deepseek-coder') THEN 'DeepSeek Coder' WHEN contains(lower(model_name), 'llama-3.1') THEN 'Llama 3.1' ELSE array_to_string(list_transform(string_split(replace(model_name, '_', ' '), ' '), lambda w: CASE WHEN lower(w) IN ('gpt', 'llm', 'ai', 'api') THEN upper(w) WHEN regexp_matches(w, '\\d') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS coding_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(model_name), '^agentless\\s*\\+?\\s*', ''), '^swe[-_]?agent\\s*\\+?\\s*', ''), '^.*\\s*\\+\\s*', '')) AS bare FROM names"))
def e4_e6_coding_names(spark, d):
    n = F.col("model_name")
    return P.names(spark, d).select(n, S.coding_model_name(n).alias("coding_name"), S.strip_wrappers(n).alias("bare"))


_FAMILIES = "SELECT model_name, family AS canonical, confidence FROM (SELECT model_name, CASE WHEN starts_with(model_name, 'Agentless') THEN 'GPT-4' WHEN starts_with(model_name, 'claude-3.5') THEN 'Claude 3.5 Sonnet' WHEN starts_with(model_name, 'OpenAI') THEN 'GPT-4' WHEN starts_with(model_name, 'gemini_2.0') THEN 'Gemini 2.0 Flash' WHEN starts_with(model_name, 'Meta-Llama') THEN 'Llama 3.1 70B' END AS family, CASE WHEN starts_with(model_name, 'OpenAI') THEN 0.9 WHEN starts_with(model_name, 'Agentless') THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM names) WHERE family IS NOT NULL"


@query(with_sql("names", _FAMILIES))
def e7_families(spark, d):
    return N.match_family(P.names(spark, d), N.family_rules())


@query()
def e9_normalize_names(spark, d):
    return N.normalize_names(name_pool(spark, d), P.aliases(spark, d), N.family_rules())


def name_pool(spark, d):
    """Names of all shapes, the facts' own, and misspelt aliases."""
    f = P.facts(spark, d).select("model_name").distinct()
    return P.names(spark, d).select("model_name").union(f).union(f.select(F.replace("model_name", F.lit("model-"), F.lit("Modle_"))))


@query(with_sql("facts aliases", "WITH pool AS (SELECT DISTINCT model_name FROM facts UNION SELECT DISTINCT upper(model_name) FROM facts UNION SELECT DISTINCT replace(model_name, '-', '_ ') FROM facts) SELECT p.model_name, coalesce(a.canonical_name, b.canonical_name, c.canonical_name, p.model_name) AS resolved, CASE WHEN a.alias IS NOT NULL THEN 'exact' WHEN b.alias IS NOT NULL THEN 'lower' WHEN c.alias IS NOT NULL THEN 'squashed' ELSE 'self' END AS stage FROM pool p LEFT JOIN aliases a ON p.model_name = a.alias LEFT JOIN aliases b ON lower(p.model_name) = b.alias LEFT JOIN aliases c ON regexp_replace(lower(p.model_name), '[\\s\\-_]+', '', 'g') = replace(c.alias, '-', '')").replace(") WITH pool", "), pool", 1))
def e10_resolve_exact_stages(spark, d):
    f = P.facts(spark, d).select("model_name").distinct()
    pool = f.union(f.select(F.upper("model_name"))).union(f.select(F.replace("model_name", F.lit("-"), F.lit("_ ")))).distinct()
    return N.resolve_names(pool, P.aliases(spark, d), fuzzy=False)


@query()
def e10_resolve_names(spark, d):
    return N.resolve_names(name_pool(spark, d), P.aliases(spark, d))


@query(with_sql("facts aliases", "SELECT model_name AS original, coalesce(canonical_name, model_name) AS canonical, CASE WHEN alias IS NULL THEN 0.1 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN alias IS NULL THEN 'manual' ELSE 'exact' END AS match_type FROM (SELECT DISTINCT model_name FROM facts) LEFT JOIN aliases ON model_name = alias"))
def e5_normalize_exact(spark, d):
    return N.normalize_names(P.facts(spark, d), P.aliases(spark, d), N.family_rules(), fuzzy=False)


@query(with_sql("facts aliases", "SELECT DISTINCT model_name FROM facts WHERE model_name NOT IN (SELECT alias FROM aliases)"))
def e12_unmapped(spark, d):
    return N.unmapped_names(P.facts(spark, d), P.aliases(spark, d))


@query(with_sql("facts", "SELECT CASE WHEN value >= 90 THEN 'high' WHEN value >= 70 THEN 'medium' WHEN value >= 30 THEN 'low' ELSE 'manual' END AS bucket, count(*) AS n FROM facts GROUP BY 1"))
def e13_buckets(spark, d):
    return P.facts(spark, d).groupBy(N.bucket(F.col("value") / 100).alias("bucket")).agg(F.count("*").alias("n"))


@query(with_sql("facts aliases", "SELECT m.model_name AS alias, 'family-1' AS canonical_name, k.model_family, k.provider, 'auto' AS source, 0.95::DOUBLE AS confidence_score FROM (SELECT DISTINCT model_name FROM facts WHERE model_name NOT IN (SELECT alias FROM aliases)) m CROSS JOIN (SELECT model_family, provider FROM aliases WHERE canonical_name = 'family-1' ORDER BY alias LIMIT 1) k"))
def e14_auto_alias(spark, d):
    m = P.facts(spark, d).select(F.col("model_name").alias("original"), F.lit("family-1").alias("canonical"), F.lit(0.95).alias("confidence")).distinct()
    return N.auto_alias(m, P.aliases(spark, d))


@query(with_sql("facts aliases", "SELECT total, mapped, total - mapped AS unmapped, round(mapped * 100 / total, 1) AS coverage_pct, canonicals, aliases FROM (SELECT count(*) AS total, count(alias) AS mapped FROM (SELECT DISTINCT model_name FROM facts) LEFT JOIN aliases ON model_name = alias) CROSS JOIN (SELECT count(DISTINCT canonical_name) AS canonicals, count(*) AS aliases FROM aliases)"))
def e15_coverage(spark, d):
    return N.alias_coverage(P.facts(spark, d), P.aliases(spark, d))


@query(with_sql("aliases", "SELECT model_family, canonical_name, provider, count(*) AS n, string_agg(alias, ',' ORDER BY alias) AS aliases FROM aliases GROUP BY ALL"))
def e21_families(spark, d):
    return N.alias_families(P.aliases(spark, d))


@query(with_sql("facts aliases", "SELECT alias, canonical_name FROM aliases WHERE alias NOT IN ('model-3', 'model-6') UNION ALL SELECT DISTINCT model_name, 'new' FROM facts WHERE model_name NOT IN (SELECT alias FROM aliases)"))
def e22_alias_maintenance(spark, d):
    a, gone = P.aliases(spark, d), spark.createDataFrame([("model-3",), ("model-6",)], "alias string")
    new = P.facts(spark, d).select(F.col("model_name").alias("alias"), F.lit("new").alias("canonical_name")).distinct()
    return N.alias_delete(N.alias_add(a, new), gone).select("alias", "canonical_name")


@query(with_sql("names", "WITH b AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(model_name)), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-v?\\d*$', ''), '-') AS model_id, score_id FROM names) SELECT model_id, coalesce(min(score_id) FILTER (score_id % 2 = 0), min(score_id)) AS first_seen, max(score_id) AS last_seen, count(*) AS n_scores, NOT bool_or(score_id % 2 = 0) AS is_new FROM b GROUP BY 1").replace(") WITH b AS", "), b AS", 1))
def e23_register_models(spark, d):
    n = P.names(spark, d).withColumn("scraped_at", F.col("score_id"))
    start = n.select(F.lit("").alias("model_id"), F.col("score_id").alias("first_seen"), F.col("score_id").alias("last_seen"), F.col("score_id").alias("n_scores")).limit(0)
    first = N.register_models(n.where("score_id % 2 = 0"), start).drop("is_new")
    return N.register_models(n.where("score_id % 2 = 1"), first)


@query(with_sql("facts", "SELECT model_name AS model_id, leaderboard, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS first_seen, leaderboard <> 'HELM Views' OR max(scraped_at) >= TIMESTAMP '2024-01-25' AS is_present FROM facts GROUP BY model_name, leaderboard"))
def e24_mark_absent(spark, d):
    f = P.facts(spark, d)
    batch = f.where((F.col("leaderboard") == "HELM Views") & (F.col("scraped_at") >= F.lit("2024-01-25").cast("timestamp"))).select(F.col("model_name").alias("model_id"))
    return N.mark_absent(N.track_sources(f), batch, "HELM Views").withColumn("first_seen", when_text("first_seen")).drop("last_seen")


@query(with_sql("facts", "SELECT model_name, max(scraped_at) < TIMESTAMP '2024-02-01' - INTERVAL 3 DAY AND count(*) < 60 AS is_deprecated FROM facts GROUP BY 1"))
def e25_deprecate(spark, d):
    r = P.facts(spark, d).groupBy("model_name").agg(F.max("scraped_at").alias("last_seen"), F.count("*").alias("n_scores"))
    return N.deprecate(r, as_of(), 3, 60).select("model_name", "is_deprecated")


@query("SELECT name, CASE WHEN contains(lower(name), 'code') THEN 'Code' WHEN contains(lower(name), 'legal') THEN 'Domain-Law' WHEN contains(lower(name), 'mgsm') THEN 'Multilingual' ELSE 'Misc' END AS category FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'Code ' || p_partkey WHEN 1 THEN 'Legal ' || p_partkey WHEN 2 THEN 'MGSM ' || p_partkey ELSE 'x' || p_partkey END AS name, p_partkey FROM part) WHERE p_partkey % 3 <> 0")
def e26_discover_benchmarks(spark, d):
    """Headers of four kinds and some that name no benchmark; a third of them is registered."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Code "), k)).when(k % 4 == 1, F.concat(F.lit("Legal "), k)).when(k % 4 == 2, F.concat(F.lit("MGSM "), k)).otherwise(F.concat(F.lit("x"), k))
    p = P.table(spark, d, "part").select(k, name.alias("name"))
    plain = p.select(F.when(k % 2 == 0, "Model").otherwise(" average ").alias("header"))
    return N.discover_benchmarks(p.select(F.concat(F.lit(" "), "name").alias("header")).union(plain), p.where("p_partkey % 3 = 0").select("name"))


@query(with_sql("facts", "SELECT DISTINCT benchmark, CASE WHEN contains(benchmark, 'long') THEN 'LongContext' WHEN contains(leaderboard, 'Legal') THEN 'Domain-Law' WHEN contains(leaderboard, 'Medical') THEN 'Domain-Med' ELSE 'Misc' END AS category, CASE WHEN contains(leaderboard, 'Legal') THEN 'legal' WHEN contains(leaderboard, 'Medical') THEN 'medical' WHEN contains(leaderboard, 'SWE') THEN 'coding' ELSE 'general' END AS metric_category FROM facts"))
def e27_e28_categories(spark, d):
    return P.facts(spark, d).select("benchmark", N.benchmark_category(F.col("benchmark"), F.col("leaderboard")).alias("category"), N.metric_category(F.col("metric"), F.col("leaderboard")).alias("metric_category")).distinct()


@query(with_sql("facts", "SELECT model_name, metric, score_id, round(value, 4) AS value FROM facts QUALIFY row_number() OVER (PARTITION BY model_name, metric ORDER BY value DESC, score_id) = 1"))
def e29_dedup_max(spark, d):
    return rounded(N.dedup_max(P.facts(spark, d), ["model_name", "metric"], "value"), "value").select("model_name", "metric", "score_id", "value")


@query(with_sql("facts", "SELECT model_name, score_id, benchmark FROM facts QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY score_id) = 1"))
def e30_dedup_first(spark, d):
    return N.dedup_first(P.facts(spark, d), S.squashed(F.col("model_name"))).select("model_name", "score_id", "benchmark")


@query(with_sql("names", "SELECT * FROM (WITH s AS (SELECT DISTINCT model_name, list_distinct(string_split(lower(model_name), '')) AS s FROM names) SELECT a.model_name AS name_a, b.model_name AS name_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON a.model_name < b.model_name) WHERE similarity > 0.8"))
def e31_near_duplicate_names(spark, d):
    """All pairs of names, from the pairs of classes and the classes' names."""
    names = P.names(spark, d)
    return N.near_duplicate_pairs(N.name_classes(names), N.near_duplicate_names(names))


_CLASSES = "(SELECT model_name, key, count(*) OVER (PARTITION BY key) AS n FROM (SELECT DISTINCT model_name, array_to_string(list_sort(list_distinct(string_split(lower(model_name), ''))), '') AS key FROM names))"


@query(with_sql("names", f"SELECT * FROM {_CLASSES}"))
def e31_name_classes(spark, d):
    return N.name_classes(P.names(spark, d))


@query(with_sql("names", f"SELECT * FROM (SELECT a.key AS key_a, a.name AS name_a, a.n AS n_a, b.key AS key_b, b.name AS name_b, b.n AS n_b, round(len(list_intersect(string_split(a.key, ''), string_split(b.key, ''))) / len(list_distinct(list_concat(string_split(a.key, ''), string_split(b.key, '')))), 6) AS similarity FROM (SELECT key, n, min(model_name) AS name FROM {_CLASSES} GROUP BY 1, 2) a JOIN (SELECT key, n, min(model_name) AS name FROM {_CLASSES} GROUP BY 1, 2) b ON a.key < b.key) WHERE similarity > 0.8"))
def e31_class_pairs(spark, d):
    return N.near_duplicate_names(P.names(spark, d))


# Monitoring


@query(with_sql("facts", "SELECT b AS leaderboard, count(score_id) AS n, count(DISTINCT model_name) AS models, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_update, round((epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(scraped_at)))::BIGINT) / 3600, 4) AS hours, CASE WHEN max(scraped_at) IS NULL THEN 'unknown' WHEN (epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(scraped_at)))::BIGINT) / 3600 <= 24 THEN 'current' WHEN (epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(scraped_at)))::BIGINT) / 3600 <= 72 THEN 'stale' ELSE 'outdated' END AS status FROM (VALUES ('Arena Clicks'), ('HELM Views'), ('Legal Purchases'), ('SWE Signups'), ('Medical Errors'), ('Empty Board')) v(b) LEFT JOIN facts ON leaderboard = b GROUP BY 1"))
def k1_source_freshness(spark, d):
    return M.source_freshness(P.facts(spark, d), P.boards(spark), as_of()).drop("first_update").withColumn("last_update", when_text("last_update"))


@query(with_sql("facts", "SELECT category, count(DISTINCT leaderboard) AS sources, count(DISTINCT model_name) AS models, count(*) AS n, round(avg((epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(scraped_at))::BIGINT) / 86400), 4) AS mean_age_days, CASE WHEN avg((epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(scraped_at))::BIGINT) / 86400) <= 7 THEN 'fresh' WHEN avg((epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(scraped_at))::BIGINT) / 86400) <= 30 THEN 'moderate' ELSE 'stale' END AS status FROM facts GROUP BY 1"))
def k2_category_freshness(spark, d):
    return M.category_freshness(P.facts(spark, d), as_of()).drop("latest", "earliest")


@query(with_sql("facts", "SELECT 'Empty Board' AS leaderboard, 'no data' AS alert UNION ALL SELECT leaderboard, 'stale' FROM facts GROUP BY 1 HAVING max(scraped_at) < TIMESTAMP '2024-02-01' - INTERVAL 1 DAY"))
def k3_stale_alerts(spark, d):
    return M.stale_alerts(P.facts(spark, d), P.boards(spark), as_of(), 1)


@query(with_sql("facts comp", "SELECT *, CASE WHEN health >= 80 THEN 'healthy' WHEN health >= 60 THEN 'warning' ELSE 'critical' END AS state FROM (SELECT *, 100 - CASE WHEN n_recent = 0 THEN 20 ELSE 0 END - CASE WHEN coverage < 80 THEN 10 ELSE 0 END AS health FROM (SELECT (SELECT count(*) FROM facts) AS n_facts, (SELECT count(*) FROM facts WHERE scraped_at >= TIMESTAMP '2024-01-31 00:00:01') AS n_recent, (SELECT count(*) FROM comp) AS n_composites, (SELECT round(count(alias) * 100 / count(*), 4) FROM (SELECT DISTINCT model_name FROM facts) LEFT JOIN aliases ON model_name = alias) AS coverage))"))
def k5_health(spark, d):
    return M.health_score(P.facts(spark, d), composites(spark, d), P.aliases(spark, d), as_of())


def runs(spark, d):
    """Ingestion runs: an event as a run of its type's source."""
    return P.table(spark, d, "events").select(F.col("event_type").alias("source"), (F.col("value") < 200).alias("success"), (F.col("value") / 10).alias("duration"), F.col("ts").cast("timestamp").alias("run_at"))


@query("SELECT event_type AS source, CASE event_type WHEN 'click' THEN 'high' ELSE 'weekly' END AS update_class, round((epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(ts) FILTER (value < 200)))::BIGINT) / 3600, 4) AS hours, round(avg((value < 200)::INT) * 100, 4) AS success_pct, (epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(max(ts) FILTER (value < 200)))::BIGINT) / 3600 > CASE event_type WHEN 'click' THEN 12 ELSE 168 END AS is_late, avg((value < 200)::INT) * 100 < 95 AS is_failing FROM events GROUP BY 1")
def k6_freshness_by_class(spark, d):
    classes = runs(spark, d).select("source").distinct().withColumn("update_class", F.when(F.col("source") == "click", "high").otherwise("weekly"))
    return M.freshness_by_class(runs(spark, d), classes, as_of())


@query("SELECT event_type AS source, count(*) AS runs, round(avg((value < 200)::INT) * 100, 4) AS success_pct, round(avg(value / 10), 4) AS avg_duration FROM events WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-02-01') - 7 * 86400 GROUP BY 1")
def k7_ingestion_stats(spark, d):
    return M.ingestion_stats(runs(spark, d), as_of())


_CHECKS = "SELECT * FROM (WITH recent AS (SELECT * FROM norm WHERE floor(epoch(scraped_at)) > epoch(TIMESTAMP '2024-02-01') - 86400), v AS (SELECT 'daily_models' AS test, 10.0 AS threshold, (SELECT count(DISTINCT model_name) FROM recent)::DOUBLE AS actual, true AS up UNION ALL SELECT 'daily_scores', 100, (SELECT count(*) FROM recent), true UNION ALL SELECT 'freshness_hours', 48, (SELECT round((epoch(TIMESTAMP '2024-02-01') - max(floor(epoch(scraped_at)))) / 3600, 6) FROM norm), false UNION ALL SELECT 'wild_values_pct', 1, 0, false UNION ALL SELECT 'mean_confidence', 0.7, (SELECT round(avg(confidence_score), 6) FROM norm), true UNION ALL SELECT 'duplicate_aliases', 0, 0, false UNION ALL SELECT 'orphan_aliases', 0, (SELECT count(DISTINCT canonical_name) FROM aliases), false UNION ALL SELECT 'rows', 1000, (SELECT count(*) FROM norm), true UNION ALL SELECT 'max_value', 10000, (SELECT round(max(abs(normalized_value)), 6) FROM norm), false UNION ALL SELECT 'mean_value', 100, (SELECT round(avg(normalized_value), 6) FROM norm), false) SELECT test, CASE WHEN up THEN actual >= threshold ELSE actual <= threshold END AS passed, threshold::DOUBLE AS threshold, actual FROM v)"


@query(with_sql("norm aliases", _CHECKS))
def k8_k17_checks(spark, d):
    return M.run_checks(norm(spark, d), P.aliases(spark, d), as_of())


@query(with_sql("names", "SELECT 'source_success_pct' AS test, actual >= 80 AS passed, 80::DOUBLE AS threshold, actual FROM (SELECT coalesce(min(p), 100)::DOUBLE AS actual FROM (SELECT round(avg((value < 200)::INT) * 100, 4) AS p FROM events WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-02-01') - 7 * 86400 GROUP BY event_type)) UNION ALL SELECT 'near_duplicate_names', actual <= 9, 9::DOUBLE, actual FROM (SELECT count(*)::DOUBLE AS actual FROM (SELECT DISTINCT model_name, list_distinct(string_split(lower(model_name), '')) AS s FROM names) a JOIN (SELECT DISTINCT model_name, list_distinct(string_split(lower(model_name), '')) AS s FROM names) b ON a.model_name < b.model_name WHERE round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) > 0.8)"))
def k9_k15_checks(spark, d):
    checks = M.run_checks(norm(spark, d), P.aliases(spark, d), as_of(), runs=runs(spark, d), names=P.names(spark, d))
    return checks.where(F.col("test").isin("source_success_pct", "near_duplicate_names"))


@query("SELECT count(*) FILTER (o_orderstatus IS NULL) AS missing_o_orderstatus, count(*) FILTER (o_totalprice IS NULL) AS missing_o_totalprice FROM orders")
def k18_required(spark, d):
    return M.validate_required(P.table(spark, d, "orders"), ["o_orderstatus", "o_totalprice"])


@query("SELECT DISTINCT event_type AS source FROM events WHERE event_type <> 'click'")
def k20_changed_sources(spark, d):
    """All sources have changed but one, whose hash is on record."""
    e = P.table(spark, d, "events").withColumnRenamed("event_type", "source")
    return M.changed_sources(e, M.content_hashes(e.where("source = 'click'"))).select("source")


# Reshaping and scalars


@query("SELECT l_orderkey AS model_name, metric, value, higher_is_better FROM (SELECT l_orderkey, 'l_quantity' AS metric, l_quantity AS value, true AS higher_is_better FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax, false FROM lineitem)")
def b9_metrics_to_facts(spark, d):
    return T.metrics_to_facts(P.table(spark, d, "lineitem"), "l_orderkey", {"l_quantity": True, "l_tax": False})


@query("SELECT 'model-' || user_id AS model, event_type AS metric, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def b2_b20_consolidate_unpivot(spark, d):
    e = P.table(spark, d, "events").select(F.concat(F.lit("model-"), "user_id").alias("model_name"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("pos"))
    return T.unpivot_scores(T.valid_record(T.consolidate_scores(e).withColumnRenamed("model_name", "model")))


@query("SELECT model, place, metric, value FROM (SELECT 'model-' || user_id AS model, 1 AS place, 'k' AS metric, (props->>'$.k')::DOUBLE AS value FROM events)")
def b3_b18_numeric_fields(spark, d):
    e = P.table(spark, d, "events")
    text = F.concat(F.lit('{"data": [{"name": "model-'), "user_id", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit(', "note": "x"}]}'))
    return T.numeric_fields_to_facts(e.select(T.unwrap_envelope(text).alias("records")), "records")


@query(with_sql("facts", "SELECT score_id, metric, CASE metric WHEN 'elo_rating' THEN 'rating' WHEN 'accuracy' THEN 'share' WHEN 'cost' THEN 'money' ELSE 'other' END AS metric_category FROM facts"))
def b8_metric_category(spark, d):
    dim = spark.createDataFrame([("elo_rating", "rating"), ("accuracy", "share"), ("cost", "money")], "metric string, category string")
    return T.map_benchmark_category(P.facts(spark, d).select("score_id", "metric"), dim, "left")


@query("SELECT event_id, event_type, 'Rank' AS rank_metric, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank_value FROM events")
def b6_position_rank(spark, d):
    return T.add_position_rank(P.table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", "Rank")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN k = 0 THEN 0 ELSE (CASE WHEN l_quantity > 0 THEN l_quantity ELSE 0 END + CASE WHEN l_tax > 0 THEN l_tax ELSE 0 END + CASE WHEN l_discount > 0 THEN l_discount ELSE 0 END) / k END, 6) AS mean_pos, CASE WHEN l_discount > 0 THEN l_discount WHEN l_tax > 0 THEN l_tax WHEN l_quantity > 0 THEN l_quantity END AS first_pos, trunc(l_quantity * 5)::INT AS resolved, l_quantity BETWEEN 10 AND 20 AS fits FROM (SELECT *, (l_quantity > 0)::INT + (l_tax > 0)::INT + (l_discount > 0)::INT AS k FROM lineitem)")
def b12_b13_row_rules(spark, d):
    li = P.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(S.mean_positive(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")), 6).alias("mean_pos"), S.first_positive(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")).alias("first_pos"), S.resolved_count(F.col("l_quantity")).alias("resolved"), S.in_range(F.col("l_quantity"), 10, 20).alias("fits"))


@query("SELECT event_id, CASE WHEN e2 = 0 THEN NULL ELSE e1 * 100.0 / e2 END AS pct, e1 AS n, (e1 / 1000)::DOUBLE AS cost, e1::DOUBLE AS seconds, (e1 * 1000)::DOUBLE AS scaled, e1::DOUBLE AS unit, 0::DOUBLE AS safe FROM (SELECT event_id, event_id % 97 AS e1, user_id % 13 AS e2 FROM events)")
def d1_d8_parsers(spark, d):
    a, b = F.col("event_id") % 97, F.col("user_id") % 13
    t = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    return P.table(spark, d, "events").select(
        "event_id", S.parse_fraction_pct(t(a, "/", b)).alias("pct"), S.first_int(t(a, " ±53%")).alias("n"), S.parse_cost(t("$", F.format_number(a / 1000, 3))).alias("cost"), S.parse_seconds(t(a, "s ±9%")).alias("seconds"),
        S.parse_scaled(t(a, "K")).alias("scaled"), S.parse_unit(t(a, " tokens/s")).alias("unit"), S.safe_float(t("n/a", a)).alias("safe"),
    )


@query(with_sql("names", "SELECT model_name, NULLIF(regexp_extract(lower(model_name), '(\\d+\\.?\\d*)b', 1), '')::DOUBLE AS params_b, len(model_name) >= 3 AND NOT regexp_matches(lower(model_name), '^(test|example|placeholder)|^model[-_]?\\d+$|^gpt-3\\.5-turbo$') AND regexp_matches(model_name, '[a-zA-Z]{2}') AS is_real, regexp_matches(lower(model_name), 'openai|gpt|claude|anthropic|google|gemini|meta|llama|mistral|cohere|ai21|o1|o3') AS vendor, regexp_matches(lower(model_name), '\\.json$') AS artifact, CASE WHEN len(model_name) > 12 THEN model_name[1:9] || '...' ELSE model_name END AS short FROM names"))
def b14_c2_c6_name_rules(spark, d):
    n = F.col("model_name")
    return P.names(spark, d).select(n, S.extract_params_b(n).alias("params_b"), S.is_real_name(n).alias("is_real"), S.has_vendor(n).alias("vendor"), S.is_artifact_name(n).alias("artifact"), S.ellipsize(n, 12).alias("short"))


@query("SELECT p_partkey, p_name, (contains(t, 'promo') OR contains(t, 'economy')) AND NOT contains(t, 'brass') AS likely, contains(n, 'language') OR contains(n, 'text') OR contains(n, 'nlp') OR contains(n, 'natural') OR contains(n, 'qa') OR contains(n, 'question') OR contains(n, 'reading') OR contains(n, 'comprehension') OR contains(n, 'generation') OR contains(n, 'classification') AS is_language FROM (SELECT *, lower(p_type || ' ' || p_name) AS t, lower(p_name || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'QA set' WHEN 1 THEN 'of Natural things' ELSE 'other' END) AS n FROM part) WHERE contains(lower(p_name), '9') OR (p_retailprice <> 0 AND contains(p_retailprice::VARCHAR, '9'))")
def c9_c13_predicates(spark, d):
    p = P.table(spark, d, "part")
    about = F.when(F.col("p_partkey") % 4 == 0, "QA set").when(F.col("p_partkey") % 4 == 1, "of Natural things").otherwise("other")
    found = p.where(S.matches_query(F.col("p_name"), [F.col("p_retailprice")], "9"))
    return found.select("p_partkey", "p_name", S.likely_leaderboard(F.col("p_type"), F.col("p_name"), ("promo", "economy"), ("brass",)).alias("likely"), S.language_related(F.col("p_name"), about).alias("is_language"))


# Pages


#: What the rows of the made tables hold, by page; the pages' own html has no table.
_MADE = "made AS (SELECT page_id, coalesce(regexp_extract(url, '://(?:www\\.|m\\.|blog\\.)?([^/.]+)', 1), '') AS host, page_id % 100 AS pct, length(url)::DOUBLE AS len FROM pages)"


@query(f"WITH {_MADE} SELECT model, metric, count(*) AS n, round(avg(value), 4) AS value FROM (SELECT host AS model, 'Score' AS metric, pct::DOUBLE AS value FROM made UNION ALL SELECT host, 'Rank', 1 FROM made UNION ALL SELECT 'base', 'Score', len FROM made UNION ALL SELECT 'base', 'Pass@1', 0.5 FROM made UNION ALL SELECT 'base', 'Rank', 3 FROM made) WHERE model <> '' GROUP BY ALL")
def a5_tables(spark, d):
    """Tables made of every page's links and headings, cut into cells and read as scores."""
    return H.table_cells_to_scores(H.extract_tables(_boards_of_pages(spark, d))).groupBy("model", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("value"))


def _boards_of_pages(spark, d):
    p = P.table(spark, d, "pages")
    row = lambda *c: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *c), F.lit("</td></tr>"))
    host = F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^/.]+)", 1)
    html = F.concat(F.lit("<table><tr><th>Model</th><th>Score</th><th>Pass@1</th></tr>"), row(host, F.concat(F.col("page_id") % 100, F.lit("%")), F.lit("-")), row(F.lit("x"), F.lit("1")), row(F.lit("base"), F.length("url").cast("string"), F.lit("0.5")), F.lit("</table>"), "html")
    return p.select("page_id", html.alias("html"))


@query("SELECT page_id, 1 AS pattern_no, page_id AS rank, true AS name_is_null FROM pages")
def a8_embedded_json(spark, d):
    """A script put before every page's own html: the first pattern's match doesn't parse, the second's does once it is mended."""
    p = P.table(spark, d, "pages").select("page_id", F.concat(F.lit("<script>var bad = {oops; var data = {rank: "), F.col("page_id"), F.lit(", /* x */ name: undefined,};</script>"), "html").alias("html"))
    found = H.extract_embedded_json(p, [r"var bad = (\{.*?;)", r"var data = (\{.*?\});"])
    return found.select("page_id", "pattern_no", F.get_json_object("json", "$.rank").cast("long").alias("rank"), F.get_json_object("json", "$.name").isNull().alias("name_is_null"))


@query(f"WITH {_MADE} SELECT page_id, host AS model, pct::DOUBLE AS value, 'range' AS rule FROM made UNION ALL SELECT page_id, 'base', len, 'range' FROM made WHERE len <= 2000 UNION ALL SELECT page_id, 'base', 0.5, 'range' FROM made WHERE len > 2000 UNION ALL SELECT page_id, 'base', len, 'two' FROM made WHERE len > 0 UNION ALL SELECT page_id, host, pct::DOUBLE, 'keyword' FROM made WHERE host <> '' UNION ALL SELECT page_id, 'base', CASE WHEN len <= 1 THEN len * 100 ELSE len END, 'keyword' FROM made")
def a6_a7_cell_rules(spark, d):
    cells = H.extract_tables(_boards_of_pages(spark, d))
    a = H.table_cells_first_in_range(cells, 0).select("page_id", "model", "value", F.lit("range").alias("rule"))
    b = H.table_cells_two_column(cells).select("page_id", "model", "value", F.lit("two").alias("rule"))
    c = H.table_cells_keyword(cells).select("page_id", "model", "value", F.lit("keyword").alias("rule"))
    return a.union(b).union(c)


@query("SELECT page_id, 'm' || page_id AS model, 'chat' AS model_type, 1::DOUBLE AS rank, (page_id % 90)::DOUBLE AS average, 40.5::DOUBLE AS ifeval, NULL::DOUBLE AS mmlu_pro, 3::DOUBLE AS co2_cost FROM pages")
def a12_map_headers(spark, d):
    """A board before every page's own html, one row of which has no score."""
    row = lambda *c: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *c), F.lit("</td></tr>"))
    head = F.lit("<table><tr><th>Rank</th><th>Model Name</th><th>T(ype)</th><th>Average ↑</th><th>IFEval</th><th>MMLU-PRO</th><th>CO₂ cost (co)</th></tr>".replace("T(ype)", "Type"))
    html = F.concat(head, row(F.lit("1"), F.concat(F.lit("m"), "page_id"), F.lit("chat"), (F.col("page_id") % 90).cast("string"), F.lit("40.5%"), F.lit("-"), F.lit("3")), row(F.lit("2"), F.lit("none"), F.lit("chat"), F.lit("-"), F.lit("N/A"), F.lit(""), F.lit("1")), F.lit("</table>"), "html")
    cells = H.extract_tables(P.table(spark, d, "pages").select("page_id", html.alias("html")))
    return H.map_headers(cells).select("page_id", "model", "model_type", "rank", "average", "ifeval", "mmlu_pro", "co2_cost")


_SCAN = "SELECT page_id, 'elo-' || page_id % 5 AS model, 1000 + page_id % 100 AS value FROM pages"
_NEAR = "SELECT page_id, 'gpt' AS model, 77.5 AS value FROM pages"
_CARDS = "SELECT page_id, trim(name) AS model, (pos - 1) + 1 AS value FROM (SELECT page_id, generate_subscripts(l, 1) AS pos, regexp_extract(unnest(l), '>([^<]*)</a>', 1) AS name FROM (SELECT page_id, regexp_extract_all(html, '<li>([^\\n\\r]*?)</li>', 1) AS l FROM pages)) WHERE trim(name) <> ''"


@query(f"SELECT page_id, model, value::DOUBLE AS value FROM ({_SCAN} UNION ALL {_NEAR} UNION ALL {_CARDS})")
def a9_a11_text_rules(spark, d):
    p = P.table(spark, d, "pages")
    end = F.concat(F.lit("\nelo-"), F.col("page_id") % 5, F.lit(" 1"), F.lpad((F.col("page_id") % 100).cast("string"), 3, "0"), F.lit("\nfar\nfar\ngpt line\n77.5 points"))
    scan = H.regex_scan(p.withColumn("html", F.concat("html", end)), r"(elo-\d)\s(\d{4})", 500, 2000).select("page_id", F.col("name").alias("model"), F.col("score").alias("value"))
    near = H.proximity_scores(p.withColumn("html", end), "gpt", F.col("html")).select("page_id", "model", "value")
    cards = H.extract_cards(p, r"<li>([^\n\r]*?)</li>", r">([^<]*)</a>", r"data-score=\"([^\"]*)\"").select("page_id", "model", F.col("rank").cast("double").alias("value"))
    return scan.union(near).union(cards)


# Changes of state


def _folder(spark, name: str) -> str:
    return shared_path(spark, name)


@query(with_sql("facts", "SELECT score_id, leaderboard, round(CASE WHEN leaderboard = 'HELM Views' THEN value + 1 ELSE value END, 4) AS value FROM facts"))
def a13_a14_overwrite_and_replace(spark, d):
    """A table overwritten by all facts, then one leaderboard's partition replaced."""
    path, first = _folder(spark, "facts"), _folder(spark, "first")
    f = P.facts(spark, d).select("score_id", "leaderboard", "value")
    T.overwrite(f.where("score_id % 2 = 0"), first)
    T.overwrite(f, first)
    T.replace_partition(T.read_current(spark, first), path)
    T.replace_partition(f.where("leaderboard = 'HELM Views'").withColumn("value", F.col("value") + 1), path)
    return rounded(T.read_current(spark, path), "value").select("score_id", "leaderboard", "value")


@query(with_sql("facts", "SELECT score_id, model_name, round(value, 4) AS value FROM facts"))
def a15_json_export(spark, d):
    path = _folder(spark, "json")
    T.export_json(rounded(P.facts(spark, d), "value").select("score_id", "model_name", "value"), path)
    return spark.read.schema("score_id long, model_name string, value double").json(path)


@query("SELECT 'model-' || user_id AS model, event_type AS metric, max(value) AS value FROM events GROUP BY user_id, event_type")
def a1_b1_score_dump(spark, d):
    """Dumps of a source a user, a file a part, written as JSON and read again as records."""
    e = P.table(spark, d, "events")
    scores = e.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("scores"))
    path = _folder(spark, "dump")
    record = F.struct(F.concat(F.lit("model-"), "user_id").alias("model"), "scores", F.lit("events").alias("source"))
    part = scores.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(16)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "user_id"), F.array(record))))).alias("value"))
    part.repartition(16, "part").select("value").write.text(path)
    dumps = T.read_score_dump(spark, path, "sources", lines=True)
    return T.unpivot_scores(T.valid_record(dumps)).select("model", "metric", "value")


@query("SELECT 's' || user_id % 16 AS source_key, 'user ' || user_id AS model, event_type AS metric, max(value) AS value FROM events GROUP BY user_id, event_type")
def a1_large_dump(spark, d):
    """Dumps of sixteen sources as JSON files of many lines, read in blocks."""
    e = P.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    scores = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("scores"))
    name = F.concat(F.lit("s"), F.pmod("user_id", F.lit(16)))
    records = scores.select(name.alias("source"), F.lit(1).alias("place"), F.concat(F.to_json(F.struct(F.concat(F.lit("user "), "user_id").alias("model"), "scores")), F.lit(",")).alias("value"))
    names = records.select("source").distinct()
    around = [names.select("source", F.lit(0).alias("place"), F.concat(F.lit('{"'), "source", F.lit('": [')).alias("value")), names.select("source", F.lit(2).alias("place"), F.lit("null]}").alias("value"))]
    path = _folder(spark, "dump")
    records.union(around[0]).union(around[1]).repartition(16, "source").sortWithinPartitions("source", "place").select("value").write.text(path)
    return T.unpivot_scores(T.valid_record(T.read_large_dump(spark, path, "sources"))).select("source_key", "model", "metric", "value")


@query("SELECT s_name AS model, 'acctbal' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_name, 'nation', s_nationkey FROM supplier")
def a3_csv_board(spark, d):
    path = _folder(spark, "csv")
    P.table(spark, d, "supplier").select(F.col("s_name").alias("model"), F.concat(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), F.lit("%")).alias("acctbal"), F.col("s_nationkey").alias("nation"), F.lit("N/A").alias("note")).write.csv(path, header=True)
    return T.read_score_csv(spark, path)


@query("SELECT part_benchmark || '_' || kind AS metric, model, value FROM (SELECT 'supplier-' || l_suppkey AS model, l_returnflag AS part_benchmark, kind, value FROM (SELECT l_suppkey, l_returnflag, round(max(l_tax), 2) AS base, round(max(l_quantity), 2) AS plus FROM lineitem GROUP BY ALL) UNPIVOT (value FOR kind IN (base, plus)))")
def b11_nested_scores(spark, d):
    g = P.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.max("l_tax"), 2).alias("base"), F.round(F.max("l_quantity"), 2).alias("plus"))
    text = F.to_json(F.create_map(F.concat(F.lit("supplier-"), "l_suppkey"), F.create_map("l_returnflag", F.struct("base", "plus"))))
    return T.nested_scores_to_facts(g.select(text.alias("t")), "t").select("metric", "model", "value")


@query(with_sql("facts", "SELECT score_id, CASE metric WHEN 'elo_rating' THEN 'Rating' WHEN 'exact_match' THEN 'Exact Match' WHEN 'accuracy' THEN 'Accuracy' WHEN 'cost' THEN 'Cost' ELSE 'Latency' END AS metric FROM facts"))
def b5_rename_metrics(spark, d):
    return P.facts(spark, d).select("score_id", S.rename_metric(F.col("metric"), {"elo_rating": "Rating"}).alias("metric"))


@query("SELECT p_partkey, p_retailprice, p_retailprice * 1000 AS cost_per_million FROM part WHERE p_retailprice > 0")
def b19_prices(spark, d):
    return T.price_facts(P.table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query()
def e8_fuzzy(spark, d):
    f = P.facts(spark, d).select("model_name").distinct()
    return N.fuzzy_match(f.select(F.replace("model_name", F.lit("model-"), F.lit("Modle_")).alias("model_name")), f.select(F.col("model_name").alias("canonical_name")))


@query()
def e11_learn_aliases(spark, d):
    a = P.aliases(spark, d)
    return N.learn_aliases(N.resolve_names(name_pool(spark, d), a), a).select("alias", "canonical_name", "source", "confidence_score")


@query()
def e16_suggest(spark, d):
    return N.suggest_aliases(e9_normalize_names(spark, d), 50)


@query(with_sql("facts aliases", "SELECT model_name AS original_name, CASE WHEN model_name IN (SELECT alias FROM aliases) THEN 'pending' WHEN length(model_name) % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM (SELECT DISTINCT model_name FROM facts)"))
def e17_e18_review_queue(spark, d):
    f, a = P.facts(spark, d).select(F.col("model_name").alias("original_name")).distinct(), P.aliases(spark, d)
    new = f.withColumn("suggested_canonical", F.lit("family-1"))
    queue = N.queue_upsert(new.limit(10).withColumn("status", F.lit("approved")), new)
    known = a.select(F.col("alias").alias("original_name"))
    decide = f.join(known, "original_name", "left_anti").withColumn("decision", F.when(F.length("original_name") % 2 == 0, "approve").otherwise("reject")).withColumn("reviewer", F.lit("x")).withColumn("reviewed_at", as_of())
    return N.apply_reviews(queue, decide, a)[0].select("original_name", "status")


@query(with_sql("facts aliases", "SELECT total, mapped, auto_normalized, review_needed, total - mapped - auto_normalized - review_needed AS unresolved FROM (SELECT count(*) AS total, count(*) FILTER (k = 0) AS mapped, count(*) FILTER (k = 1) AS auto_normalized, count(*) FILTER (k = 2) AS review_needed FROM (SELECT model_name, CASE WHEN model_name IN (SELECT alias FROM aliases) THEN 0 WHEN u % 5 < 2 THEN 1 WHEN u % 5 = 2 THEN 2 ELSE 3 END AS k FROM (SELECT DISTINCT model_name, replace(model_name, 'model-', '')::BIGINT AS u FROM facts)))"))
def e19_process_batch(spark, d):
    """A batch of the facts' names, of which those without an alias carry the name of a known family, one that leaves doubt, or none."""
    f = P.facts(spark, d).select("model_name").distinct()
    u = F.replace("model_name", F.lit("model-"), F.lit("")).cast("long")
    known = F.col("alias").isNotNull()
    name = F.when(known, F.col("model_name")).when(u % 5 < 2, F.concat(F.lit("openai gpt-3.5-turbo "), u)).when(u % 5 == 2, F.concat(F.lit("my claude-3-opus "), u)).otherwise(F.concat(F.lit("x"), u))
    batch = f.join(P.aliases(spark, d).select("alias"), F.col("model_name") == F.col("alias"), "left").select(name.alias("model_name"))
    rules = N.family_rules({"GPT-3.5 Turbo": (r"gpt-3\.5-turbo\s\d",), "Claude": (r"claude-3-opus",)})
    return N.process_batch(N.normalize_names(batch, P.aliases(spark, d), rules, fuzzy=False))


# Streams: each reads a table as a stream, runs until all of it is processed, and returns what was written.


#: Rows of a file of a stream's source, about.
FILE_ROWS = 1_000_000


def _events_stream(spark, d, batches: int = 3, twice: bool = False):
    """events dealt over several batches by time, so that a stream carries state from batch to batch; a batch is as many files as its rows ask
    for. With `twice` each is in two batches, which are written one after the other, as files are taken by their age."""
    path = _folder(spark, "events")
    e = P.table(spark, d, "events")
    files = -(-max(e.count(), 1) * (1 + twice) // (batches * FILE_ROWS))
    if twice:
        for k in range(batches):
            part = F.pmod(F.xxhash64("event_id"), F.lit(batches))
            e.where(part.isin(k, (k + 1) % batches)).repartition(files).write.mode("append").parquet(path)
    else:
        e.repartitionByRange(batches * files, "ts", "event_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def _facts_stream(spark, d, twice: bool = False):
    return P.facts_of(_events_stream(spark, d, twice=twice))


def _ran(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    path, state = _folder(spark, "stream"), _folder(spark, "state")
    if mode == "append":
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    else:
        df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query(with_sql("norm", "SELECT score_id, normalization_method, round(normalized_value, 4) AS normalized_value FROM norm"))
def l1_stream_normalize(spark, d):
    from scorelake.streaming.streams import stream_normalize

    s = stream_normalize(_facts_stream(spark, d).drop("category"), P.boards(spark))
    return rounded(_ran(spark, s), "normalized_value").select("score_id", "normalization_method", "normalized_value")


@query(with_sql("facts", "SELECT count(*) AS n FROM (SELECT DISTINCT model_name, leaderboard, benchmark, scraped_at FROM facts)"))
def l2_stream_dedup(spark, d):
    from scorelake.streaming.streams import stream_dedup

    f = _facts_stream(spark, d, twice=True)
    own = f.select("model_name", "leaderboard", "benchmark", "scraped_at")
    return _ran(spark, stream_dedup(own, "400 days")).agg(F.count("*").alias("n"))


@query(with_sql("facts", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS scores, count(DISTINCT model_name) AS models FROM (SELECT model_name, unnest(generate_series(date_trunc('hour', scraped_at) - INTERVAL 23 HOUR, date_trunc('hour', scraped_at), INTERVAL 1 HOUR)) AS w FROM facts) GROUP BY w"))
def l3_stream_volume(spark, d):
    from scorelake.streaming.streams import rolling_volume, stream_panes

    return rolling_volume(_ran(spark, stream_panes(_facts_stream(spark, d), delay="400 days"), "complete")).withColumn("start", when_text("start")).drop("end")


@query(with_sql("facts", "SELECT model_name, benchmark, round(arg_max(value, (scraped_at, score_id)), 4) AS value FROM facts GROUP BY ALL"))
def l4_stream_upsert(spark, d):
    from scorelake.streaming.streams import read_upserts, stream_upsert

    path = _folder(spark, "upserts")
    stream_upsert(_facts_stream(spark, d), path, _folder(spark, "state"), 8).trigger(availableNow=True).start().awaitTermination()
    return rounded(read_upserts(spark, path), "value").select("model_name", "benchmark", "value")


@query(with_sql("facts", "SELECT model_name, benchmark, round(arg_max(value, (scraped_at, score_id)), 4) AS value, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM facts GROUP BY ALL"))
def l4_stream_latest(spark, d):
    from scorelake.streaming.streams import read_latest, stream_latest

    state = _folder(spark, "state")
    changes = stream_latest(_facts_stream(spark, d))
    changes.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return rounded(read_latest(spark, state), "value").withColumn("updated_at", when_text("updated_at"))


@query(BATTLES_SQL)
def l5_stream_win_rates(spark, d):
    from scorelake.streaming.streams import stream_win_rates

    return _ran(spark, stream_win_rates(battles_of(_events_stream(spark, d))), "complete")


# More rules on rows


@query("SELECT event_id, CASE WHEN value / 500 <= 1 THEN round(value / 500 * 100, 6) ELSE round(value / 500, 6) END AS pct, CASE event_type WHEN 'click' THEN 'chat' ELSE 'unknown' END AS kind, CASE WHEN s >= 86400 THEN (s // 86400) || ' days ago' WHEN s >= 3600 THEN (s // 3600) || ' hours ago' ELSE (s // 60) || ' minutes ago' END AS age, coalesce(nullif(event_type, 'view'), 'seen') AS present FROM (SELECT *, epoch(TIMESTAMP '2024-02-01')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)")
def d9_d13_more_scalars(spark, d):
    e = P.table(spark, d, "events")
    kind = S.model_type(F.concat(F.when(F.col("event_type") == "click", "💬").otherwise(""), "event_type"))
    return e.select("event_id", F.round(S.to_percent_if_unit(F.col("value") / 500), 6).alias("pct"), kind.alias("kind"), S.age_text(F.col("ts").cast("timestamp"), as_of()).alias("age"), S.first_present(F.nullif("event_type", F.lit("view")), F.lit("seen"), truthy=True).alias("present"))


@query(with_sql("names", "SELECT model_name, trim(regexp_replace(regexp_replace(model_name, '\\s*\\([^)]*\\)$', ''), '\\s+', ' ', 'g')) AS paper, contains(lower(model_name), 'gpt') OR contains(lower(model_name), 'claude') AS provider, contains(lower(model_name), 'run') AS hit, model_name AS fixed FROM names"))
def c7_c11_e3_name_filters(spark, d):
    n = F.col("model_name")
    return P.names(spark, d).select(n, S.clean_paper_name(n).alias("paper"), S.of_providers(n, ["GPT", "Claude"]).alias("provider"), S.contains_query(n, "RUN").alias("hit"), S.fix_known_name(n).alias("fixed"))


@query(with_sql("facts", "SELECT count(*) AS n, count(DISTINCT benchmark) AS benchmarks FROM facts WHERE category = 'software_engineering'"))
def c8_coding_facts(spark, d):
    return P.facts(spark, d).where(S.is_coding(F.col("category"))).agg(F.count("*").alias("n"), F.countDistinct("benchmark").alias("benchmarks"))


@query(with_sql("norm aliases", "SELECT profile_rank, n.category, count(*) AS n, round(avg(normalized_value), 4) AS score FROM norm n JOIN (SELECT alias AS model_name, row_number() OVER (ORDER BY alias) AS profile_rank FROM aliases QUALIFY row_number() OVER (ORDER BY alias) <= 20) t USING (model_name) GROUP BY ALL"))
def g2_g8_restrict_to_top(spark, d):
    top = B.with_rank(P.aliases(spark, d).select(F.col("alias").alias("model_name"), F.lit(0).alias("s")).orderBy("model_name").limit(20), "s").select("model_name", F.col("rank").alias("profile_rank"))
    f, n = P.facts(spark, d), norm(spark, d).select("score_id", "normalized_value")
    kept = f.join(n, "score_id").join(top, "model_name")
    return kept.groupBy("profile_rank", "category").agg(F.count("*").alias("n"), F.round(F.avg("normalized_value"), 4).alias("score"))


@query("SELECT 'supplier-' || l_suppkey AS model_name, benchmark, metric, round(value, 4) AS value, up AS higher_is_better FROM (SELECT l_suppkey, 'Quantity' AS benchmark, 'Mean' AS metric, avg(l_quantity) AS value, true AS up FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'TAX', 'Score', avg(l_tax), true FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'Overall Performance', 'mean_win_rate', avg(l_discount), true FROM lineitem GROUP BY 1)")
def b7_helm_to_facts(spark, d):
    g = P.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.avg("l_discount").alias("mean_win_rate"))
    dim = spark.createDataFrame([("quantity", "Quantity", "Mean", True)], "benchmark string, full_name string, metric string, higher_is_better boolean")
    return rounded(T.helm_to_facts(g.select(F.concat(F.lit("supplier-"), "l_suppkey").alias("model_name"), "quantity", "tax", "mean_win_rate"), dim), "value")


@query("SELECT s_name AS model, metric, value FROM (SELECT s_name, 'a' AS metric, s_acctbal / 100 AS value FROM supplier UNION ALL SELECT s_name, 'b', s_nationkey::DOUBLE FROM supplier) WHERE value BETWEEN 0 AND 100")
def c4_clean_medical(spark, d):
    s = P.table(spark, d, "supplier").select(F.concat(F.lit("★ "), "s_name", F.lit(" ")).alias("model"), F.col("s_suppkey").alias("place"), (F.col("s_acctbal") / 100).cast("string").alias("a"), F.col("s_nationkey").cast("string").alias("b"))
    return T.clean_medical(s.union(s.withColumn("place", F.col("place") + 100000).withColumn("b", F.lit("1"))), ["a", "b"])


@query(with_sql("comp aliases", "SELECT 'ok' AS composites, CASE WHEN p < 50 THEN 'alert' WHEN p < 80 THEN 'warning' ELSE 'ok' END AS coverage FROM (SELECT round(count(alias) * 100 / count(*), 1) AS p FROM (SELECT DISTINCT model_name FROM facts) LEFT JOIN aliases ON model_name = alias)"))
def k4_system_alerts(spark, d):
    c = composites(spark, d).withColumn("updated_at", as_of())
    return M.system_alerts(c, N.alias_coverage(P.facts(spark, d), P.aliases(spark, d)), as_of())


@query(with_sql("facts", "SELECT 'coverage' AS test, c >= 95 AS passed, 95::DOUBLE AS threshold, round(c, 6) AS actual FROM (SELECT least(100, count(*) FILTER (model_name LIKE '%1') * 100 / 15)::DOUBLE AS c FROM (SELECT DISTINCT model_name FROM facts)) UNION ALL SELECT 'empty_categories', false, 0, 1"))
def k10_k14_coverage_checks(spark, d):
    f = P.facts(spark, d)
    models = f.select("model_name").distinct()
    return M.check_coverage(models, F.col("model_name").endswith("1"), 15).union(M.check_categories(B.category_coverage(f, P.boards(spark).select("category"))))


@query(with_sql("facts", "SELECT count(DISTINCT model_name) AS models_found, count(DISTINCT model_name) FILTER (NOT old) AS models_new, count(DISTINCT benchmark) AS benchmarks_found, 0::BIGINT AS benchmarks_new, count(value) AS scores FROM (SELECT *, bool_or(score_id < 100) OVER (PARTITION BY model_name) AS old FROM facts)"))
def k19_ingest_batch(spark, d):
    f = P.facts(spark, d)
    known = f.where("score_id < 100").select(F.col("model_name").alias("model_id"))
    return M.ingest_batch(f, known, f.select(S.canonical_benchmark(F.col("benchmark")).alias("benchmark_id")))


@query(with_sql("facts aliases", "SELECT n AS before, n + (SELECT count(DISTINCT model_name) FROM facts WHERE model_name NOT IN (SELECT alias FROM aliases)) AS after, true AS recomputed FROM (SELECT count(*) + 1 AS n FROM aliases)"))
def e20_daily_normalize(spark, d):
    """Names without an alias are written as a known model's; they are sure matches and become aliases, so composites are made anew."""
    known = spark.createDataFrame([("seed-gpt", "GPT-3.5 Turbo", "GPT", "OpenAI", "seed", 1.0)], "alias string, canonical_name string, model_family string, provider string, source string, confidence_score double")
    a = P.aliases(spark, d).unionByName(known)
    n = norm(spark, d)
    rest = n.join(a.select(F.col("alias").alias("model_name")), "model_name", "left_anti").withColumn("model_name", F.concat(F.lit("gpt-3.5-turbo 1 "), "model_name"))
    both = n.join(a.select(F.col("alias").alias("model_name")), "model_name", "left_semi").unionByName(rest)
    rules = N.family_rules({"GPT-3.5 Turbo": (r"gpt-3\.5-turbo\s\d",)})
    _, after, made = N.daily_normalize(both, a, rules, recompute=lambda own: C.composite_scores(C.domain_scores(both, own), P.profiles(spark)))
    return a.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).crossJoin((made if made is not None else a.limit(0)).agg((F.count("*") > 0).alias("recomputed")))  # one row each
