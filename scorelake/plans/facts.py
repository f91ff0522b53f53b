"""The given tables as score facts, names and dimensions, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.scalars import cascade

#: event type: leaderboard, category, metric, value.
BOARDS = {
    "click": ("Arena Clicks", "comprehensive", "elo_rating", "800 + value"),
    "view": ("HELM Views", "academic", "exact_match", "value / 500"),
    "purchase": ("Legal Purchases", "legal", "accuracy", "value"),
    "signup": ("SWE Signups", "software_engineering", "cost", "value / 500"),
    "error": ("Medical Errors", "medical", "latency", "value"),
}
CATEGORIES = [b[1] for b in BOARDS.values()]
AS_OF = "2024-02-01 00:00:00"
PROFILES = [(1, "General", 0.2, 0.2, 0.2, 0.1, 0.1, 0.2), (2, "Developer", 0.6, 0.2, 0.0, 0.0, 0.0, 0.2), (3, "Clinician", 0.0, 0.1, 0.3, 0.6, 0.0, 0.0)]
PROFILE_COLUMNS = "profile_id int, name string, software_engineering_weight double, reasoning_weight double, academic_weight double, medical_weight double, legal_weight double, comprehensive_weight double"
#: Shapes of names as boards write them; # stands for a number.
SHAPES = [
    "Agentless + GPT-4o v#", "claude-3.5-sonnet-#", "Meta-Llama-3.1-70B #", "gemini_2.0_flash #", "o3 mini #", "SWE-agent + Claude 2 run #",
    "OpenAI / gpt-4.1 #", "qwen_chat ai #b", "model#", "test run #", "deepseek-coder-#b", "results-#.json",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "events"))


def facts_of(e: DataFrame) -> DataFrame:
    of = lambda k: cascade([(F.col("event_type") == t, b[k]) for t, b in BOARDS.items()])
    value = cascade([(F.col("event_type") == t, F.expr(b[3])) for t, b in BOARDS.items()], F.col("value"))
    return e.where(F.col("event_type").isin(*BOARDS)).select(
        F.col("event_id").alias("score_id"), F.concat(F.lit("model-"), "user_id").alias("model_name"), of(0).alias("leaderboard"), of(1).alias("category"),
        F.concat_ws("_", "event_type", F.pmod("event_id", F.lit(7))).alias("benchmark"), of(2).alias("metric"), value.alias("value"), (~F.col("event_type").isin("signup", "error")).alias("higher_is_better"),
        F.col("ts").cast("timestamp").alias("scraped_at"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user is an alias of one of ten families."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 = 0")
    return u.select(F.concat(F.lit("model-"), "user_id").alias("alias"), F.concat(F.lit("family-"), F.col("user_id") % 10).alias("canonical_name"), F.concat(F.lit("f"), F.col("user_id") % 4).alias("model_family"), F.concat(F.lit("p"), F.col("user_id") % 10 % 2).alias("provider"), F.lit("seed").alias("source"), F.lit(1.0).alias("confidence_score"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of one of SHAPES for every user, with a score_id for order."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("score_id"))
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.pmod("user_id", F.lit(len(SHAPES))) + 1).cast("int"))
    return u.select("score_id", F.replace(shape, F.lit("#"), F.col("user_id").cast("string")).alias("model_name"))


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_COLUMNS)


def boards(spark: SparkSession) -> DataFrame:
    """The leaderboards, and one without facts."""
    return spark.createDataFrame([(b[0], b[1]) for b in BOARDS.values()] + [("Empty Board", "finance")], "leaderboard string, category string")


def _case(k: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{b[k]}'" for t, b in BOARDS.items()) + " END"


_LOW, _HIGH = "CASE WHEN dom = 'math' THEN 1200.0 WHEN dom = 'coding' THEN 1150.0 ELSE 1100.0 END", "CASE WHEN dom = 'math' THEN 1450.0 WHEN dom = 'coding' THEN 1400.0 ELSE 1450.0 END"


def _has(col: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


SQL = {
    "facts": f"""
        SELECT event_id AS score_id, 'model-' || user_id AS model_name, {_case(0)} AS leaderboard, {_case(1)} AS category, event_type || '_' || (event_id % 7) AS benchmark, {_case(2)} AS metric,
               CASE event_type {" ".join(f"WHEN '{t}' THEN {b[3]}" for t, b in BOARDS.items())} END AS value, event_type NOT IN ('signup', 'error') AS higher_is_better, ts AS scraped_at
        FROM events WHERE event_type IN ({", ".join(f"'{t}'" for t in BOARDS)})""",
    "aliases": "SELECT DISTINCT 'model-' || user_id AS alias, 'family-' || (user_id % 10) AS canonical_name, 'f' || (user_id % 4) AS model_family, 'p' || (user_id % 10 % 2) AS provider, 'seed' AS source, 1.0 AS confidence_score FROM events WHERE user_id % 3 = 0",
    "names": f"SELECT min(event_id) AS score_id, replace(([{', '.join(repr(s) for s in SHAPES)}])[1 + user_id % {len(SHAPES)}], '#', user_id::VARCHAR) AS model_name FROM events GROUP BY user_id",
    "typed": f"""
        SELECT *, CASE WHEN {_has("t", "elo", "rating", "arena", "rank")} THEN 'elo_rating' WHEN {_has("t", "cost", "price", "dollar", "$")} THEN 'cost_metric' WHEN {_has("t", "time", "latency", "seconds", "speed")} THEN 'time_metric'
                        WHEN {_has("t", "token", "length", "count")} THEN 'token_count' WHEN {_has("t", "accuracy", "pass", "rate", "percent")} THEN 'percentage'
                        WHEN value BETWEEN 0 AND 1 AND (contains(lower(leaderboard), 'helm') OR contains(t, 'academic')) THEN 'academic_score' WHEN value BETWEEN 0 AND 1 THEN 'decimal_score' WHEN value BETWEEN 0 AND 100 THEN 'percentage2' ELSE 'unknown' END AS ty
        FROM (SELECT *, lower(metric || ' ' || benchmark || ' ' || leaderboard) AS t,
                     CASE WHEN contains(lower(category || ' ' || leaderboard), 'math') THEN 'math' WHEN {_has("lower(category || ' ' || leaderboard)", "cod", "programming")} THEN 'coding' ELSE 'general' END AS dom FROM facts)""",
    "norm": f"""
        SELECT score_id, model_name, leaderboard, category, benchmark, metric, value, higher_is_better, scraped_at,
               CASE ty WHEN 'elo_rating' THEN greatest(0, least(100, (value - ({_LOW})) / (({_HIGH}) - ({_LOW})) * 100)) WHEN 'percentage' THEN greatest(0, least(100, value)) WHEN 'percentage2' THEN value
                       WHEN 'academic_score' THEN greatest(0, least(100, value * 100)) WHEN 'decimal_score' THEN greatest(0, least(100, value * 100))
                       WHEN 'cost_metric' THEN CASE WHEN value <= 0 THEN 100 WHEN value >= 1 THEN 0 ELSE 100 * ln(1 / greatest(value, 0.001)) / ln(1000) END
                       WHEN 'time_metric' THEN CASE WHEN value <= 0.1 THEN 100 WHEN value >= 60 THEN 0 ELSE (1 - value / 60) * 100 END ELSE greatest(0, least(100, value)) END AS normalized_value,
               least(CASE ty WHEN 'elo_rating' THEN CASE WHEN value BETWEEN 800 AND 1600 THEN 0.95 ELSE 0.7 END WHEN 'cost_metric' THEN 0.9 WHEN 'time_metric' THEN 0.9 WHEN 'token_count' THEN 0.85 WHEN 'percentage' THEN CASE WHEN value BETWEEN 0 AND 100 THEN 0.95 ELSE 0.7 END
                             WHEN 'academic_score' THEN 0.9 WHEN 'decimal_score' THEN 0.8 WHEN 'percentage2' THEN 0.6 ELSE 0.3 END,
                     CASE ty WHEN 'elo_rating' THEN CASE WHEN value BETWEEN ({_LOW}) AND ({_HIGH}) THEN 0.95 WHEN value BETWEEN ({_LOW}) - 100 AND ({_HIGH}) + 100 THEN 0.8 ELSE 0.6 END
                             WHEN 'cost_metric' THEN 0.85 WHEN 'time_metric' THEN 0.85 WHEN 'percentage' THEN CASE WHEN value BETWEEN 0 AND 100 THEN 0.95 ELSE 0.7 END WHEN 'token_count' THEN CASE WHEN value BETWEEN 0 AND 100 THEN 0.95 ELSE 0.3 END WHEN 'unknown' THEN 0.3 ELSE 0.95 END)::DOUBLE AS confidence_score,
               CASE WHEN ty IN ('token_count', 'unknown') THEN CASE WHEN value BETWEEN 0 AND 100 THEN 'percentage' ELSE 'fallback_clamp' END WHEN ty = 'percentage2' THEN 'percentage' ELSE ty END AS normalization_method
        FROM typed""",
    "canon": "SELECT n.* REPLACE (coalesce(a.canonical_name, n.model_name) AS model_name) FROM norm n LEFT JOIN (SELECT alias, min(canonical_name) AS canonical_name FROM aliases GROUP BY alias) a ON n.model_name = a.alias",
    "doms": "SELECT model_name, category AS domain, CASE WHEN sum(confidence_score) > 0 THEN sum(normalized_value * confidence_score) / sum(confidence_score) ELSE avg(normalized_value) END AS score, CASE WHEN sum(confidence_score) > 0 THEN avg(confidence_score) ELSE 0.5 END AS confidence, count(*) AS n FROM canon GROUP BY ALL",
    "weights": "SELECT * FROM (VALUES " + ", ".join(f"({p[0]}, '{p[1]}', '{d}', {w}::DOUBLE)" for p in PROFILES for d, w in zip(("software_engineering", "reasoning", "academic", "medical", "legal", "comprehensive"), p[2:], strict=True)) + ") v(profile_id, profile, domain, weight)",
    "comp": """
        SELECT model_name, profile_id, profile, CASE WHEN w > 0 THEN printf('%.2f', s / w)::DOUBLE ELSE 0 END AS composite_score, CASE WHEN w > 0 THEN printf('%.3f', c / w * n / 6)::DOUBLE ELSE 0 END AS confidence_score, n AS domain_coverage,
               CASE WHEN NOT w > 0 THEN 'no_data_available' WHEN n = 6 THEN 'full_coverage' WHEN n >= 4 THEN 'high_coverage' WHEN n >= 2 THEN 'moderate_coverage' ELSE 'low_coverage' END AS method
        FROM (SELECT model_name, profile_id, profile, sum(score * weight) AS s, sum(confidence * weight) AS c, sum(weight) AS w, count(*) AS n FROM doms JOIN weights USING (domain) GROUP BY ALL)""",
}
#: What each of the named tables is built on.
NEEDS = {"typed": ["facts"], "norm": ["typed"], "canon": ["norm", "aliases"], "doms": ["canon"], "comp": ["doms", "weights"]}


def with_sql(names: str, body: str) -> str:
    """A query over the named tables."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body
