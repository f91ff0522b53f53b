"""Freshness, health and quality checks. `as_of` is always given, never the clock."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.scalars import canonical_benchmark, canonical_model, cascade
from scorelake.operators.names import _by_id, near_duplicate_count, register_benchmarks, register_models, registered_aliases, update_tracking
from scorelake.sources.versioned import VersionedTable


def hours_since(then: Column, as_of: Column) -> Column:
    return F.round((F.unix_seconds(as_of) - F.unix_seconds(then)) / 3600, 4)


def source_freshness(facts: DataFrame, boards: DataFrame, as_of: Column) -> DataFrame:
    """Every leaderboard, also one without facts: counts, first and last update, and how fresh it is."""
    g = facts.groupBy("leaderboard").agg(F.count("*").alias("n"), F.countDistinct("model_name").alias("models"), F.min("scraped_at").alias("first_update"), F.max("scraped_at").alias("last_update"))
    df = boards.join(g, "leaderboard", "left").withColumn("hours", hours_since(F.col("last_update"), as_of))
    status = cascade([(F.col("hours").isNull(), "unknown"), (F.col("hours") <= 24, "current"), (F.col("hours") <= 72, "stale")], "outdated")
    return df.select("leaderboard", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("models", F.lit(0)).alias("models"), "first_update", "last_update", "hours", status.alias("status"))


def category_freshness(facts: DataFrame, as_of: Column) -> DataFrame:
    age = (F.unix_seconds(as_of) - F.unix_seconds("scraped_at")) / 86400
    g = facts.groupBy("category").agg(F.countDistinct("leaderboard").alias("sources"), F.countDistinct("model_name").alias("models"), F.count("*").alias("n"), F.max("scraped_at").alias("latest"), F.min("scraped_at").alias("earliest"), F.round(F.avg(age), 4).alias("mean_age_days"))
    return g.withColumn("status", cascade([(F.col("mean_age_days") <= 7, "fresh"), (F.col("mean_age_days") <= 30, "moderate")], "stale"))


def stale_alerts(facts: DataFrame, boards: DataFrame, as_of: Column, max_days: float = 3) -> DataFrame:
    df = source_freshness(facts, boards, as_of)
    return df.where(F.col("hours").isNull() | (F.col("hours") > 24 * max_days)).select("leaderboard", F.when(F.col("hours").isNull(), "no data").otherwise("stale").alias("alert"))


def health_score(facts: DataFrame, composites: DataFrame, aliases: DataFrame, as_of: Column) -> DataFrame:
    """One row: a score from 100 downwards, and a state."""
    names = facts.select("model_name").distinct().join(aliases.select(F.col("alias").alias("_a")).distinct(), F.col("model_name") == F.col("_a"), "left")
    cover = names.agg(F.coalesce(F.round(F.try_divide(F.count("_a") * 100, F.count("*")), 4), F.lit(0.0)).alias("coverage"))
    f = facts.agg(F.count("*").alias("n_facts"), F.count_if(F.unix_seconds("scraped_at") > F.unix_seconds(as_of) - 86400).alias("n_recent"))
    c = composites.agg(F.count("*").alias("n_composites"))
    df = f.crossJoin(c).crossJoin(cover)  # one row each
    lost = lambda cond, n: F.when(cond, n).otherwise(0)
    score = F.greatest(F.lit(0), 100 - lost(F.col("n_facts") == 0, 50) - lost(F.col("n_composites") == 0, 30) - lost(F.col("n_recent") == 0, 20) - lost(F.col("coverage") < 80, 10))
    return df.withColumn("health", score).withColumn("state", cascade([(F.col("health") >= 80, "healthy"), (F.col("health") >= 60, "warning")], "critical"))


#: Hours within which a source of each class must be updated.
UPDATE_HOURS = {"high": 12, "medium": 24, "low": 48, "weekly": 168}


def freshness_by_class(runs: DataFrame, classes: DataFrame, as_of: Column) -> DataFrame:
    """runs: source, success, run_at; classes: source, update_class. Per source: hours since its last success, share of successes, alerts."""
    g = runs.groupBy("source").agg(F.max(F.when(F.col("success"), F.col("run_at"))).alias("last"), F.round(F.avg(F.col("success").cast("double")) * 100, 4).alias("success_pct"))
    limit = cascade([(F.col("update_class") == k, h) for k, h in UPDATE_HOURS.items()], 24)
    df = classes.join(g, "source", "left").withColumn("hours", hours_since(F.col("last"), as_of))
    return df.select("source", "update_class", "hours", "success_pct", (F.col("hours").isNull() | (F.col("hours") > limit)).alias("is_late"), (F.coalesce("success_pct", F.lit(0.0)) < 95).alias("is_failing"))


def ingestion_totals(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Per source over the last days: models found and scores ingested in all, and when it last ran. runs has models_found, scores_ingested."""
    df = runs.where(F.unix_seconds("run_at") > F.unix_seconds(as_of) - days * 86400)
    return df.groupBy("source").agg(F.sum("models_found").alias("total_models"), F.sum("scores_ingested").alias("total_scores"), F.max("run_at").alias("last_run"))


def ingestion_stats(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    df = runs.where(F.unix_seconds("run_at") > F.unix_seconds(as_of) - days * 86400)
    return df.groupBy("source").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("double")) * 100, 4).alias("success_pct"), F.round(F.avg("duration"), 4).alias("avg_duration"))


def check(name: str, df: DataFrame, actual: Column, threshold: float, at_least: bool = True) -> DataFrame:
    """One row: test, passed, threshold, actual. An empty table has the actual value 0."""
    value = F.coalesce(F.round(actual.cast("double"), 6), F.lit(0.0))
    row = df.agg(value.alias("actual"))
    return row.select(F.lit(name).alias("test"), (F.col("actual") >= threshold if at_least else F.col("actual") <= threshold).alias("passed"), F.lit(float(threshold)).alias("threshold"), "actual")


def run_checks(norm: DataFrame, aliases: DataFrame, as_of: Column, limits: Mapping[str, float] | None = None, runs: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """All quality checks, a row each: those of sources' success and of near-duplicate names where runs and names are given."""
    lim = {"models": 10, "scores": 100, "hours": 48, "wild": 1, "confidence": 0.7, "rows": 1000, "success": 80, "near": 10} | dict(limits or {})
    recent = norm.where(F.unix_seconds("scraped_at") > F.unix_seconds(as_of) - 86400)
    orphan = aliases.select("canonical_name").distinct().join(norm.select(F.col("model_name").alias("canonical_name")).distinct(), "canonical_name", "left_anti")
    double = aliases.groupBy("alias").count().where("count > 1")
    n = F.col("normalized_value")
    more = []
    if runs is not None:
        more.append(check("source_success_pct", ingestion_stats(runs, as_of), F.coalesce(F.min("success_pct"), F.lit(100.0)), lim["success"]))
    if names is not None:
        more.append(check("near_duplicate_names", near_duplicate_count(names), F.first("n_pairs"), lim["near"] - 1, False))  # fewer than the limit
    return reduce(
        DataFrame.unionByName,
        [
            check("daily_models", recent, F.countDistinct("model_name"), lim["models"]),
            check("daily_scores", recent, F.count("*"), lim["scores"]),
            check("freshness_hours", norm, F.coalesce((F.unix_seconds(F.first(as_of)) - F.max(F.unix_seconds("scraped_at"))) / 3600, F.lit(999.0)), lim["hours"], False),
            check("wild_values_pct", norm, F.avg((F.abs(n) > 1000).cast("double")) * 100, lim["wild"], False),
            check("mean_confidence", norm, F.avg("confidence_score"), lim["confidence"]),
            check("duplicate_aliases", double, F.count("*"), 0, False),
            check("orphan_aliases", orphan, F.count("*"), 0, False),
            check("rows", norm, F.count("*"), lim["rows"]),
            check("max_value", norm, F.max(F.abs(n)), 10000, False),
            check("mean_value", norm, F.avg(n), 100, False),
            *more,
        ],
    )


#: Levels of what a failed check raises, and what it is about.
CHECK_LEVELS = {
    "daily_models": ("warning", "models in the last 24 hours"),
    "daily_scores": ("warning", "scores in the last 24 hours"),
    "source_success_pct": ("error", "lowest success rate of a source"),
    "freshness_hours": ("error", "hours since the latest score"),
    "wild_values_pct": ("warning", "share of normalised values beyond 1000"),
    "mean_confidence": ("warning", "mean confidence"),
    "duplicate_aliases": ("error", "aliases on record twice"),
    "orphan_aliases": ("warning", "canonical names without a model"),
    "near_duplicate_names": ("info", "pairs of nearly equal names"),
    "rows": ("critical", "normalised rows"),
    "max_value": ("warning", "largest normalised value"),
    "mean_value": ("warning", "mean normalised value"),
}


def with_messages(checks: DataFrame) -> DataFrame:
    """checks with a message, and level: that of the alert which a failed check raises, null for one that passed. Unlisted checks warn."""
    test = F.col("test")
    about = cascade([(test == k, text) for k, (_, text) in CHECK_LEVELS.items()], test)
    level = cascade([(test == k, lv) for k, (lv, _) in CHECK_LEVELS.items()], "warning")
    number = lambda c: F.format_string("%.2f", c)
    return checks.withColumn("message", F.concat(about, F.lit(": "), number("actual"), F.lit(" (threshold "), number("threshold"), F.lit(")"))).withColumn("level", F.when(~F.col("passed"), level))


def source_health(stats: DataFrame, limit: float = 80) -> DataFrame:
    """One row on the sources of ingestion_stats: whether all succeed often enough, the share that do, and the names of those that don't."""
    bad = F.col("success_pct") < limit
    g = stats.agg(F.count("*").alias("n"), F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("source")))), ", ").alias("names"))
    return g.select(F.lit("source_health").alias("test"), (F.col("failed") == 0).alias("passed"), F.lit(limit / 100).alias("threshold"), F.when(F.col("n") == 0, 1.0).otherwise(1 - F.col("failed") / F.nullif("n", F.lit(0))).alias("actual"), F.when(F.col("failed") == 0, "All sources healthy").otherwise(F.concat(F.lit("Failed sources: "), "names")).alias("message"))


def checks_summary(checks: DataFrame) -> DataFrame:
    """One row: checks passed and failed, success rate, and the alerts of each level."""
    own = with_messages(checks)
    levels = (F.count_if(F.col("level") == x).alias(f"{x}_alerts") for x in ("info", "warning", "error", "critical"))
    return own.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg(F.col("passed").cast("double")) * 100, 4).alias("success_pct"), *levels)


def validate_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: missing values of each field."""
    return df.agg(*(F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields))


def _content(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and content_hash of records grouped by `by`: see content_hashes."""
    cols = [c for c in sorted(records.columns) if c not in by]
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    g = records.select(*by, digest.alias("d")).groupBy(*by).agg(*words, F.count("*").alias("n"))
    return g.select(*by, F.sha2(F.concat_ws("|", *(f"w{i}" for i in range(8)), "n"), 256).alias("content_hash"))


def content_hashes(records: DataFrame, source: str = "source") -> DataFrame:
    """Per source a SHA-256 of its records as canonical JSON (keys in order, nulls kept), whatever the records' order.

    Each record's JSON is hashed, equal ones counted; the digests of a source are summed in eight 32-bit words, each weighted by how often the
    record occurs, and the sums with the count are hashed again. Sums are combined before the shuffle, so no source is gathered.
    """
    return _content(records, [source])


def key_path(key: Column, levels: int) -> Column:
    """The leaf of a tree of 16 ** levels leaves that a key's records are in: hexadecimal digits of the key's MD5."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, levels)


def content_tree(records: DataFrame, key: str, source: str = "source", levels: int = 2) -> DataFrame:
    """source, path and content_hash of every node of a hash tree a source. A leaf holds the records of the keys of its path, hashed as
    content_hashes does; a node above is the SHA-256 of its children's hashes in order of their paths, joined by |. The root's path is empty.
    Empty leaves have no node."""
    level = _content(records.withColumn("path", key_path(F.col(key), levels)), [source, "path"])
    tree = level
    for depth in range(levels - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("path", "content_hash")))  # 16 at most
        level = level.groupBy(source, F.substring("path", 1, depth).alias("path")).agg(F.sha2(F.array_join(F.transform(children, lambda x: x["content_hash"]), "|"), 256).alias("content_hash"))
        tree = tree.unionByName(level)
    return tree


def changed_ranges(tree: DataFrame, last: DataFrame, source: str = "source", levels: int = 2) -> DataFrame:
    """source and path of the leaves that differ from the last tree on record, new and vanished ones too. Only below nodes that differ are
    children compared, from the roots down."""
    old = last.select(F.col(source).alias("_source"), F.col("path").alias("_path"), F.col("content_hash").alias("_old"))
    both = tree.join(old, (tree[source] == F.col("_source")) & (tree["path"] == F.col("_path")), "full_outer")
    differ = both.where(~F.col("content_hash").eqNullSafe(F.col("_old"))).select(F.coalesce(source, "_source").alias(source), F.coalesce("path", "_path").alias("path"))
    found = differ.where("path = ''")
    for depth in range(1, levels + 1):
        here = differ.where(F.length("path") == depth)
        found = here.join(found.withColumnsRenamed({source: "_above", "path": "_parent"}), (F.col(source) == F.col("_above")) & (F.substring("path", 1, depth - 1) == F.col("_parent")), "left_semi")
    return found


def changed_records(records: DataFrame, ranges: DataFrame, key: str, source: str = "source", levels: int = 2) -> DataFrame:
    """The records of the leaves that changed_ranges names: all that has to be taken in."""
    own = records.withColumn("_path", key_path(F.col(key), levels))
    return own.join(ranges.withColumnsRenamed({source: "_source", "path": "_leaf"}), (F.col(source) == F.col("_source")) & (F.col("_path") == F.col("_leaf")), "left_semi").drop("_path")


def changed_sources(records: DataFrame, last: DataFrame, source: str = "source") -> DataFrame:
    """Sources whose content differs from the last hash on record."""
    now = content_hashes(records, source)
    old = last.select(source, F.col("content_hash").alias("_old"))
    return now.join(old, source, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("content_hash"))).drop("_old")


def system_alerts(composites: DataFrame, aliases_pct: DataFrame, as_of: Column) -> DataFrame:
    """One row: whether composites are missing or over 48 hours old (updated_at), and whether coverage (coverage_pct) is below 80 or 50."""
    c = composites.agg(F.count("*").alias("n"), F.max("updated_at").alias("last"))
    df = c.crossJoin(aliases_pct.select("coverage_pct"))  # one row each
    old = cascade([(F.col("n") == 0, "alert"), (hours_since(F.col("last"), as_of) > 48, "warning")], "ok")
    cover = cascade([(F.coalesce("coverage_pct", F.lit(0.0)) < 50, "alert"), (F.col("coverage_pct") < 80, "warning")], "ok")
    return df.select(old.alias("composites"), cover.alias("coverage"))


def check_coverage(registry: DataFrame, wanted: Column, denominator: int, limit: float = 95) -> DataFrame:
    """Check: registered rows that are wanted, against how many there should be."""
    return check("coverage", registry, F.least(F.lit(100.0), F.count_if(wanted) * 100 / denominator), limit)


def check_categories(coverage: DataFrame) -> DataFrame:
    """Check: no listed category without a benchmark."""
    return check("empty_categories", coverage, F.count_if(F.col("n") == 0), 0, False)


def ingest_batch(facts: DataFrame, registry: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """One row of counts of a batch: models and benchmarks found and new, scores."""
    m = facts.select(canonical_model(F.col("model_name"), strip_version=False).alias("model_id")).distinct().join(registry.select("model_id", F.lit(1).alias("old")).distinct(), "model_id", "left").agg(F.count("*").alias("models_found"), F.count_if(F.col("old").isNull()).alias("models_new"))
    b = facts.select(canonical_benchmark(F.col("benchmark")).alias("benchmark_id")).distinct().join(benchmarks.select("benchmark_id", F.lit(1).alias("old")).distinct(), "benchmark_id", "left").agg(F.count("*").alias("benchmarks_found"), F.count_if(F.col("old").isNull()).alias("benchmarks_new"))
    return m.crossJoin(b).crossJoin(facts.agg(F.count("value").alias("scores")))  # one row each


@dataclass
class Store:
    """The registries and facts that batches are ingested to: models (model_id, first_seen, last_seen, n_scores), aliases (alias, model_id),
    tracking (model_id, leaderboard, last_seen, is_present), benchmarks and benchmark_aliases as register_benchmarks has them, facts."""

    models: DataFrame
    aliases: DataFrame
    tracking: DataFrame
    benchmarks: DataFrame
    benchmark_aliases: DataFrame
    facts: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, facts: DataFrame) -> Store:
        """No rows; facts gives its columns."""
        none = lambda ddl: spark.createDataFrame([], ddl)
        benchmarks = "benchmark_id string, display_name string, category string, auto_discovered boolean, is_active boolean, default_weight double, last_updated timestamp"
        return cls(
            none("model_id string, first_seen timestamp, last_seen timestamp, n_scores long"), none("alias string, model_id string"),
            none("model_id string, leaderboard string, last_seen timestamp, is_present boolean"), none(benchmarks), none("alias string, benchmark_id string"), facts.limit(0),
        )


#: Keys of the store's tables.
STORE_KEYS = {"models": ["model_id"], "aliases": ["alias", "model_id"], "tracking": ["model_id", "leaderboard"], "benchmarks": ["benchmark_id"], "benchmark_aliases": ["alias", "benchmark_id"], "facts": ["model_name", "benchmark"]}


def new_facts(batch: DataFrame, store: Store) -> DataFrame:
    """The batch's facts that have a value, under the ids that they are registered by."""
    ids = _by_id(batch, store.models, store.aliases).where("value is not null")
    rows = ids.select(F.col("model_id").alias("model_name"), canonical_benchmark(F.col("benchmark")).alias("benchmark"), *(c for c in store.facts.columns if c not in ("model_name", "benchmark")))
    return rows.select(*store.facts.columns)


def ingest(batch: DataFrame, store: Store, as_of: Column) -> Store:
    """store with a batch of facts put in: models, their aliases and sources registered, benchmarks and their aliases too, and the facts that
    have a value appended under the registered ids. Null values count as found, but give no fact."""
    models = register_models(batch, store.models, store.aliases).drop("is_new")
    aliases = registered_aliases(batch, store.models, store.aliases)
    tracking = update_tracking(store.tracking, batch, store.models, store.aliases)
    named = batch.select(F.col("benchmark").alias("name"), F.lit("").alias("description")).distinct()
    benchmarks, benchmark_aliases = register_benchmarks(named, store.benchmarks, store.benchmark_aliases, as_of)
    return Store(models, aliases, tracking, benchmarks.drop("is_new"), benchmark_aliases, store.facts.unionByName(new_facts(batch, store)))


def open_store(spark: SparkSession, folder: str, empty: Store, before: str | None = None) -> Store:
    """The store in a folder, or as it was before the batch of a token was put in; empty where it holds nothing yet."""
    read = lambda t, schema: t.read(schema=schema) if before is None else t.read_before(before, schema)
    return Store(**{name: read(VersionedTable(spark, f"{folder}/{name}", keys), getattr(empty, name).schema) for name, keys in STORE_KEYS.items()})


def ingest_into(spark: SparkSession, folder: str, batch: DataFrame, as_of: Column, token: str, empty: Store) -> None:
    """Puts a batch into the store in a folder, as `ingest` does. Registries are changed in the buckets of the batch's keys only, facts are
    appended; each table changes at once. A batch whose ingestion was broken off is put in again under the same token: what is done already is
    left, and the rest follows from the store as it was before. A batch that is in changes nothing."""
    tables = {name: VersionedTable(spark, f"{folder}/{name}", keys) for name, keys in STORE_KEYS.items()}
    if tables["facts"].holds(token):  # which are written last
        return
    old = open_store(spark, folder, empty, token)
    new = ingest(batch, old, as_of)
    ids = _by_id(batch, old.models, old.aliases).select("model_id").distinct()
    added = lambda name: getattr(new, name).join(getattr(old, name).select(*STORE_KEYS[name]), STORE_KEYS[name], "left_anti")
    changed = {
        "models": new.models.join(ids, "model_id", "left_semi"), "aliases": added("aliases"), "tracking": new.tracking.join(ids, "model_id", "left_semi"),
        "benchmarks": new.benchmarks.where(F.col("last_updated") == as_of), "benchmark_aliases": added("benchmark_aliases"),
    }
    for name, rows in changed.items():
        tables[name].upsert(rows.select(*getattr(empty, name).columns), token)
    tables["facts"].append(new_facts(batch, old), token)
