"""Model names to canonical ones: aliases, patterns, similarity; registries; duplicates.

aliases: alias, canonical_name, model_family, provider, source, confidence_score. Resolving works on distinct names; callers join back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.scalars import canonical_benchmark, canonical_model, cascade, contains_any, squashed, strip_wrappers
from scorelake.operators.similar import ratios, similar_pairs
from scorelake.sources.shared import stored

#: Patterns of model families, in order of trial.
FAMILY_PATTERNS = {
    "GPT-4": (r"gpt[-_]?4(?:\.?\d+)?(?:[-_]?(?:turbo|o|omni|mini))?", r"gpt[-_]?4o[-_]?(?:mini)?", r"agentless.*gpt[-_]?4", r".*\+.*gpt[-_]?4", r"auto.*gpt[-_]?4", r"swe[-_]?agent.*gpt[-_]?4"),
    "Claude 3.5 Sonnet": (r"claude[-_]?3\.?5[-_]?sonnet", r"claude[-_]?sonnet[-_]?3\.?5", r"agentless.*claude[-_]?3\.?5", r".*\+.*claude[-_]?3\.?5[-_]?sonnet", r"swe[-_]?agent.*claude[-_]?3\.?5", r"auto.*claude[-_]?3\.?5[-_]?sonnet"),
    "Claude 3 Opus": (r"claude[-_]?3[-_]?opus", r"claude[-_]?opus[-_]?3", r".*\+.*claude[-_]?3[-_]?opus"),
    "Claude 3.7 Sonnet": (r"claude[-_]?3\.?7[-_]?sonnet", r"claude[-_]?sonnet[-_]?3\.?7"),
    "Claude 2": (r"claude[-_]?2(?:\.0)?(?![\d\.])", r".*\+.*claude[-_]?2"),
    "Gemini 2.5 Pro": (r"gemini[-_]?2\.?5[-_]?pro", r"gemini[-_]?pro[-_]?2\.?5"),
    "Gemini 2.5 Flash": (r"gemini[-_]?2\.?5[-_]?flash", r"gemini[-_]?flash[-_]?2\.?5"),
    "Gemini 2.0 Flash": (r"gemini[-_]?2\.?0[-_]?flash", r"gemini[-_]?flash[-_]?2\.?0"),
    "Llama 3.1 70B": (r"ll?ama[-_]?3\.?1[-_]?70b", r"meta[-_]?ll?ama[-_]?3\.?1[-_]?70b"),
    "Llama 2 70B": (r"ll?ama[-_]?2[-_]?70b", r"meta[-_]?ll?ama[-_]?2[-_]?70b"),
    "Llama 2 13B": (r"ll?ama[-_]?2[-_]?13b", r"meta[-_]?ll?ama[-_]?2[-_]?13b"),
    "Llama 2 7B": (r"ll?ama[-_]?2[-_]?7b", r"meta[-_]?ll?ama[-_]?2[-_]?7b"),
    "GPT-3.5 Turbo": (r"gpt[-_]?3\.?5[-_]?turbo", r"chatgpt[-_]?3\.?5"),
}
#: Patterns at a name's start and what they stand for, in order; matched in any case.
KNOWN_PATTERNS = (
    (r"gpt[\s\-_]?4\.1", "GPT 4.1"),
    (r"gpt[\s\-_]?4(?![\.\d])", "GPT-4"),
    (r"gpt[\s\-_]?4o", "GPT-4o"),
    (r"claude[\s\-_]?(?:opus[\s\-_]?)?4", "Claude 4 Opus"),
    (r"claude[\s\-_]?(?:sonnet[\s\-_]?)?4", "Claude 4 Sonnet"),
    (r"claude[\s\-_]?3\.5[\s\-_]?sonnet", "Claude 3.5 Sonnet"),
    (r"o3[\s\-_]?mini", "o3-mini"),
    (r"o3", "o3"),
)


def family_rules(families: Mapping[str, Sequence[str]] = FAMILY_PATTERNS) -> list[tuple[str, str, float]]:
    """(family, pattern, confidence before the match's place counts), in order of trial."""
    rules = []
    for family, patterns in families.items():
        for p in patterns:
            short = len(p.replace("[-_]?", "").replace(r"\.?", "")) < 6
            rules.append((family, p, 0.8 + 0.1 * (r"\d" in p) - 0.2 * short))
    return rules


def best_family(c: Column, rules: Sequence[tuple[str, str, float]]) -> Column:
    """struct of confidence, place and family of the best rule for a cleaned name, the earlier one of equals; null if none fits. The patterns
    are literals, so each is compiled once."""

    def tried(name: Column) -> Column:
        cases = []
        for k, (family, p, base) in enumerate(rules):
            sure = F.when(name.rlike(f"^(?:{p})"), F.lit(round(min(1.0, base + 0.05), 6))).otherwise(F.lit(round(min(1.0, base), 6)))
            cases.append(F.when(name.rlike(p), F.struct(sure.alias("confidence"), F.lit(-k).alias("place"), F.lit(family).alias("family"))))
        return F.array_max(F.array(*cases))

    return F.get(F.transform(F.array(c), tried), F.lit(0))  # so c is computed once


def match_family(names: DataFrame, rules: Sequence[tuple[str, str, float]] | None = None) -> DataFrame:
    """model_name, canonical, confidence of every name that a rule fits, by its best rule."""
    best = best_family(strip_wrappers(F.col("model_name")), rules or family_rules())
    found = names.select("model_name", F.explode(F.array_compact(F.array(best))).alias("b"))  # so the patterns are tried once
    return found.select("model_name", F.col("b.family").alias("canonical"), "b.confidence")


def resolve_exact(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """model_name, canonical of names that are an alias, in any case."""
    a = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min("canonical_name").alias("canonical"))
    return names.join(a, F.lower("model_name") == F.col("_a")).select("model_name", "canonical")


def fuzzy_match(names: DataFrame, canon: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """model_name, canonical, confidence: the canonical name closest to the lower-case name (the later one of equals by text)."""
    left, right = names.select(F.lower("model_name").alias("name")), canon.select(F.lower("canonical_name").alias("other"))
    best = similar_pairs(left, right, cutoff, swap=True, best=True).select("name", "other")
    back = canon.groupBy(F.lower("canonical_name").alias("other")).agg(F.min("canonical_name").alias("canonical"))
    found = names.select("model_name", F.lower("model_name").alias("name")).join(best, "name").join(back, "other")
    return found.select("model_name", "canonical", F.pandas_udf(ratios, T.DoubleType())("name", "other").alias("confidence"))


def normalize_names(names: DataFrame, aliases: DataFrame, rules: Sequence[tuple[str, str, float]] | None = None, fuzzy: bool = True) -> DataFrame:
    """original, canonical, confidence, match_type of every distinct name: alias, pattern, similarity, or itself."""
    d = stored(names.select("model_name").distinct(), "names")  # read by every step
    exact = resolve_exact(d, aliases).select("model_name", F.col("canonical").alias("e"))
    pattern = match_family(d, rules).where("confidence >= 0.7").select("model_name", F.struct("canonical", "confidence").alias("p"))
    df = stored(d.join(exact, "model_name", "left").join(pattern, "model_name", "left"), "names")
    if fuzzy:
        rest = df.where("e is null and p is null").select("model_name")
        near = fuzzy_match(rest, aliases.select("canonical_name").distinct()).where("confidence >= 0.7").select("model_name", F.struct("canonical", "confidence").alias("f"))
        df = df.join(near, "model_name", "left")
    else:
        df = df.withColumn("f", F.lit(None).cast("struct<canonical:string,confidence:double>"))
    name = F.col("model_name")
    kind = cascade([(F.coalesce(name, F.lit("")) == "", "empty"), (F.col("e").isNotNull(), "exact"), (F.col("p").isNotNull(), "pattern"), (F.col("f").isNotNull(), "fuzzy")], "manual")
    sure = cascade([(kind == "empty", 0.0), (kind == "exact", 1.0), (kind == "pattern", F.col("p.confidence")), (kind == "fuzzy", F.col("f.confidence"))], 0.1)
    return df.select(name.alias("original"), F.coalesce("e", "p.canonical", "f.canonical", name).alias("canonical"), F.round(sure, 6).alias("confidence"), kind.alias("match_type"))


def pattern_name(c: Column) -> Column:
    """What a known pattern at the name's start stands for, else null."""
    return cascade([(c.rlike(f"(?i)^{p}"), v) for p, v in KNOWN_PATTERNS], F.lit(None).cast("string"))


def resolve_names(names: DataFrame, aliases: DataFrame, threshold: float = 0.85, fuzzy: bool = True) -> DataFrame:
    """model_name, resolved, stage: alias, alias in lower case, alias squashed, similar to a squashed name, known pattern, itself."""
    d = names.select("model_name").distinct()
    by = lambda key, out: aliases.groupBy(key.alias("_k")).agg(F.min("canonical_name").alias(out))
    step = lambda df, key, out, left: df.join(by(key, out), left == F.col("_k"), "left").drop("_k")
    name = F.col("model_name")
    df = stored(step(step(step(d, F.col("alias"), "a", name), F.col("alias"), "b", F.lower(name)), squashed(F.col("alias")), "c", squashed(name)), "names")
    if fuzzy:
        rest = df.where("a is null and b is null and c is null").select(squashed(name).alias("name"))
        canon = aliases.select("canonical_name").distinct()
        # Of targets that squash to the same text a canonical name goes before an alias's; then the later one by text.
        sure, late = F.concat(F.lit("1"), F.col("canonical_name")), F.concat(F.lit("0"), F.col("canonical_name"))
        targets = canon.select(squashed(F.col("canonical_name")).alias("other"), sure.alias("prefer")).union(aliases.select(squashed(F.col("alias")), late))
        near = similar_pairs(rest, targets, threshold, best=True).select("name", F.substring("prefer", 2, 1 << 30).alias("f"))
        df = df.withColumn("_s", squashed(name)).join(near, F.col("_s") == F.col("name"), "left")
    else:
        df = df.withColumn("f", F.lit(None).cast("string"))
    p = pattern_name(name)
    stage = cascade([(F.col("a").isNotNull(), "exact"), (F.col("b").isNotNull(), "lower"), (F.col("c").isNotNull(), "squashed"), (F.col("f").isNotNull(), "fuzzy"), (p.isNotNull(), "pattern")], "self")
    return df.select(name, F.coalesce("a", "b", "c", "f", p, name).alias("resolved"), stage.alias("stage"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def learn_aliases(resolved: DataFrame, aliases: DataFrame, threshold: float = 0.85) -> DataFrame:
    """aliases and those that similarity and patterns have found; known aliases stay as they are."""
    new = resolved.where(F.col("stage").isin("fuzzy", "pattern")).select(F.col("model_name").alias("alias"), F.col("resolved").alias("canonical_name"), F.concat("stage", F.lit("_match")).alias("source"), F.when(F.col("stage") == "fuzzy", threshold).otherwise(0.9).alias("confidence_score"))
    return aliases.unionByName(unmatched(new, aliases, "alias"), allowMissingColumns=True)


def unmapped_names(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    return unmatched(facts.select("model_name").distinct(), aliases.select(F.col("alias").alias("model_name")), "model_name")


def bucket(confidence: Column) -> Column:
    return cascade([(confidence >= 0.9, "high"), (confidence >= 0.7, "medium"), (confidence >= 0.3, "low")], "manual")


def auto_alias(matches: DataFrame, aliases: DataFrame, min_conf: float = 0.9) -> DataFrame:
    """New alias rows for sure matches, with family and provider of the canonical name's first alias; none for unknown canonicals."""
    known = aliases.groupBy("canonical_name").agg(F.min_by(F.struct("model_family", "provider"), "alias").alias("k"))
    new = matches.where((F.col("confidence") >= min_conf) & F.col("original").isNotNull()).select(F.col("original").alias("alias"), F.col("canonical").alias("canonical_name"), F.col("confidence").alias("confidence_score"))
    return unmatched(new.join(known, "canonical_name"), aliases, "alias").select("alias", "canonical_name", "k.model_family", "k.provider", F.lit("auto").alias("source"), "confidence_score")


def normalization_report(facts: DataFrame, aliases: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: alias_coverage, how many of the matches of unmapped names are of each bucket, and the actions that follow: aliases to create,
    matches to review, names to look at."""
    of = lambda b: F.count_if(bucket(F.col("confidence")) == b)
    counts = matches.agg(*(of(b).alias(n) for b, n in (("high", "high_confidence"), ("medium", "medium_confidence"), ("low", "low_confidence"), ("manual", "manual_review"))))
    actions = counts.select("*", F.col("high_confidence").alias("auto_create"), F.col("medium_confidence").alias("review"), (F.col("low_confidence") + F.col("manual_review")).alias("manual_needed"))
    return alias_coverage(facts, aliases).crossJoin(actions)  # one row each


def alias_coverage(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: names, mapped and unmapped, coverage, canonicals, aliases."""
    names = facts.select("model_name").distinct().join(aliases.select(F.col("alias").alias("_a")).distinct(), F.col("model_name") == F.col("_a"), "left")
    a = names.agg(F.count("*").alias("total"), F.count("_a").alias("mapped"))
    b = aliases.agg(F.countDistinct("canonical_name").alias("canonicals"), F.count("*").alias("aliases"))
    return a.crossJoin(b).select("total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"), F.round(F.try_divide(F.col("mapped") * 100, F.col("total")), 1).alias("coverage_pct"), "canonicals", "aliases")


def suggest_aliases(matches: DataFrame, n: int, min_conf: float = 0.7) -> DataFrame:
    return matches.where((F.col("confidence") >= min_conf) & (F.col("match_type") != "exact")).orderBy(F.desc("confidence"), "original").limit(n)


def queue_upsert(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Review queue by original_name; a new row replaces the old one and is pending again."""
    fresh = new.withColumn("status", F.lit("pending"))
    return unmatched(queue, fresh, "original_name").unionByName(fresh, allowMissingColumns=True)


def queue_list(queue: DataFrame, status: str, n: int) -> DataFrame:
    """The n surest rows of a status, the later created of equals first, then by name."""
    return queue.where(F.col("status") == status).orderBy(F.desc("confidence"), F.desc("created_at"), "original_name").limit(n)


def apply_reviews(queue: DataFrame, decisions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, aliases) after decisions (original_name, decision, reviewer, reviewed_at): approved where the alias is new, or rejected."""
    df = queue.drop("reviewer", "reviewed_at").join(decisions, "original_name", "left").join(aliases.select(F.col("alias").alias("original_name"), F.lit(True).alias("_known")).distinct(), "original_name", "left")
    ok = (F.col("decision") == "approve") & F.col("_known").isNull()
    status = cascade([(ok, "approved"), (F.col("decision") == "reject", "rejected")], F.col("status"))
    done = df.withColumn("status", status)
    new = df.where(ok).select(F.col("original_name").alias("alias"), F.col("suggested_canonical").alias("canonical_name"), F.lit("review").alias("source"), F.lit(1.0).alias("confidence_score"))
    return done.drop("decision", "_known"), aliases.unionByName(new, allowMissingColumns=True)


def process_batch(matches: DataFrame) -> DataFrame:
    """One row of counts for a batch's matches: mapped, normalised by itself, queued for review, left."""
    c, t = F.col("confidence"), F.col("match_type")
    return matches.agg(F.count("*").alias("total"), F.count_if(t == "exact").alias("mapped"), F.count_if((t != "exact") & (c >= 0.9)).alias("auto_normalized"), F.count_if((t != "exact") & (c >= 0.3) & (c < 0.9)).alias("review_needed"), F.count_if(c < 0.3).alias("unresolved"))


def alias_families(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("model_family", "canonical_name", "provider").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))


def alias_add(aliases: DataFrame, new: DataFrame) -> DataFrame:
    return aliases.unionByName(unmatched(new, aliases, "alias"), allowMissingColumns=True)


def alias_delete(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """Without the named aliases, but never a canonical name's own."""
    return aliases.join(names.select(F.col("alias").alias("_d")).distinct(), (F.col("alias") == F.col("_d")) & (F.col("alias") != F.col("canonical_name")), "left_anti")


def aliases_of(aliases: DataFrame, canonical: str) -> DataFrame:
    return aliases.where((F.col("canonical_name") == canonical) & (F.col("alias") != F.lower("alias"))).select("alias").orderBy("alias")


def _by_id(facts: DataFrame, registry: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """facts with model_id: the canonical id if it is registered, else the model of the alias that is the lower-case name, else the canonical id as
    a new one; by_alias is true for the second. aliases: alias, model_id."""
    df = facts.withColumn("model_id", canonical_model(F.col("model_name")))
    if aliases is None:
        return df.withColumn("by_alias", F.lit(False))
    known = registry.select("model_id", F.lit(True).alias("_known")).distinct()
    other = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min("model_id").alias("_other"))
    df = df.join(known, "model_id", "left").join(other, F.lower("model_name") == F.col("_alias"), "left")
    by = F.col("_known").isNull() & F.col("_other").isNotNull()
    return df.withColumn("by_alias", by).withColumn("model_id", F.when(by, F.col("_other")).otherwise(F.col("model_id"))).drop("_known", "_alias", "_other")


def register_models(facts: DataFrame, registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """registry (model_id, first_seen, last_seen, n_scores) with the batch's models put in, found by their canonical id, else by alias."""
    batch = _by_id(facts, registry, aliases).groupBy("model_id").agg(F.min("scraped_at").alias("f"), F.max("scraped_at").alias("l"), F.count("*").alias("n"))
    both = registry.join(batch, "model_id", "full_outer")
    return both.select("model_id", F.coalesce("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"), (F.coalesce("n_scores", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_scores"), F.col("first_seen").isNull().alias("is_new"))


def registered_aliases(facts: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias, model_id: the aliases, and the lower-case names of the batch that differ from their model's id and aren't on record for it. A name
    that was found by an alias adds none. registry is that from before the batch."""
    named = _by_id(facts, registry, aliases).where(~F.col("by_alias")).select(F.lower("model_name").alias("alias"), "model_id").where("alias != model_id").distinct()
    old = aliases.select("alias", "model_id")
    return old.unionByName(named.join(old, ["alias", "model_id"], "left_anti"))


def track_sources(facts: DataFrame) -> DataFrame:
    """Per model id and leaderboard: first and last seen."""
    return facts.groupBy(canonical_model(F.col("model_name"), strip_version=False).alias("model_id"), "leaderboard").agg(F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("last_seen"))


def update_tracking(tracking: DataFrame, facts: DataFrame, registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """tracking (model_id, leaderboard, last_seen, is_present) by model and source, with the batch's put in: models are found as
    register_models finds them; those seen are present, and others stay as they are."""
    seen = _by_id(facts, registry, aliases).groupBy("model_id", "leaderboard").agg(F.max("scraped_at").alias("l"))
    both = tracking.join(seen, ["model_id", "leaderboard"], "full_outer")
    return both.select("model_id", "leaderboard", F.greatest("last_seen", "l").alias("last_seen"), (F.col("l").isNotNull() | F.coalesce("is_present", F.lit(False))).alias("is_present"))


def mark_absent(tracking: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """tracking with is_present false for the source's models that its newest batch lacks."""
    seen = batch.select("model_id").distinct().withColumn("_seen", F.lit(True))
    out = (F.col("leaderboard") == source) & F.col("_seen").isNull()
    return tracking.join(seen, "model_id", "left").select(*tracking.columns, (~out).alias("is_present"))


def deprecate(registry: DataFrame, as_of: Column, days: int = 180, min_scores: int = 5) -> DataFrame:
    """registry with is_deprecated: not seen for `days` and of few scores."""
    return registry.withColumn("is_deprecated", (F.col("last_seen") < as_of - F.make_interval(days=F.lit(days))) & (F.coalesce("n_scores", F.lit(0)) < min_scores))


#: Words of each benchmark category, inside words too, in order of trial.
BENCHMARK_CATEGORIES = {
    "Code": ("humaneval", "mbpp", "codegen", "code", "programming", "python", "javascript", "bigcode", "evalplus", "ds-1000"),
    "Truthfulness": ("truthful", "factual", "hallucination", "factcheck", "verification"),
    "LongContext": ("long", "context", "length", "needle", "haystack", "longeval"),
    "Tool": ("tool", "function", "api", "berkeley", "toolbench"),
    "Domain-Med": ("medical", "medqa", "usmle", "pubmed", "clinical", "biomedical"),
    "Domain-Law": ("legal", "law", "bar", "legalbench", "jurisprudence"),
    "Domain-Finance": ("finance", "financial", "finqa", "economics", "accounting"),
    "HumanPref": ("elo",),
    "Multilingual": ("multilingual", "chinese", "c-eval", "ceval", "french", "german", "mgsm", "xnli", "tydiqa", "mlqa"),
    "Reasoning": ("mmlu", "hellaswag", "arc", "winogrande", "reasoning", "logic", "commonsense", "natural", "language"),
}


def benchmark_category(name: Column, description: Column | None = None) -> Column:
    text = name if description is None else F.concat_ws(" ", name, description)
    return cascade([(contains_any(text, terms), c) for c, terms in BENCHMARK_CATEGORIES.items()], "Misc")


#: Words of a source, and then of a metric, and the category that they tell, in order of trial.
SOURCE_WORDS = ((("medical",), "medical"), (("legal",), "legal"), (("swe", "code"), "coding"), (("arena",), "general"), (("strawberry",), "reasoning"))
METRIC_WORDS = (
    (("medical", "health", "clinical"), "medical"),
    (("legal", "law", "jurisprudence"), "legal"),
    (("code", "programming", "software"), "coding"),
    (("math", "mathematical", "reasoning"), "reasoning"),
    (("academic", "research", "scientific"), "academic"),
)
#: Categories of one board's metrics; any other is general.
BOARD_METRICS = {"gpqa_diamond": "reasoning", "aime_2025": "math", "swe_bench": "code", "bfcl": "tool_use", "grind": "reasoning", "humanity_last_exam": "general"}


def metric_category(metric: Column, source: Column) -> Column:
    """By words of the source, then of the metric."""
    return cascade([*((contains_any(source, t), v) for t, v in SOURCE_WORDS), *((contains_any(metric, t), v) for t, v in METRIC_WORDS)], "general")


def board_metric_category(metric: Column) -> Column:
    return cascade([(metric == k, v) for k, v in BOARD_METRICS.items()], "general")


#: Headers that name no benchmark.
PLAIN_HEADERS = ("model", "rank", "score", "average", "overall")


def discover_benchmarks(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """Headers that name a benchmark not yet registered, with their category."""
    new = headers.select(F.trim("header").alias("name")).distinct().where(~F.lower("name").isin(*PLAIN_HEADERS) & (F.col("name") != ""))
    return unmatched(new, registry.select("name"), "name").withColumn("category", benchmark_category(F.col("name")))


def register_benchmarks(batch: DataFrame, registry: DataFrame, aliases: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(registry, aliases) with a batch of benchmark names (name, description) put in. registry: benchmark_id, display_name, category,
    auto_discovered, is_active, default_weight, last_updated; aliases: alias, benchmark_id.

    A name is found by its canonical id, else as an alias in lower case; what isn't is new, with its category by name and description, the first
    name by text as its display name, and weight 1. All found are stamped. A lower-case name that differs from its id is a new alias of it,
    unless it was found as one.
    """
    named = batch.where("name is not null").select("name", "description", canonical_benchmark(F.col("name")).alias("own_id"))
    known = registry.select(F.col("benchmark_id").alias("own_id"), F.lit(True).alias("known")).distinct()
    other = aliases.groupBy(F.lower("alias").alias("low")).agg(F.min("benchmark_id").alias("other"))
    df = named.join(known, "own_id", "left").join(other, F.lower("name") == F.col("low"), "left")
    by_alias = F.col("known").isNull() & F.col("other").isNotNull()
    df = df.select("name", "description", F.when(by_alias, F.col("other")).otherwise(F.col("own_id")).alias("benchmark_id"), by_alias.alias("by_alias"))
    one = df.groupBy("benchmark_id").agg(F.min(F.struct("name", "description")).alias("b"))
    both = registry.join(one, "benchmark_id", "full_outer")
    new, seen = F.col("display_name").isNull(), F.col("b").isNotNull()
    out = both.select(
        "benchmark_id", F.coalesce("display_name", "b.name").alias("display_name"), F.coalesce("category", benchmark_category(F.col("b.name"), F.coalesce("b.description", F.lit("")))).alias("category"),
        F.coalesce("auto_discovered", F.lit(True)).alias("auto_discovered"), F.coalesce("is_active", F.lit(True)).alias("is_active"), F.coalesce("default_weight", F.lit(1.0)).alias("default_weight"),
        F.when(seen, as_of).otherwise(F.col("last_updated")).alias("last_updated"), new.alias("is_new"),
    )
    more = df.where(~F.col("by_alias")).select(F.lower("name").alias("alias"), "benchmark_id").where("alias != benchmark_id").distinct()
    old = aliases.select("alias", "benchmark_id")
    return out, old.unionByName(more.join(old, ["alias", "benchmark_id"], "left_anti"))


def update_benchmarks(registry: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """registry with the fields that updates (benchmark_id and some of its columns) has, where they aren't null; those rows are stamped. Ids
    that aren't registered are left out."""
    fields = [c for c in updates.columns if c != "benchmark_id" and c in registry.columns]
    one = updates.groupBy(F.col("benchmark_id").alias("_id")).agg(F.max(F.struct(*fields)).alias("_u"))
    both = registry.join(one, F.col("benchmark_id") == F.col("_id"), "left")
    value = lambda c: F.coalesce(F.col(f"_u.{c}"), F.col(c)).alias(c) if c in fields else F.when(F.col("_id").isNotNull(), as_of).otherwise(F.col(c)).alias(c) if c == "last_updated" else F.col(c)
    return both.select(*(value(c) for c in registry.columns))


def registry_stats(models: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: models in all, active, deprecated, and aliases. models: model_id, source, is_active."""
    return models.agg(F.count("*").alias("total_models"), F.count_if("is_active").alias("active_models"), F.count_if(~F.col("is_active")).alias("deprecated_models")).crossJoin(aliases.agg(F.count("*").alias("total_aliases")))  # one row each


def models_by_source(models: DataFrame) -> DataFrame:
    return models.groupBy("source").agg(F.count("*").alias("n"))


def benchmark_stats(registry: DataFrame) -> DataFrame:
    """One row: benchmarks in all, active, discovered, and active ones that weren't."""
    return registry.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("auto_discovered").alias("auto_discovered")).withColumn("curated", F.col("active") - F.col("auto_discovered"))


def category_weights(registry: DataFrame, categories: DataFrame) -> DataFrame:
    """Every listed category that has an active benchmark, with the sum of their weights and their number."""
    g = registry.where("is_active").groupBy("category").agg(F.sum("default_weight").alias("weight"), F.count("*").alias("n"))
    return categories.select("category").join(g, "category")


def dedup_max(df: DataFrame, keys: Sequence[str], score: str, order: str = "score_id") -> DataFrame:
    """The row of the highest score of each key, the first of equals."""
    best = F.max_by(F.struct(*df.columns), F.struct(score, -F.col(order)))
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(best.alias("r")).select("r.*")


def dedup_first(df: DataFrame, key: Column, order: str = "score_id") -> DataFrame:
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def name_classes(names: DataFrame) -> DataFrame:
    """model_name, key (its set of lower-case characters) of every distinct name that has any, and n, the names of that key."""
    chars = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("model_name"), ""), lambda x: x != "")))
    df = names.select("model_name").distinct().select("model_name", F.array_join(chars, "").alias("key")).where("key != ''")
    return df.join(df.groupBy("key").agg(F.count("*").alias("n")), "key").select("model_name", "key", "n")


def near_duplicate_count(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row, n_pairs: pairs of different names that are linked, within a class and between two."""
    n = F.col("n").cast("long")
    inside = name_classes(names).groupBy("key").agg(F.first("n").alias("n")).select((n * (n - 1) / 2).alias("p"))
    across = near_duplicate_names(names, threshold).select((F.col("n_a") * F.col("n_b")).cast("double").alias("p"))
    return inside.union(across).agg(F.coalesce(F.sum("p"), F.lit(0.0)).cast("long").alias("n_pairs"))


def near_duplicate_names(names: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of names whose sets of lower-case characters have a Jaccard similarity above the threshold.

    Names of one character set are one class, of which the least name stands for all. With characters in one order, the rarest first, two
    different sets that reach the threshold share two among the first of each (a prefix filter, of one more than needed for one), so sets meet
    by two characters and the other's size, and each pair once. (Sets of fewer than two characters reach it with none.) A pair links every name of class key_a with every one of key_b, and n_a and n_b
    are the numbers of names; `name_classes` has each class's names, which are linked with one another too.
    """
    sets = name_classes(names).groupBy("key").agg(F.min("model_name").alias("name"), F.count("*").alias("n"))
    sets = sets.withColumn("s", F.filter(F.split("key", ""), lambda x: x != ""))
    freq = sets.select(F.explode("s").alias("c")).groupBy("c").agg(F.count("*").alias("f"))
    ordered = sets.select("key", F.explode("s").alias("c")).join(freq, "c").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "c"))), lambda x: x["c"]).alias("o"))
    m = F.size("o")
    two = F.slice("o", 1, F.least(m, m - F.ceil(m * threshold - 1e-9) + 2).cast("int"))
    pairs = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.concat(x, y))))
    keyed = sets.join(ordered, "key").select("key", "name", "n", "s", pairs(two).alias("p"), m.alias("m"))
    a = keyed.select(F.col("key").alias("ka"), F.col("name").alias("name_a"), F.col("n").alias("n_a"), F.col("s").alias("sa"), F.col("p").alias("pa"), F.col("m").alias("ma"), F.explode("p").alias("c"))
    a = a.select("*", F.explode(F.sequence(F.ceil(F.col("ma") * threshold - 1e-9), F.floor(F.col("ma") / threshold + 1e-9))).alias("mb"))
    b = keyed.select(F.col("key").alias("kb"), F.col("name").alias("name_b"), F.col("n").alias("n_b"), F.col("s").alias("sb"), F.col("p").alias("pb"), F.col("m").cast("long").alias("mb"), F.explode("p").alias("c"))
    once = a.join(b, ["c", "mb"]).where((F.col("ka") < F.col("kb")) & (F.get(F.array_intersect("pa", "pb"), F.lit(0)) == F.col("c")))
    sim = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return once.select(F.col("ka").alias("key_a"), "name_a", "n_a", F.col("kb").alias("key_b"), "name_b", "n_b", F.round(sim, 6).alias("similarity")).where(F.col("similarity") > threshold)


def near_duplicate_pairs(classes: DataFrame, linked: DataFrame) -> DataFrame:
    """name_a, name_b (the greater) and similarity of all pairs of different names that are linked, of `name_classes` and the pairs of classes
    of `near_duplicate_names`: so as many rows as pairs, which grow with the square of the names that are alike."""
    a, b = (classes.select(F.col("key").alias(f"key_{x}"), F.col("model_name").alias(x)) for x in "ab")
    between = linked.select("key_a", "key_b", "similarity").join(a, "key_a").join(b, "key_b").select("a", "b", "similarity")
    inside = a.join(b, F.col("key_a") == F.col("key_b")).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return between.union(inside).select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b"), "similarity")


def daily_normalize(facts: DataFrame, aliases: DataFrame, rules: Sequence[tuple[str, str, float]] | None = None, min_conf: float = 0.9, recompute: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(coverage report, aliases with the sure matches of names that had none, what `recompute` makes of the aliases if any were added, else
    None)."""
    matches = normalize_names(unmapped_names(facts, aliases), aliases, rules, fuzzy=False)
    new = auto_alias(matches, aliases, min_conf)
    after = alias_add(aliases, new)
    return normalization_report(facts, aliases, matches), after, recompute(after) if recompute is not None and not new.isEmpty() else None
