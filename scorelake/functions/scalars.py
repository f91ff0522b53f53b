"""Scalar functions as Column expressions, for use in bulk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def cascade(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for cond, value in reversed(rules):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether c, lower-cased, holds any of the terms, inside words too."""
    return reduce(lambda a, b: a | b, (F.lower(c).contains(t) for t in terms))


def round_exact(c: Column, n: int) -> Column:
    """c rounded to n places as its exact binary value lies, halves to even: 2.675, which is a little less, as 2.67. (F.round goes by the
    shortest decimal text.) The product's rounding error is found by splitting both factors in halves of their bits."""
    scale = float(10**n)
    p = c * scale

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(c), halves(F.lit(scale))
    error = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    down = F.floor(p).cast("double")
    tie = p - down == 0.5
    up = (tie & ((error > 0) | ((error == 0) & (F.pmod(down, F.lit(2.0)) == 1)))) | (p - down > 0.5)
    # From 2**52 on there are no places to round.
    return F.when(F.abs(p) < 4503599627370496.0, (down + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(c)


# Parsing of cells


def parse_fraction_pct(c: Column) -> Column:
    """"8/10" as 80; anything else, or a zero below, as null."""
    return F.try_divide(_extract(c, r"(\d+)\s*/\s*\d+").cast("double") * 100, _extract(c, r"\d+\s*/\s*(\d+)").cast("double"))


def first_int(c: Column) -> Column:
    return _extract(c, r"(\d+)").try_cast("long")


def parse_cost(c: Column) -> Column:
    return _extract(c, r"\$(\d+\.?\d*)").try_cast("double")


def parse_seconds(c: Column) -> Column:
    """The number before an s."""
    return _extract(c, r"(\d+\.?\d*)\s*s").try_cast("double")


def parse_pct(c: Column, strict: bool = True) -> Column:
    """The number before %; if not strict the sign may be absent."""
    return _extract(c, r"(\d+\.?\d*)\s*%" if strict else r"(\d+\.?\d*)\s*%?").try_cast("double")


def parse_pct_cell(c: Column) -> Column:
    """A whole cell as a number, % dropped; -, empty and N/A as null."""
    bare = F.trim(F.replace(c, F.lit("%"), F.lit("")))
    return F.when(~F.upper(bare).isin("-", "", "N/A"), bare.try_cast("double"))


def parse_scaled(c: Column) -> Column:
    """"4%", "3M" and "12K" as 4, 3 and 12 with their factors, tried in this order."""
    number = lambda sign: F.trim(F.replace(F.upper(c), F.lit(sign), F.lit(""))).try_cast("double")
    return cascade([(c.contains("%"), number("%")), (F.upper(c).contains("M"), number("M") * 1e6), (F.upper(c).contains("K"), number("K") * 1e3)], F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))


def parse_unit(c: Column) -> Column:
    """A number with ms, tokens/s, GB or % after it."""
    return F.trim(reduce(lambda x, u: F.replace(x, F.lit(u), F.lit("")), ("ms", "tokens/s", "GB", "%"), c)).try_cast("double")


def safe_float(c: Column) -> Column:
    """A number, % dropped; whatever is none is 0."""
    return F.coalesce(F.trim(F.replace(c, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def to_percent_if_unit(c: Column) -> Column:
    return F.when(c <= 1, c * 100).otherwise(c)


def resolved_count(pct: Column, total: int = 500) -> Column:
    """Tasks solved, of `total`, cut to a whole number."""
    return (pct * (total / 100)).cast("int")


# Names


def strip_decoration(c: Column) -> Column:
    """Without stars, arrows, currency signs, [..] parts and non-word characters at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"[★⚡▶$]|\x{FE0E}|\[[^\]]*\]", ""), r"^\W+|\W+$", "")


def drop_provider(c: Column, single: bool = False) -> Column:
    """The part after the last /; with `single` only where there is just one."""
    last = F.element_at(F.split(c, "/"), -1)
    return F.when(F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))) == 1, last).otherwise(c) if single else last


def canonical_model(c: Column, strip_version: bool = True) -> Column:
    """Lower case, spaces and _ as -, other signs dropped, and a trailing version dropped: "GPT-4" is "gpt"."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-"), r"-+", "-")
    out = F.regexp_replace(out, r"[^a-z0-9-]", "")
    return F.trim(F.regexp_replace(out, r"-v?\d*$", "") if strip_version else out, F.lit("-"))


def canonical_benchmark(c: Column) -> Column:
    """Lower case without (..) parts and signs, words joined by -."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"\([^)]*\)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\s_]+", "-"), r"[^a-z0-9-]", "")
    return F.trim(F.regexp_replace(out, r"-+", "-"), F.lit("-"))


def clean_paper_name(c: Column) -> Column:
    """Without a leading "the", trailing (..) and [..], and runs of white space."""
    out = F.regexp_replace(F.trim(c), r"(?i)^the\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*\([^)]*\)$", ""), r"\s*\[[^\]]*\]$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_metric(c: Column) -> Column:
    return F.initcap(F.trim(F.replace(F.regexp_replace(c, r"\s*\([^)]*\)$", ""), F.lit("%"), F.lit(""))))


#: Substrings of a lower-case name and the name they stand for, in order of trial.
CODING_NAMES = {
    "gpt-4o": "GPT-4o",
    "gpt-4o-mini": "GPT-4o mini",
    "gpt-4-turbo": "GPT-4 Turbo",
    "gpt-4": "GPT-4",
    "codestral": "Codestral",
    "deepseek-coder": "DeepSeek Coder",
    "gemini-1.5-pro": "Gemini 1.5 Pro",
    "gemini-2.0-flash": "Gemini 2.0 Flash",
    "llama-3.1": "Llama 3.1",
}
#: Words written in capitals.
CAPITALS = ("gpt", "llm", "ai", "api")


#: Substrings that are tried before those of CODING_NAMES.
CODING_FIRST = {"claude-opus-4": "Claude 4 Opus", "claude opus 4": "Claude 4 Opus", "claude-sonnet-4": "Claude 4 Sonnet", "claude sonnet 4": "Claude 4 Sonnet", "claude-3-5-sonnet": "Claude 3.5 Sonnet"}


def coding_model_name(c: Column) -> Column:
    """A coding board's name for a model: known families by prefix or substring, else words in their usual case."""
    name = F.trim(c)
    low = F.lower(name)
    word = lambda w: F.when(F.lower(w).isin(*CAPITALS), F.upper(w)).when(w.rlike(r"\d"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    words = F.filter(F.split(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    known = [
        (low.startswith("o3") & low.contains("mini"), "o3-mini"),
        (low.startswith("o3"), "o3"),
        *((low.contains(k), v) for k, v in (CODING_FIRST | CODING_NAMES).items()),
    ]
    return cascade(known, F.array_join(F.transform(words, word), " "))


#: What wraps a model's name, stripped in this order.
WRAPPERS = (r"^agentless\s*\+?\s*", r"^swe[-_]?agent\s*\+?\s*", r"^auto(code)?rover\s*\+?\s*", r"^rag\s*\+?\s*", r"^composio\s*\+?\s*", r"^tools?\s*\+?\s*", r"^moatless\s*\+?\s*", r"^epam\s*ai\s*\+?\s*", r"^.*\s*\+\s*")


def strip_wrappers(c: Column) -> Column:
    """The lower-case model name behind agents and tools."""
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, p, ""), WRAPPERS, F.trim(F.lower(c))))


def squashed(c: Column) -> Column:
    """Lower case without spaces, - and _."""
    return F.regexp_replace(F.lower(c), r"[\s\-_]+", "")


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


# Attributes


def extract_params_b(c: Column) -> Column:
    """Billions of parameters in a name; the first pattern that fits."""
    return F.coalesce(*(_extract(F.lower(c), p).try_cast("double") for p in (r"(\d+\.?\d*)b", r"(\d+\.?\d*)-billion", r"(\d+\.?\d*)\s*billion")))


def size_class(c: Column) -> Column:
    """Large for 72B and 78B, as the boards name them."""
    return F.when(F.upper(c).contains("72B") | F.upper(c).contains("78B"), "large").otherwise("other")


def add_tiers(name: Column, confidence: Column) -> dict[str, Column]:
    """Cost, speed and reliability tiers."""
    low = F.lower(name)
    has = lambda *t: reduce(lambda a, b: a | b, (low.contains(x) for x in t))
    return {
        "cost_tier": cascade([(has("gpt-4", "claude"), "$$$"), (has("gemini", "sonnet"), "$$")], "$"),
        "speed_tier": cascade([(has("mini", "flash"), "Very Fast"), (has("pro", "max"), "Fast")], "Standard"),
        "reliability": cascade([(confidence > 0.8, "Excellent"), (confidence > 0.6, "Good")], "Fair"),
    }


def mean_positive(*cols: Column) -> Column:
    """Mean of the values above 0, or 0 if there is none."""
    kept = F.filter(F.array(*cols), lambda x: x > 0)
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def first_present(*cols: Column, truthy: bool = False) -> Column:
    """The first value that isn't null; with `truthy` 0 and empty text count as missing."""
    if not truthy:
        return F.coalesce(*cols)
    return F.coalesce(*(F.when((c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c) for c in cols))


def first_positive(*cols: Column) -> Column:
    """The first value above 0."""
    return F.get(F.filter(F.array(*cols), lambda x: x > 0), F.lit(0))


def rename_metric(c: Column, names: Mapping[str, str]) -> Column:
    """The listed name, else _ as space and Title Case."""
    other = F.initcap(F.translate(c, "_", " "))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[c], other) if names else other


#: Words of a header and the metric that they name, in order of trial.
HEADER_WORDS = {
    "swe_bench": ("agentic coding", "swe"),
    "tool_use": ("tool use", "bfcl"),
    "adaptive_reasoning": ("adaptive reasoning", "grind"),
    "math": ("high school math", "aime"),
    "reasoning": ("reasoning", "gpqa"),
    "overall": ("overall", "humanity"),
}


def header_metric(c: Column) -> Column:
    """A header as a metric name: by keyword, else its first two words that aren't common ones."""
    low = F.lower(c)
    words = F.filter(F.split(low, r"\W+"), lambda w: (w != "") & ~w.isin("best", "in", "the", "and", "or", "of"))
    rules = [(contains_any(c, k), v) for v, k in HEADER_WORDS.items()]
    return cascade(rules, F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 2), "_"), F.lit("")), F.lit("general")))


def age_text(then: Column, as_of: Column) -> Column:
    """Days, hours or minutes ago."""
    s = F.unix_seconds(as_of) - F.unix_seconds(then)
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s.isNull(), "never").when(s >= 86400, ago(86400, "days")).when(s >= 3600, ago(3600, "hours")).otherwise(ago(60, "minutes"))


# Predicates


#: Beginnings of placeholders, and names that are no model's of their own.
PLACEHOLDERS = r"^(test|example|placeholder)|^model[-_]?\d+$|^gpt-3\.5-turbo$"


def is_real_name(c: Column) -> Column:
    """A name of three characters or more with two letters in a row, and no placeholder."""
    return (F.length(c) >= 3) & ~F.lower(c).rlike(PLACEHOLDERS) & c.rlike("[a-zA-Z]{2}")


#: Vendor keywords of a model name.
VENDORS = ("openai", "gpt", "claude", "anthropic", "google", "gemini", "meta", "llama", "mistral", "cohere", "ai21", "o1", "o3")


def has_vendor(c: Column) -> Column:
    return (F.length(F.trim(c)) >= 3) & contains_any(c, VENDORS)


def in_range(c: Column, low: float, high: float) -> Column:
    return c.between(low, high)


#: Endings and names that stem from files and folders, not models.
FILE_ENDINGS = (".py", ".sh", ".txt", ".md", ".gitignore", ".js", ".json", ".yml", ".yaml", ".xml", ".csv", ".log")
FOLDERS = ("senior", "sbox", "results", "prompts", "params", "models", "junior-v2", "img", "humaneval", "compare", "compare-v1", "requirements-exl2", "requirements-transformers", "requirements-vllm")


def is_artifact_name(c: Column) -> Column:
    """Whether a name is a file's or folder's; endings in any case, folders as written."""
    low = F.lower(c)
    return reduce(lambda a, b: a | b, (low.endswith(e) for e in FILE_ENDINGS)) | c.isin(*FOLDERS) | low.startswith("bracket.")


#: Parts of names that the second source's list has by mistake.
BAD_PARTS = ("zyte-1b", "anthopic")


def is_usable_entry(c: Column, score: Column) -> Column:
    """The second source's rule: no file or folder, none of the known mistakes, and a score above 0."""
    return ~is_artifact_name(c) & ~contains_any(c, BAD_PARTS) & F.coalesce(score > 0, F.lit(False))


def fix_known_name(c: Column) -> Column:
    """A known typo mended; names known to be incomplete as null."""
    fixed = F.replace(c, F.lit("Anthopic"), F.lit("Anthropic"))
    return F.when(~(fixed.startswith("Moatless Tools") & fixed.endswith(" + Deepseek V3")), fixed)


#: Words that speak for a leaderboard, and against one.
BOARD_WORDS = ("leaderboard", "ranking", "benchmark", "eval", "competition", "arena", "comparison", "performance", "sota")
OTHER_WORDS = ("demo", "playground", "chat", "generator", "creator")


def likely_leaderboard(title: Column, board_id: Column, good: Sequence[str] = BOARD_WORDS, bad: Sequence[str] = OTHER_WORDS) -> Column:
    text = F.concat_ws(" ", title, board_id)
    return contains_any(text, good) & ~contains_any(text, bad)


def matches_query(name: Column, scores: Sequence[Column], query: str) -> Column:
    """Whether the name, or the text of any score that isn't 0, holds the query."""
    q = query.lower()
    hit = F.lower(name).contains(q)
    for s in scores:
        hit = hit | ((F.coalesce(s, F.lit(0.0)) != 0) & s.cast("string").contains(q))
    return hit


def contains_query(c: Column, query: str) -> Column:
    return F.lower(c).contains(query.lower())


def of_providers(c: Column, providers: Sequence[str]) -> Column:
    """Whether the name holds any of the providers' names."""
    return contains_any(c, [p.lower() for p in providers])


#: Categories of coding facts, and words of language-related data sets.
CODING_CATEGORIES = ("software_engineering", "coding", "programming")
LANGUAGE_WORDS = ("language", "text", "nlp", "natural", "qa", "question", "reading", "comprehension", "generation", "classification")


def is_coding(category: Column) -> Column:
    return category.isin(*CODING_CATEGORIES)


def language_related(name: Column, description: Column) -> Column:
    return contains_any(F.concat_ws(" ", name, description), LANGUAGE_WORDS)


#: Signs of model types.
MODEL_TYPES = {"🟢": "pretrained", "🔶": "fine-tuned", "💬": "chat", "🤝": "merged"}


def model_type(c: Column) -> Column:
    return cascade([(c.contains(k), v) for k, v in MODEL_TYPES.items()], "unknown")


def extract_license(card: Column, tags: Column) -> Column:
    """The card's licence, else that of the first tag that names one, else null."""
    tag = F.get(F.filter(tags, lambda t: t.contains("license:") | F.lower(t).contains("apache") | F.lower(t).contains("mit")), F.lit(0))
    return F.coalesce(card, F.trim(F.replace(tag, F.lit("license:"), F.lit(""))))
