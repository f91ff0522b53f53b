"""Reading and writing: Parquet tables, score dumps as JSON and CSV, exports; and reshaping of scraped records to score facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.scalars import parse_pct_cell
from scorelake.sources.versioned import VersionedTable

RECORD = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("source", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("organization", T.StringType()),
        T.StructField("votes", T.LongType()),
        T.StructField("rank", T.LongType()),
        T.StructField("scraped_at", T.StringType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database's table, read in ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """Writes df to a database's table over `parts` connections. A task that is run again appends its rows again, so write to an empty table of
    its own (mode="overwrite") where executors can be lost, and rename it in the database."""
    df.coalesce(parts).write.options(**options).jdbc(url, table, mode=mode)


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def overwrite(df: DataFrame, path: str, token: str | None = None) -> None:
    """df as the whole of the table at path, at once: readers see the old rows until the new ones are there. See VersionedTable."""
    VersionedTable(df.sparkSession, path).overwrite(df, token)


def replace_partition(df: DataFrame, path: str, key: str = "leaderboard", values: Sequence[object] | None = None, token: str | None = None) -> None:
    """Replaces all rows of the key's values by df's, at once, and leaves the others. The values are those that df has, or those given: of them
    those that df has no row of are emptied, and rows of others aren't taken."""
    spark = df.sparkSession
    keys = df.select(key) if values is None else spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    VersionedTable(spark, path, [key]).replace_keys(df, keys, token)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that overwrite, replace_partition or another write of VersionedTable has made."""
    return VersionedTable(spark, path).read()


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def latest_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """The lines of the file changed last among those of a pattern, as `value`; of equals the later name. Only the files' names and times are
    read to find it."""
    path = F.col("path")
    listed = spark.read.format("binaryFile").load(pattern).select(path, F.col("modificationTime").alias("at"))  # contents aren't read
    newest = listed.agg(F.max(F.struct("at", "path")).alias("m")).first()["m"]
    if newest is None:
        return spark.createDataFrame([], "value string")
    return spark.read.text(newest["path"])


def read_score_dump(spark: SparkSession, path: str, shape: str = "array", lines: bool = False) -> DataFrame:
    """Records of a JSON dump: `array` of records, `sources` {source: [record]}, `categories` {source: {category: [record]}} or `models`
    {models: [record]}. A file, or with `lines` (not for `array`) a line, is a dump, and one task's work; read_large_dump shares out files."""
    records = T.ArrayType(RECORD)
    if shape == "array":
        return spark.read.schema(RECORD).json(path, multiLine=True)
    text = spark.read.text(path, wholetext=not lines)
    if shape == "models":
        return text.select(F.explode(F.from_json("value", T.StructType([T.StructField("models", records)]))["models"]).alias("r")).select("r.*")
    return flatten_sources(text.select(F.from_json("value", T.MapType(T.StringType(), records if shape == "sources" else T.MapType(T.StringType(), records))).alias("dump")), nested=shape == "categories")


def read_large_dump(spark: SparkSession, path: str, shape: str = "array") -> DataFrame:
    """What read_score_dump gives of files of any size: each is read by as many tasks as it has blocks. See record_texts."""
    from scorelake.sources.dumps import record_texts

    keys = {"sources": ["source_key"], "categories": ["source_key", "category_key"]}.get(shape, [])
    records = record_texts(spark, path, shape)
    if shape == "models":
        records = records.where("source_key = 'models'")
    return records.select(*keys, F.from_json("json", RECORD).alias("r")).select(*keys, "r.*")


def flatten_sources(df: DataFrame, nested: bool = False) -> DataFrame:
    """Rows with a map `dump` of sources, or of sources and categories, as one list of records with source_key (and category_key)."""
    one = df.select(F.explode("dump").alias("source_key", "v"))
    if not nested:
        return one.select("source_key", F.explode("v").alias("r")).select("source_key", "r.*")
    return one.select("source_key", F.explode("v").alias("category_key", "w")).select("source_key", "category_key", F.explode("w").alias("r")).select("source_key", "category_key", "r.*")


def valid_record(df: DataFrame) -> DataFrame:
    """Records with a model and at least one score."""
    return df.where(F.col("model").isNotNull() & (F.size("scores") > 0))


def unpivot_scores(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """A row a model and metric; null values and the metrics in `skip` are left out."""
    rest = [c for c in df.columns if c != "scores"]
    return df.select(*rest, F.explode("scores").alias("metric", "value")).where(F.col("value").isNotNull() & ~F.col("metric").isin(*skip) if skip else F.col("value").isNotNull())


def read_score_csv(spark: SparkSession, path: str, model_cols: Sequence[str] = ("model", "model_name", "name")) -> DataFrame:
    """model, metric, value of a CSV board: the first column with a model's header, all others as numbers; cells that are none are left out."""
    df = spark.read.csv(path, header=True)
    model = next((c for want in model_cols for c in df.columns if c.strip().lower() == want), df.columns[0])
    rest = [c for c in df.columns if c != model]
    long = df.select(F.trim(F.col(f"`{model}`")).alias("model"), *(F.col(f"`{c}`") for c in rest)).unpivot(["model"], [F.col(f"`{c}`") for c in rest], "metric", "cell")
    return long.select("model", "metric", parse_pct_cell(F.col("cell")).alias("value")).where("value is not null and model != ''")


def unwrap_envelope(text: Column, keys: Sequence[str] = ("data", "leaderboard", "models", "results", "entries")) -> Column:
    """The list in a JSON text, as array<map<string,string>>: the first of the keys that holds one, else the top level; {model: {..}} too."""
    kind = "array<map<string,string>>"
    lists = [F.from_json(F.get_json_object(text, f"$.{k}"), kind) for k in keys]
    by_name = F.from_json(text, "map<string,map<string,string>>")
    named = F.transform(F.map_entries(by_name), lambda e: F.map_concat(F.map_filter(e["value"], lambda k, _: k != "model"), F.create_map(F.lit("model"), e["key"])))
    top = F.when(text.startswith("["), F.from_json(text, kind))
    usable = lambda c: F.when(F.size(F.filter(c, lambda x: x.isNotNull())) > 0, c)
    return F.coalesce(*(usable(x) for x in lists), usable(top), usable(named))


def numeric_fields_to_facts(df: DataFrame, records: str, model_keys: Sequence[str] = ("model", "model_name", "name", "Model", "id")) -> DataFrame:
    """records: a column of array<map<string,string>>. Every field but the model's that reads as a number is a metric; places from 1."""
    one = df.select(F.posexplode(records).alias("pos", "m"))
    model = F.coalesce(*(F.nullif(F.col("m")[k], F.lit("")) for k in model_keys))
    long = one.select(model.alias("model"), (F.col("pos") + 1).alias("place"), F.explode(F.map_filter("m", lambda k, _: ~k.isin(*model_keys))).alias("metric", "text"))
    return long.select("model", "place", "metric", F.col("text").try_cast("double").alias("value")).where("value is not null and model is not null")


def add_position_rank(df: DataFrame, keys: Sequence[str], order: str, metric: str) -> DataFrame:
    """Facts of each row's place in its list, as a rank metric; of equals in `order` any may be first. Long lists are ranked over all tasks."""
    from scorelake.operators.boards import global_rank

    return global_rank(df, order, order, keys, ascending=True).select(*df.columns, F.lit(metric).alias("rank_metric"), F.col("rank").cast("long").alias("rank_value"))


def nested_scores_to_facts(df: DataFrame, text: str, percent_below_one: bool = False) -> DataFrame:
    """{model: {benchmark: {kind: score}}} as model, metric <benchmark>_<kind>, value."""
    m = df.select(F.explode(F.from_json(text, "map<string,map<string,map<string,double>>>")).alias("model", "b")).select("model", F.explode("b").alias("benchmark", "k")).select("model", "benchmark", F.explode("k").alias("kind", "value"))
    v = F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")) if percent_below_one else F.col("value")
    return m.select("model", F.concat_ws("_", "benchmark", "kind").alias("metric"), v.alias("value")).where("value is not null")


def metrics_to_facts(df: DataFrame, model: str, metrics: Mapping[str, bool], absent: float | None = 0.0) -> DataFrame:
    """Fixed metrics as facts with direction flags; nulls are left out. A metric that df has no column of counts as `absent` (None: is left
    out)."""
    have = {m: up for m, up in metrics.items() if m in df.columns or absent is not None}
    value = lambda m: F.col(m).cast("double") if m in df.columns else F.lit(absent)
    row = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), value(m).alias("value"), F.lit(up).alias("higher_is_better")) for m, up in have.items())))
    return df.select(F.col(model).alias("model_name"), row.alias("f")).select("model_name", "f.*").where("value is not null")


#: Fields of usage records and the metrics that they give.
USAGE_FIELDS = {
    "tokens": "Total Tokens",
    "prompt_tokens": "Prompt Tokens",
    "completion_tokens": "Completion Tokens",
    "usage_count": "Usage Count",
    "requests": "Requests",
    "rank": "Popularity Rank",
    "percentage": "Usage Percentage",
    "weekly_tokens": "Weekly Tokens",
    "monthly_tokens": "Monthly Tokens",
}
#: Fields of open-model records and the metrics that they give; an absent one counts as 0.
OPEN_LLM_FIELDS = {"ARC": "arc", "HellaSwag": "hellaswag", "MMLU": "mmlu", "TruthfulQA": "truthfulqa", "Winogrande": "winogrande", "GSM8K": "gsm8k", "Average": "average"}


def map_fields(df: DataFrame, record: str, fields: Mapping[str, str], model_keys: Sequence[str] = ("id", "name", "model"), absent: float | None = None, unknown: str | None = None) -> DataFrame:
    """model (after the provider's /), original_name, metric and value of records in a column of map<string,string>. The model is the first key
    with text, or `unknown`; records without one are left out, and so are absent fields unless `absent` is given."""
    name = F.coalesce(*(F.nullif(F.col(record)[k], F.lit("")) for k in model_keys), F.lit(unknown))
    number = lambda k: F.coalesce(F.col(record)[k].try_cast("double"), F.lit(absent).cast("double"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), number(k).alias("value")) for k, m in fields.items())))
    out = df.select(name.alias("original_name"), pairs.alias("f")).where("original_name is not null and f.value is not null")
    return out.select(F.element_at(F.split("original_name", "/"), -1).alias("model"), "original_name", "f.metric", "f.value")


def map_benchmark_category(df: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    """df with the category of its metric from dim (metric, category): unlisted ones dropped, or with how="left" `other`."""
    return df.join(dim.select("metric", F.col("category").alias("metric_category")), "metric", how).withColumn("metric_category", F.coalesce("metric_category", F.lit("other")))


def consolidate_scores(df: DataFrame) -> DataFrame:
    """One score map a model of rows (model_name, metric, value, pos): of several values the last."""
    one = df.groupBy("model_name", "metric").agg(F.max_by("value", "pos").alias("value"))
    return one.groupBy("model_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("scores"))


def price_facts(df: DataFrame, prompt: str = "prompt_price") -> DataFrame:
    """Priced rows with the cost of a million tokens, by the boards' factor."""
    return df.where(F.col(prompt) > 0).withColumn("cost_per_million", F.col(prompt) * 1000)


def helm_to_facts(df: DataFrame, dim: DataFrame, model: str = "model_name", win_rate: str = "mean_win_rate") -> DataFrame:
    """Wide rows of benchmark columns as facts with full name, metric and direction from dim (benchmark, full_name, metric,
    higher_is_better); unlisted ones keep their name in capitals. Models without a score are left out; the win rate is a benchmark too."""
    cols = [c for c in df.columns if c not in (model, win_rate)]
    long = df.unpivot([F.col(model).alias("model_name")] if model != "model_name" else ["model_name"], [F.col(c).cast("double").alias(c) for c in cols], "benchmark", "value").where("value is not null")
    own = df.where(F.coalesce(*cols).isNotNull() & F.col(win_rate).isNotNull()).select(F.col(model).alias("model_name"), F.lit("Overall Performance").alias("benchmark"), F.lit(win_rate).alias("metric"), F.col(win_rate).cast("double").alias("value"), F.lit(True).alias("higher_is_better"))
    d = dim.select("benchmark", "full_name", F.col("metric").alias("m"), F.col("higher_is_better").alias("up"))
    named = long.join(d, "benchmark", "left").select("model_name", F.coalesce("full_name", F.upper("benchmark")).alias("benchmark"), F.coalesce("m", F.lit("Score")).alias("metric"), "value", F.coalesce("up", F.lit(True)).alias("higher_is_better"))
    return named.unionByName(own)


def clean_medical(df: DataFrame, benchmarks: Sequence[str], model: str = "model") -> DataFrame:
    """model, metric, value of entries with a name of three characters and a number of 0 to 100 in some benchmark; the first of equal names
    by `place`."""
    name = F.regexp_replace(F.trim(model), r"^\W+|\W+$", "")
    num = lambda c: F.when(F.col(c).try_cast("double").between(0, 100), F.col(c).try_cast("double"))
    kept = df.select(name.alias("model"), "place", *(num(c).alias(c) for c in benchmarks)).where((F.length("model") >= 3) & F.coalesce(*benchmarks).isNotNull())
    first = kept.groupBy("model").agg(F.min_by(F.struct(*benchmarks), "place").alias("r")).select("model", "r.*")
    return first.unpivot(["model"], list(benchmarks), "metric", "value").where("value is not null")
