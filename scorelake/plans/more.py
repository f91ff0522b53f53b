"""More queries: registries, reports, statistics, details and field maps. They are registered beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import scalars as S
from scorelake.operators import boards as B
from scorelake.operators import composite as C
from scorelake.operators import monitor as M
from scorelake.operators import names as N
from scorelake.operators import normalize as Z
from scorelake.plans import facts as P
from scorelake.plans.facts import with_sql
from scorelake.plans.queries import _folder, as_of, composites, domains, norm, query, runs, when_text
from scorelake.sources import pages as H
from scorelake.sources import tables as T


# Sources and sinks


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 1")
def a4_tables(spark, d):
    """A table written, read, and written again from two."""
    folder = _folder(spark, "tables")
    e = T.read_table(spark, d, "events").select("event_id", "event_type", "value")
    for k in (0, 1):
        T.write_table(e.where(F.col("event_id") % 2 == k), folder, f"part{k}")
    return B.union_sources(T.read_table(spark, folder, "part0"), T.read_table(spark, folder, "part1"))


@query("SELECT 'new' || event_id AS value FROM events")
def a2_latest_snapshot(spark, d):
    """Two snapshots of which the later is read."""
    folder = _folder(spark, "snapshots")
    e = P.table(spark, d, "events")
    for k, word in enumerate(("old", "new")):
        e.select(F.concat(F.lit(word), "event_id").alias("value")).coalesce(1).write.text(f"{folder}/{k}-{word}")
    return T.latest_snapshot(spark, f"{folder}/*/part-*")


# Pages


@query("""
    SELECT page_id, table_no, row_no, header, cell FROM (SELECT page_id, url, page_id % 7 AS n FROM pages) p, LATERAL (VALUES
        (0, 1, 'Model', trim('m' || coalesce(url, '') || ' end')), (0, 1, 'Score', n::VARCHAR), (1, 1, 'in', 'x' || page_id), (0, 2, 'Model', 'last'), (0, 2, 'Score', '7'),
        (0, 3, 'Model', 'last'), (0, 3, 'Score', '8')) v(table_no, row_no, header, cell)
""")
def a5_nested_tables(spark, d):
    """A table before every page's own html with a table inside a cell, a script inside another, and a cell of two rows."""
    inner = F.concat(F.lit("<table><tr><th>in</th></tr><tr><td>x"), "page_id", F.lit("</td></tr></table>"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = F.concat(F.lit("<tr><td>m"), url, inner, F.lit(" end</td><td>"), F.col("page_id") % 7, F.lit("<script>'<td>'</script></td></tr><tr><td rowspan=2>last</td><td>7</td></tr><tr><td>8</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Model</th><th>Score</th></tr>"), rows, F.lit("</table>"), F.coalesce("html", F.lit("")))
    return H.extract_tables(P.table(spark, d, "pages").select("page_id", html.alias("html"))).select("page_id", "table_no", "row_no", "header", "cell")


@query("SELECT page_id, 'http://h/' || page_id AS url, 'a, b: c // }' AS note, 'it''s' AS tag, page_id AS n FROM pages")
def a8_script_literals(spark, d):
    """A script before every page's own html whose strings hold what marks comments, keys and ends outside them."""
    script = F.concat(F.lit("<script>var conf = {url: 'http://h/"), "page_id", F.lit("""', "note": "a, b: c // }", tags: ["x", 'it\\'s',], /* }; */ n: """), "page_id", F.lit(",};</script>"))
    found = H.extract_embedded_json(P.table(spark, d, "pages").select("page_id", F.concat(script, F.coalesce("html", F.lit(""))).alias("html")), [r"var conf = (\{.*?\});"])
    value = lambda path: F.get_json_object("json", path)
    return found.select("page_id", value("$.url").alias("url"), value("$.note").alias("note"), value("$.tags[1]").alias("tag"), value("$.n").cast("long").alias("n"))


# Scalars


@query("SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice * l_discount)::DOUBLE AS two, printf('%.1f', l_quantity * 0.25)::DOUBLE AS one, printf('%.0f', l_quantity / 2)::DOUBLE AS whole, printf('%.2f', -(l_quantity + 0.675))::DOUBLE AS negative FROM lineitem")
def d16_round_exact(spark, d):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.round_exact(x * F.col("l_discount"), 2).alias("two"), S.round_exact(q * 0.25, 1).alias("one"), S.round_exact(q / 2, 0).alias("whole"), S.round_exact(-(q + 0.675), 2).alias("negative"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'swe_bench' WHEN 1 THEN 'math' WHEN 2 THEN 'model_x' ELSE 'general' END AS metric, CASE p_partkey % 3 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0' END AS license, CASE WHEN p_partkey % 5 = 0 THEN 'large' ELSE 'other' END AS size, 'Part Name ' || p_partkey AS shown, 'Model' || p_partkey AS bare, 'Acc' AS clean FROM part")
def b14_b17_d10_d15_more_rules(spark, d):
    k = F.col("p_partkey")
    header = F.when(k % 4 == 0, "Agentic Coding (best)").when(k % 4 == 1, "High School Math").when(k % 4 == 2, "Best in model x").otherwise("the best of")
    card, tags = F.when(k % 3 == 0, "mit"), F.when(k % 3 == 1, F.array(F.lit("task:qa"), F.lit("license:apache-2.0"))).otherwise(F.array(F.lit("task:qa")))
    name = F.when(k % 5 == 0, F.concat(F.lit("m-72b-"), k)).otherwise(F.concat(F.lit("m-7b-"), k))
    return P.table(spark, d, "part").select(
        "p_partkey", S.header_metric(header).alias("metric"), S.extract_license(card, tags).alias("license"), S.size_class(name).alias("size"), S.display_name(F.concat(F.lit("part-name-"), k)).alias("shown"),
        S.strip_decoration(F.concat(F.lit("▶ Model"), k, F.lit(" [new] ⚡!"))).alias("bare"), S.clean_metric(F.lit("acc (5-shot)")).alias("clean"),
    )


@query("SELECT event_id, (event_id % 97)::DOUBLE AS strict, CASE WHEN event_id % 3 = 0 THEN (event_id % 97)::DOUBLE END AS none_lenient, event_id % 97 > 0 AND event_id % 5 > 0 AS usable FROM events")
def c6_d5_entries_and_percents(spark, d):
    e, k = P.table(spark, d, "events"), F.col("event_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("x Zyte-1B "), k)).otherwise(F.concat(F.lit("model "), k))
    return e.select("event_id", S.parse_pct(F.concat(F.lit("about "), k % 97, F.lit(" %"))).alias("strict"), S.parse_pct(F.when(k % 3 == 0, F.concat(k % 97, F.lit(" points"))).otherwise(F.lit("n/a")), strict=False).alias("none_lenient"), S.is_usable_entry(name, k % 97).alias("usable"))


@query("SELECT 'm' || p_partkey AS model, 'org/m' || p_partkey AS original_name, metric, value FROM (SELECT p_partkey, unnest(['Total Tokens', 'Popularity Rank']) AS metric, unnest([p_size * 100, p_partkey])::DOUBLE AS value FROM part) UNION ALL SELECT 'f' || p_partkey, 'f' || p_partkey, metric, CASE metric WHEN 'arc' THEN p_size::DOUBLE WHEN 'average' THEN p_retailprice ELSE 0 END FROM part CROSS JOIN (SELECT unnest(['arc', 'hellaswag', 'mmlu', 'truthfulqa', 'winogrande', 'gsm8k', 'average']) AS metric)")
def b19_field_maps(spark, d):
    p = P.table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    usage = F.create_map(F.lit("id"), F.concat(F.lit("org/m"), "p_partkey"), F.lit("tokens"), (F.col("p_size") * 100).cast("string"), F.lit("rank"), text("p_partkey"), F.lit("requests"), F.lit("many"))
    boards = F.create_map(F.lit("fullname"), F.concat(F.lit("f"), "p_partkey"), F.lit("ARC"), text("p_size"), F.lit("Average"), text("p_retailprice"))
    a = T.map_fields(p.select(usage.alias("r")), "r", T.USAGE_FIELDS)
    return a.union(T.map_fields(p.select(boards.alias("r")), "r", T.OPEN_LLM_FIELDS, ("fullname",), 0.0, "Unknown"))


@query("SELECT s_suppkey AS model_name, unnest(['pass_rate', 'tokens', 'cost']) AS metric, unnest([s_acctbal, s_nationkey, 0])::DOUBLE AS value, unnest([true, false, false]) AS higher_is_better FROM supplier")
def b9_absent_metrics(spark, d):
    """A metric of which there is no column counts as 0; one that is null is left out."""
    s = P.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("pass_rate"), F.col("s_nationkey").alias("tokens"), F.lit(None).cast("double").alias("response_time_seconds"))
    return T.metrics_to_facts(s, "s_suppkey", {"pass_rate": True, "tokens": False, "cost": False, "response_time_seconds": False})


@query(with_sql("doms comp", "SELECT model_name, concat_ws('; ', p, CASE WHEN confidence_score >= 0.8 THEN 'Highly reliable and consistent results' END, CASE WHEN missing = '' THEN 'Complete domain coverage across all areas' END, CASE WHEN p IS NULL AND confidence_score < 0.8 AND missing <> '' THEN 'Well-rounded AI assistant; Tested across multiple benchmarks' END) AS pros, concat_ws('; ', CASE WHEN missing <> '' THEN 'Limited coverage in ' || missing || ' domains' END, CASE WHEN confidence_score < 0.6 THEN 'Lower confidence in some evaluations' END, c) AS cons FROM (SELECT model_name, string_agg(CASE WHEN score >= 80 THEN 'Excellent ' || replace(domain, '_', ' ') || ' performance' WHEN score >= 70 THEN 'Strong ' || replace(domain, '_', ' ') || ' capabilities' END, '; ' ORDER BY k) AS p, string_agg(CASE WHEN score < 50 THEN 'Weaker ' || replace(domain, '_', ' ') || ' performance' END, '; ' ORDER BY k) AS c, coalesce(string_agg(domain, ', ' ORDER BY k) FILTER (score IS NULL), '') AS missing FROM (SELECT m.model_name, g.domain, k, d.score AS score FROM (SELECT DISTINCT model_name FROM doms) m CROSS JOIN (SELECT unnest(['software_engineering', 'reasoning', 'academic', 'medical', 'legal', 'comprehensive']) AS domain, unnest([1, 2, 3, 4, 5, 6]) AS k) g LEFT JOIN doms d ON d.model_name = m.model_name AND d.domain = g.domain) GROUP BY 1) JOIN (SELECT model_name, confidence_score FROM comp WHERE profile_id = 1) USING (model_name)"))
def b16_pros_and_cons(spark, d):
    wide = C.pivot_domains(domains(spark, d), C.DOMAINS).join(composites(spark, d).where("profile_id = 1").select("model_name", "confidence_score"), "model_name")
    return C.pros_and_cons(wide).select("model_name", F.array_join("pros", "; ").alias("pros"), F.array_join("cons", "; ").alias("cons"))


@query(with_sql("norm", "SELECT count(*) AS total, count(*) FILTER (score_id % 5 = 0) AS skipped, count(*) FILTER (score_id % 5 <> 0 AND score_id % 7 <> 0) AS processed, count(*) FILTER (score_id % 5 <> 0 AND score_id % 7 = 0) AS failed, round(avg(confidence_score) FILTER (score_id % 5 <> 0 AND score_id % 7 <> 0), 6) AS avg_confidence FROM norm"))
def f9_normalize_report(spark, d):
    f = P.facts(spark, d).withColumn("value", F.when(F.col("score_id") % 7 != 0, F.col("value")))
    return Z.normalize_report(f, f.where("score_id % 5 = 0")).withColumn("avg_confidence", F.round("avg_confidence", 6))


# Names and registries


@query(with_sql("facts", "SELECT metric AS given, CASE k WHEN 0 THEN 'reasoning' WHEN 1 THEN 'code' WHEN 2 THEN 'tool_use' ELSE 'general' END AS category, count(*) AS n FROM (SELECT *, score_id % 4 AS k FROM facts) GROUP BY ALL"))
def e28_board_metrics(spark, d):
    k = F.col("score_id") % 4
    metric = F.when(k == 0, "gpqa_diamond").when(k == 1, "swe_bench").when(k == 2, "bfcl").otherwise(F.col("metric"))
    return P.facts(spark, d).groupBy(F.col("metric").alias("given"), N.board_metric_category(metric).alias("category")).agg(F.count("*").alias("n"))


@query(with_sql("facts aliases", "SELECT total, mapped, total - mapped AS unmapped, round(mapped * 100 / total, 1) AS coverage_pct, canonicals, aliases, (total - mapped) - m - l - h AS manual_review, h AS high_confidence, m AS medium_confidence, l AS low_confidence, h AS auto_create, m AS review, l + (total - mapped) - m - l - h AS manual_needed FROM (SELECT count(*) AS total, count(alias) AS mapped, count(*) FILTER (alias IS NULL AND u % 4 = 1) AS h, count(*) FILTER (alias IS NULL AND u % 4 = 2) AS m, count(*) FILTER (alias IS NULL AND u % 4 = 3) AS l FROM (SELECT DISTINCT model_name, replace(model_name, 'model-', '')::BIGINT AS u FROM facts) LEFT JOIN aliases ON model_name = alias) CROSS JOIN (SELECT count(DISTINCT canonical_name) AS canonicals, count(*) AS aliases FROM aliases)"))
def e15_report(spark, d):
    f, a = P.facts(spark, d), P.aliases(spark, d)
    u = F.replace("model_name", F.lit("model-"), F.lit("")).cast("long") % 4
    matches = N.unmapped_names(f, a).select(F.when(u == 1, 0.95).when(u == 2, 0.75).when(u == 3, 0.4).otherwise(0.1).alias("confidence"))
    return N.normalization_report(f, a, matches)


@query(with_sql("facts", "SELECT original_name, confidence, created_at FROM (SELECT DISTINCT model_name AS original_name, (length(model_name) % 3)::DOUBLE / 10 AS confidence, replace(model_name, 'model-', '')::BIGINT % 7 AS created_at FROM facts) WHERE created_at > 2 ORDER BY confidence DESC, created_at DESC, original_name LIMIT 20"))
def e17_queue_list(spark, d):
    """The surest 20 of a queue, part of which has been decided on."""
    u = F.replace("model_name", F.lit("model-"), F.lit("")).cast("long") % 7
    q = P.facts(spark, d).select("model_name").distinct().select(F.col("model_name").alias("original_name"), (F.length("model_name") % 3 / 10).alias("confidence"), u.alias("created_at"), F.when(u > 2, "pending").otherwise("approved").alias("status"))
    return N.queue_list(q, "pending", 20).drop("status")


def benchmark_registry(spark, d):
    """The benchmarks of the facts with even numbers, of weights and states by number, and an alias for each odd one of views."""
    b = P.facts(spark, d).select("benchmark").distinct().withColumn("k", F.regexp_extract("benchmark", r"(\d+)$", 1).cast("int"))
    reg = b.where("k % 2 = 0").select(S.canonical_benchmark(F.col("benchmark")).alias("benchmark_id"), F.col("benchmark").alias("display_name"), F.lit("Old").alias("category"), (F.col("k") == 0).alias("auto_discovered"), (F.col("k") != 4).alias("is_active"), (1.0 + F.col("k")).alias("default_weight"), F.lit("2024-01-01").cast("timestamp").alias("last_updated"))
    return reg, spark.createDataFrame([("view_1", "view-0"), ("view_3", "view-0")], "alias string, benchmark_id string")


_REGISTRY = "reg AS (SELECT DISTINCT replace(benchmark, '_', '-') AS benchmark_id, benchmark AS name, right(benchmark, 1)::INT AS k FROM facts)"


@query(with_sql("facts", f"SELECT * FROM (WITH {_REGISTRY} SELECT benchmark_id, name AS display_name, CASE WHEN k % 2 = 0 THEN 'Old' WHEN contains(lower(name || ' long context'), 'long') THEN 'LongContext' END AS category, k % 2 = 1 OR k = 0 AS auto_discovered, k <> 4 AS is_active, CASE WHEN k % 2 = 0 THEN 1.0 + k ELSE 1.0 END::DOUBLE AS default_weight, '2024-02-01 00:00:00' AS last_updated, k % 2 = 1 AS is_new FROM reg WHERE benchmark_id NOT IN ('view-1', 'view-3'))"))
def e26_register_benchmarks(spark, d):
    reg, aliases = benchmark_registry(spark, d)
    batch = P.facts(spark, d).select(F.col("benchmark").alias("name"), F.lit("long context").alias("description")).distinct()
    return N.register_benchmarks(batch, reg, aliases, as_of())[0].withColumn("last_updated", when_text("last_updated"))


@query(with_sql("facts", f"SELECT * FROM (WITH {_REGISTRY} SELECT name AS alias, benchmark_id FROM reg WHERE benchmark_id NOT IN ('view-1', 'view-3') UNION ALL SELECT 'view_1', 'view-0' UNION ALL SELECT 'view_3', 'view-0')"))
def e26_benchmark_aliases(spark, d):
    reg, aliases = benchmark_registry(spark, d)
    return N.register_benchmarks(P.facts(spark, d).select(F.col("benchmark").alias("name"), F.lit("").alias("description")).distinct(), reg, aliases, as_of())[1]


@query(with_sql("facts", f"SELECT * FROM (WITH {_REGISTRY} SELECT benchmark_id, CASE WHEN k = 2 THEN 'Code' ELSE 'Old' END AS category, CASE WHEN k = 2 THEN 9.5 ELSE 1.0 + k END::DOUBLE AS default_weight, CASE WHEN k = 2 THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS last_updated FROM reg WHERE k % 2 = 0)"))
def e26_update_benchmarks(spark, d):
    reg, _ = benchmark_registry(spark, d)
    more = reg.where(F.col("default_weight") == 3.0).select("benchmark_id", F.lit("Code").alias("category"), F.lit(9.5).alias("default_weight"), F.lit("x").alias("no_such_column"))
    return N.update_benchmarks(reg, more, as_of()).select("benchmark_id", "category", "default_weight", when_text("last_updated").alias("last_updated"))


@query(with_sql("facts", f"SELECT * FROM (WITH {_REGISTRY} SELECT count(*) AS total, count(*) FILTER (k <> 4) AS active, count(*) FILTER (k = 0) AS auto_discovered, count(*) FILTER (k <> 4) - count(*) FILTER (k = 0) AS curated FROM reg WHERE k % 2 = 0)"))
def h35_benchmark_stats(spark, d):
    return N.benchmark_stats(benchmark_registry(spark, d)[0])


@query(with_sql("facts", f"SELECT * FROM (WITH {_REGISTRY} SELECT 'Old' AS category, sum(1.0 + k)::DOUBLE AS weight, count(*) AS n FROM reg WHERE k % 2 = 0 AND k <> 4)"))
def h35_category_weights(spark, d):
    listed = spark.createDataFrame([(c,) for c in (*N.BENCHMARK_CATEGORIES, "Misc", "Old")], "category string")
    return N.category_weights(benchmark_registry(spark, d)[0], listed)


@query(with_sql("facts aliases", "SELECT (SELECT count(DISTINCT model_name) FROM facts) AS total_models, (SELECT count(DISTINCT model_name) FROM facts WHERE length(model_name) > 7) AS active_models, (SELECT count(DISTINCT model_name) FROM facts WHERE length(model_name) <= 7) AS deprecated_models, (SELECT count(*) FROM aliases) AS total_aliases"))
def h35_registry_stats(spark, d):
    return N.registry_stats(_models(spark, d), P.aliases(spark, d))


def _models(spark, d):
    """Each model with the board of its first fact; those of short names are deprecated."""
    return P.facts(spark, d).groupBy(F.col("model_name").alias("model_id")).agg(F.min_by("leaderboard", "score_id").alias("source")).withColumn("is_active", F.length("model_id") > 7)


@query(with_sql("facts", "SELECT source, count(*) AS n FROM (SELECT model_name, arg_min(leaderboard, score_id) AS source FROM facts GROUP BY 1) GROUP BY 1"))
def h35_models_by_source(spark, d):
    return N.models_by_source(_models(spark, d))


@query(with_sql("facts", "SELECT model_name AS model_id, leaderboard, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_seen, max(scraped_at) >= TIMESTAMP '2024-01-20' AS is_present FROM facts GROUP BY 1, 2"))
def e23_source_tracking(spark, d):
    """Earlier facts' sources are on record as absent; those of later facts are put in."""
    f = P.facts(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp")
    none = f.select(F.col("model_name").alias("model_id"), F.col("scraped_at").alias("last_seen"), F.lit("").alias("leaderboard"), F.lit(True).alias("is_present")).limit(0)
    reg = f.select(F.col("model_name").alias("model_id")).distinct()
    own = f.select(F.concat("model_name", F.lit("-v0")).alias("model_name"), "leaderboard", "scraped_at")  # the version is dropped from the id
    early = N.update_tracking(none, own.where(F.col("scraped_at") < cut), reg).withColumn("is_present", F.lit(False))
    return N.update_tracking(early, own.where(F.col("scraped_at") >= cut), reg).withColumn("last_seen", when_text("last_seen"))


@query(with_sql("facts", "SELECT (SELECT count(DISTINCT model_name) FROM facts) AS models, (SELECT count(*) FROM (SELECT DISTINCT model_name, leaderboard FROM facts)) AS tracked, (SELECT count(DISTINCT benchmark) FROM facts) AS benchmarks, (SELECT count(DISTINCT benchmark) FROM facts) AS benchmark_aliases, count(*) AS facts, round(sum(value), 2) AS total FROM facts"))
def k19_ingest(spark, d):
    """Two batches put into an empty store on disk, the first one twice, as after a failure."""
    f = P.facts(spark, d).withColumn("model_name", F.concat("model_name", F.lit("-v0")))
    folder, empty = _folder(spark, "store"), M.Store.empty(spark, f)
    for token, part in (("one", "score_id % 3 > 0"), ("one", "score_id % 3 > 0"), ("two", "score_id % 3 = 0")):
        M.ingest_into(spark, folder, f.where(part), as_of(), token, empty)
    store = M.open_store(spark, folder, empty)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sums = store.facts.agg(F.count("*").alias("facts"), F.round(F.sum("value"), 2).alias("total"))
    return n(store.models, "models").crossJoin(n(store.tracking, "tracked")).crossJoin(n(store.benchmarks, "benchmarks")).crossJoin(n(store.benchmark_aliases, "benchmark_aliases")).crossJoin(sums)  # one row each


# Reports and statistics


@query(with_sql("facts", "SELECT benchmark, r AS rank, model_name, round(value, 4) AS value, greatest(n - 10, 0) AS n_more FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY value DESC, score_id) AS r, count(*) OVER (PARTITION BY benchmark) AS n FROM facts) WHERE r <= 10"))
def h29_top_per_benchmark(spark, d):
    return B.report_top(P.facts(spark, d), "benchmark", 10).withColumn("value", F.round("value", 4))


@query(with_sql("facts", "SELECT category, r AS rank, model_name, round(value, 4) AS value, greatest(n - 15, 0) AS n_more FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY value DESC, score_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM facts) WHERE r <= 15"))
def h29_top_per_category(spark, d):
    return B.report_top(P.facts(spark, d), "category", 15).withColumn("value", F.round("value", 4))


_TIER = "CASE WHEN v >= 1400 THEN 'Elite (1400+)' WHEN v >= 1350 THEN 'High (1350-1399)' WHEN v >= 1300 THEN 'Good (1300-1349)' WHEN v >= 1200 THEN 'Average (1200-1299)' ELSE 'other' END"


@query(with_sql("facts", f"SELECT tier, r AS rank, score_id, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY v DESC, score_id) AS r FROM (SELECT *, {_TIER} AS tier FROM (SELECT score_id, 1000 + value AS v FROM facts))) WHERE r <= 3"))
def h32_top_of_tiers(spark, d):
    f = P.facts(spark, d).select("score_id", (F.col("value") + 1000).alias("value"))
    return B.top_of_tiers(f, B.RATING_TIERS, 3, "value", "other", "score_id")


@query(with_sql("facts", "SELECT b.place, b.band, count(v) AS n FROM (VALUES (0, '1400+', 1400, 1e9), (1, '1300-1399', 1300, 1400), (2, '1200-1299', 1200, 1300), (3, '1100-1199', 1100, 1200), (4, '1000-1099', 1000, 1100), (5, 'Below 1000', -1e9, 1000)) b(place, band, lo, hi) LEFT JOIN (SELECT 1000 + value AS v FROM facts) ON v >= lo AND v < hi GROUP BY ALL"))
def h32_histogram(spark, d):
    return B.score_histogram(P.facts(spark, d).withColumn("value", F.col("value") + 1000))


@query(with_sql("facts", "SELECT model_name, value, score_id FROM facts WHERE leaderboard = 'Legal Purchases' AND metric = 'accuracy' ORDER BY value DESC, model_name, score_id LIMIT 5"))
def h34_top_by_metric(spark, d):
    return B.top_by_metric(P.facts(spark, d), "Legal Purchases", "accuracy")


@query(with_sql("facts", "SELECT DISTINCT benchmark FROM facts WHERE category = 'academic'"))
def h39_distinct_benchmarks(spark, d):
    return B.distinct_benchmarks(P.facts(spark, d), "academic")


@query(with_sql("facts comp aliases", "SELECT (SELECT count(DISTINCT model_name) FROM facts) AS total_models, (SELECT count(DISTINCT canonical_name) FROM aliases) AS canonical_models, (SELECT count(*) FROM comp) AS composite_scores, 6::BIGINT AS domains"))
def h36_quick_stats(spark, d):
    return B.quick_stats(P.facts(spark, d), P.aliases(spark, d), composites(spark, d), P.boards(spark))


def _store(spark, d):
    """The latest-only store of the facts, with an overall composite a model."""
    n = norm(spark, d)
    latest = n.groupBy("model_name", "benchmark", "category").agg(F.max_by("normalized_value", F.struct("scraped_at", "score_id")).alias("normalized_value"), F.max("scraped_at").alias("updated_at"))
    overall = latest.groupBy("model_name").agg(F.avg("normalized_value").alias("normalized_value"), F.max("updated_at").alias("updated_at"))
    return latest.unionByName(overall.select("model_name", F.lit("overall_composite").alias("benchmark"), F.lit("composite").alias("category"), "normalized_value", "updated_at"))


_STORE = "latest AS (SELECT model_name, benchmark, category, arg_max(normalized_value, (scraped_at, score_id)) AS v, max(scraped_at) AS seen FROM norm GROUP BY ALL), store AS (SELECT * FROM latest UNION ALL SELECT model_name, 'overall_composite', 'composite', avg(v), max(seen) FROM latest GROUP BY 1)"


@query(with_sql("norm", f"SELECT * FROM (WITH {_STORE} SELECT count(DISTINCT model_name) AS total_models, count(DISTINCT benchmark) AS total_benchmarks, count(*) AS total_scores, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS latest_update FROM store)"))
def h36_store_stats(spark, d):
    return B.store_stats(_store(spark, d)).withColumn("latest_update", when_text("latest_update"))


@query(with_sql("norm", f"SELECT * FROM (WITH {_STORE} SELECT category, count(*) AS n FROM store GROUP BY 1)"))
def h36_scores_by_category(spark, d):
    return B.scores_by_category(_store(spark, d))


@query(with_sql("norm", f"SELECT * FROM (WITH {_STORE} SELECT model_name, round(v, 6) AS score FROM store WHERE benchmark = 'overall_composite' ORDER BY v DESC, model_name LIMIT 10)"))
def h36_top_composites(spark, d):
    return B.top_composites(_store(spark, d)).withColumn("score", F.round("score", 6))


_DETAIL = "SELECT model_name, printf('%.2f', avg(normalized_value))::DOUBLE AS overall_normalized, printf('%.3f', avg(confidence_score))::DOUBLE AS overall_confidence, count(*) AS total_benchmarks, count(DISTINCT category) AS n_categories, strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_update, round(greatest(0, least(1, avg(confidence_score) - 0.2 * avg((confidence_score < 0.7)::INT) + least(0.1, count(*) / 100))), 6) AS quality, sum(score_id)::BIGINT AS ids FROM norm WHERE model_name = 'model-7' GROUP BY 1"


@query(with_sql("norm", f"SELECT t.*, (SELECT count(*) + 1 FROM (SELECT model_name, avg(normalized_value) AS m FROM norm GROUP BY 1) a, (SELECT avg(normalized_value) AS own FROM norm WHERE model_name = 'model-7') b WHERE a.m > b.own OR (a.m = b.own AND a.model_name < 'model-7')) AS global_rank FROM ({_DETAIL}) t"))
def h23_normalized_detail(spark, d):
    out = B.normalized_detail(norm(spark, d), "model-7")
    ids = F.aggregate("benchmark_details", F.lit(0).cast("long"), lambda a, x: a + x["score_id"])
    return out.select("model_name", "overall_normalized", "overall_confidence", "total_benchmarks", F.size("category_summaries").cast("long").alias("n_categories"), when_text("last_update").alias("last_update"), "quality", ids.alias("ids"), "global_rank")


# Monitoring


@query("SELECT event_type AS source, sum(user_id % 5)::BIGINT AS total_models, sum(event_id % 11)::BIGINT AS total_scores, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run FROM events WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-02-01') - 7 * 86400 GROUP BY 1")
def k7_ingestion_totals(spark, d):
    e = P.table(spark, d, "events")
    own = e.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("run_at"), (F.col("user_id") % 5).alias("models_found"), (F.col("event_id") % 11).alias("scores_ingested"))
    return M.ingestion_totals(own, as_of()).withColumn("last_run", when_text("last_run"))


@query("SELECT 'source_health' AS test, count(*) FILTER (p < 95) = 0 AS passed, 0.95::DOUBLE AS threshold, 1 - count(*) FILTER (p < 95) / count(*) AS actual, CASE WHEN count(*) FILTER (p < 95) = 0 THEN 'All sources healthy' ELSE 'Failed sources: ' || string_agg(source, ', ' ORDER BY source) FILTER (p < 95) END AS message FROM (SELECT event_type AS source, round(avg((value < 200)::INT) * 100, 4) AS p FROM events WHERE floor(epoch(ts)) > epoch(TIMESTAMP '2024-02-01') - 7 * 86400 GROUP BY 1)")
def k9_source_health(spark, d):
    return M.source_health(M.ingestion_stats(runs(spark, d), as_of()), 95)


_MESSAGES = "SELECT test, passed, about || ': ' || printf('%.2f', actual) || ' (threshold ' || printf('%.2f', threshold) || ')' AS message, CASE WHEN NOT passed THEN level END AS level FROM (SELECT 'rows' AS test, 'normalised rows' AS about, 'critical' AS level, 1000000000::DOUBLE AS threshold, count(*)::DOUBLE AS actual, false AS passed FROM norm UNION ALL SELECT 'daily_scores', 'scores in the last 24 hours', 'warning', 0, count(*), true FROM norm WHERE floor(epoch(scraped_at)) > epoch(TIMESTAMP '2024-02-01') - 86400 UNION ALL SELECT 'orphan_aliases', 'canonical names without a model', 'warning', 0, count(DISTINCT canonical_name), false FROM aliases)"


@query(with_sql("norm aliases", _MESSAGES))
def k17_messages(spark, d):
    checks = M.run_checks(norm(spark, d), P.aliases(spark, d), as_of(), {"rows": 1e9, "scores": 0})
    return M.with_messages(checks).where(F.col("test").isin("rows", "daily_scores", "orphan_aliases")).select("test", "passed", "message", "level")


@query(with_sql("norm aliases", "SELECT passed, 10 - passed AS failed, round(passed * 10, 4)::DOUBLE AS success_pct, 0::BIGINT AS info_alerts, 10 - passed - 1 - late AS warning_alerts, late AS error_alerts, 1::BIGINT AS critical_alerts FROM (SELECT (SELECT count(DISTINCT model_name) >= 10 FROM recent)::BIGINT + (SELECT count(*) >= 100 FROM recent)::BIGINT + (1 - late) + 1 + (SELECT round(avg(confidence_score), 6) >= 0.7 FROM norm)::BIGINT + 1 + 0 + 0 + (SELECT max(abs(normalized_value)) <= 10000 FROM norm)::BIGINT + (SELECT avg(normalized_value) <= 100 FROM norm)::BIGINT AS passed, late FROM (SELECT (round((epoch(TIMESTAMP '2024-02-01') - max(floor(epoch(scraped_at)))) / 3600, 6) > 48)::BIGINT AS late FROM norm))".replace("FROM recent", "FROM norm WHERE floor(epoch(scraped_at)) > epoch(TIMESTAMP '2024-02-01') - 86400")))
def k17_summary(spark, d):
    return M.checks_summary(M.run_checks(norm(spark, d), P.aliases(spark, d), as_of(), {"rows": 1e9}))


# Rules that other queries leave out


_EVEN = "replace(model_name, 'model-', '')::BIGINT % 2 = 0"


@query(with_sql("facts aliases", "SELECT alias, canonical_name, source, confidence_score FROM aliases UNION ALL SELECT model_name, 'family-1', 'review', 1.0::DOUBLE FROM (SELECT DISTINCT model_name FROM facts) WHERE model_name NOT IN (SELECT alias FROM aliases) AND length(model_name) % 2 = 0"))
def e18_review_aliases(spark, d):
    """The aliases after reviews that approve or reject every queued name: approved ones are new aliases, unless they are on record."""
    f, a = P.facts(spark, d).select(F.col("model_name").alias("original_name")).distinct(), P.aliases(spark, d)
    queue = N.queue_upsert(f.limit(0).withColumns({"suggested_canonical": F.lit(""), "status": F.lit("")}), f.withColumn("suggested_canonical", F.lit("family-1")))
    known = a.select(F.col("alias").alias("original_name"), F.lit(True).alias("known")).distinct()
    approve = (F.length("original_name") % 2 == 0) | F.col("known")
    decide = f.join(known, "original_name", "left").select("original_name", F.when(approve, "approve").otherwise("reject").alias("decision"), F.lit("x").alias("reviewer"), as_of().alias("reviewed_at"))
    return N.apply_reviews(queue, decide, a)[1].select("alias", "canonical_name", "source", "confidence_score")


@query(with_sql("facts", f"SELECT CASE WHEN {_EVEN} THEN 'reg-' || model_name ELSE model_name || '-x' END AS model_id, count(*) AS n_scores, NOT bool_or({_EVEN}) AS is_new, CASE WHEN {_EVEN} THEN '2000-01-01' ELSE strftime(min(scraped_at), '%Y-%m-%d') END AS first_seen FROM facts GROUP BY model_name"))
def e23_models_by_alias(spark, d):
    """Names of which every other is on record as an alias, in another case, of a registered model."""
    f = P.facts(spark, d)
    even = F.replace("model_name", F.lit("model-"), F.lit("")).cast("long") % 2 == 0
    old = f.where(even).select("model_name").distinct()
    registry = old.select(F.concat(F.lit("reg-"), "model_name").alias("model_id"), F.lit("2000-01-01").cast("timestamp").alias("first_seen"), F.lit("2000-01-01").cast("timestamp").alias("last_seen"), F.lit(0).cast("long").alias("n_scores"))
    aliases = old.select(F.upper(F.concat("model_name", F.lit("-x"))).alias("alias"), F.concat(F.lit("reg-"), "model_name").alias("model_id"))
    out = N.register_models(f.withColumn("model_name", F.concat("model_name", F.lit("-x"))), registry, aliases)
    return out.select("model_id", "n_scores", "is_new", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query(with_sql("comp", "SELECT model_name, profile_id, CASE WHEN bad THEN 0 ELSE composite_score END AS composite_score, CASE WHEN bad THEN 0 ELSE confidence_score END AS confidence_score, CASE WHEN bad THEN 0 ELSE domain_coverage END AS domain_coverage, CASE WHEN bad THEN 'calculation_error' ELSE method END AS method FROM (SELECT *, length(model_name) % 2 = 0 AS bad FROM comp)"))
def h2b_unknown_domain(spark, d):
    """Models of names of even length have a score in a domain that no profile knows, which makes an error row."""
    own = domains(spark, d)
    extra = own.where(F.length("model_name") % 2 == 0).dropDuplicates(["model_name"]).withColumn("domain", F.lit("unheard of"))
    out = C.composite_scores(own.unionByName(extra), P.profiles(spark), "error_row")
    return out.select("model_name", "profile_id", "composite_score", "confidence_score", "domain_coverage", "method")


@query(with_sql("facts", "SELECT score_id, metric, CASE metric WHEN 'elo_rating' THEN 'rating' ELSE 'share' END AS metric_category FROM facts WHERE metric IN ('elo_rating', 'accuracy')"))
def b8_listed_metrics(spark, d):
    """Facts of listed metrics only."""
    dim = spark.createDataFrame([("elo_rating", "rating"), ("accuracy", "share")], "metric string, category string")
    return T.map_benchmark_category(P.facts(spark, d).select("score_id", "metric"), dim)


@query("SELECT l_returnflag || '_' || kind AS metric, 'supplier-' || l_suppkey AS model, round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 6) AS value FROM (SELECT l_suppkey, l_returnflag, round(max(l_tax), 2) AS base, round(max(l_quantity), 2) AS plus FROM lineitem GROUP BY ALL) UNPIVOT (value FOR kind IN (base, plus))")
def b11_percent_scores(spark, d):
    """Scores of at most 1 count as shares of a hundred."""
    g = P.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.max("l_tax"), 2).alias("base"), F.round(F.max("l_quantity"), 2).alias("plus"))
    text = F.to_json(F.create_map(F.concat(F.lit("supplier-"), "l_suppkey"), F.create_map("l_returnflag", F.struct("base", "plus"))))
    return T.nested_scores_to_facts(g.select(text.alias("t")), "t", percent_below_one=True).select("metric", "model", F.round("value", 6).alias("value"))


@query("""
    SELECT c_nationkey, sha256(concat_ws('|', """ + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(8)) + """, count(*))) AS content_hash
    FROM (SELECT c_nationkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS d FROM customer) GROUP BY 1
""")
def d14_content_hashes(spark, d):
    """Customers' names by nation, as one hash a nation."""
    return M.content_hashes(P.table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey"), "c_nationkey")


@query("""
    WITH leaves AS (
        SELECT c_nationkey, path, sha256(concat_ws('|', """ + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(8)) + """, count(*))) AS content_hash
        FROM (SELECT c_nationkey, substr(md5(c_custkey::VARCHAR), 1, 1) AS path, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS d FROM customer) GROUP BY ALL)
    SELECT * FROM leaves UNION ALL SELECT c_nationkey, '', sha256(string_agg(content_hash, '|' ORDER BY path)) FROM leaves GROUP BY 1
""")
def k20_content_tree(spark, d):
    """Customers' names by nation, as a hash tree of one level."""
    return M.content_tree(P.table(spark, d, "customer").select("c_nationkey", "c_name", "c_custkey"), "c_custkey", "c_nationkey", levels=1)


@query("SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'new ' ELSE '' END || c_name AS c_name FROM customer WHERE (c_nationkey, substr(md5(c_custkey::VARCHAR), 1, 2)) IN (SELECT (c_nationkey, substr(md5(c_custkey::VARCHAR), 1, 2)) FROM customer WHERE c_custkey % 50 = 0)")
def k20_changed_records(spark, d):
    """Every fiftieth customer has a new name: what is taken in again are the leaves of the tree that these lie in."""
    old = P.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    new = old.withColumn("c_name", F.concat(F.when(F.col("c_custkey") % 50 == 0, "new ").otherwise(""), "c_name"))
    ranges = M.changed_ranges(M.content_tree(new, "c_custkey", "c_nationkey"), M.content_tree(old, "c_custkey", "c_nationkey"), "c_nationkey")
    return M.changed_records(new, ranges, "c_custkey", "c_nationkey")
