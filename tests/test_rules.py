"""Golden values and edge cases of rules that the oracle queries don't reach."""

import json
import os
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scorelake.functions import scalars as S
from scorelake.operators import boards as B
from scorelake.operators import composite as C
from scorelake.operators import names as N
from scorelake.operators import normalize as Z
from scorelake.sources import pages as H
from scorelake.sources import tables as T


def one(spark, rows, schema, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in cols.items())).collect()]


GOLDEN = [
    (1446.0, "math_score", "Arena Math", "Chatbot Arena", "math", 98.4, 0.95, "elo_rating"),
    (1200.0, "overall_score", "Arena Overall", "Chatbot Arena", "general", 28.571428, 0.95, "elo_rating"),
    (0.944, "mean_win_rate", "Overall Performance", "Stanford HELM Classic", "academic", 0.944, 0.95, "percentage"),
    (0.822, "Exact Match", "HellaSwag", "Stanford HELM Classic", "academic", 82.2, 0.9, "academic_score"),
    (83.6, "accuracy", "LegalBench Legal Reasoning", "LegalBench Legal Reasoning", "legal", 83.6, 0.95, "percentage"),
    (0.01109, "cost", "Cost Efficiency", "Strawberry Bench", "reasoning", 65.17, 0.85, "cost_metric"),
    (58.0, "response_time_seconds", "Speed", "Strawberry Bench", "reasoning", 3.3333, 0.85, "time_metric"),
    (411.0, "tokens", "Token Efficiency", "Strawberry Bench", "reasoning", 100.0, 0.3, "fallback_clamp"),
]


def test_normalisation_golden(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], "value double, metric string, benchmark string, leaderboard string, category string")
    for r in Z.normalize_scores(df).collect():
        want = next(g for g in GOLDEN if g[:2] == (r.value, r.metric))
        assert r.normalized_value == pytest.approx(want[5], abs=0.01) and r.confidence_score == want[6] and r.normalization_method == want[7]


def test_z_golden(spark):
    df = spark.createDataFrame([("a", 90.0), ("a", 100.0), ("a", 110.0), ("b", 5.0)], "k string, v double")
    got = [(r.k, r.v, r.z) for r in Z.z_score(df, ["k"], "v", F.lit(True)).collect()]
    assert sorted(got) == [("a", 90.0, -1.0), ("a", 100.0, 0.0), ("a", 110.0, 1.0), ("b", 5.0, 0.0)]
    assert sorted(r.z for r in Z.z_score(df, ["k"], "v", F.lit(False)).collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_outliers_need_four_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100)] + [("b", float(v)) for v in (10, 11, 12, 13, 14, 15, 16, 90)] + [("c", 1.0), ("c", 99.0)], "k string, v double")
    assert {(r.k, r.v) for r in Z.flag_outliers(df, ["k"], "v").where("is_outlier").collect()} == {("b", 90.0)}


def test_names_golden(spark):
    rows = [("GPT-4",), ("gpt-4.1",), ("claude-3-opus-20240229",), ("GPT-4 Turbo Preview",), ("Meta-Llama-3-8B",)]
    got = {r["n"]: r["m"] for r in one(spark, rows, "n string", n=F.col("n"), m=S.canonical_model(F.col("n")))}
    assert got == {"GPT-4": "gpt", "gpt-4.1": "gpt", "claude-3-opus-20240229": "claude-3-opus", "GPT-4 Turbo Preview": "gpt-4-turbo-preview", "Meta-Llama-3-8B": "meta-llama-3-8b"}
    got = one(spark, [("MMLU (5-shot)",), ("HumanEval",)], "n string", m=S.canonical_benchmark(F.col("n")))
    assert [g["m"] for g in got] == ["mmlu", "humaneval"]
    got = one(spark, [("▶ OpenAI / o1 [new]",), ("o3-mini-high",), ("gpt-4o-mini",), ("qwen_chat ai 2",), ("Claude Opus 4",)], "n string", d=S.strip_decoration(F.col("n")), c=S.coding_model_name(F.col("n")))
    assert got[0]["d"] == "OpenAI / o1" and [g["c"] for g in got[1:]] == ["o3-mini", "GPT-4o", "Qwen Chat AI 2", "Claude 4 Opus"]
    got = one(spark, [(n,) for n in ("gpt-4.1 mini", "GPT 4", "gpt4o", "Claude 4", "o3", "other")], "n string", p=N.pattern_name(F.col("n")))
    assert [g["p"] for g in got] == ["GPT 4.1", "GPT-4", "GPT-4", "Claude 4 Opus", "o3", None]


def test_parsers(spark):
    c = F.col("x")
    got = one(spark, [("8/10",), ("1/0",), ("12K",), ("3M",), ("4%",), ("$0.01109",), ("58s ±92%",), ("-",), ("7 GB",)], "x string", fr=S.parse_fraction_pct(c), sc=S.parse_scaled(c), co=S.parse_cost(c), se=S.parse_seconds(c), pc=S.parse_pct(c), cell=S.parse_pct_cell(c), u=S.parse_unit(c), sf=S.safe_float(c))
    assert got[0]["fr"] == 80.0 and got[1]["fr"] is None and [g["sc"] for g in got[2:5]] == [12000.0, 3e6, 4.0]
    assert got[5]["co"] == 0.01109 and got[6]["se"] == 58.0 and got[4]["pc"] == 4.0 and got[7]["cell"] is None and got[8]["u"] == 7.0 and got[8]["sf"] == 0.0


def test_unknown_domain_is_ignored_or_an_error_row(spark):
    scores = spark.createDataFrame([("m", "legal", 80.0, 0.9, 1), ("m", "safety", 10.0, 0.9, 1), ("k", "legal", 50.0, 1.0, 1)], "model_name string, domain string, score double, confidence double, n long")
    profiles = spark.createDataFrame([(1, "P", 0.5, 0.5)], "profile_id int, name string, legal_weight double, medical_weight double")
    got = {r.model_name: (r.composite_score, r.method) for r in C.composite_scores(scores, profiles).collect()}
    assert got == {"m": (80.0, "low_coverage"), "k": (50.0, "low_coverage")}
    got = {r.model_name: (r.composite_score, r.method) for r in C.composite_scores(scores, profiles, "error_row").collect()}
    assert got == {"m": (0.0, "calculation_error"), "k": (50.0, "low_coverage")}


def test_similar_pairs_lose_none(spark):
    words = ["tide", "diet", "gpt-4", "gpt4", "gpt-4o", "claude-3-opus", "claude-3.5-opus", "llama", "lama", "a", "ab", "aaaa", "aab", "xyz"]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    for cut in (0.6, 0.85):
        got = {(r.name, r.other) for r in N.similar_pairs(df, df.withColumnRenamed("name", "other"), cut).collect()}
        assert got == {(a, b) for a in words for b in words if SequenceMatcher(None, a, b).ratio() >= cut}


def test_resolver_cascade(spark):
    aliases = spark.createDataFrame([("gpt-4-turbo", "GPT-4 Turbo"), ("claude 3 opus", "Claude 3 Opus")], "alias string, canonical_name string")
    names = spark.createDataFrame([("gpt-4-turbo",), ("GPT-4-TURBO",), ("gpt_4 turbo",), ("gpt-4-turbos",), ("o3 mini",), ("nothing",)], "model_name string")
    got = {r.model_name: (r.resolved, r.stage) for r in N.resolve_names(names, aliases).collect()}
    assert got == {"gpt-4-turbo": ("GPT-4 Turbo", "exact"), "GPT-4-TURBO": ("GPT-4 Turbo", "lower"), "gpt_4 turbo": ("GPT-4 Turbo", "squashed"), "gpt-4-turbos": ("GPT-4 Turbo", "fuzzy"), "o3 mini": ("o3-mini", "pattern"), "nothing": ("nothing", "self")}
    learnt = N.learn_aliases(N.resolve_names(names, aliases), aliases)
    assert {r.alias for r in learnt.collect()} == {"gpt-4-turbo", "claude 3 opus", "gpt-4-turbos", "o3 mini"}


def test_dumps(spark, tmp_path):
    record = {"model": "a", "scores": {"x": 1.0, "y": None}, "source": "s"}
    for name, body in {"array": [record, {"model": "b", "scores": {}}], "sources": {"s": [record]}, "categories": {"s": {"c": [record]}}, "models": {"models": [record]}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body))
        got = T.unpivot_scores(T.valid_record(T.read_score_dump(spark, str(path), name))).collect()
        assert [(r.model, r.metric, r.value) for r in got] == [("a", "x", 1.0)]


def test_envelopes(spark):
    texts = ['{"data": [{"model": "a", "v": "1"}]}', '[{"name": "b", "v": 2}]', '{"c": {"v": 3.5, "note": "x"}}', '{"leaderboard": [], "results": [{"id": "d", "v": 4}]}', "broken"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.unwrap_envelope(F.col("t")).alias("r"))
    assert sorted((r.model, r.metric, r.value) for r in T.numeric_fields_to_facts(df, "r").collect()) == [("a", "v", 1.0), ("b", "v", 2.0), ("c", "v", 3.5), ("d", "v", 4.0)]


def test_csv_and_snapshots(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Model,Avg,Note\nx,50%,n\ny,-,7\n")
    assert sorted((r.model, r.metric, r.value) for r in T.read_score_csv(spark, str(tmp_path / "a.csv")).collect()) == [("x", "Avg", 50.0), ("y", "Note", 7.0)]
    for i, n in enumerate(("s1.txt", "s2.txt")):
        (tmp_path / n).write_text(f"line {i}")
        os.utime(tmp_path / n, (time.time() - 1000 * (1 - i),) * 2)
    assert [r.value for r in T.latest_snapshot(spark, str(tmp_path / "s*.txt")).collect()] == ["line 1"]


def test_replacing_one_partition(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "leaderboard string, v int")
    T.replace_partition(df, str(tmp_path / "t"))
    T.replace_partition(df.where("v = 2").withColumn("v", F.lit(3)), str(tmp_path / "t"))
    assert {(r.leaderboard, r.v) for r in T.read_current(spark, str(tmp_path / "t")).collect()} == {("a", 1), ("b", 3)}


PAGE = """<p>x</p><table><tr><th>Rank</th><th>Model</th><th>Average</th><th>IFEval</th></tr><tr><td>1</td><td> calme <b>78B</b></td><td>52.08</td><td>80%</td></tr><tr><td>2</td><td>short</td></tr>
<tr><td>3</td><td>other</td><td>-</td><td>0.5</td></tr></table><script>var d = {rows: [1, 2,], // note
 x: undefined};</script><table></table>"""


def test_tables_of_a_page(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<table><tr><td>")], "page_id long, html string")
    cells = H.extract_tables(pages)
    assert sorted((r.model, r.metric, r.value) for r in H.table_cells_to_scores(cells, rank_metric="Place").collect()) == [("calme 78B", "Average", 52.08), ("calme 78B", "IFEval", 80.0), ("calme 78B", "Place", 1.0), ("calme 78B", "Rank", 1.0), ("other", "IFEval", 0.5), ("other", "Place", 3.0), ("other", "Rank", 3.0)]
    assert {(r.model, r.average, r.ifeval) for r in H.map_headers(cells).collect()} == {("calme 78B", 52.08, 80.0), ("other", None, 0.5)}
    assert {(r.model, r.value) for r in H.table_cells_first_in_range(cells, 1, 1, 60).collect()} == {("calme 78B", 52.08)}
    assert {(r.model, r.value) for r in H.table_cells_keyword(cells, ("model",), ("ifeval",)).collect()} == {("calme 78B", 80.0), ("other", 50.0)}
    got = H.extract_embedded_json(pages, [r"nothing(.*)", r"(?s)var d = (\{.*?\});"]).collect()
    assert len(got) == 1 and json.loads(got[0].json) == {"rows": [1, 2], "x": None} and got[0].pattern_no == 1


def test_text_rules(spark):
    text = "a\nclaude here\n4.0\n88.5 points\nfar\nfar\nfar\ngpt\nnone"
    pages = spark.createDataFrame([(1, text)], "page_id long, html string")
    assert [(r.model, r.value) for r in H.proximity_scores(pages, "claude|gpt", F.col("html")).collect()] == [("claude", 88.5)]
    pages = spark.createDataFrame([(1, "m1 900 m2 1200 m1 1000 m3 9999")], "page_id long, html string")
    assert {(r.name, r.score) for r in H.regex_scan(pages, r"(m\d) (\d+)", 500, 2000).collect()} == {("m1", 1000.0), ("m2", 1200.0)}


def test_detail_hangs_on_no_order_of_rows(spark):
    """Equal means tie in whatever order their rows come, and go by name; halves round by the exact mean."""
    rows = [("m", 0.1), ("m", 0.2), ("m", 0.3), ("k", 0.3), ("k", 0.2), ("k", 0.1), ("z", 0.1)]
    df = spark.createDataFrame([(i, n, v, 0.8 if i % 2 else 0.825) for i, (n, v) in enumerate(rows + [("m", 0.2)])], "score_id long, model_name string, normalized_value double, confidence_score double").coalesce(1)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("leaderboard", "benchmark", "metric", "normalization_method", "category")), F.lit(1.0).alias("value"), F.lit("2024-01-01").cast("timestamp").alias("scraped_at"))
    r = B.normalized_detail(df, "m").first()
    assert (r.overall_confidence, r.overall_normalized, r.global_rank) == (0.812, 0.2, 2)
