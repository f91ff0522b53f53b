"""Literals of scripts and nested tables of pages, on inputs that simpler rules get wrong, and against plain versions."""

import json
import random
import re

import pytest

from scorelake.sources import pages as H
from scorelake.sources.scripts import embedded_json, literal


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"rank": 3, "note": "a, b: c"}', {"rank": 3, "note": "a, b: c"}),
        ("{url: 'http://x.y/z'}", {"url": "http://x.y/z"}),
        ('{"a": "/* no */ // no", b: 1 /* yes */, // {\n c: [1, 2,],}', {"a": "/* no */ // no", "b": 1, "c": [1, 2]}),
        ("{s: 'it\\'s \"q\" \\\\', t: \"\\\"}\", 'k-1': undefined}", {"s": 'it\'s "q" \\', "t": '"}', "k-1": None}),
        ("{undefined: undefined, null: null, true: [true, false], $a_1: -1.5e+3}", {"undefined": None, "null": None, "true": [True, False], "$a_1": -1500.0}),
        ("[[], {}, [{a: []}]] + rest", [[], {}, [{"a": []}]]),
        ('{"u": "\\u00e9", a: "日本 {"}', {"u": "é", "a": "日本 {"}),
    ],
)
def test_literals(text, want):
    assert json.loads(literal(text, 0)) == want


@pytest.mark.parametrize("text", ["{a: f(1)}", "{oops; x}", '{"a": tru', "{]", "[1}", '{"a": "open', "{", "{a = 1}"])
def test_no_literals(text):
    assert literal(text, 0) is None


def test_json_comes_through_unchanged():
    """Any JSON text, however spaced, and the same one written as a script would."""
    rng = random.Random(4)
    texts = ["", "a", "it's", '"', "\\", "//x", "/*", "a, b: c", "},]", "undefined", "\n", "é😀"]

    def value(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return [rng.choice(texts), rng.randrange(-99, 99), rng.choice([True, False, None]), rng.random()][kind]
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice([*texts, "k1", "_k"]): value(depth - 1) for _ in range(rng.randrange(4))}

    def script(v):
        if isinstance(v, str):
            quote = rng.choice("'\"")
            body = json.dumps(v)[1:-1]
            return f'"{body}"' if quote == '"' else "'" + body.replace('\\"', '"').replace("'", "\\'") + "'"
        if isinstance(v, list):
            return "[" + ", ".join(map(script, v)) + rng.choice(["", "," if v else ""]) + "/* ] */]"
        if isinstance(v, dict):
            return "{" + ",\n // }\n".join(f"{k if re.fullmatch('[a-z_]\\w*', k) and rng.random() < 0.7 else script(k)}: {script(x)}" for k, x in v.items()) + rng.choice(["", "," if v else ""]) + "}"
        return "undefined" if v is None and rng.random() < 0.5 else json.dumps(v)

    for _ in range(300):
        v = [value(3)] if rng.random() < 0.5 else {"v": value(3)}
        plain = json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        assert literal(plain + "; rest", 0) == plain
        assert json.loads(literal(script(v) + "; rest", 0)) == v


def test_matches_in_order():
    find = lambda t, p: embedded_json(t, re.compile(p, re.DOTALL))
    assert find('x = {"a": "};"}; y', r"x = (\{.*?\});") == '{"a": "};"}'
    assert find("d = {}; d = {bad; d = [1]", r"d = ([{\[].*?);") is None
    assert find("d = {}; d = {bad; d = {a: 1};", r"d = ([{\[].*?);") == '{"a": 1}'
    assert find("d = [NaN]; d = [2];", r"d = (\[.*?\]);") == "[2]"


NESTED = """<table><tr><th>Model</th><th>Score</th></tr>
<tr><td>a &amp; b<table><tr><th>in</th></tr><tr><td>1</td></tr></table>tail</td><td>5<script>var x = "<td>7</td>";</script></td></tr>
<tr><td>c</td><td>6</td></tr></table>"""


def cells(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return sorted(tuple(r)[1:] for r in H.extract_tables(df).collect())


def test_tables_in_cells(spark):
    assert cells(spark, NESTED) == [(0, 1, 0, "Model", "a & btail"), (0, 1, 1, "Score", "5"), (0, 2, 0, "Model", "c"), (0, 2, 1, "Score", "6"), (1, 1, 0, "in", "1")]


def test_spans(spark):
    html = '<table><tr><th>m</th><th colspan="2">s</th></tr><tr><td rowspan=2>a</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td>b</td><td colspan=9999>x</td></tr><tr><td>c</td><td>5</td><td rowspan="0">6</td></tr><tr><td>d</td><td>7</td></tr><tr><td>e</td><td>8<td colspan="x">no</table>'
    want = [["a", "1", "2"], ["a", "3", "4"], None, ["c", "5", "6"], ["d", "7", "6"], None]
    got = cells(spark, html)
    assert [(r, t) for _, r, _, _, t in got] == [(k + 1, t) for k, row in enumerate(want) if row for t in row]
    assert {h for *_, h, _ in got} == {"m", "s"}


def test_large_pages_come_in_pieces(monkeypatch):
    """A page of many slices, cut anywhere, gives the cells of the whole page, and few at a time."""
    rows = "".join(f"<tr><td>m&eacute;{i}</td><td>{i}</td></tr>" for i in range(3000))
    html = f"<table><tr><th>m</th><th>v</th></tr>{rows}</table><!-- <table> --><p>" + NESTED
    whole = [c for part in H._Cells().taken(html) for c in part]
    assert len(whole) == 6005
    monkeypatch.setattr(H, "SLICE", 997)
    monkeypatch.setattr(H, "YIELDED", 100)
    parts = list(H._Cells().taken(html))
    assert [c for p in parts for c in p] == whole
    assert max(map(len, parts)) < 300
