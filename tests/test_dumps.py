"""Large dumps, read in blocks, against the plain reader of JSON."""

import json
import random

import pytest

from scorelake.sources import tables as T

ODD = ['a "quoted" name', "brace } in { text", "[list], {x", "back\\slash \\", 'end\\"', "ünï 日本", "", "tab\tnew\nline", '"models": [{']


def _record(r):
    return {"model": r.choice(ODD) + str(r.randint(0, 9)), "scores": {r.choice(ODD) + str(i): i / 2 for i in range(r.randint(0, 3))}, "source": r.choice([None, *ODD]), "extra": [{"deep": {"x": [1, {"y": "}"}]}}], "votes": r.randint(0, 99)}


def _dumps(seed):
    r = random.Random(seed)
    records = lambda: [_record(r) for _ in range(r.randint(0, 6))]
    keys = [k + str(i) for i, k in enumerate(ODD)]
    return {
        "array": records() + [_record(r)],
        "sources": {k: records() for k in keys},
        "categories": {k: {c: records() for c in r.sample(keys, r.randint(0, 4))} for k in keys},
        "models": {"other": [{"model": "no"}], "meta": 3, "models": records() + [_record(r)], "after": [{"model": "no"}]},
    }


def _plain(shape, dump):
    if shape in ("array", "models"):
        return [((), x) for x in (dump if shape == "array" else dump["models"])]
    if shape == "sources":
        return [((k,), x) for k, own in dump.items() for x in own]
    return [((k, c), x) for k, inner in dump.items() for c, own in inner.items() for x in own]


@pytest.mark.parametrize("shape", ["array", "sources", "categories", "models"])
@pytest.mark.parametrize("indent", [None, 2])
def test_blocks_against_plain(spark, tmp_path, shape, indent):
    dumps = [_dumps(seed)[shape] for seed in (1, 2)]
    for i, dump in enumerate(dumps):
        (tmp_path / f"{i}.json").write_text(json.dumps(dump, indent=indent, ensure_ascii=bool(i)))
    want = sorted((*key, x["model"], sorted(x["scores"].items()), x["source"] or "", x["votes"]) for dump in dumps for key, x in _plain(shape, dump))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (301, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
            rows = T.read_large_dump(spark, str(tmp_path), shape)
            keys = [c for c in rows.columns if c.endswith("_key")]
            got = sorted((*(r[k] for k in keys), r.model, sorted(r.scores.items()), r.source or "", r.votes) for r in rows.collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_odd_dumps(spark, tmp_path):
    """No record, elements that are no objects, dumps one after the other."""
    for name, body, want in (("empty", "", []), ("none", '{"a": [], "b": []}\n', []), ("mixed", '{"a": [null, 1, {"model": "x"}, "s", {"model": "y"}], "b": []} {"c": [{"model": "z"}]}\n\n', [("a", "x"), ("a", "y"), ("c", "z")])):
        path = tmp_path / f"{name}.json"
        path.write_text(body)
        assert sorted((r.source_key, r.model) for r in T.read_large_dump(spark, str(path), "sources").collect()) == want
