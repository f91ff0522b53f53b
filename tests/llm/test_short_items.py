"""Benchmark items of fewer words than a window, and documents without an id."""

from scorelake.llm.decontam import decontaminate

ITEM = "one two three four five six seven eight nine"
LONG = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"


def test_short_items_and_null_ids(spark):
    docs = [(1, f"before {ITEM} after " + "word " * 90), (2, "before one two three four five six seven eight after"), (3, "a b c d here"), (4, "x v w x y z"), (None, f"see {LONG} there"), (None, "clean"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM), (2, "a b c d"), (3, "v w x y z"), (4, LONG)], "item_id long, text string")
    got = {tuple(r) for r in decontaminate(d, b, max_coverage=0.0).collect()}
    assert got == {docs[1], docs[5], docs[6]}
    got = {tuple(r) for r in decontaminate(d, b, max_coverage=0.0, shortest=5).collect()}
    assert got == {docs[1], docs[2], docs[5], docs[6]}
    got = {tuple(r) for r in decontaminate(d, b).collect()}
    assert got == {(1, "before  after " + "word " * 90), docs[1], docs[5], docs[6]}
