import pytest

ODD = [
    None, "", " ", "  a  b ", "Hello   World\r\n", "a" * 500, "a b c d e f g h i j k l", "日本語 テキスト\n\nnew\tline", "emoji 😀 x", "▁x ▁▁ y", "<s> </s> <unk>",
    "<|endoftext|> a<|ENDOFTEXT|>b", "It's we'll they'RE 'sound d'accord !!'s ''s 't", "a1b22 3", "É à Ñ ß×÷ÿ Ÿ", "é a b", "one two three " * 3000, "12 %% ##", "\u0000x\x1cy",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Every odd text, one of them twice in one row's stead, with columns of names that operators use themselves."""
    rows = [(i, t, None, None, len(t or ""), f"x{i}", i) for i, t in enumerate([*ODD, ODD[9]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens long").coalesce(2)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
