"""Operators 1, 4 and 5 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import huffman, pieces, token_counts
from scorelake.llm.common import WordTable, model_file, shared_path
from scorelake.llm.queries import PIECES, QUERIES, WORDS
from scorelake.llm.word_bpe import WordBpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=model_file(PIECES))


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(model_file(WORDS))


def test_pieces_equal_the_library(spark, odd, sp):
    for r in pieces.encode_documents(odd, PIECES, keep=("lang", "source")).collect():
        text = next(x.text for x in odd.collect() if x.doc_id == r.doc_id) or ""
        want = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == sp.decode(want)
        spans = [tuple(x) for x in np.frombuffer(r.spans, "<u4").reshape(-1, 2).tolist()]
        assert spans[1:-1] == [(p.begin, p.end) for p in sp.encode_as_proto(text).pieces]


def test_op1_over_a_table(spark, docs, sp):
    got = {r.doc_id: r for r in QUERIES["op1_pieces"](spark, SF).collect()}
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """The public model with a compiled character map, a dummy prefix and squeezed white space instead of its own normaliser."""
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True)
    spec = lib.serialized_normalizer_spec() if callable(lib.serialized_normalizer_spec) else lib.serialized_normalizer_spec
    with open(model_file(PIECES), "rb") as f:
        rest = b"".join(raw for field, _, raw in pieces.proto_fields(f.read()) if field != 3)
    size, head = len(spec), bytearray([0x1A])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(rest + bytes([*head, size]) + spec)
    return str(path)


def test_offsets_through_a_compiled_map_equal_the_library(mapped):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=mapped), pieces.Codec(mapped)
    random.seed(5)
    chars = "ab Z\u3000\u00e9e\u0301\ufb01\u2460\u2167\uff71\uff76\uff9e\u200b\t\u3300\u01c4\u00df\uff21\U0001f600\u0130"
    texts = ["\ufb01 \u2460 \u2167 \uff71\uff76\uff9e", "  \uff21  \uff22 ", "Stra\u00dfe", "", " ", "x\u200by\tz", "\u3300\u3300", *("".join(random.choice(chars) for _ in range(random.randint(1, 25))) for _ in range(300))]
    for text in texts:
        ((ids, spans),) = own.encode([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_bos=True, add_eos=True), text
        want = [(p.begin, p.end) for p in lib.encode_as_proto(text).pieces]
        assert [tuple(x) for x in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()][1:-1] == want, text
        assert own.decode([ids]) == [lib.decode(np.frombuffer(ids, "<u4").tolist())]


def test_word_bpe_equals_the_library(hf):
    words = WordBpe(WORDS)
    random.seed(3)
    texts = ["".join(random.choice(" '\nabstrvemlldÉéß1.,!<|") for _ in range(random.randint(1, 40))) for _ in range(800)]
    for t, ids in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == hf.encode(t, add_special_tokens=False).ids, t


def test_counts_at_every_prefix(odd, hf):
    counter = token_counts.Counter(WORDS)
    n = lambda s: len(hf.encode(s, add_special_tokens=False).ids)
    texts = [r.text or "" for r in odd.collect() if len(r.text or "") < 1000] + ["'ll 'lx don't we're", "a<|startoftext|>b <|endoftext", "\u00e7a \u00e9t\u00e9"]
    random.seed(8)
    chars = "aB  \n'sl.!1\u0301\u0323e\u00c9\u0130\u03a3\u1100\u1161\u11a8\uac00\u0915\u093c\u0300\u2019\u3042\U0001f600\u00a0\u2028"
    texts += ["".join(random.choice(chars) for _ in range(random.randint(1, 14))) for _ in range(300)]
    texts += ["".join(random.choice(["<|endoftext|>", "<|startoftext|>", "a", "!", " ", "e\u0301", "<|", "|>"]) for _ in range(8)) for _ in range(60)]
    for t in texts:
        (deltas,) = counter([t.encode()])
        assert np.cumsum(deltas, dtype=int).tolist() == [n(t[:k]) for k in range(1, len(t) + 1)], t


def test_many_special_strings_take_time_in_proportion(hf):
    import time

    counter, took = token_counts.Counter(WORDS), []
    for k in (2_000, 16_000):
        text = "a <|endoftext|>" * k
        began = time.process_time()
        (deltas,) = counter([text.encode()])
        took.append(time.process_time() - began)
        assert deltas.sum(dtype=int) == len(hf.encode(text, add_special_tokens=False).ids)
    assert took[1] < 24 * took[0] + 0.2


def morse(n, a, b):
    """Two strings that a polynomial hash modulo a power of two can't tell apart."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_strings_that_simple_hashes_confuse(hf):
    x, y = morse(10, "c", "d")
    text = f"qqqqqqqq{x} qqqqqqqq{y} qqqqqqqq{x} {x} {y}"
    want = hf.encode(text, add_special_tokens=False).ids
    assert WordBpe(WORDS).encode([text.encode()])[0].tolist() == want
    assert token_counts.Counter(WORDS)([text.encode()])[0].sum(dtype=int) == len(want)


def test_a_text_of_many_megabytes(spark, hf, sp):
    text = " ".join(f"word{i % 7919} and {i % 13}" for i in range(250_000)) + " \u2019 end"
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    ids = hf.encode(text, add_special_tokens=False).ids
    assert [r.n_tokens for r in token_counts.token_counts(df, WORDS).where("doc_id = 1").collect()] == [len(ids)] * 2
    path = shared_path(spark, "t")
    huffman.write_ids(df, path, WORDS)
    got = huffman.read_ids(spark, path).orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got[:2]] == [[*ids, 1]] * 2 and len(got) == 3
    want = sp.encode(text, add_bos=True, add_eos=True)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode_documents(df, PIECES).where("doc_id = 1").collect()] == [want] * 2


def test_repeated_rows_and_ids(spark, odd, hf):
    both = odd.union(odd).withColumn("doc_id", F.col("doc_id") % 3)
    texts = sorted([(r.doc_id, r.text or "") for r in both.collect()])
    want = sorted((i, len(hf.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(both, WORDS).collect()) == want
    assert pieces.encode_documents(both, PIECES).count() == len(texts)
    path = shared_path(spark, "t")
    huffman.write_ids(both, path, WORDS)
    got = huffman.read_ids(spark, path).collect()
    assert sorted((r.doc_id, r.n_tokens - 1) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_ranges_are_read_from_checkpoints(spark, odd, hf, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 3000)
    path = shared_path(spark, "t")
    huffman.write_ids(odd, path, WORDS)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in huffman.read_ids(spark, path).orderBy("start").collect()])
    for first, n in ((0, 5), (0, len(every)), (700, 1), (1500, 2600), (len(every) - 3, 10), (len(every), 5)):
        got = sorted(huffman.read_range(spark, path, first, n).collect(), key=lambda r: r.start)
        assert np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r.ids, "<u4") for r in got)]).tolist() == every[first : first + n].tolist()


def test_budget_questions_from_stored_counts(spark, hf):
    df = spark.createDataFrame([(1, "It's a truth universally acknowledged, that nothing lasts"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in token_counts.token_counts(df, WORDS).select("doc_id", token_counts.longest_prefix("prefix_deltas", 5).alias("n")).collect()}
    text = df.first().text
    assert got[1] == max(k for k in range(len(text) + 1) if len(hf.encode(text[:k], add_special_tokens=False).ids) <= 5) and got[2] == 0


def test_op4_and_op5_over_a_table(spark, docs, hf):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    four = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    five = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, SF).collect()}
    start = 0
    for r in rows:
        ids = hf.encode(r.text or "", add_special_tokens=False).ids
        assert (four[r.doc_id].n_tokens, four[r.doc_id].n_bytes, four[r.doc_id].over_limit) == (len(ids), len((r.text or "").encode()), len(ids) > 2048)
        want = np.array([*ids, 1], "<u4").tobytes()
        assert (five[r.doc_id].start, five[r.doc_id].n_tokens, five[r.doc_id].ids_crc32) == (start, len(ids) + 1, zlib.crc32(want))
        start += len(ids) + 1
    assert len(four) == len(five) == len(rows)


def test_files_round_trip_odd_texts_and_small_blocks(spark, odd, hf, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 64)
    path = shared_path(spark, "t")
    huffman.write_ids(odd, path, WORDS)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman.read_ids(spark, path).collect()}
    assert got == {r.doc_id: [*hf.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd.collect()}


def test_empty_tables(spark, empty):
    assert not pieces.encode_documents(empty, PIECES).count() and not token_counts.token_counts(empty, WORDS).count()
    path = shared_path(spark, "t")
    huffman.write_ids(empty, path, WORDS)
    assert not huffman.read_ids(spark, path).count()


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_code_is_optimal_under_its_limit(n):
    import heapq

    rng = np.random.default_rng(n)
    counts = np.zeros(n + 5, np.int64)
    counts[rng.permutation(n + 5)[:n]] = rng.zipf(1.3, n).clip(max=10**6)
    lengths = huffman.code_lengths(counts, 16).astype(int)
    used = counts > 0
    assert (lengths[used] > 0).all() and not lengths[~used].any() and lengths.max() <= 16
    assert n == 1 or abs((0.5 ** lengths[used]).sum() - 1) < 1e-12
    free = huffman.code_lengths(counts, 60)
    heap, cost = sorted(counts[used].tolist()), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert n == 1 or (counts * free).sum() == cost
    book = huffman.Book(lengths)
    ids = rng.choice(np.flatnonzero(used), 5000)
    bits, marks = book.encode(ids)
    assert (book.decode(bits, marks, len(ids)) == ids).all()


def test_word_table_starts_anew():
    seen = []

    def lengths(words):
        seen.extend(words)
        return np.array([len(w) for w in words], np.int32), np.ones(len(words), np.int64)

    table = WordTable(lengths, np.int32, cap=8)
    for k in range(5):
        words = [b"w" * (i % 11) + bytes([65 + k]) for i in range(30)]
        flat, upto = table.concatenated(words)
        assert flat.tolist() == [len(w) for w in words] and upto[-1] == 30 and len(table.known) == 11
