"""Quality rules on repetition: how much of a text lies in n-grams of words, or lines, that it holds before.

Distinct words are numbered; n-grams of several lengths get rolling hashes of their words' numbers, all texts of a slice at once, and equal
ones are found by sorting. N-grams of one hash are compared word by word, so the counts are exact. A word counts as repeated at a length if an
n-gram around it occurs twice or more in its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorelake.llm.common import joined, line_numbers, ship, slices, utf8, word_numbers, words_of

LENGTHS = (3, 5, 7, 10)
#: Kept if the shares of word characters in n-grams or lines seen before stay within these.
MAX_NGRAM_SHARE = {5: 0.35, 7: 0.30, 10: 0.25}
MAX_LINE_SHARE = 0.30
SYMBOLS = b"#*$%&|<>"
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
LINE = np.ones(256, bool)
LINE[10] = False
_MIX, _BASE, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in LENGTHS if n > 3)]


def _groups(keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of parts, of which keys are hashes: whether it occurs twice or more, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    at = np.flatnonzero(same)
    if not all(np.array_equal(p[order[at]], p[order[at + 1]]) for p in parts):  # two n-grams of one hash: those are told apart by sorting them
        order = np.lexsort((np.arange(len(keys)), *parts))
        same = np.all([p[order[1:]] == p[order[:-1]] for p in parts], axis=0)
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, before


def _covered(hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside the windows of n words whose first is in hit."""
    edge = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(hit)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    buf, at = joined(texts)
    starts, ends = words_of(buf, WORD)
    doc = np.searchsorted(at, starts, side="right") - 1
    docs = len(texts)
    per = lambda mask, weight=None: np.bincount(doc[mask], None if weight is None else weight[mask], docs).astype(np.int64)
    first_byte = (buf & 0xC0) != 0x80
    length = np.add.reduceat(first_byte, np.stack([starts, ends], axis=1).ravel(), dtype=np.int64)[::2] if len(starts) else np.zeros(0, np.int64)
    every = np.ones(len(starts), bool)
    out = {"n_words": per(every), "word_chars": per(every, length)}
    marks = np.flatnonzero(np.isin(buf, np.frombuffer(SYMBOLS, np.uint8)))
    out["n_symbols"] = np.bincount(np.searchsorted(at, marks, side="right") - 1, None, docs).astype(np.int64)

    word = word_numbers(buf, starts, ends)
    hashed = (word.astype(np.uint64) + np.uint64(1)) * _ODD
    hashed ^= hashed >> np.uint64(32)
    rolled, n = np.zeros(len(word), np.uint64), 0
    for size in LENGTHS:
        for n in range(n, size):  # rolled[i]: the hash of the words i .. i + n
            m = max(0, len(word) - n)
            rolled[:m] = rolled[:m] * _BASE + hashed[n : n + m]
        n = size
        first = np.flatnonzero(doc[: max(0, len(word) - size + 1)] == doc[size - 1 :])
        keys = rolled[first] ^ ((doc[first].astype(np.uint64) + np.uint64(1)) * _MIX)
        again, before = _groups(keys, [doc[first], *(word[first + k] for k in range(size))])
        hit = np.zeros(len(word), bool)
        hit[first] = again if size == 3 else before
        inside = _covered(hit, size, len(word)) if len(word) else hit
        if size == 3:
            out["n_repeat_words"] = per(inside)
        else:
            out[f"dup_{size}gram_chars"] = per(inside, length)

    a, b = words_of(buf, LINE)
    sums = np.concatenate([[0], np.cumsum(length)])
    held = sums[np.searchsorted(starts, b)] - sums[np.searchsorted(starts, a)]
    a, b, held = a[held > 0], b[held > 0], held[held > 0]
    owner = np.searchsorted(at, a, side="right") - 1
    number = line_numbers(buf, a, b)
    _, before = _groups(number * docs + owner, [number, owner])
    out["n_dup_lines"] = np.bincount(owner[before], None, docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(owner[before], held[before], docs).astype(np.int64)
    return out


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, the counts in COLUMNS, base_failed (fewer than 50 words, or over half of them in 3-word windows that occur
    twice or more) and kept (not base_failed, and shares of characters in repeated lines and n-grams within the limits).

    n_dup_lines: lines with a word that equal an earlier line. dup_*: characters of words inside n-grams, or lines, seen before in the text;
    the first occurrence isn't counted. Null and empty texts have no words and fail the base. Texts of any length are measured whole; n-grams
    and lines are equal only if their bytes are. Repeated rows get equal results, an empty table none. Other columns aren't read, so their names
    can't clash.
    """
    ship(docs.sparkSession)
    own = docs.select(id_col, text_col)
    schema = T.StructType([own.schema[0], *(T.StructField(c, T.LongType()) for c in COLUMNS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            m = measure(utf8(b.column(1)))
            failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            most = m["dup_line_chars"] <= MAX_LINE_SHARE * m["word_chars"]
            for n, share in MAX_NGRAM_SHARE.items():
                most &= m[f"dup_{n}gram_chars"] <= share * m["word_chars"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(~failed & most)], names=[id_col, *COLUMNS, "base_failed", "kept"])

    return own.mapInArrow(run, schema)
