"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned by quantiles. Cyclic boosting visits one feature after the other, fits a shallow tree to the logistic gradients of its
bins and adds the leaves to the feature's table; then the same for the pairs of features that help most. A score is the sum of table
entries, so scoring is a look-up and an addition a feature for a whole batch at once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import drop, joined, line_numbers, ship, slices, utf8, word_numbers, words_of, written
from scorelake.llm.repetition import LINE, WORD

#: Rows that the model is fitted on at most (about: drawn by a hash of the id); they come to the driver as features.
MAX_TRAIN_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIRS, RATE, LEAST = 32, 8, 150, 6, 0.1, 10

FEATURES = ["log_words", "word_length", "upper", "digits", "symbols", "stops", "commas", "shouts", "bars", "other_signs", "high_bytes", "words_a_line", "repeats_last_word", "repeats_a_word", "repeats_a_line"]
_CLASSES = [(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b"0123456789", b"#*$%&<>@^~", b".;:?", b",", b"!", b"|", b"()[]{}\"'`/\\_=+-", bytes(range(128, 256))]


def features(texts: list[bytes]) -> np.ndarray:
    """A row a text. Texts without words have zeros."""
    docs = len(texts)
    buf, at = joined(texts)
    starts, ends = words_of(buf, WORD)
    owner = np.searchsorted(at, starts, side="right") - 1
    n = np.bincount(owner, minlength=docs).astype(np.float64)
    chars = np.bincount(owner, ends - starts, docs)
    own = word_numbers(buf, starts, ends) * docs + owner
    last = np.zeros(len(own), bool)
    last[1:] = own[1:] == own[:-1]
    order = np.argsort(own, kind="stable")
    seen = np.zeros(len(own), bool)
    seen[order[1:]] = own[order][1:] == own[order][:-1]
    a, b = words_of(buf, LINE)
    line_owner = np.searchsorted(at, a, side="right") - 1
    line = line_numbers(buf, a, b) * docs + line_owner
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = line[order][1:] == line[order][:-1]
    lines = np.bincount(line_owner, minlength=docs)
    group = np.full(256, len(_CLASSES), np.int64)
    for k, c in enumerate(_CLASSES):
        group[np.frombuffer(c, np.uint8)] = k
    kinds = np.stack([np.add.reduceat(group[buf] == k, at[:-1], dtype=np.int64) for k in range(len(_CLASSES))], axis=1) if docs else np.zeros((0, len(_CLASSES)))
    words, size = np.maximum(n, 1), np.maximum(chars, 1)
    out = np.column_stack([np.log1p(n), chars / words, kinds / size[:, None], n / np.maximum(lines, 1), np.bincount(owner[last], minlength=docs) / words, np.bincount(owner[seen], minlength=docs) / words, np.bincount(line_owner[again], b[again] - a[again], docs) / size])
    return np.where(n[:, None] > 0, out, 0).astype(np.float32)


def batch_features(col: pa.Array) -> np.ndarray:
    """Of a column of texts, a slice at a time."""
    rows = [features(utf8(b.column(0))) for b in slices(iter([pa.RecordBatch.from_arrays([col], names=["text"])]), 0)]
    return np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *rows])


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values of a tree over ordered bins with gradient and hessian sums g and h: split where the gain is best, `depth` times deep."""
    whole = g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0)
    gain[(hl < 0.05 * LEAST) | (hr < 0.05 * LEAST)] = -1
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + 1.0):
        return np.full(len(g), whole)
    return np.concatenate([_leaves(g[: k + 1], h[: k + 1], depth - 1), _leaves(g[k + 1 :], h[k + 1 :], depth - 1)])


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values on a grid: the best cut of one axis, then of each side the best cut of the other; both orders are tried."""

    def one(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        best = (-1.0, np.zeros_like(g))
        for k in range(1, len(g)):
            out, gain = np.empty_like(g), 0.0
            for part in (slice(0, k), slice(k, None)):
                v = _leaves(g[part].sum(axis=0), h[part].sum(axis=0), 1)
                out[part] = v
                gain += float((2 * v * g[part].sum(axis=0) - v**2 * h[part].sum(axis=0)).sum())
            if gain > best[0]:
                best = (gain, out)
        return best

    a, b = one(g, h), one(g.T, h.T)
    return a[1] if a[0] >= b[0] else b[1].T


class Gam:
    """Tables over bins: `edges` a feature, `tables` a feature, `pairs` of features with coarser edges and a grid each."""

    def __init__(self) -> None:
        self.base, self.edges, self.coarse, self.tables, self.pairs = 0.0, [], [], [], []

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        """No rows: every score is 0.5. Rows of one label: every score is close to it."""
        if not len(y):
            return self
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        cuts = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) for j in range(x.shape[1])]
        self.edges, self.coarse = cuts(BINS), cuts(PAIR_BINS)
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.base)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                g, h = slope()
                step = RATE * _leaves(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), 2)
                table += step
                total += step[bins[:, j]]
        g, h = slope()
        sums = {}
        for a, b in combinations(range(x.shape[1]), 2):
            shape = len(self.coarse[a]) + 1, len(self.coarse[b]) + 1
            at = grid[:, a] * shape[1] + grid[:, b]
            gs, hs = np.bincount(at, g, shape[0] * shape[1]), np.bincount(at, h, shape[0] * shape[1])
            sums[a, b] = float((gs**2 / (hs + 1.0)).sum())
        for a, b in sorted(sums, key=lambda k: (-sums[k], k))[:PAIRS]:
            self.pairs.append((a, b, np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))))
        for _ in range(ROUNDS // 5):
            for a, b, table in self.pairs:
                g, h = slope()
                at = grid[:, a] * table.shape[1] + grid[:, b]
                step = RATE * _pair_leaves(np.bincount(at, g, table.size).reshape(table.shape), np.bincount(at, h, table.size).reshape(table.shape))
                table += step
                total += step[grid[:, a], grid[:, b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for a, b, table in self.pairs:
            total += table[grid[:, a], grid[:, b]]
        return 1 / (1 + np.exp(-total))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves the remainder 1 by 3; null ids aren't held out, and never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Gam:
    """A model of label_col, learnt from labelled ids that aren't held out: all, or about max_rows of them by a hash of the id.

    Several labels of one id count as their mean, several texts as one of them, so repeated rows weigh no more and neither the broadcast
    labels nor the features at the driver exceed a row an id. Null ids and labels aren't learnt from. Columns other than those named aren't
    read, so their names can't clash. Without rows every score is 0.5.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    total = known.count()
    limit = int(min(1.0, max_rows / max(1, total)) * (1 << 30))
    drawn = written(known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < limit), "labels")
    if (n := drawn.count()) > 2 * max_rows:
        raise ValueError(f"{n} labelled ids drawn for about {max_rows}: their hashes aren't spread")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("label_id"))  # of checked size
    vector = F.arrow_udf(_vectors, "array<float>")
    one = rows.select("label_id", "y", vector("text").alias("x")).groupBy("label_id").agg(F.first("y").alias("y"), F.min("x").alias("x"))
    got = one.toPandas().sort_values("label_id", kind="stable")
    drop(drawn)
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(FEATURES))
    return Gam().fit(x, got["y"].to_numpy(np.float64))


def _vectors(text: pa.Array) -> pa.Array:
    x = batch_features(text)
    return pa.array(list(x), pa.list_(pa.float32()))


def quality_score(model: Gam, text: Column) -> Column:
    """Score of each whole text, however long, 0 to 1, higher: label 1 likelier. Null and empty texts have a score too, that of a text without
    words. Equal texts have equal scores, so repeated rows too; an empty table has none."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(batch_features(texts)), pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(text)


_vectors.__annotations__ = {"text": pa.Array, "return": pa.Array}
