"""Language ID: unigrams over a fixed vocabulary of pieces, summed over all segmentations.

For each language the model has a probability of every piece. A word's probability is the sum over all ways of cutting it into pieces (the
forward algorithm), a text's the product over its words. Probabilities are learnt by expectation-maximisation: expected counts of pieces
under the present model, by the forward and backward algorithms, over the training words. Sums are kept in scale, so words have any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import WordTable, drop, kept, model_file, ship, slices, utf8, written

ITERATIONS, SMOOTH, FLOOR = 3, 0.05, 1e-9
#: Times the mean surprise a character of its language's documents that a text's may be.
FIT_RATIO = 3.0
#: Bytes of a text cut into words at a time, and words whose segmentations are summed at a time.
CUT_BYTES, STEP = 1 << 20, 1 << 13
#: A word: a letter, and the letters and marks after it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Of texts in Latin-1: letters lower-cased, all else a space.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Words of more characters are summed by stretches, so many characters of which are looked up at a time.
LONG_WORD, LONG_STEP, STRETCH = 1 << 12, 1 << 17, 256
TINY = 1e-200


def words_in(text: bytes) -> Iterator[list[str]]:
    """The lower-case words of a text, a bounded list at a time."""
    whole = text.decode(errors="replace")
    try:
        flat = whole.encode("latin-1").translate(FOLD)
    except UnicodeEncodeError:
        batch: list[str] = []
        for m in WORD.finditer(whole.lower()):
            batch.append(m.group())
            if len(batch) == CUT_BYTES >> 3:
                yield batch
                batch = []
        yield batch
        return
    at = 0
    while at < len(flat):
        end = len(flat) if len(flat) - at <= CUT_BYTES else flat.find(b" ", at + CUT_BYTES)
        end = len(flat) if end < 0 else end
        yield flat[at:end].decode("latin-1").split()
        at = end


def vocabulary(name: str) -> list[str]:
    """The model file's pieces that a lower-case word may hold, some with a space before them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file(name))
    names = {sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return sorted(p for p in names if p == p.lower() and regex.fullmatch(r" |(?: ?[\p{L}\p{M}]+)", p))


class Lattice:
    """Piece numbers of the substrings of words, from a trie of the pieces. Numbers: 0 no piece, 1 a character that is no piece of its own,
    then the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.single = np.ones(0x110000, np.int32)
        kinds: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        at_node = {0: 0}
        for number, p in enumerate(pieces, 2):
            if len(p) == 1:
                self.single[ord(p)] = number
                continue
            node = 0
            for c in p:
                node = nodes.setdefault((node, kinds.setdefault(c, len(kinds) + 1)), len(nodes) + 1)
            at_node[node] = number
        self.kind = np.zeros(0x110000, np.int32)
        for c, k in kinds.items():
            self.kind[ord(c)] = k
        self.width = len(kinds) + 1
        keys = np.array([n * self.width + k for n, k in nodes], np.int64)
        # A hash table of (node, character), an eighth full at most.
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, place = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[todo[free]]  # of those for one place the last stays
            won = self.keys[place] == keys[todo]
            self.next[place[won]] = todo[won] + 1
            todo, place = todo[~won], (place[~won] + 1) & ((1 << self.bits) - 1)
        self.piece = np.zeros(len(nodes) + 1, np.int32)
        self.piece[list(at_node)] = list(at_node.values())

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each node and character, or 0."""
        key = node * self.width + self.kind[code]
        out, todo, place = np.zeros(len(key), np.int64), np.arange(len(key)), self._place(key)
        while len(todo):
            found = self.keys[place]
            hit = found == key
            out[todo[hit]] = self.next[place[hit]]
            on = ~hit & (found >= 0)
            todo, key, place = todo[on], key[on], (place[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each word's start, its characters, ids): ids[k - 1, at] is the number of the piece of k characters at that place of all words one
        after the other."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        ids = np.zeros((self.longest, len(code)), np.int32)
        ids[0] = self.single[code]
        ends = np.repeat(starts + sizes, sizes)
        at, node = np.arange(len(code)), self._step(np.zeros(len(code), np.int64), code)
        for k in range(2, self.longest + 1):
            go = (node > 0) & (at + k <= ends[at])
            at = at[go]
            node = self._step(node[go], code[at + k - 1])
            ids[k - 1, at] = self.piece[node]
        return starts, sizes, ids


def forward(number: Callable[[int, int], np.ndarray], n: int, longest: int, p: np.ndarray, last: bool = False) -> list[np.ndarray]:
    """Log-probabilities, by word and language, of the first 0 to n characters, or with last of all n only. number(j, k): piece numbers of the
    k characters before j, a word each. p: by piece number and language; p[0] is 0."""
    words = len(number(1, 1))
    alpha, shift = [np.ones((words, p.shape[1]))], np.zeros((words, p.shape[1]))
    logs = [shift]
    for j in range(1, n + 1):
        own = np.zeros_like(shift)
        for k in range(1, min(j, longest) + 1):
            ids = number(j, k)
            if k == 1 or ids.any():
                own += alpha[j - k] * p[ids]
        if own.min(initial=1.0) < TINY:
            down = np.where(own < TINY, own, 1.0)
            shift = shift + np.log(down)
            own /= down
            for k in range(1, min(j, longest)):
                alpha[j - k] = alpha[j - k] / down
        alpha.append(own)
        if j >= longest:
            alpha[j - longest] = None
        if not last or j == n:
            logs.append(np.log(own) + shift)
    return logs


def transfers(ids: np.ndarray, at: np.ndarray, length: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices, logs): what stretches of `length` characters, which begin at the places `at` of ids, do to the probabilities of the texts that
    end at the last few places: by stretch, place back after it, place back before it, and language; a matrix times exp(log) is the sum."""
    longest, languages = len(ids), p.shape[1]
    window = [np.zeros((len(at), longest, languages)) for _ in range(longest)]
    for k in range(longest):
        window[k][:, k] = 1.0
    logs = np.zeros((len(at), languages))
    for j in range(1, length + 1):
        own = np.zeros_like(window[0])
        for k in range(1, longest + 1):
            numbers = ids[k - 1, at + j - k]
            if k == 1 or numbers.any():
                own += window[k - 1] * p[numbers][:, None, :]
        window = [own, *window[:-1]]
        top = own.max(1)
        if top.min(initial=1.0) < TINY:
            down = np.where((top < TINY) & (top > 0), top, 1.0)
            logs += np.log(down)
            window = [w / down[:, None, :] for w in window]
    return np.stack(window, 1), logs


def long_log_probability(lattice: Lattice, word: str, p: np.ndarray) -> np.ndarray:
    """By language, of a word of any length, in memory that doesn't grow with it: its stretches' matrices are computed side by side, some at a
    time, and applied one after the other."""
    longest = lattice.longest
    ends, log = np.zeros((longest, p.shape[1])), np.zeros(p.shape[1])
    ends[0] = 1.0
    for a in range(0, len(word), LONG_STEP):
        own = word[max(0, a - longest + 1) : a + LONG_STEP]
        lead = min(a, longest - 1)
        ids = np.pad(lattice.numbers([own])[2], ((0, 0), (longest - 1 - lead, 0)))
        n = len(own) - lead
        whole = n // STRETCH
        for starts, length in ((np.arange(whole) * STRETCH, STRETCH), (np.array([whole * STRETCH]), n - whole * STRETCH)):
            if not len(starts) or not length:
                continue
            matrices, logs = transfers(ids, longest - 1 + starts, length, p)
            for m, down in zip(matrices, logs, strict=True):
                ends = np.einsum("oil,il->ol", m, ends)
                top = np.maximum(ends.max(0), np.finfo(float).tiny)
                ends /= top
                log += down + np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(ends[0]) + log


def by_length(lattice: Lattice, words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(places of words of one length, that length, their starts, piece numbers)."""
    for a in range(0, len(words), STEP):
        starts, sizes, ids = lattice.numbers(words[a : a + STEP])
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            yield a + at, n, starts[at], ids


def log_probabilities(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
    """By word and language."""
    out = np.zeros((len(words), p.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
    for i in long:
        out[i] = long_log_probability(lattice, words[i], p)
    if long:
        words = ["" if len(w) > LONG_WORD else w for w in words]
    for at, n, starts, ids in by_length(lattice, words):
        if n:
            out[at] = forward(lambda j, k, s=starts, ids=ids: ids[k - 1, s + j - k], n, lattice.longest, p, last=True)[-1]
    return out


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the words, of which there are `counts`, under one language's probabilities p."""
    out = np.zeros(len(p))
    for at, n, starts, ids in by_length(lattice, words):
        before = forward(lambda j, k, s=starts, ids=ids: ids[k - 1, s + j - k], n, lattice.longest, p[:, None])
        after = forward(lambda j, k, s=starts + n, ids=ids: ids[k - 1, s - j], n, lattice.longest, p[:, None])
        for i in range(n):
            for k in range(1, min(n - i, lattice.longest) + 1):
                number = ids[k - 1, starts + i]
                if number.any():
                    share = np.exp((before[i] + after[n - i - k] - before[n])[:, 0]) * p[number]
                    out += np.bincount(number, counts[at] * share, len(p))
    return out


class LanguageModel:
    """p: by piece number and language. floors: by language the least mean log-probability a character that counts as explained, or none."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray, floors: np.ndarray | None = None):
        self.pieces, self.languages, self.p, self.floors = pieces, languages, p, floors

    def _ready(self) -> tuple[Lattice, WordTable]:
        """What a worker keeps from task to task for the model that it has seen last."""
        key = "languages", hashlib.sha256(self.p.tobytes()).digest()
        return kept(key, lambda: (Lattice(self.pieces), WordTable(self._words, np.float32)))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = log_probabilities(self._ready()[0], [" " + w for w in words], self.p)
        return got.astype(np.float32).reshape(-1), np.full(len(words), len(self.languages))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the likeliest language (first by name of equals), its posterior probability, and how the text's mean log-probability a
        character lies above the language's floor (0 without floors); `und`, 0 and 0 where there is no word."""
        n = len(self.languages)
        total, chars = np.zeros((len(texts), n)), np.zeros(len(texts))
        if n:
            table = self._ready()[1]
            words: list[str] = []
            owner: list[int] = []
            sizes: list[int] = []

            def flush() -> None:
                of = np.repeat(np.array(owner, np.int64), sizes)
                rows = table.numbers(words)
                values = table.flat[: table.used].reshape(-1, n)[rows]
                for k in range(n):
                    total[:, k] += np.bincount(of, values[:, k], len(texts))
                chars[:] += np.bincount(of, np.fromiter(map(len, words), np.int64, len(words)) + 1, len(texts))
                for x in (words, owner, sizes):
                    x.clear()

            for i, t in enumerate(texts):
                for batch in words_in(t):
                    words += batch
                    owner.append(i)
                    sizes.append(len(batch))
                    if len(words) >= CUT_BYTES >> 3:
                        flush()
            flush()
        seen = chars > 0
        if not seen.any():
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = np.argmax(total, axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        floors = np.zeros(n) if self.floors is None else self.floors
        above = total[np.arange(len(texts)), best] / np.maximum(chars, 1) - floors[best]
        return [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, posterior, 0.0), np.where(seen, above, 0.0)


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int | None) -> tuple[DataFrame, list[str]]:
    """(lang, text) of the documents to learn from, and the languages."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null").where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return own.select("lang", "text"), []
    if max_docs is None:
        return own.select("lang", "text"), sorted(sizes)
    share = F.create_map(*(F.lit(x) for lang in sorted(sizes) for x in (lang, int(min(1.0, max_docs / sizes[lang]) * (1 << 30)))))
    return own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text"), sorted(sizes)


def fit_languages(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int | None = None, with_floors: bool = False) -> LanguageModel:
    """Learns from documents with a language whose id's crc32 doesn't leave 1 by 3: all of them, or, only if max_docs is given, about so many
    of a language by a hash of the id (rows of one id are drawn together). vocab: a model file's path, or a public tokeniser's bare name. Repeated rows count as often as they
    are there. The driver gets a row a language and piece, which the vocabulary bounds. Without such documents the model knows no language.
    with_floors: in one more pass over those documents, FIT_RATIO times each language's mean log-probability a character. (Its spread over
    documents is no measure: it is that of long ones, while a short text with a key or a rare name in it lies many deviations off.)"""
    ship(docs.sparkSession)
    pieces = vocabulary(vocab)
    drawn, languages = _learnable(docs, id_col, text_col, lang_col, max_docs)
    if not languages:
        return LanguageModel(pieces, [], np.zeros((len(pieces) + 2, 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            total: dict = {}
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for words in words_in(text):
                    for w in words:
                        total[lang, w] = total.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([w for _, w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])

    words = written(drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((len(pieces) + 2, len(languages)), 1.0 / (len(pieces) + 1))
    p[0], p[1] = 0, FLOOR
    for _ in range(ITERATIONS):
        got = words.mapInArrow(_expectation(pieces, languages, p), "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(p)
        total[got["piece"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] = got["n"]
        p = (total + SMOOTH) / (total[2:].sum(axis=0) + SMOOTH * len(pieces))
        p[0], p[1] = 0, FLOOR
    drop(words)
    model = LanguageModel(pieces, languages, p)
    if with_floors:
        found = language(model, F.col("text"))
        own = drawn.select(found.alias("x")).where("x.lang_pred != 'und'").groupBy("x.lang_pred").agg(F.avg("x.above").alias("m"))
        by = {r.lang_pred: FIT_RATIO * r.m for r in own.collect()}
        model.floors = np.array([by.get(x, -np.inf) for x in languages])
    return model


def _expectation(pieces: list[str], languages: list[str], p: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = kept(("lattice", hashlib.sha256("\n".join(pieces).encode()).digest()), lambda: Lattice(pieces))
        total = np.zeros_like(p)
        for b in batches:
            lang, word, n = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for k, name in enumerate(languages):
                mine = [i for i, x in enumerate(lang) if x == name]
                if mine:
                    total[:, k] += expected(lattice, [" " + word[i] for i in mine], n[mine], p[:, k])
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[piece, k], pa.float64())], names=["lang", "piece", "n"])

    return run


def language(model: LanguageModel, text: Column) -> Column:
    """struct of lang_pred, score and above of each whole text, however long. Null, empty and letterless texts are `und`, with zeros; of
    equally likely languages the first by name is taken. above: of the mean log-probability a character, what exceeds the language's floor
    (without floors, all of it): below 0, no learned language explains the text. Repeated rows get equal results; an empty table none."""

    def predict(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores, above = [np.zeros(0)], [np.zeros(0)]
        for b in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), 0):
            lang, score, more = model.predict(utf8(b.column(0)))
            langs += lang
            scores.append(score)
            above.append(more)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(above), pa.float64())], names=["lang_pred", "score", "above"])

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, "lang_pred string, score double, above double")(text)
