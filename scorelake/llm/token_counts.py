"""Token counts at every prefix of a text, by dynamic programming over word-level BPE.

Of a pre-token's bytes b[:i], the last token t of the encoding is the only one for which the encoding of b[:i - len(t)] ends in a token
that may stand before t, that is, BPE joins the two to nothing else. So last[i] and count[i] = count[i - len(t)] + 1 follow from shorter
prefixes in one pass, once for prefixes that go on (inside a word) and once for those that end there. A text's prefix counts are those of
its pre-tokens, one upon the other.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import STEP_WORDS, WordTable, joined, kept, model_file, ragged, ship, slices, utf8
from scorelake.llm.word_bpe import WordBpe, pre_tokens, values

END = "</w>"
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PrefixBpe:
    def __init__(self, path: str):
        with open(model_file(path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.kinds: dict[str, int] = {}  # bits: 1 a token inside a word, 2 a token at a word's end
        for t in model["vocab"]:
            stem = t.removesuffix(END)
            self.kinds[stem] = self.kinds.get(stem, 0) | (2 if stem != t else 1)
        self.longest = max(map(len, self.kinds))
        self.letters = byte_letters()
        self.known: dict = {}
        self.before: tuple = "", [""], [0], [0]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the leftmost pair of the best rank until there is none."""
        rank = self.rank.get
        while len(symbols) > 1:
            ranks = [rank(p, NONE) for p in zip(symbols, symbols[1:])]  # noqa: B905
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _fits(self, pair: tuple[str, str], kind: int) -> int:
        """Bits: 1 if BPE leaves the two of pair as they are, side by side; 2 if so with the word's end after them. The first may be empty."""
        before, token = pair
        own = [x for x in (before, token) if x]
        got = kind & 1 and self.merged([*before, *token]) == own
        if kind & 2:
            got |= 2 * (self.merged([*before, *token[:-1], token[-1] + END]) == [*own[:-1], token + END])
        if len(self.known) > 600_000:
            self.known.clear()
        self.known[pair] = got
        return got

    def counts(self, word: bytes) -> list[int]:
        """Number of tokens of each prefix that ends with a character, taken as a whole pre-token. What the word before has in common with
        this one is kept, so sorted words share the work on their common prefixes."""
        w, n = "".join(map(self.letters.__getitem__, word)), len(word)
        old, last, count, ended = self.before
        k = 0
        while k < n and k < len(old) and w[k] == old[k]:
            k += 1
        del last[k + 1 :], count[k + 1 :], ended[k + 1 :]
        kinds, known, longest = self.kinds.get, self.known.get, self.longest
        for i in range(k + 1, n + 1):
            go = end = 0
            for j in range(max(0, i - longest), i):
                t = w[j:i]
                kind = kinds(t)
                if kind is None:
                    continue
                pair = last[j], t
                fit = known(pair)
                if fit is None:
                    fit = self._fits(pair, kind)
                if fit & 1:
                    go = count[j] + 1
                    token = t
                if fit & 2:
                    end = count[j] + 1
                if go and end:
                    break
            last.append(token)
            count.append(go)
            ended.append(end)
        self.before = w, last, count, ended
        return [x for x, b in zip(ended[1:], [*word[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def deltas(self, word: bytes) -> list[int]:
        """What each character of a pre-token adds to the number of tokens. A cut contraction ('l of 'll) is two pre-tokens."""
        own = self.counts(word)
        if word in (b"'re", b"'ve", b"'ll"):
            own[1] = own[0] + self.counts(word[1:2])[-1]
        return [own[0], *(b - a for a, b in zip(own, own[1:], strict=False))]


@cache
def joins_before() -> frozenset[str]:
    """Characters that composition may join with the one before them although they aren't combining marks."""
    out = {c for x in range(0x110000) if (d := unicodedata.decomposition(chr(x))) and d[0] != "<" and len(d.split()) == 2 and not unicodedata.combining(c := chr(int(d.split()[1], 16)))}
    return frozenset(out | {chr(x) for x in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})  # and vowels and ends of Hangul


#: White space as Unicode has it, which the library takes for one space.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
SPACE_RUN = regex.compile(f"[{''.join(WHITE)}]+")


class Counter:
    """path: a file, or a public tokeniser's bare name."""

    def __init__(self, path: str):
        self.bpe, self.words = PrefixBpe(path), WordBpe(path)
        self.table = WordTable(self._compute, np.int8, 1_000_000, 128 << 20)  # what it has computed is dear
        self.cut = regex.compile("|".join(map(regex.escape, sorted((s.decode() for s in self.words.special), key=len, reverse=True))) or r"(?!)")
        self.bytes = {c: b for b, c in enumerate(self.bpe.letters)}

    def _compute(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(words)), key=words.__getitem__)
        each: list = [()] * len(words)
        for i in order:
            each[i] = self.bpe.deltas(words[i])
        return np.array([x for d in each for x in d], np.int8), np.array([len(d) for d in each])

    def _spread(self, texts: list[bytes]) -> list[np.ndarray]:
        """Deltas of plain texts, a character each; white space adds nothing."""
        buf, at = joined(texts)
        buf, starts, ends = pre_tokens(buf)
        flat, _ = values(self.table, buf, starts, ends)
        char = (buf & 0xC0) != 0x80
        inside = np.zeros(len(buf) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        out = np.zeros(len(buf), np.int8)
        out[char & (np.cumsum(inside[:-1], dtype=np.int8) > 0)] = flat
        return [out[a : b - 1][char[a : b - 1]] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _general(self, text: str) -> np.ndarray:
        """Deltas of any text, cut at the special tokens' strings as the library does."""
        out, at = [np.zeros(0, np.int64)], 0
        for m in self.cut.finditer(text):
            own = self._deltas(text[at : m.end()])
            own[-1] = 1 - own[m.start() - at : -1].sum()  # the string is one token instead of those of its characters
            out.append(own)
            at = m.end()
        out.append(self._deltas(text[at:]))
        return np.concatenate(out)

    def _aligned(self, text: str) -> tuple[str, np.ndarray, list[tuple[int, int, int]]]:
        """The normalised text, how much of it the first 1, 2, .. characters of text give, and those places that lie inside characters that
        are normalised together: (place, where they begin in text, and in the normalised text)."""
        lib = self.words.library.normalizer.normalize_str
        whole = lib(text)
        kept = np.ones(len(text), bool)
        for m in SPACE_RUN.finditer(text):
            kept[m.start() + 1 : m.end()] = False
        if int(kept.sum()) == len(whole) and unicodedata.is_normalized("NFC", text):
            return whole, np.cumsum(kept), []
        joins, norm, places, inside = joins_before(), [], [], []
        i = n = 0
        while i < len(text):
            j, space = i + 1, text[i] in WHITE
            while j < len(text) and (text[j] in WHITE if space else unicodedata.combining(text[j]) or text[j] in joins):
                j += 1
            new = lib(text[i:j])
            if j > i + 1 and not space:
                inside += [(k, i, n) for k in range(i, j - 1)]
            norm.append(new)
            n += len(new)
            places += [n] * (j - i)
            i = j
        return "".join(norm), np.array(places, np.int64), inside

    def _deltas(self, text: str) -> np.ndarray:
        """What each character of a text without special strings adds to the number of tokens."""
        if not text:
            return np.zeros(0, np.int64)
        norm, places, inside = self._aligned(text)
        split = self.words.library.pre_tokenizer.pre_tokenize_str
        per = np.zeros(len(norm) + 1, np.int64)
        begin = np.zeros(len(norm) + 1, np.int64)  # where the pre-token that holds, or ends before, each place begins; white space begins anew
        last = 0
        pieces = split(norm)
        for i in range(0, len(pieces), STEP_WORDS):
            part = pieces[i : i + STEP_WORDS]
            first, end = np.array([at for _, at in part]).T
            # A pre-token that comes again is looked up, in whatever script.
            per[ragged(first + 1, end - first)] = self.table.concatenated([bytes(map(self.bytes.__getitem__, piece)) for piece, _ in part])[0]
        for _, (a, b) in pieces:
            begin[last : a + 1] = np.arange(last, a + 1)
            begin[a + 1 : b + 1] = a
            last = b + 1
        begin[last:] = np.arange(last, len(norm) + 1)
        total = np.cumsum(per)
        out = total[places]
        for k, i, n in inside:
            a = int(begin[n])
            some = norm[a:n] + self.words.library.normalizer.normalize_str(text[i : k + 1])
            out[k] = total[a] + sum(sum(self.bpe.deltas(bytes(map(self.bytes.__getitem__, piece)))) for piece, _ in split(some))
        return np.diff(out, prepend=0)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        quick = [i for i, t in enumerate(texts) if self.words.fast(t)]
        out: list = [None] * len(texts)
        for i, d in zip(quick, self._spread([texts[i] for i in quick]), strict=True):
            out[i] = d
        for i, x in enumerate(out):
            if x is None:
                out[i] = self._general(texts[i].decode())
        return out


def counter(path: str) -> Counter:
    return kept(("counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes (UTF-8), n_tokens, and prefix_deltas: little-endian signed 16-bit integers, one a character of the
    text, whose running sum is the token count of every prefix. (A character may take tokens away, as one that composes with the one before it
    or ends a special token's string.)

    Null and empty texts have no bytes, tokens and prefixes. Texts of any length are counted whole, a text at a time in memory. Repeated rows
    and ids give a row each, an empty table none. Other columns aren't read, so their names can't clash.
    """
    ship(docs.sparkSession)
    own = docs.select(id_col, text_col)
    schema = T.StructType([own.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_deltas", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in slices(batches, 1):
            texts = utf8(b.column(1))
            deltas = c(texts)
            cols = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(d.sum(dtype=np.int64)) for d in deltas], pa.int64()), pa.array([d.astype("<i2").tobytes() for d in deltas], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_bytes", "n_tokens", "prefix_deltas"])

    return own.mapInArrow(run, schema)


def longest_prefix(prefix_deltas: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from what token_counts has stored; no text is encoded again."""

    @F.pandas_udf(T.LongType())
    def fit(s):  # noqa: ANN001, ANN202
        return s.map(lambda d: int(np.flatnonzero(np.append(0, np.cumsum(np.frombuffer(d, "<i2"), dtype=np.int64)) <= budget)[-1]))

    return fit(prefix_deltas)
