"""Fast exact encoding with a word-level BPE tokeniser of the `tokenizers` library (NFC, white space, lower case; then pieces of letters,
single digits, other signs; then BPE with word ends).

A text of ASCII and Latin-1 letters is cut into pre-tokens with numpy, and each distinct pre-token is encoded once a worker. Any other text,
and any that holds a special token's string, is left to the library whole.
"""

from __future__ import annotations

import numpy as np

from scorelake.llm.common import STEP_WORDS, WordTable, joined, kept, model_file, ragged

SPACE, LETTER, DIGIT, OTHER = range(4)
#: Lower case of A-Z; the second byte of the upper-case letters of U+00C0..U+00DE moves by 32 too.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[97:123] = LETTER
KIND[48:58] = DIGIT


def plain(text: bytes) -> bool:
    """Whether the fast path holds: every byte is ASCII but no control, or begins or ends a letter of U+00C0..U+00FF."""
    if text.isascii():
        high = False
    else:
        high = True
        rest = text.translate(None, _ASCII)
        if len(rest) % 2 or rest[::2].strip(b"\xc3") or rest[1::2].translate(None, _SECOND):
            return False
    return not text.translate(None, _KEPT) if high else not text.translate(None, _KEPT_ASCII)


_ASCII = bytes(range(128))
_KEPT_ASCII = bytes([9, 10, 11, 12, 13, *range(32, 127)])
_SECOND = bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))  # not the signs for times and divided by
_KEPT = _KEPT_ASCII + bytes(range(0x80, 0x100))


def pre_tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the pre-tokens of plain texts."""
    buf = LOWER[buf]
    lead = buf == 0xC3
    second = np.zeros(len(buf), bool)
    second[1:] = lead[:-1]
    upper = second & (buf <= 0x9E)
    buf = np.where(upper, buf + 32, buf).astype(np.uint8)
    kind = KIND[buf]
    kind[lead | second] = LETTER
    new = np.ones(len(buf), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buf))[: len(starts)]
    quote = np.flatnonzero((buf[starts] == 39) & (ends - starts == 1) & (kind[starts] == OTHER))
    quote = quote[quote + 1 < len(starts)]
    quote = quote[kind[starts[quote + 1]] == LETTER]
    if len(quote):  # 's 't 'm 'd 're 've 'll are pre-tokens; the letters after them, if any, are another
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        a, b = pad[starts[quote] + 1], pad[starts[quote] + 2]
        more = np.where(np.isin(a, list(b"stmd")), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
        quote, more = quote[more > 0], more[more > 0]
        ends[quote] += more
        starts[quote + 1] += more
    keep = (kind[starts] != SPACE if len(buf) else np.zeros(0, bool)) & (starts < ends)
    return buf, starts[keep], ends[keep]


def values(table: WordTable, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's values of all pre-tokens one after the other, and the number of each. A list of a few pre-tokens is held at a time."""
    out, sizes = [np.zeros(0, table.dtype)], [np.zeros(0, np.int64)]
    for i in range(0, len(starts), STEP_WORDS):
        s, e = starts[i : i + STEP_WORDS], ends[i : i + STEP_WORDS]
        touching = s[1:][s[1:] == e[:-1]] - s[0]  # the others have white space between them
        n = table.numbers(np.insert(buf[s[0] : e[-1]], touching, 32).tobytes().split())
        out.append(table.flat[ragged(table.at[n], table.size[n])])
        sizes.append(table.size[n])
    return np.concatenate(out), np.concatenate(sizes)


class WordBpe:
    """Ids of whole texts as the library gives them, without added special tokens. path: a file, or a public tokeniser's bare name."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_file(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.word_end = np.zeros(self.size, bool)
        for t, i in self.library.get_vocab().items():
            self.word_end[i] = t.endswith("</w>")
        self.table = WordTable(self._words, "<u4")

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens and how many each has: encoded as one text with spaces between them; a word-end token ends each."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            each = [self.library.encode(w.decode(), add_special_tokens=False).ids for w in words]
            return np.array(sum(each, []), "<u4"), np.array([len(x) for x in each])
        return ids, np.diff(ends, prepend=0)

    def fast(self, text: bytes) -> bool:
        return plain(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        quick = [i for i, t in enumerate(texts) if self.fast(t)]
        out: list = [None] * len(texts)
        buf, at = joined([texts[i] for i in quick])
        buf, starts, ends = pre_tokens(buf)
        flat, sizes = values(self.table, buf, starts, ends)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, at)].tolist()
        for k, i in enumerate(quick):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        slow = [i for i, x in enumerate(out) if x is None]
        for i in slow:
            out[i] = np.array(self.library.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4")
        return out


def word_bpe(path: str) -> WordBpe:
    return kept(("words", path), lambda: WordBpe(path))
