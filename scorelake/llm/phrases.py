"""Phrase collocations mined with an FM-index a shard.

A shard is a bounded run of words of one language's texts. Its index over word numbers is kept in a table: the Burrows-Wheeler transforms of
the word sequence and of its reversal, which together let the interval of a phrase be extended by a word on either side. Rows are ordered by
DEPTH words, all that phrases of DEPTH words need. Phrases are enumerated level by level: counts of a level are summed across shards, and only
what is frequent overall is extended. Phrases are counted by the 64-bit hashes of their words, where no frequent word shares its hash with another
word, and the words are joined to those that are frequent. Else a level is counted by short hashes first, and then the phrases whose hashes are
frequent are, by their words. What the shards are told of frequent phrases is a bitmap of bounded size: a false positive costs a row in a
shuffle, a frequent phrase is never missed. These bitmaps are all that the driver holds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.llm.common import PAGE_BITS, STEP_WORDS, drop, ragged, release, ship, slices, utf8, words_of, written

DEPTH = 3
#: Words of a shard: its index is built and read in some 100 bytes a word.
SHARD_WORDS = 1 << 18
#: Words of the shards, of several languages, that a task fills at a time, in shards.
SHARDS_HELD = 4
#: Bytes of text that are cut into words at a time.
WINDOW_BYTES = 1 << 20
#: A-Z lower-cased; what ends a piece becomes a line feed, what parts words a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
GAP = re.compile(rb"[ \n]")
INSIDE = np.array([b not in b" \n" for b in range(256)])
#: Bits of a bitmap of frequent phrases: about 16 a phrase, between these. It is put together from pages.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Frequent words that are told apart by their hashes at most: of more, two equal hashes are likely.
MOST_WORDS = 1 << 30
#: Bits of a phrase's hash: what is counted first. Phrases of one hash are told apart later, when only the frequent are left.
HASH_BITS = 44
#: Rows of an index that are extended at a time.
ROWS = 1 << 17
#: Parts that a language's candidates are ranked in, before the best of all are.
RANK_PARTS = 32
INDEX = "lang string, words binary, forward binary, backward binary, twice array<string>"


class Shard:
    """Word sequences of one language, pieces parted by 0, until they are indexed.

    A text that is longer than a shard goes on in the next one: with up to DEPTH - 1 words of the open piece again, so that no phrase is
    lost. What these words count twice is in `twice`.
    """

    def __init__(self) -> None:
        self.number = defaultdict(count(1).__next__)
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.twice: list[str] = []
        self.open = False

    def add(self, raw: bytes) -> None:
        """Takes in folded bytes that begin and end at a gap."""
        buf = np.frombuffer(raw, np.uint8)
        starts, ends = words_of(buf, INSIDE)
        ended = np.cumsum(buf == 10)
        if not len(starts):
            self.open &= not (len(ended) and ended[-1])
            return
        ids = np.empty(len(starts), np.int64)
        for i in range(0, len(starts), STEP_WORDS):
            j = min(i + STEP_WORDS, len(starts))
            ids[i:j] = np.fromiter(map(self.number.__getitem__, raw[starts[i] : ends[j - 1]].split()), np.int64, j - i)
        pieces = ended[starts]
        first = np.concatenate([[not self.open or pieces[0] > 0], np.diff(pieces) > 0])
        at = np.arange(len(ids)) + np.cumsum(first)
        out = np.zeros(len(ids) + int(first.sum()), np.int32)
        out[at] = ids
        self.parts.append(out)
        self.n += len(ids)
        self.open = bool(ended[-1] == pieces[-1])

    def sequence(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(1, np.int32)])

    def rest(self) -> Shard:
        """The next shard, which the open piece goes on in."""
        out = Shard()
        tail = self.sequence()[-DEPTH:-1] if self.open else np.zeros(0, np.int32)
        tail = tail[np.flatnonzero(np.append(0, tail) == 0)[-1] :]
        if len(tail):
            words = list(self.number)
            held = [words[i - 1] for i in tail.tolist()]
            out.add(b" ".join(held))
            texts = [w.decode("utf-8", "replace") for w in held]
            out.twice = [" ".join(texts[a:b]) for a in range(len(texts)) for b in range(a + 1, len(texts) + 1)]
        return out


def index_of(t: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transforms of the sequence t, read around in a circle, and of its reversal, ordered by DEPTH symbols."""
    kind, base = np.uint16 if n_words < 1 << 16 else np.uint32, np.int64(n_words + 1)
    out = []
    for step in (1, -1):
        key = np.zeros(len(t), np.int64)
        for k in range(DEPTH):
            key = key * base + np.roll(t, -step * k)
        out.append(np.roll(t, step)[np.argsort(key)].astype(kind))
    return out[0], out[1]


class Transform:
    """One of the two transforms: what stands before a row, and which row stands for that."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.to = np.empty(len(bwt), np.int32)
        self.to[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
        """For intervals of phrases: place of the phrase, word, interval in this transform, interval in the other one, and size of each of
        their extensions by a word."""
        rows = ragged(low, size)
        key = np.repeat(np.arange(len(low)), size) * base + self.bwt[rows]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(key)))
        phrase, word = np.divmod(ordered[first], base)
        before = np.cumsum(size) - size  # rows of the phrases before
        held = word > 0
        return tuple(x[held] for x in (phrase, word, self.to[rows[order[first]]].astype(np.int64), other[phrase] + first - before[phrase], counts))


def stretches(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of places whose sizes sum up to about `most`, or one place."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def full_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit(" "), word))


def hash_of(lang: Column, *words: Column) -> Column:
    """As phrase_hash."""
    out = full_hash(lang, words[0])
    for w in words[1:]:
        out = F.shiftleft(out, 7).bitwiseXOR(full_hash(lang, w))
    return out.bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash")


def phrase_hash(hashes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The hash of each phrase, from its words'; a single word's too."""
    out = hashes[words[0]]
    for w in words[1:]:
        out = out << np.uint64(7) ^ hashes[w]
    return out & np.uint64((1 << HASH_BITS) - 1)


def bitmap(hashes: DataFrame) -> Broadcast:
    """The hashes (one column) as bits of an array of 64-bit numbers, of a size by their count but MOST_BITS at most."""
    bits = LEAST_BITS
    n = hashes.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    own = hashes.toDF("hash").select(F.shiftright(place, PAGE_BITS.bit_length() - 1).alias("page"), place.bitwiseAND(F.lit(PAGE_BITS - 1)).alias("bit"))
    out = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    for r in own.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        out[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.reshape(-1).view(np.uint64))


def among(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(held) - 1)
    return (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def build_indexes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards' indexes, INDEX rows."""
    ship(docs.sparkSession)

    def row(lang: str, s: Shard) -> pa.RecordBatch:
        forward, backward = index_of(s.sequence(), len(s.number))
        columns = [pa.array([lang]), pa.array([b"\n".join(s.number)], pa.binary()), pa.array([forward.tobytes()], pa.binary()), pa.array([backward.tobytes()], pa.binary()), pa.array([s.twice], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "forward", "backward", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        for b in slices(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                s = shards.setdefault(lang, Shard())
                s.open = False
                text = text.translate(FOLD)
                a = 0
                while a < len(text):
                    gap = GAP.search(text, min(a + WINDOW_BYTES, len(text)))
                    end = gap.end() if gap else len(text)
                    s.add(text[a:end])
                    a = end
                    if s.n >= shard_words:
                        yield row(lang, s)
                        s = shards[lang] = s.rest()
                while sum(s.n for s in shards.values()) >= SHARDS_HELD * shard_words:
                    most = max(shards, key=lambda k: shards[k].n)
                    yield row(most, shards.pop(most))
        for lang, s in shards.items():
            if s.n:
                yield row(lang, s)

    own = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return own.mapInArrow(run, INDEX)


def shard_hashes(lang: str, known: list[bytes]) -> np.ndarray:
    """The hash of each of a shard's words, from 1; 0 is none."""
    prefix = lang.encode() + b" "
    return np.concatenate([np.zeros(1, np.uint64), np.fromiter((xxhash.xxh64_intdigest(prefix + w, 42) for w in known), np.uint64, len(known))])


def phrases_of(hashes: np.ndarray, forward: bytes, backward: bytes, depth: int, bitmaps: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of a shard's phrases of `depth` words the words' numbers and the counts, some at a time: of those whose parts the bitmaps hold, of
    frequent words, of frequent pairs of words, ..., up to `depth` of them."""
    base = len(hashes)
    kind = np.uint16 if base <= 1 << 16 else np.uint32
    bwt = np.frombuffer(forward, kind)
    sizes = np.bincount(bwt, minlength=base)
    lows = np.cumsum(sizes) - sizes
    firsts = np.arange(1, base)

    def held(words: list[np.ndarray]) -> np.ndarray:
        return among(bitmaps[len(words) - 1], phrase_hash(hashes, words)) if len(bitmaps) >= len(words) else np.ones(len(words[0]), bool)

    firsts = firsts[held([firsts])]
    if depth == 1:
        yield [firsts], sizes[firsts]
        return
    frequent = np.zeros(base, bool)
    frequent[firsts] = True
    # A word's intervals in both transforms are the same; to the right one extends in the reversal's, to the left in the sequence's own.
    after, before = Transform(np.frombuffer(backward, kind)), Transform(bwt) if depth == 3 else None
    for part in stretches(sizes[firsts], ROWS):
        w1 = firsts[part]
        at, w2, back, ahead, n = after.extend(lows[w1], lows[w1], sizes[w1], base)
        w1, keep = w1[at], frequent[w2]
        keep[keep] = held([w1[keep], w2[keep]])
        words, n = [w1[keep], w2[keep]], n[keep]
        if depth == 3:
            at, w1, *_, n = before.extend(ahead[keep], back[keep], n, base)
            w2, w3, keep = words[0][at], words[1][at], frequent[w1]
            keep[keep] = held([w1[keep], w2[keep]])
            keep[keep] = held([w1[keep], w2[keep], w3[keep]])
            words, n = [w1[keep], w2[keep], w3[keep]], n[keep]
        yield words, n


def level_counts(indexes: DataFrame, depth: int, bitmaps: list[Broadcast], how: str = "words") -> DataFrame:
    """Phrases of `depth` words of all shards, of the parts that the bitmaps hold, with their counts f: by lang, w1 .. w<depth>; with how =
    "hash" by hash; with "hashes" by h1 .. h<depth>, the whole hashes of the words."""
    names = [f"w{k + 1}" for k in range(depth)]
    keys = {"words": ["lang", *names], "hash": ["hash"], "hashes": [f"h{k + 1}" for k in range(depth)]}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in bitmaps]
        for b in batches:
            for i in range(b.num_rows):
                lang, vocabulary, forward, backward, twice = (b.column(k)[i].as_py() for k in range(5))
                known = vocabulary.split(b"\n")
                hashes = shard_hashes(lang, known)
                texts = pa.array([b"", *known], pa.binary()).cast(pa.string(), safe=False) if how == "words" else None

                def batch(words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
                    if how == "words":
                        columns = [pa.repeat(pa.scalar(lang), len(n)), *(texts.take(pa.array(w)) for w in words)]  # noqa: B023
                    elif how == "hash":
                        columns = [pa.array(phrase_hash(hashes, words).view(np.int64))]  # noqa: B023
                    else:
                        columns = [pa.array(hashes[w].view(np.int64)) for w in words]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], [*keys, "f"])

                for words, n in phrases_of(hashes, forward, backward, depth, own):
                    yield batch(words, n)
                # What a cut text's shards count twice; hashes may be counted too often.
                again = [t.encode().split(b" ") for t in twice if t.count(" ") == depth - 1]
                if again and how != "hash":
                    at = {w: k + 1 for k, w in enumerate(known)}
                    yield batch([np.array([at[w] for w in column]) for column in zip(*again, strict=True)], np.full(len(again), -1))

    schema = ", ".join([*(f"{k} {'string' if how == 'words' else 'long'}" for k in keys), "f long"])
    return indexes.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("f").alias("f"))


def told_apart(words: DataFrame, min_count: int) -> bool:
    """Whether no frequent word shares its hash with another word, so that hashes stand for them."""
    if words.where(F.col("f") >= min_count).count() > MOST_WORDS:
        return False
    by = words.groupBy(full_hash(F.col("lang"), F.col("w1")).alias("hash")).agg(F.count("*").alias("n"), F.max("f").alias("most"))
    return not by.where((F.col("n") > 1) & (F.col("most") >= min_count)).count()


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact for counts of up to 14 digits; whole, as a is at most l and r."""
    x, y, z = (c.cast("decimal(14,0)") for c in (a, l, r))
    return F.call_function("div", x * x * F.lit(1_000_000).cast("decimal(7,0)"), y * z)


def collocations(docs: DataFrame, min_count: int = 10, cover_percent: int = 50, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 or 3 words that stand `min_count` times or more.

    Words are the runs without space and tab, A-Z lower-cased, of the pieces between punctuation (.,;:!? and line ends); a phrase lies within
    a piece. It is cut where that scores least, at the first such place. A phrase of 2 words that lies in one of 3 which stands at least
    `cover_percent` of its times is left out. Ranks go by score and a, falling, and the phrase's bytes; top=None ranks nothing and returns
    every phrase, rank null.

    Null texts are empty, a null language is `und`; repeated rows count each time; an empty table gives no rows; texts may be of any length.
    Only the two named columns are read.
    """
    indexes = written(build_indexes(docs, lang_col, text_col, shard_words), "indexes")
    words = written(level_counts(indexes, 1, []), "words")
    frequent = words.where(F.col("f") >= min_count)
    lang, w = F.col("lang"), [F.col(f"w{k + 1}") for k in range(DEPTH)]
    hashed = told_apart(words, min_count)
    names = written(frequent.select(full_hash(lang, w[0]).alias("hash"), "lang", F.col("w1").alias("w")), "names") if hashed else None
    bitmaps = [bitmap(frequent.select(hash_of(lang, w[0])))]
    levels = []
    for depth in range(2, DEPTH + 1):
        if hashed:
            found = level_counts(indexes, depth, bitmaps, "hashes").where(F.col("f") >= min_count)
            for k in range(depth):
                found = found.join(names.select(F.col("hash").alias(f"h{k + 1}"), *(["lang"] if not k else []), F.col("w").alias(f"w{k + 1}")), f"h{k + 1}")
            found = found.select("lang", *(f"w{k + 1}" for k in range(depth)), "f")
        else:
            hashes = written(level_counts(indexes, depth, bitmaps, "hash").where(F.col("f") >= min_count).select("hash"), "hashes")
            bitmaps.append(bitmap(hashes))
            drop(hashes)
            found = level_counts(indexes, depth, bitmaps).where(F.col("f") >= min_count)
        levels.append(written(found, "phrases"))
        if hashed and depth < DEPTH:
            bitmaps.append(bitmap(levels[-1].select(hash_of(lang, *w[:depth]))))
        release(docs.sparkSession)
    if names is not None:
        drop(names)
    pairs, triples = levels
    drop(indexes)
    for b in bitmaps:
        b.destroy()

    # The extensions of a pair to the left and to the right.
    of = lambda *w: triples.select("lang", F.col(w[0]).alias("w1"), F.col(w[1]).alias("w2"), "f")
    longest = of("w2", "w3").union(of("w1", "w2")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    word = lambda k, f: frequent.select("lang", F.col("w1").alias(k), F.col("f").alias(f))
    pair = lambda j, k, f: pairs.select("lang", F.col("w1").alias(j), F.col("w2").alias(k), F.col("f").alias(f))
    two = pairs.withColumnRenamed("f", "a").join(longest, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    two = two.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.withColumnRenamed("f", "a").join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    three = three.join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
    cut = lambda k: F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1), cut(2)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = two.union(three)
    if top is None:
        ranked = found.withColumn("rank", F.lit(None).cast("long"))
    else:
        best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        near = found.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("place") <= top)
        ranked = near.drop("part", "place").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
