"""Similar names by the Ratcliff-Obershelp ratio, without comparing all of them by it.

The matched blocks of a pair never cross, so they are a common subsequence, and the ratio is at most 2 c / (la + lb) for the longest one's
length c. A pair of the lengths la and lb that reaches a ratio so has a common subsequence of ceil(ratio * (la + lb) / 2) characters. Pairs of
lengths are searched in one of two ways, by what costs less for as many names as there are:

- by deletion: both sides give all their subsequences of that length, as hashes, and meet on them. Names of one shape, that differ in a few
  characters, meet only where they are similar. Meetings are counted first; where they cost more than blocks, blocks are taken;
- by blocks: blocks of names are dealt to tasks in pairs, where the longest common subsequences of all pairs are found by bit operations on
  whole matrices, some 0.1 microseconds a pair; pairs whose bound is too low, or below what a name has found, are never matched.

Neither loses a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.sources.shared import delete_table, stored

#: Names of a block, and columns of a block that are matched at a time.
BLOCK, COLUMNS = 2048, 256
#: Seconds of a pair of names in blocks, and of a subsequence, or of two names that meet on one, that is hashed, shuffled and joined.
PAIR_COST, KEY_COST = 1e-7, 2e-6
#: Seconds of all pairs from which on best pairs are looked for at higher ratios first.
LADDER_COST = 20.0
#: Subsequences of a name at most: the index table of their characters is held in memory.
MOST_KEYS = 20_000
_POWERS = np.random.default_rng(11).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
PAIRS = "name string, other string, ratio double, prefer string"


def matcher_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratios(text: pd.Series, other: pd.Series) -> pd.Series:
    """The ratio of each pair, in this order."""
    return pd.Series([matcher_ratio(a, b) for a, b in zip(text, other, strict=True)], dtype="float64")


def least_common(la: int, lb: int, threshold: float) -> int:
    """Characters that strings of these lengths have in common, in order, where their ratio is `threshold` or more."""
    return math.ceil(threshold * (la + lb) / 2 - 1e-9)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=64)
def choices(n: int, k: int) -> np.ndarray:
    """Every way to take k of n places, in order, a row each."""
    return np.array(list(combinations(range(n), k)), np.int16).reshape(math.comb(n, k), k)


def subsequence_hashes(text: str, length: int) -> np.ndarray:
    own = points(text).astype(np.uint64)[choices(len(text), length)]
    mixed = ((own + np.uint64(1)) * _POWERS[:length]).sum(1, dtype=np.uint64)
    return np.unique(mixed ^ mixed >> np.uint64(29)).view(np.int64)


def common_lengths(left: list[str], right: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """For slices of right (the place of the first, and a matrix): lengths of the longest common subsequences with all of left.

    The bits of a state that are 0 are the steps of the last row of the usual table (Hyyro's recurrence), in as many 64-bit words as the
    longest left string needs.
    """
    alphabet = {c: k for k, c in enumerate(sorted(set("".join(left))))}
    longest = max(map(len, left))
    words = (longest + 63) // 64
    masks = np.zeros((words, len(left), len(alphabet) + 1), np.uint64)  # the last column is of characters that left hasn't
    for i, text in enumerate(left):
        for k, c in enumerate(text):
            masks[k // 64, i, alphabet[c]] |= np.uint64(1 << (k % 64))
    valid = np.array([[(1 << min(max(len(t) - 64 * w, 0), 64)) - 1 for t in left] for w in range(words)], np.uint64)[:, :, None]
    for a in range(0, len(right), COLUMNS):
        own = right[a : a + COLUMNS]
        codes = np.full((len(own), max(map(len, own))), len(alphabet))
        for j, text in enumerate(own):
            codes[j, : len(text)] = [alphabet.get(c, len(alphabet)) for c in text]
        state = np.full((words, len(left), len(own)), ~np.uint64(0))
        for code in codes.T:
            carry = None
            for w in range(words):
                v = state[w]
                u = v & masks[w][:, code]
                added = v + u
                if words > 1:
                    over = added < v
                    if carry is not None:
                        added += carry
                        over |= carry.astype(bool) & (added == 0)
                    carry = over.astype(np.uint64)
                state[w] = added | v ^ u
        yield a, np.bitwise_count(~state & valid).sum(0, dtype=np.int64)


def match_blocks(left: list[str], right: list[str], prefer: list[str], threshold: float, swap: bool, best: bool) -> list[tuple[str, str, float, str]]:
    """Pairs of the ratio `threshold` or more; with best, each left string's one of the highest ratio, and of equals of the greatest `prefer`."""
    la, lb = np.array([len(t) for t in left]), np.array([len(t) for t in right])
    ratio = (lambda a, b: matcher_ratio(b, a)) if swap else matcher_ratio
    floor, rank = np.full(len(left), threshold), np.unique(np.array(prefer, object), return_inverse=True)[1]
    out: dict[int, tuple[float, int, int]] = {}
    found = []
    for start, common in common_lengths(left, right):
        bound = 2 * common / (la[:, None] + lb[None, start : start + common.shape[1]])
        hopeful = bound >= floor[:, None] - 1e-9
        for i in np.flatnonzero(hopeful.any(1)).tolist():
            js = np.flatnonzero(hopeful[i])
            if not best:
                for j in (start + js).tolist():
                    r = ratio(left[i], right[j])
                    if r >= threshold:
                        found.append((left[i], right[j], r, prefer[j]))
                continue
            order = js[np.lexsort((rank[start + js], bound[i, js]))[::-1]]
            for b, j in zip(bound[i, order].tolist(), (start + order).tolist(), strict=True):
                if i in out and (b, rank[j]) <= out[i][:2]:
                    break
                r = ratio(left[i], right[j])
                if r >= threshold and (i not in out or (r, rank[j]) > out[i][:2]):
                    out[i] = (r, rank[j], j)
                    floor[i] = r
    return [(left[i], right[j], r, prefer[j]) for i, (r, _, j) in out.items()] if best else found


def search_plan(left: dict[int, int], right: dict[int, int], threshold: float) -> list[tuple[int, int, int, int, int, bool]]:
    """la, lb, common, blocks of left, blocks of right, by_deletion of each pair of lengths that can reach the threshold. left and right:
    how many names have each length."""
    out = []
    for la, na in left.items():
        for lb, nb in right.items():
            c = least_common(la, lb, threshold)
            if c > min(la, lb):
                continue
            keys = max(math.comb(la, c), math.comb(lb, c))
            by_deletion = c > 0 and la <= len(_POWERS) and keys <= MOST_KEYS and (na * math.comb(la, c) + nb * math.comb(lb, c)) * KEY_COST < na * nb * PAIR_COST
            out.append((la, lb, c, -(-na // BLOCK), -(-nb // BLOCK), by_deletion))
    return out


def levels(threshold: float) -> list[float]:
    """Ratios at which the best pairs are looked for one after the other: from the highest down to the threshold."""
    return [x for x in (k / 100 for k in range(95, 0, -5)) if x > threshold + 1e-9] + [threshold]


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, swap: bool = False, best: bool = False) -> DataFrame:
    """name, other, ratio, prefer of left.name and right.other with a ratio of `threshold` or more (with swap, of other and then name).

    With best, of each name only the pair of the highest ratio, and among equals that of the greatest right.prefer; without a column prefer it
    is other. Where comparing all names would take long, best pairs are looked for at higher ratios first: a name that has a pair there has its
    best one, as all pairs of that ratio are found, and only the others go on. Null and empty strings have no pairs; repeated ones count once,
    the greatest prefer of an other too. The driver holds how many strings have each length, and for the pairs of lengths how they are searched.
    """
    preference = F.col("prefer") if "prefer" in right.columns else F.col("other")
    a = stored(left.select("name").where("name != ''").distinct().withColumn("la", F.length("name")), "names")
    b = stored(right.select("other", preference.alias("prefer")).where("other != ''").groupBy("other").agg(F.max("prefer").alias("prefer")).withColumn("lb", F.length("other")), "names")
    sizes = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}  # noqa: E731  a row a length
    na, nb = sizes(a, "la"), sizes(b, "lb")
    parts = []
    for level in levels(threshold) if best else [threshold]:
        plan = search_plan(na, nb, threshold)
        if level > threshold and sum(na[p[0]] * nb[p[1]] for p in plan) * PAIR_COST <= LADDER_COST:
            continue
        parts.append(stored(_search(a, b, na, nb, level, swap, best), "pairs"))
        if level == threshold:
            break
        rest = stored(a.join(parts[-1].select("name"), "name", "left_anti").select(*a.columns), "names")
        delete_table(a)
        a, na = rest, sizes(rest, "la")
    delete_table(a, b)
    return reduce(DataFrame.union, parts)


def _search(a: DataFrame, b: DataFrame, na: dict[int, int], nb: dict[int, int], threshold: float, swap: bool, best: bool) -> DataFrame:
    """The pairs of a (name, la) and b (other, prefer, lb), both distinct, of which na and nb have each length."""
    spark = a.sparkSession
    plan = search_plan(na, nb, threshold)
    schema = "la int, lb int, common int, blocks_a int, blocks_b int"
    rows = lambda deletion: spark.createDataFrame([p[:5] for p in plan if p[5] == deletion], schema)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                part = rows.iloc[at : at + 256]
                own = [subsequence_hashes(t, c) for t, c in zip(part["text"], part["common"], strict=True)]
                sizes = [len(k) for k in own]
                yield pd.DataFrame({"text": np.repeat(part["text"].to_numpy(), sizes), "prefer": np.repeat(part["prefer"].to_numpy(), sizes), "both": np.repeat(part["both"].to_numpy(), sizes), "key": np.concatenate(own)})

    def keyed() -> tuple[DataFrame, DataFrame]:
        meeting = F.broadcast(rows(True).select("la", "lb", "common"))  # a row a pair of lengths
        # The sum of the lengths gives the number of common characters; with a string's own length it gives the other's.
        each = lambda df, own, text, prefer: df.join(meeting, own).select(F.col(text).alias("text"), prefer.alias("prefer"), (F.col("la") + F.col("lb")).alias("both"), "common").distinct().mapInPandas(keys, "text string, prefer string, both int, key long")
        return each(a, "la", "name", F.lit("")).select(F.col("text").alias("name"), "both", "key"), each(b, "lb", "other", F.col("prefer")).select(F.col("text").alias("other"), "prefer", "both", "key")

    if any(p[5] for p in plan):
        # Names of one beginning meet on many keys: where their meetings cost more than the blocks of that sum of lengths, blocks it is.
        x, y = (df.groupBy("both", "key").agg(F.count("*").cast("double").alias(n)) for df, n in zip(keyed(), ("n", "m"), strict=True))
        met = {r[0]: r[1] for r in x.join(y, ["both", "key"]).groupBy("both").agg(F.sum(F.col("n") * F.col("m"))).collect()}  # a row a sum of lengths
        cost: dict[int, float] = {}
        for la, lb, *_, by_deletion in plan:
            cost[la + lb] = cost.get(la + lb, 0.0) + by_deletion * na[la] * nb[lb] * PAIR_COST
        plan = [(*p[:5], p[5] and met.get(p[0] + p[1], 0.0) * KEY_COST <= cost[p[0] + p[1]]) for p in plan]
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    found = spark.createDataFrame([], PAIRS)
    if any(not p[5] for p in plan):
        blocks = F.broadcast(rows(False))  # a row a pair of lengths
        x = a.join(blocks, "la").select("la", "lb", place("name", "blocks_a").alias("i"), every("blocks_b").alias("j"), F.lit(True).alias("own"), F.col("name").alias("text"), F.lit("").alias("prefer"))
        y = b.join(blocks, "lb").select("la", "lb", every("blocks_a").alias("i"), place("other", "blocks_b").alias("j"), F.lit(False).alias("own"), F.col("other").alias("text"), "prefer")

        def match(rows: pd.DataFrame) -> pd.DataFrame:
            own = rows["own"].to_numpy(bool)
            mine, others = rows[own], rows[~own]
            if not len(mine) or not len(others):
                return pd.DataFrame([], columns=["name", "other", "ratio", "prefer"])
            got = match_blocks(mine["text"].tolist(), others["text"].tolist(), others["prefer"].tolist(), threshold, swap, best)
            return pd.DataFrame(got, columns=["name", "other", "ratio", "prefer"])

        found = found.union(x.union(y).groupBy("la", "lb", "i", "j").applyInPandas(match, PAIRS))
    if any(p[5] for p in plan):
        x, y = keyed()
        met = x.join(y, ["both", "key"]).where(F.length("name") + F.length("other") == F.col("both")).select("name", "other", "prefer").distinct()
        r = F.pandas_udf(ratios, "double")
        found = found.union(met.select("name", "other", (r("other", "name") if swap else r("name", "other")).alias("ratio"), "prefer").where(F.col("ratio") >= threshold))
    if best:
        found = found.groupBy("name").agg(F.max(F.struct("ratio", "prefer", "other")).alias("m")).select("name", "m.other", "m.ratio", "m.prefer")
    return found
