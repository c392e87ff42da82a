"""Same or nearly the same records across splits (problem 5): a prefix-filtered bipartite join on rare words, then word edit distance.

Two texts of at most max(m, n) words that differ by at most k = floor(0.2 max(m, n)) edits share at least ceil(0.8 max(m, n)) words (as a multiset). Words are put
in one global order, rarest first; a text of n words then misses at most floor(0.2 n) of the shared ones, so the first shared word stands among its first
floor(0.2 n) + 1. A signature is a path of shared words: it starts at one of these and, while the words so far are too frequent to tell texts apart, goes on with one of the
next words as far as the number of skipped words allows. Both texts of a pair walk the path of their shared words and end it by the same rule (the expected number of texts that hold
its words, or a number of words), so no pair is lost. Five-word shingles can not serve here: at 20 % edits a pair need not share any.

The rule is that of the length class (a power of two) of the longer text of a pair: the more words, the sooner a path ends, so that the number of signatures of a text is bounded by its length alone, whatever
the number of texts (see most_signatures). A text makes those of its own class and, where a partner may be in the next one, of that too.

Pairs that meet are filtered inside the join, again without loss: lengths must fit, the parity sketches (bit b: is the number of words hashed to b odd?) may differ
in at most 2 k bits, and the skipped words must fit k. What is left is verified by edit distance over words.

Equal word sequences are joined once and expanded at the end. Defined results: null texts are left out; texts without words equal each other; null splits are in neither
side; repeated rows give one pair; an id that is in train and in dev or test does not pair with itself; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.rarity import BUCKETS, word_counts
from sieveloom.functions.text import WordHashes, folded_words, map_batches
from sieveloom.operators.common import lookup_join, materialize

#: Of texts of up to 31 words a path ends when about RARE texts are expected to hold its words; each further length class allows GROWTH times as many.
RARE, GROWTH = 40.0, 4.0
#: Most words of a path by length class (number of binary digits of the text's length, from 5 on): up to 31 words, up to 63, 127, 255, and longer.
DEPTHS = (4, 3, 2, 2, 1)


def allowance(n: int) -> int:
    """Edits allowed between texts whose longer one has n words."""
    return n // 5


def classes_of(n: int) -> list[int]:
    """Length classes of the longer texts of the pairs that a text of n words can be in: its own, and that of the longest partner (k <= floor(n / 4) more words)."""
    return sorted({max(5, n.bit_length()), max(5, (n + n // 4).bit_length())})


def most_signatures(n: int) -> int:
    """Bound of a text's signatures, whatever the other texts are: paths of d words with at most k skipped ones in all, for each of its length classes."""
    k = allowance(n)
    return sum(math.comb(k + d, d) for d in (DEPTHS[min(c, 9) - 5] for c in classes_of(n)))


def signatures(order: list[int], freq: list[float], n: int, texts: float) -> list[tuple[int, int]]:
    """(path hash, skipped words) of a text whose words, rarest first, have the hashes `order` and the counts `freq`; texts: number of texts."""
    if n == 0:
        return [(0, 0)]
    k = allowance(n)
    out: list[tuple[int, int]] = []
    for cls in classes_of(n):
        need, rare = min(DEPTHS[min(cls, 9) - 5], n - k), RARE * GROWTH ** (cls - 5)
        stack = [(0, 0, 0, cls, texts)]  # depth, next position, skipped, path, expected texts
        while stack:
            depth, pos, skipped, path, expected = stack.pop()
            for i in range(pos, min(n, pos + k - skipped + 1)):
                seen = expected * min(1.0, freq[i] / texts)
                got = (path * 0x9E3779B97F4A7C15 + order[i]) & 0xFFFFFFFFFFFFFFFF
                got ^= got >> 29
                if depth + 1 >= need or seen <= rare:
                    out.append((got, skipped + i - pos))
                else:
                    stack.append((depth + 1, i + 1, skipped + i - pos, got, seen))
    return out


def edit_within(a: list[str], b: list[str], k: int) -> bool:
    """Do the word sequences differ by at most k insertions, deletions and replacements? Banded, so in time len * k."""
    if abs(len(a) - len(b)) > k:
        return False
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    s = 0
    while s < min(len(a), len(b)) and a[s] == b[s]:
        s += 1
    a, b = a[s:], b[s:]
    n = len(b)
    row = [j if j <= k else k + 1 for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - k), min(n, i + k)
        left = i if lo == 1 else k + 1
        diag, best = row[lo - 1], k + 1
        row[lo - 1] = left
        for j in range(lo, hi + 1):
            up = row[j] if j < i + k else k + 1
            v = diag if x == b[j - 1] else 1 + min(diag, up, left)
            diag, left = row[j], v
            row[j] = v
            best = min(best, v)
        if best > k and left > k:
            return False
    return row[n] <= k


def word_texts(rows: DataFrame) -> DataFrame:
    """(id, side, cls, words): the folded words of each row, and a 128-bit digest of them. rows: (id, side, text)."""

    def kernel(ids: pa.Array, sides: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = [" ".join(folded_words(t)) for t in texts.to_pylist()]
        return pa.record_batch([ids, sides, pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()), pa.array(words, pa.string())], names=["id", "side", "cls", "words"])

    return map_batches(rows.filter("id is not null and text is not null"), ["id", "side", "text"], kernel, "id string, side int, cls binary, words string")


def _signature_rows(texts: DataFrame, counts: np.ndarray, n_texts: int) -> DataFrame:
    """(sig, skipped, n, s1, s2, cls, sides) of distinct texts."""
    hashes = WordHashes()
    held = texts.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def kernel(cls: pa.Array, sides: pa.Array, words: pa.Array) -> pa.RecordBatch:
        sig, skipped, length, s1, s2, who = [], [], [], [], [], []
        for k, t in enumerate(words.to_pylist()):
            h = [hashes[w] for w in t.split()]
            n, parity = len(h), 0
            seen: dict[int, int] = {}
            ranked = []
            for x in h:
                parity ^= 1 << (x >> 57)
                c = seen[x] = seen.get(x, 0) + 1
                ranked.append((float(held.value[x % BUCKETS]) / c, x * (2 * c - 1) & 0xFFFFFFFFFFFFFFFF))
            ranked.sort()
            for path, skip in signatures([x for _, x in ranked], [f for f, _ in ranked], n, float(n_texts)):
                sig.append(path)
                skipped.append(skip)
                who.append(k)
            m = len(sig) - len(length)
            length += [n] * m
            s1 += [parity & 0xFFFFFFFFFFFFFFFF] * m
            s2 += [parity >> 64] * m
        take = pa.array(who, pa.int64())
        u = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.record_batch([u(sig), pa.array(skipped, pa.int32()), pa.array(length, pa.int32()), u(s1), u(s2), cls.take(take), sides.take(take)], names=["sig", "skipped", "n", "s1", "s2", "cls", "sides"])

    return map_batches(texts, ["cls", "sides", "words"], kernel, "sig long, skipped int, n int, s1 long, s2 long, cls binary, sides int")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes whose words (wx, wy) are near enough."""

    def kernel(x: pa.Array, y: pa.Array, wx: pa.Array, wy: pa.Array) -> pa.RecordBatch:
        keep = []
        for k, (a, b) in enumerate(zip(wx.to_pylist(), wy.to_pylist())):
            a, b = a.split(), b.split()
            if edit_within(a, b, allowance(max(len(a), len(b)))):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        return pa.record_batch([x.take(at), y.take(at)], names=["x", "y"])

    return map_batches(pairs, ["x", "y", "wx", "wy"], kernel, "x binary, y binary")


def near_classes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(x, y) of different classes, x held in train and y in evaluation, within the allowance. texts: (cls, sides, words), sides 1 train, 2 evaluation, 3 both."""
    sigs = materialize(_signature_rows(texts, counts, max(1, texts.count())), "signatures")
    left = sigs.filter(F.col("sides").bitwiseAND(1) > 0).select("sig", *[F.col(c).alias(f"x_{c}") for c in ("skipped", "n", "s1", "s2", "cls")])
    right = sigs.filter(F.col("sides").bitwiseAND(2) > 0).select("sig", *[F.col(c).alias(f"y_{c}") for c in ("skipped", "n", "s1", "s2", "cls")])
    most = F.greatest("x_n", "y_n")
    k = F.floor(most / 5)
    met = left.join(right, "sig").filter(
        (F.abs(F.col("x_n") - F.col("y_n")) <= k) & (F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1"))) + F.bit_count(F.col("x_s2").bitwiseXOR(F.col("y_s2"))) <= 2 * k)
        & (F.col("x_skipped") <= F.col("x_n") - most + k) & (F.col("y_skipped") <= F.col("y_n") - most + k) & (F.col("x_cls") != F.col("y_cls"))
    )
    pairs = materialize(met.select(F.col("x_cls").alias("x"), F.col("y_cls").alias("y")).distinct(), "met")
    x_words = texts.select(F.col("cls").alias("x"), F.col("words").alias("wx"))
    y_words = texts.select(F.col("cls").alias("y"), F.col("words").alias("wy"))
    return _verified(pairs.join(x_words, "x").join(y_words, "y"))


def near_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal texts (x held in train, y in evaluation; x = y where a class is on both sides), and the membership (id, side, cls). rows: (id, side, text), side 1 train, 2 evaluation."""
    named = materialize(word_texts(rows), "rows")
    counts = word_counts(named, "words")
    texts = materialize(named.groupBy("cls").agg(F.bit_or("side").alias("sides"), F.min("words").alias("words")), "texts")
    near = near_classes(texts, counts).union(texts.filter("sides = 3").select(F.col("cls").alias("x"), F.col("cls").alias("y")))
    return near, named.select("id", "side", "cls").distinct()


def cross_split(rows: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: a train row and an evaluation row that are near."""
    near, members = near_records(rows)
    train = members.filter("side = 1").select(F.col("cls").alias("x"), F.col("id").alias("i"))
    held = members.filter("side = 2").select(F.col("cls").alias("y"), F.col("id").alias("j"))
    return near.join(train, "x").join(held, "y").filter("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def partners(rows: DataFrame) -> DataFrame:
    """(id, pairs): the number of train records that each evaluation record is near to, itself not counted. From pairs of classes and the classes' sizes, without expanding any class."""
    near, members = near_records(rows)
    members = materialize(members, "members")
    train = members.filter("side = 1").groupBy(F.col("cls").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    by_class = materialize(near.join(train, "x").groupBy("y").agg(F.sum("k").alias("k")), "partners")
    held = members.filter("side = 2").select("id", F.col("cls").alias("y"))
    sizes = held.groupBy("y").agg(F.count(F.lit(1)).alias("rows"))
    both = members.filter("side = 1").select("id", F.col("cls").alias("y"), F.lit(1).alias("own"))
    found = lookup_join(held, materialize(by_class.join(sizes, "y"), "partners"), "y", "rows", "inner").join(both, ["id", "y"], "left")
    return found.groupBy("id").agg(F.sum(F.col("k") - F.coalesce("own", F.lit(0))).alias("pairs")).filter("pairs > 0")
