"""Weighted n-gram counts, vocabulary cuts, back-off repair and probabilities of a three-order language model, as DataFrame operations.

An n-gram is one string of words joined by blanks, with its words beside it where they are joined on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.unicode import nfc, words

#: Smoothing constants of the interpolated model (fixed values): unigram addend, bigram and trigram weights, joint pair and triple normalisers; floor of a logarithm.
ADD, ALPHA, BETA, PAIR, TRIPLE = 0.5, 2.0, 1.0, 20.0, 10.0
FLOOR = 2.220446049250313e-16


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., words) of each non-empty line of a text; n-grams never cross a line."""
    src = df.select(*keep, F.explode(F.split(F.col(text), "\n")).alias("line"))
    return src.select(*keep, words(nfc("line")).alias("words")).filter(F.size("words") > 0)


def grams(c: Column, n: int) -> Column:
    """Array of the n-grams of an array of words."""
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))


def count_grams(df: DataFrame, n: int, weight: Column | None = None) -> DataFrame:
    """(gram, c): n-gram counts of the column `words`, each row weighing `weight`."""
    rows = df.select((weight if weight is not None else F.lit(1)).cast("long").alias("w"), F.explode("words" if n == 1 else grams(F.col("words"), n)).alias("gram"))
    return rows.groupBy("gram").agg(F.sum("w").alias("c"))


def split_gram(df: DataFrame, n: int) -> DataFrame:
    """Adds the words w1..wn of the gram."""
    parts = F.split("gram", " ")
    return df.select("*", *[F.element_at(parts, i).alias(f"w{i}") for i in range(1, n + 1)])


def in_vocabulary(counts: DataFrame, n: int, vocabulary: DataFrame) -> DataFrame:
    """n-grams all of whose words are in the vocabulary (column gram)."""
    out = split_gram(counts, n)
    for i in range(1, n + 1):
        out = out.join(vocabulary.select(F.col("gram").alias(f"w{i}")), f"w{i}", "left_semi")
    return out.select("gram", "c")


def top(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent; at the cut-off count larger keys survive."""
    return counts.orderBy(F.desc("c"), F.desc("gram")).limit(n)


def retain_evidence(trigrams: DataFrame, kept: DataFrame, centres: DataFrame) -> DataFrame:
    """Kept trigrams, and those below the cut-off whose middle word is an evidence word (column gram of centres)."""
    cutoff = kept.agg(F.min("c").alias("cut"))
    below = split_gram(trigrams, 3).join(F.broadcast(cutoff), F.col("c") < F.col("cut")).join(centres.select(F.col("gram").alias("w2")), "w2", "left_semi").select("gram", "c")
    return kept.unionByName(below)


def repair_backoff(bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Bigram counts raised to what the trigrams that contain them need: c(a,b) >= sum c(a,b,.) and >= sum c(.,a,b)."""
    t = split_gram(trigrams, 3)
    need = [t.groupBy(F.concat_ws(" ", *w).alias("gram")).agg(F.sum("c").alias("c")) for w in (("w1", "w2"), ("w2", "w3"))]
    return reduce(DataFrame.unionByName, [bigrams.select("gram", "c"), *need]).groupBy("gram").agg(F.max("c").alias("c"))


def families(counts: DataFrame, accent_key, cap: int | None = None) -> DataFrame:
    """(akey, gram, c, rnk): the spellings of each key without accents, most frequent first; with a cap, the first `cap` of each."""
    w = Window.partitionBy("akey").orderBy(F.desc("c"), "gram")
    out = counts.withColumn("akey", accent_key("gram")).withColumn("rnk", F.row_number().over(w))
    return out.filter(F.col("rnk") <= cap) if cap else out


def p_uni(c: Column, total: Column, vocabulary: Column) -> Column:
    return (c + ADD) / (total + ADD * vocabulary)


def p_bi(pair: Column, prev: Column, lower: Column) -> Column:
    """Interpolated with the unigram probability; that itself after an unknown word."""
    return F.when(prev > 0, (pair + ALPHA * lower) / (prev + ALPHA)).otherwise(lower)


def p_tri(triple: Column, pair: Column, lower: Column) -> Column:
    return (triple + BETA * lower) / (pair + BETA)


def joint_pair(pair: Column, p_a: Column, p_b: Column, total: Column) -> Column:
    """Smoothed probability of a neighbouring pair; its denominator doesn't depend on the candidate."""
    return (pair + PAIR * p_a * p_b) / (total + PAIR)


def joint_triple(triple: Column, p_a: Column, p_b: Column, p_c: Column, total: Column) -> Column:
    return (triple + TRIPLE * p_a * p_b * p_c) / (total + TRIPLE)


def log_floor(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(FLOOR)))


def log_ratio(candidate: Column, original: Column) -> Column:
    return F.log1p(candidate) - F.log1p(original)


def scored(unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """Each trigram with its counts and its uni-, bi- and trigram probability."""
    meta = unigrams.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("vocabulary"))
    t = split_gram(trigrams.withColumnRenamed("c", "c3"), 3)
    t = t.withColumn("first", F.concat_ws(" ", "w1", "w2")).withColumn("second", F.concat_ws(" ", "w2", "w3"))
    t = t.join(bigrams.select(F.col("gram").alias("first"), F.col("c").alias("c12")), "first", "left").join(bigrams.select(F.col("gram").alias("second"), F.col("c").alias("c23")), "second", "left")
    t = t.join(unigrams.select(F.col("gram").alias("w2"), F.col("c").alias("c2")), "w2", "left").join(unigrams.select(F.col("gram").alias("w3"), F.col("c").alias("c3u")), "w3", "left")
    t = t.fillna(0, ["c12", "c23", "c2", "c3u"]).join(F.broadcast(meta))
    t = t.withColumn("p1", p_uni(F.col("c3u"), F.col("total"), F.col("vocabulary")))
    t = t.withColumn("p2", p_bi(F.col("c23"), F.col("c2"), F.col("p1")))
    return t.withColumn("p3", p_tri(F.col("c3"), F.col("c12"), F.col("p2"))).select("gram", "c3", "c12", "c23", "p1", "p2", "p3")


def overlay(unigrams: DataFrame, base: DataFrame, domain: DataFrame, weight: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Trigrams (gram, c) counted again over base lines and domain lines (words), the latter weighing `weight`, from `least` on; and the header (vocabulary, tokens) that goes with them: unigrams and bigrams stay as
    they are, and the tokens grow by what the domain's lines weigh beyond one."""
    rows = base.select("words", F.lit(1).alias("w")).unionByName(domain.select("words", F.lit(weight).alias("w")))
    trigrams = count_grams(rows, 3, F.col("w")).filter(F.col("c") >= least)
    extra = domain.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).select((F.col("n") * (weight - 1)).alias("extra"))
    head = unigrams.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("c").alias("tokens")).join(extra).select("vocabulary", (F.col("tokens") + F.col("extra")).alias("tokens"))
    return trigrams, head
