"""Lexicons, word classes and edit candidates: joins on words, keys without accents, and deletion variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveloom.functions.unicode import accent_key, osa_distance

#: Weights of the cheap ranking (fixed values): distance, log frequency, same key.
CHEAP = (1.0, 0.5, 0.75)


def merge(corpus: DataFrame, curated: DataFrame, stop: DataFrame) -> DataFrame:
    """(word, freq, src) of two lexicons (word, freq) without stop words; the corpus frequency wins, and src says where a word stands."""
    a = corpus.groupBy("word").agg(F.max("freq").alias("cf"))
    b = curated.groupBy("word").agg(F.max("freq").alias("uf"))
    src = F.when(F.col("cf").isNotNull() & F.col("uf").isNotNull(), "both").when(F.col("cf").isNotNull(), "corpus").otherwise("curated")
    return a.join(b, "word", "full_outer").join(stop.select("word").distinct(), "word", "left_anti").select("word", F.coalesce("cf", "uf").alias("freq"), src.alias("src"))


def real_frequency(freq: str = "freq", src: str = "src") -> Column:
    """Frequency as far as a corpus backs it: 0 for curated words."""
    return F.when(F.col(src) == "curated", 0).otherwise(F.col(freq))


def known_words(tokens: DataFrame, lexicon: DataFrame, fams: DataFrame, allowed: DataFrame) -> DataFrame:
    """(word, akey, members, accented, backed, plain, others, siblings, ok) of the distinct words of tokens: all that a word alone tells. plain: its frequency in the lexicon; others: has its key another
    spelling; siblings: the other accented spellings (gram, c) of its key. lexicon: (word, freq, src); fams: (akey, gram, c, rnk); allowed: (word)."""
    keys = tokens.select("word").distinct().withColumn("akey", accent_key("word"))
    family = fams.groupBy("akey").agg(F.count(F.lit(1)).alias("members"), F.max((F.col("gram") != F.col("akey")).cast("int")).alias("accented"), F.sort_array(F.collect_list(F.struct("gram", "c"))).alias("family"))
    known = keys.join(family, "akey", "left").join(lexicon.select("word", real_frequency().alias("backed"), F.col("freq").alias("plain")), "word", "left").join(allowed.select("word", F.lit(True).alias("ok")).distinct(), "word", "left")
    known = known.withColumn("family", F.filter("family", lambda f: f["gram"] != F.col("word")))
    return known.withColumn("others", F.coalesce(F.size("family") > 0, F.lit(False))).withColumn("siblings", F.filter("family", lambda f: f["gram"] != F.col("akey"))).drop("family")


def with_class(tokens: DataFrame) -> DataFrame:
    """Adds `class` to tokens (word, protected, mode) with what is known of their words: the first that holds of PROTECTED, WHITELISTED, CODE_LIKE, DICTIONARY, UNACCENTED_VALID, UNKNOWN.

    A word is in the dictionary when a corpus backs it, but in accented messages not when it has no accents and some accented sibling has."""
    bare = F.col("word") == F.col("akey")
    cls = (
        F.when(F.col("protected"), "PROTECTED").when(F.col("ok"), "WHITELISTED").when(F.col("word").rlike("[0-9]"), "CODE_LIKE")
        .when((F.coalesce("backed", F.lit(0)) > 0) & ~((F.col("mode") == "ACCENTED") & bare & (F.coalesce("accented", F.lit(0)) > 0)), "DICTIONARY")
        .when(bare & (F.coalesce("members", F.lit(0)) > 0), "UNACCENTED_VALID").otherwise("UNKNOWN")
    )
    return tokens.withColumn("class", cls)


def classify(tokens: DataFrame, lexicon: DataFrame, fams: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tokens (word, protected, mode) with their class."""
    return with_class(tokens.join(known_words(tokens, lexicon, fams, allowed), "word"))


def deletes(c: Column) -> Column:
    """The word and what is left of it without one character."""
    n = F.length(c)
    return F.array_distinct(F.concat(F.array(c), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))).otherwise(F.array().cast("array<string>"))))


def deletes_to(c: Column, depth: int) -> Column:
    """Deletion variants up to a depth of 1 or 2."""
    one = deletes(c)
    return one if depth == 1 else F.array_distinct(F.flatten(F.transform(one, deletes)))


def delete_index(vocabulary: DataFrame, depth: int = 1) -> DataFrame:
    """(variant, word) of each word's deletion variants."""
    return vocabulary.select(F.explode(deletes_to(F.col("word"), depth)).alias("variant"), "word")


def pool(inputs: DataFrame, vocabulary: DataFrame, depth: int = 1) -> DataFrame:
    """(input, word, freq, lev): words that share a deletion variant with an input, within edit distance `depth`. inputs: (word); vocabulary: (word, freq)."""
    left = inputs.select(F.col("word").alias("input")).distinct().withColumn("variant", F.explode(deletes_to(F.col("input"), depth)))
    pairs = left.join(delete_index(vocabulary, depth), "variant").filter("input <> word").select("input", "word").distinct()
    near = pairs.withColumn("lev", F.levenshtein("input", "word")).filter(F.col("lev") <= depth + 1)
    return near.join(vocabulary.select("word", "freq"), "word").select("input", "word", "freq", "lev")


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds osa, the cheap score and its rank within an input, and the rank by (distance, frequency, word)."""
    scored = candidates.withColumn("osa", osa_distance("input", "word")).withColumn("same", accent_key("input") == accent_key("word"))
    d, f, k = CHEAP
    cheap = -d * F.col("osa") + f * F.log10(1.0 + F.col("freq")) + k * F.col("same").cast("double")
    by = Window.partitionBy("input")
    return scored.withColumn("cheap", cheap).withColumn("cheap_rank", F.row_number().over(by.orderBy(F.desc("cheap"), "word"))).withColumn("pool_rank", F.row_number().over(by.orderBy("osa", F.desc("freq"), "word")))


def word_splits(inputs: DataFrame, lexicon: DataFrame, least: int, best: int = 4) -> DataFrame:
    """(word, left, right, lowest, rnk): splits of a word into two lexicon words of at least that frequency, the best four."""
    w = inputs.select("word").distinct().filter(F.length("word") >= 2)
    cut = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    cut = cut.select("word", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    good = lexicon.filter(F.col("freq") >= least)
    both = cut.join(good.select(F.col("word").alias("left"), F.col("freq").alias("lf")), "left").join(good.select(F.col("word").alias("right"), F.col("freq").alias("rf")), "right")
    by = Window.partitionBy("word").orderBy(F.desc("lowest"), "left")
    return both.select("word", "left", "right", F.least("lf", "rf").alias("lowest")).withColumn("rnk", F.row_number().over(by)).filter(F.col("rnk") <= best)


def word_merges(pairs: DataFrame, lexicon: DataFrame, least: int) -> DataFrame:
    """(w1, w2, merged, freq): neighbours that make one lexicon word of at least that frequency and more frequent than either."""
    good = lexicon.filter(F.col("freq") >= least).select(F.col("word").alias("merged"), "freq")
    return pairs.select("w1", "w2").distinct().withColumn("merged", F.concat("w1", "w2")).join(good, "merged").select("w1", "w2", "merged", "freq")


def index_stats(index: DataFrame) -> DataFrame:
    """Keys, variants, edges and the largest bucket of a deletion index (variant, word)."""
    edges = index.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("edges"), F.max("n").alias("largest"))
    return index.agg(F.count_distinct("word").alias("keys")).join(edges)


def retained(fams: DataFrame, n: int) -> DataFrame:
    """At most n spellings of each key (akey, gram, c), with their position: the n - 1 (at least three) most frequent accented ones and the one without accents are chosen, accented ones first."""
    bare = F.col("gram") == F.col("akey")
    rank = F.row_number().over(Window.partitionBy("akey", bare).orderBy(F.desc("c"), "gram"))
    kept = fams.withColumn("_n", rank).filter(bare | (F.col("_n") <= max(3, n - 1))).drop("_n")
    pos = F.row_number().over(Window.partitionBy("akey").orderBy(bare, F.desc("c"), "gram"))
    return kept.withColumn("pos", pos).filter(F.col("pos") <= n).select("akey", "gram", "c", "pos")


def first_of(*sources: DataFrame) -> DataFrame:
    """(input, word, source) of candidates (input, word) of several sources, each once, by the first source that has it."""
    rows = [s.select("input", "word", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    return reduce(DataFrame.union, rows).groupBy("input", "word").agg(F.min("source").alias("source"))


def scaled(freq: Column) -> Column:
    """A small corpus's count on the scale of a large one's frequencies (fixed values): 500 times, between 1,000 and 990,000."""
    return F.least(F.greatest(freq * 500, F.lit(1000)), F.lit(990000))
