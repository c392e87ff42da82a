"""Data preparation: cleaning, sentences, templates, hash splits, error channels, synthetic accent loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Every kind of blank, as a Java and RE2 character class.
BLANK = r"[\t\n\x{0b}\x{0c}\r\x{85} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{BLANK}+", " "), "^ | $", "")


def template(c: Column) -> Column:
    """The text with codes, web addresses and numbers as one mark, lower case, blanks collapsed."""
    c = F.regexp_replace(c, r"(^|[^A-Za-z0-9])[A-Z0-9]*[A-Z][0-9A-Z]{5,}", "$1<var>")
    c = F.regexp_replace(F.lower(collapse(c)), rf"(https?://|www\.)[^ ]+|[a-z0-9-]+\.example[^ ]*", "<var>")
    return F.regexp_replace(c, "[0-9]+([.,:/-][0-9]+)*", "<var>")


def placeholders(c: Column) -> Column:
    """Web addresses, e-mail addresses and phone numbers as marks."""
    c = F.regexp_replace(c, r"https?://[^ \n]+", "<url>")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>")
    return F.regexp_replace(c, r"(\+84|0)[0-9]{9}", "<phone>")


#: The five named entities that cleaning knows (fixed values); the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def clean_markup(c: Column) -> Column:
    """Tags become blanks, entities their characters; blanks collapsed."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return collapse(c)


def sentences(c: Column) -> Column:
    """Array of the sentences of a text, cut after a mark and blanks."""
    return F.split(F.regexp_replace(c, rf"([.!?…]){BLANK}+", "$1\x1e"), "\x1e")


def hash_percent(c: Column, salt: str) -> Column:
    """0..99 from the first eight hex digits of a salted digest."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), c), 256), 1, 8), 16, 10).cast("long") % 100


def byte_percent(c: Column) -> Column:
    """0..99 from the first byte of a digest; uneven, for parity with older splits."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int") % 100


def split_of(percent: Column, train: int, dev: int) -> Column:
    return F.when(percent < train, "train").when(percent < train + dev, "dev").otherwise("test")


def prefix_split(groups: DataFrame, key: str, size: str, names: list[str], ratio: list[float]) -> DataFrame:
    """(key, split): groups in the order of their digest, cut where the running size passes the wanted shares.

    The running sum is made of sums over 65,536 digest prefixes (a bounded table) and running sums within a prefix, so no task orders all groups."""
    g = groups.select(key, F.col(size).cast("long").alias("s"), F.sha2(F.col(key).cast("string"), 256).alias("h")).withColumn("p", F.substring("h", 1, 4))
    sums = g.groupBy("p").agg(F.sum("s").alias("t"))
    before = sums.select("p", (F.sum("t").over(Window.orderBy("p")) - F.col("t")).alias("before"))
    total = sums.agg(F.sum("t").alias("total"))
    run = g.join(F.broadcast(before), "p").join(F.broadcast(total)).withColumn("mid", F.col("before") + F.sum("s").over(Window.partitionBy("p").orderBy("h")) - F.col("s") / 2)
    edge, out = 0.0, F.lit(names[-1])
    cuts = []
    for n, r in zip(names[:-1], ratio):
        edge += r
        cuts.append((n, edge))
    for n, e in reversed(cuts):
        out = F.when(F.col("mid") < F.col("total") * F.lit(e), n).otherwise(out)
    return run.select(key, out.alias("split"))


def channel(pairs: DataFrame) -> DataFrame:
    """(source, target, n) of corrections (error, correction)."""
    return pairs.select(F.lower("error").alias("source"), F.lower("correction").alias("target")).filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def direct(pairs: DataFrame, correct: DataFrame) -> DataFrame:
    """(source, target, n): sources with exactly one target that never stand as a correct word (column word)."""
    one = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("targets"), F.max("target").alias("target"), F.max("n").alias("n")).filter("targets = 1")
    return one.join(correct.select(F.col("word").alias("source")).distinct(), "source", "left_anti").select("source", "target", "n")


def relation(error: Column, correction: Column, ekey: Column, ckey: Column) -> Column:
    """How a correction relates to the error; the keys are those without accents."""
    gaps = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (
        F.when(error == correction, "IDENTITY").when(gaps(correction) > gaps(error), "SPLIT").when(gaps(correction) < gaps(error), "MERGE")
        .when((ekey == ckey) & (error == ekey), "UNACCENTED_SAME_KEY").when(ekey == ckey, "ACCENTED_SAME_KEY").when(gaps(error) == 0, "DIFFERENT_KEY_SINGLE").otherwise("DIFFERENT_KEY_MULTI")
    )
