"""What ranking and calibration are trained and decided on: pairwise features, standardisation, logistic weights, shortlists, budgets, gates, synthetic damage."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sieveloom.functions.unicode import fnv1a, strip_accents


def feature_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean, std) with the population deviation; 1 where it is 0."""
    got = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), F.when(F.col(f"s_{n}") == 0, 1.0).otherwise(F.col(f"s_{n}")).alias("std")) for n in names])).alias("x")).select("x.*")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (2 pos) and n / (2 neg); null for a class without rows."""
    n, pos = F.count(F.lit(1)), F.sum(F.col(label).cast("int"))
    return rows.agg(n.alias("n"), pos.alias("pos")).select("n", "pos", F.try_divide(F.col("n"), 2 * F.col("pos")).alias("w_pos"), F.try_divide(F.col("n"), 2 * (F.col("n") - F.col("pos"))).alias("w_neg"))


def logit(values: dict[str, tuple[float, float, float]], bias: float = 0.0) -> Column:
    """Linear score of standardised features (name -> weight, mean, std), as one inlined expression; null if a feature is missing."""
    return reduce(lambda x, y: x + y, [F.lit(w) * ((F.col(n) - F.lit(m)) / F.lit(s)) for n, (w, m, s) in values.items()], F.lit(bias))


def logistic(x: Column, limit: float = 36.0) -> Column:
    """Logistic function with its argument clamped."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def fit_logistic(rows: DataFrame, names: list[str], label: str, l2: float = 1e-3, steps: int = 12) -> DataFrame:
    """(feature, weight, mean, std) of a balanced logistic model, by full-batch Newton steps: each step is one aggregation of the gradient and the curvature, so the rows stay where they are. The bias isn't
    penalised; it is the row named `bias`."""
    import numpy as np

    spark = rows.sparkSession
    stats = {r["feature"]: (r["mean"], r["std"]) for r in feature_stats(rows, names).collect()}
    cw = class_weights(rows, label).first()
    if not cw["n"] or not cw["pos"] or cw["pos"] == cw["n"]:
        return spark.createDataFrame([], "feature string, weight double, mean double, std double")
    z = rows.select(*[((F.col(n) - stats[n][0]) / stats[n][1]).alias(f"z{i}") for i, n in enumerate(names)], F.col(label).cast("double").alias("y"), F.when(F.col(label), cw["w_pos"]).otherwise(cw["w_neg"]).alias("w"))
    k = len(names) + 1
    beta = np.zeros(k)
    x = [F.col(f"z{i}") for i in range(k - 1)] + [F.lit(1.0)]
    for _ in range(steps):
        p = logistic(reduce(lambda a, b: a + b, [F.lit(float(b)) * c for b, c in zip(beta, x)]), 60.0)
        g, h = F.col("w") * (p - F.col("y")), F.col("w") * p * (1 - p)
        got = z.agg(*[F.sum(g * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        penal = np.array([l2 * cw["n"]] * (k - 1) + [0.0])
        grad = np.array([got[f"g{i}"] for i in range(k)]) + penal * beta
        hess = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(penal + 1e-9)
        move = np.linalg.solve(hess, grad)
        beta = beta - move
        if np.abs(move).max() < 1e-9:
            break
    out = [(n, float(b), float(stats[n][0]), float(stats[n][1])) for n, b in zip(names, beta)] + [("bias", float(beta[-1]), 0.0, 1.0)]
    return spark.createDataFrame(out, "feature string, weight double, mean double, std double")


def shortlist(pool: DataFrame, by: list[str], size: int) -> DataFrame:
    """The pool's candidates that a diverse shortlist keeps, with their position `pos`. pool: (by..., cand, dist, freq, same, attested, recall, cheap_rank).

    Heads come in this order: two cheap ones, two (three from size 8) of the same key, one (two from size 6) by distance, one (two from size 8) attested, one by recall, one by frequency, then the cheap rest. A
    recall head that found no room replaces the weakest that is no head, if its score is higher."""
    def rank(*order: Column, when: Column | None = None) -> Column:
        w = Window.partitionBy(*by, *([when] if when is not None else [])).orderBy(*order)
        n = F.row_number().over(w)
        return n if when is None else F.when(when, n)

    cheap = F.col("cheap_rank")
    same, att = rank(cheap, F.desc("freq"), "dist", when=F.col("same")), rank(cheap, F.desc("freq"), when=F.col("attested"))
    dist, freq = rank(F.col("dist"), cheap, F.desc("freq")), rank(F.desc("freq"), cheap)
    rec = F.when(F.col("recall").isNotNull(), rank(F.desc_nulls_last("recall"), cheap))
    p = pool.withColumn("_s", same).withColumn("_d", dist).withColumn("_a", att).withColumn("_r", rec).withColumn("_f", freq)
    slots = [
        F.when(cheap <= 2, cheap), F.when(F.col("_s") <= (3 if size >= 8 else 2), 2 + F.col("_s")), F.when(F.col("_d") <= (2 if size >= 6 else 1), 5 + F.col("_d")),
        F.when(F.col("_a") <= (2 if size >= 8 else 1), 7 + F.col("_a")), F.when(F.col("_r") == 1, 10), F.when(F.col("_f") == 1, 11), 11 + cheap,
    ]
    p = p.withColumn("_slot", F.least(*slots))
    p = p.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_slot", "cheap_rank")))
    head = (cheap <= 2) | (F.col("_s") == 1) | (F.col("_d") == 1) | (F.col("_a") == 1)
    whole = Window.partitionBy(*by)
    kept = F.col("pos") <= size
    weak = F.max(F.when(kept & ~F.coalesce(head, F.lit(False)), F.struct("cheap_rank", (-F.col("freq")).alias("nf"), (-F.col("pos")).alias("np"), "cand", "recall"))).over(whole)
    p = p.withColumn("_weak", weak).withColumn("_new", F.max(F.when((F.col("_r") == 1) & ~kept, F.struct("recall", "cand"))).over(whole))
    swap = F.col("_new").isNotNull() & F.col("_weak").isNotNull() & (F.col("_weak.recall").isNull() | (F.col("_new.recall") > F.col("_weak.recall")))
    p = p.withColumn("_swap", F.coalesce(swap, F.lit(False)))
    p = p.withColumn("pos", F.when(F.col("_swap") & (F.col("cand") == F.col("_new.cand")), -F.col("_weak.np")).when(F.col("_swap") & (F.col("cand") == F.col("_weak.cand")), F.lit(size + 1)).otherwise(F.col("pos")))
    return p.filter(F.col("pos") <= size).select(*pool.columns, "pos")


def admit(groups: DataFrame, budget: int, most: int = 6) -> DataFrame:
    """(key, size) of the groups that a greedy scan in the order (first, strongest desc, key) admits within a budget of members; a group that would overflow is passed over and the scan goes on.

    groups: (key, first, strongest, size), size at most `most`. While at least `most` members fit, nothing is passed over, so that part is a running sum (over a table of the distinct strengths, then within
    one); after it at most `most` more groups can be admitted, each the first that fits, found by a minimum."""
    g = groups.filter(F.col("size").between(1, most)).select("key", F.when(F.col("first"), 0).otherwise(1).alias("o1"), (-F.col("strongest")).alias("o2"), "size")
    order = ["o1", "o2"]
    sums = g.groupBy(*order).agg(F.sum("size").alias("t"))
    before = sums.withColumn("before", F.sum("t").over(Window.orderBy(*order)) - F.col("t")).drop("t")
    run = g.join(F.broadcast(before), order).withColumn("used", F.col("before") + F.sum("size").over(Window.partitionBy(*order).orderBy("key")))
    free = run.filter(F.col("used") <= budget)
    spent = free.agg(F.max("used")).first()[0] or 0
    last = free.agg(F.max(F.struct("o1", "o2", "key"))).first()[0]
    extra = []
    while spent < budget:
        later = g.filter(F.col("size") <= budget - spent)
        if last is not None:
            o1, o2, k = last["o1"], last["o2"], last["key"]
            later = later.filter((F.col("o1") > o1) | ((F.col("o1") == o1) & ((F.col("o2") > o2) | ((F.col("o2") == o2) & (F.col("key") > k)))))
        nxt = later.agg(F.min(F.struct("o1", "o2", "key", "size"))).first()[0]
        if nxt is None:
            break
        extra.append((nxt["key"], nxt["size"]))
        spent += nxt["size"]
        last = nxt
    more = groups.sparkSession.createDataFrame(extra, groups.select("key", F.col("size")).schema)
    return free.select("key", "size").union(more)


def context_slots(words: DataFrame, by: list[str], target: str, idx: str, most: int = 32, heads: int = 4) -> DataFrame:
    """At most `most` words of each target's message: the first four, the target, and the nearest by (distance, place), with their slot in the message's order."""
    dist = F.abs(F.col(idx) - F.col(target))
    forced = (F.col(idx) < heads) | (F.col(idx) == F.col(target))
    rank = F.row_number().over(Window.partitionBy(*by, target).orderBy(F.when(forced, 0).otherwise(1), dist, idx))
    kept = words.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy(*by, target).orderBy(idx)) - 1)


def char_hashes(word: str, most: int = 32, buckets: int = 4096) -> list[int]:
    """Bucket of each distinct run of two to four characters of a word with marked ends, in order of length and place, at most 32."""
    w = f"<{word}>"
    grams = dict.fromkeys(w[i : i + k] for k in (2, 3, 4) for i in range(len(w) - k + 1))
    return [fnv1a(g) % buckets for g in list(grams)[:most]]


def char_hashes_udf(c: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(char_hashes, na_action="ignore")

    return run(c)


def match_case(pattern: Column, word: Column) -> Column:
    """The word in the case of the pattern: all capitals, a first capital, or as it is."""
    first = F.substring(pattern, F.lit(1), F.lit(1))
    return F.when((F.length(pattern) > 1) & (F.upper(pattern) == pattern) & (F.lower(pattern) != pattern), F.upper(word)).when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(word, F.lit(1), F.lit(1))), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


_TONES = {"\u0300": "f", "\u0301": "s", "\u0309": "r", "\u0303": "x", "\u0323": "j"}


def _pick(seed: str, n: int) -> int:
    return int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big") % n


def telex_typo(word: str) -> str:
    """The word with its tone typed as a letter at the end; the word itself if it has no tone."""
    import unicodedata

    d = unicodedata.normalize("NFD", word)
    tone = next((c for c in d if c in _TONES), None)
    return word if tone is None else unicodedata.normalize("NFC", d.replace(tone, "", 1)) + _TONES[tone]


def damage(text: str, kind: str, seed: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The text with one kind of damage and its repairs (error, correction, start, end) in the damaged text's offsets. Words are chosen by digest, so the same seed damages alike."""
    words = [m for m in re.finditer(r"[^\W\d_]+", text)]
    edits: list[tuple[int, int, str]] = []
    if kind == "ALL_UNACCENTED":
        edits = [(m.start(), m.end(), strip_accents(m.group())) for m in words]
    elif kind == "SOME_UNACCENTED":
        edits = [(m.start(), m.end(), strip_accents(m.group())) for i, m in enumerate(words) if _pick(f"{seed}:{i}", 4) == 0]
    elif words and kind == "TELEX":
        toned = [m for m in words if telex_typo(m.group()) != m.group()]
        edits = [(m.start(), m.end(), telex_typo(m.group())) for m in toned[_pick(seed, len(toned)) :][:1]] if toned else []
    elif words and kind == "TYPO":
        long = [m for m in words if len(m.group()) >= 4]
        for m in long[_pick(seed, len(long)) :][:1] if long else []:
            at = 1 + _pick(seed + "at", len(m.group()) - 2)
            edits.append((m.start(), m.end(), m.group()[:at] + m.group()[at + 1] + m.group()[at] + m.group()[at + 2 :]))
    elif kind == "BOUNDARY":
        pairs = [(a, b) for a, b in zip(words, words[1:]) if text[a.end() : b.start()] == " "]
        for a, b in pairs[_pick(seed, len(pairs)) :][:1] if pairs else []:
            edits.append((a.start(), b.end(), a.group() + b.group()))
    out, labels, at, shift = [], [], 0, 0
    for s, e, new in edits:
        old = text[s:e]
        if new == old:
            continue
        out += [text[at:s], new]
        labels.append((new, old, s + shift, s + shift + len(new)))
        shift += len(new) - (e - s)
        at = e
    return "".join(out) + text[at:], labels


def repair(text: str, labels: list[tuple[str, str, int, int]]) -> str:
    for _, old, s, e in sorted(labels, key=lambda x: -x[2]):
        text = text[:s] + old + text[e:]
    return text


def damaged(rows: DataFrame, id_col: str, text: str, kinds: list[str]) -> DataFrame:
    """(id, kind, text, labels): each text damaged in the kind that its id's digest chooses."""
    schema = "struct<kind:string,text:string,labels:array<struct<error:string,correction:string,start:int,end:int>>>"

    @F.pandas_udf(schema)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for i, t in zip(ids, texts):
            kind = kinds[_pick(f"kind:{i}", len(kinds))]
            new, labels = damage(t, kind, str(i))
            out.append((kind, new, [dict(zip(("error", "correction", "start", "end"), x)) for x in labels]))
        return pd.DataFrame(out, columns=["kind", "text", "labels"])

    return rows.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), run(F.col(id_col).cast("string"), text).alias("d")).select("id", "d.*")


def sentence_around(text: str, at: int) -> tuple[int, int]:
    """(start, end) of the sentence that holds an offset: bounded by line ends, and by a mark with a blank after it."""
    start = max((m.end() for m in re.finditer(r"\n|[.!?…]\s+", text[:at])), default=0)
    stop = re.search(r"\n|[.!?…](?=\s|$)", text[at:])
    return start, len(text) if stop is None else at + stop.end() - (stop.group() == "\n")


def gates(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, value, limit, pass) of one row of metrics and its rules (column, >= or <=, limit); a missing value fails. The last row, `all`, passes only if every gate does."""
    rows = [F.struct(F.lit(f"{c} {op} {x}").alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.coalesce(F.col(c) >= x if op == ">=" else F.col(c) <= x, F.lit(False)).alias("pass")) for c, op, x in rules]
    g = metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return g.unionByName(g.agg(F.lit("all").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("limit"), F.coalesce(F.every("pass"), F.lit(False)).alias("pass")))
