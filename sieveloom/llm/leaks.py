"""Held-out items in training documents (problem 4): a prefix-filtered set join on rare shingles, then word-for-word comparison of item-sized windows.

Two texts share WINDOW consecutive words only if they share a window of that length, and equal windows have the same rarest shingle of SHINGLE words. So each text
is indexed by the rarest shingle of each of its windows (its necessary prefix token) alone: rarity is the count of the shingle's rarest word over all documents,
kept in a table of fixed size, ties going by hash. A document's token is kept if some item has it with enough words around it: of the words before and after the shingle, at most as many count as the
shorter of the two texts has there, and both together must fill a window (the bounds by position and length). Around what is kept, windows are joined by a 128-bit digest. Of each document and item that meet, the
document's window of the item's size, laid so that the shared words lie upon each other, is compared with the item word for word: a run of WINDOW equal words must stand there.

Joins are by token, by window and by item, with many rows on the documents' side only; skewed partitions of such joins are split by adaptive execution. A document's matches are compared in
lists of about LIST.

Defined results: null and empty texts and items of under WINDOW words never count; equal items are matched once and expanded at the end; repeated ids give one row;
other columns are ignored; a text of any length is taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.rarity import BUCKETS, word_counts
from sieveloom.functions.text import WordHashes, folded_words, map_batches, shingle_hashes
from sieveloom.llm.repetition import groups
from sieveloom.operators.common import materialize

SHINGLE, WINDOW, LIST = 5, 12, 1000
_SPAN = WINDOW - SHINGLE + 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _order(h: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sort key of each shingle: the count of its rarest word, then its hash."""
    c = counts[(h % np.uint64(BUCKETS)).astype(np.int64)]
    n = len(grams)
    least = c[:n].copy()
    for j in range(1, SHINGLE):
        np.minimum(least, c[j : j + n], out=least)
    return (np.minimum(least, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))


def prefix_tokens(words: list[list[str]], hashes: WordHashes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, shingle hash) of the shingles that are the rarest of some window, over several texts at once."""
    lens = np.array([len(w) for w in words])
    h = np.fromiter((hashes[x] for w in words for x in w), np.uint64, int(lens.sum()))
    owner = np.repeat(np.arange(len(words)), lens)
    if len(h) < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = shingle_hashes(h, SHINGLE)
    order = _order(h, grams, counts)
    order[owner[: len(grams)] != owner[SHINGLE - 1 :]] = _NONE
    n = len(h) - WINDOW + 1
    least = order
    for step in (1, 2, 4):  # smallest of eight in a row
        least = np.minimum(least[:-step], least[step:])
    whole = owner[:n] == owner[WINDOW - 1 :]
    chosen = np.zeros(len(grams), bool)
    for j in range(_SPAN):
        chosen[j : j + n] |= whole & (least[:n] == order[j : j + n])
    at = np.flatnonzero(chosen)
    start = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return owner[at], at - start[owner[at]], grams[at]


def tokens(df: DataFrame, id_col: str, text_col: str, counts: np.ndarray) -> DataFrame:
    """(token, id, pos, before, after) of the prefix tokens of each text, with the number of words around the shingle that a window can take in."""
    hashes = WordHashes()
    kind = df.schema[id_col].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def kernel(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ts, parts = texts.to_pylist(), []
        for a, b in groups([t or "" for t in ts]):
            words = [folded_words(t) if t else [] for t in ts[a:b]]
            who, pos, gram = prefix_tokens(words, hashes, held.value)
            after = np.array([len(w) for w in words])[who] - SHINGLE - pos
            parts.append((who + a, pos, after, gram))
        who, pos, after, gram = (np.concatenate(x) for x in zip(*parts))
        small = lambda x: pa.array(np.minimum(x, _SPAN - 1).astype(np.int8))
        return pa.record_batch([pa.array(gram.view(np.int64)), ids.take(pa.array(who)), pa.array(pos.astype(np.int32)), small(pos), small(after)], names=["token", "id", "pos", "before", "after"])

    return map_batches(df, [id_col, text_col], kernel, f"token long, id {kind}, pos int, before byte, after byte")


def windows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(w1, w2, id, pos, n): digests of the windows that hold one of the shingles at the positions in `at`, where they start, and the number of words of the text."""
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(ids: pa.Array, texts: pa.Array, ats: pa.Array) -> pa.RecordBatch:
        digests, who, pos, size = [], [], [], []
        for k, (t, at) in enumerate(zip(texts.to_pylist(), ats.to_pylist())):
            words = folded_words(t)
            for s in sorted({i for p in at for i in range(max(0, p - _SPAN + 1), min(p, len(words) - WINDOW) + 1)}):
                digests.append(xxhash.xxh3_128_digest(" ".join(words[s : s + WINDOW])))
                who.append(k)
                pos.append(s)
                size.append(len(words))
        both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), ids.take(pa.array(who, pa.int64())), pa.array(pos, pa.int32()), pa.array(size, pa.int32())], names=["w1", "w2", "id", "pos", "n"])

    return map_batches(df, [id_col, text_col, "at"], kernel, f"w1 long, w2 long, id {kind}, pos int, n int")


def shares_run(window: list[str], item: list[str], at: int) -> bool:
    """Do the words of the window, whose first one lies upon the item's word `at`, equal the item's over WINDOW words in a row?"""
    run = 0
    for x, y in zip(window, item[at:]):
        run = run + 1 if x == y else 0
        if run == WINDOW:
            return True
    return False


def _verified(met: DataFrame, docs: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """(id, cls) of the pairs of met (id, cls, n, best: (dpos, ipos)) whose words agree. docs: (id_col, text); texts: (cls, text)."""
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = met.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    lists = met.join(sizes, "id").withColumn("part", F.pmod(F.xxhash64("cls"), F.floor(F.col("k") / LIST) + 1)).groupBy(F.col("id").alias(id_col), "part").agg(F.collect_list(F.struct("cls", "n", "best.dpos", "best.ipos")).alias("hits"))

    def cut_out(ids: pa.Array, ts: pa.Array, hits: pa.Array) -> pa.RecordBatch:
        who, cls, at, window = [], [], [], []
        for k, (t, hs) in enumerate(zip(ts.to_pylist(), hits.to_pylist())):
            words = folded_words(t)
            for h in hs:
                first = h["dpos"] - h["ipos"]
                who.append(k)
                cls.append(h["cls"])
                at.append(max(0, -first))
                window.append(" ".join(words[max(0, first) : first + h["n"]]))
        return pa.record_batch([ids.take(pa.array(who, pa.int64())), pa.array(cls, pa.binary()), pa.array(at, pa.int32()), pa.array(window, pa.string())], names=["id", "cls", "at", "window"])

    def compare(ids: pa.Array, cls: pa.Array, ats: pa.Array, ws: pa.Array, ts: pa.Array) -> pa.RecordBatch:
        keep = pa.array([k for k, (a, w, t) in enumerate(zip(ats.to_pylist(), ws.to_pylist(), ts.to_pylist())) if shares_run(w.split(), t.split(), a)], pa.int64())
        return pa.record_batch([ids.take(keep), cls.take(keep)], names=["id", "cls"])

    laid = map_batches(docs.select(id_col, "text").join(lists, id_col), [id_col, "text", "hits"], cut_out, f"id {kind}, cls binary, at int, window string")
    return map_batches(laid.join(texts, "cls"), ["id", "cls", "at", "window", "text"], compare, f"id {kind}, cls binary")


def item_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (cls, item_table, item_id) and one text (cls, text) of each class of items with the same words. items: (item_table, item_id, text)."""

    def kernel(tables: pa.Array, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = [folded_words(t or "") for t in texts.to_pylist()]
        keep = [k for k, w in enumerate(words) if len(w) >= WINDOW]
        text = [" ".join(words[k]) for k in keep]
        at = pa.array(keep, pa.int64())
        return pa.record_batch([pa.array([xxhash.xxh3_128_digest(t) for t in text], pa.binary()), tables.take(at), ids.take(at), pa.array(text, pa.string())], names=["cls", "item_table", "item_id", "text"])

    named = materialize(map_batches(items.select("item_table", F.col("item_id").cast("string").alias("item_id"), "text"), ["item_table", "item_id", "text"], kernel, "cls binary, item_table string, item_id string, text string"), "items")
    return named.select("cls", "item_table", "item_id").distinct(), named.groupBy("cls").agg(F.min("text").alias("text"))


def leaked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_table, item_id) of each document and item that share WINDOW or more consecutive words."""
    counts = word_counts(docs)
    members, texts = item_classes(items)
    texts = materialize(texts, "classes")
    item_tokens = materialize(tokens(texts, "cls", "text", counts), "item_tokens")
    doc_tokens = tokens(docs, id_col, "text", counts)
    bounds = item_tokens.select("token", F.col("before").alias("b"), F.col("after").alias("a")).distinct()
    room = F.least("before", "b") + F.least("after", "a") >= _SPAN - 1
    shared = materialize(doc_tokens.join(bounds, (doc_tokens["token"] == bounds["token"]) & room, "left_semi").select("token", "id", "pos"), "shared")
    doc_at = shared.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumnRenamed("id", id_col)
    item_at = item_tokens.join(shared.select("token").distinct(), "token", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumnRenamed("id", "cls")
    doc_windows = windows(docs.select(id_col, "text").join(doc_at, id_col), id_col, "text").select("w1", "w2", "id", F.col("pos").alias("dpos"))
    item_windows = windows(texts.join(item_at, "cls"), "cls", "text").groupBy("w1", "w2", F.col("id").alias("cls"), "n").agg(F.min("pos").alias("ipos"))
    met = materialize(doc_windows.join(item_windows, ["w1", "w2"]).groupBy("id", "cls", "n").agg(F.min(F.struct("dpos", "ipos")).alias("best")), "met")
    pairs = _verified(met, docs, texts, id_col)
    return pairs.join(members, "cls").select(F.col("id").alias(id_col), "item_table", "item_id").distinct()
