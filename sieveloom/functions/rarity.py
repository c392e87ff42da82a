"""Word counts over all rows in a table of fixed size, by hash of the word: an order of rarity that every task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveloom.functions.text import WordHashes, folded_words, map_batches

BUCKETS = 1 << 18


def word_counts(texts: DataFrame, column: str = "text") -> np.ndarray:
    """Number of words in each hash bucket, over all rows; at most BUCKETS rows reach the driver. Null texts have no words."""
    hashes = WordHashes()

    def count(words: list[str]) -> np.ndarray:
        return np.bincount((np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)

    def kernel(col: pa.Array) -> pa.RecordBatch:
        acc, pending = np.zeros(BUCKETS, np.int64), []
        for t in col.to_pylist():
            if t:
                pending += folded_words(t)
                if len(pending) > 200_000:
                    acc += count(pending)
                    pending = []
        acc += count(pending)
        at = np.flatnonzero(acc)
        return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(acc[at])], names=["bucket", "n"])

    got = map_batches(texts, [column], kernel, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out
