"""Forms of words and lines that are compared, counted or fed to a model, as built-in expressions (NFC aside)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveloom.functions.unicode import nfc


def blank_codes(c: Column) -> Column:
    """Clusters of letters and digits (with dots and hyphens inside) that hold a digit become a blank: codes would leave phantom words."""
    return F.regexp_replace(c, r"[0-9][0-9\p{L}.-]*[0-9\p{L}]|\p{L}[\p{L}.-]*[0-9](?:[0-9\p{L}.-]*[0-9\p{L}])?", " ")


def plain_surface(c: Column) -> Column:
    """Lower case, without what isn't a letter or digit at the ends."""
    return F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")


def label_surface(c: str | Column) -> Column:
    """The same of the composed form: what labels and findings are compared by."""
    return plain_surface(nfc(c))


def mark_surface(c: str | Column) -> Column:
    """Composed, lower case, without punctuation and separators at the ends; symbols stay."""
    return F.regexp_replace(F.lower(nfc(c)), r"^[\p{P}\p{Z}]+|[\p{P}\p{Z}]+\z", "")


def model_tokens(c: str | Column) -> Column:
    """Array of a model's tokens: marks in angle brackets or double braces, and runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(nfc(c)), F.lit(r"<[^>]+>|\{\{[^}]+\}\}|[\p{L}\p{N}_]+"), F.lit(0))


def first_runs(word: Column, most: int = 32) -> Column:
    """The first `most` distinct runs of two to four characters of a word with marked ends, by length and place."""
    w = F.concat(F.lit("<"), word, F.lit(">"))

    def runs(k: int) -> Column:
        return F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(F.concat(*map(runs, (2, 3, 4)))), 1, most)


def word_at(text: Column, offset: Column) -> Column:
    """The word (letters and marks) that covers an offset of a text, null if none does."""
    left = F.regexp_extract(F.substring(text, F.lit(1), offset), r"[\p{L}\p{M}]+$", 0)
    right = F.regexp_extract(F.substring(text, offset + 1, F.length(text)), r"^[\p{L}\p{M}]+", 0)
    return F.when(right != "", F.concat(left, right))


def canonical_json(*names: str) -> Column:
    """Compact JSON of columns in the order of their names, nulls included."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def int8(vector: Column) -> Column:
    """(scale, values) of a vector on the symmetric scale of -127 to 127; a vector of zeros has scale 1."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(most > 0, most / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(vector, lambda x: F.floor(x.cast("double") / scale + 0.5).cast("int")).alias("values"))
