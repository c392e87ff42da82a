"""Sizes in tokens of a public tokenizer, whose rank file is a parameter."""

from __future__ import annotations

import base64
import functools

import tiktoken

#: Folder of the public tokenizers' files; it must be at this place on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; 0 for null and empty ones."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]
