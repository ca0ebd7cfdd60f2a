"""Public tokenizers: their files stay where they are, the path is a parameter."""

from __future__ import annotations

import base64
import functools
import os

VOCABULARY = os.environ.get("CINDERLODE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str = VOCABULARY):
    """The byte-level tokenizer of a rank file; held once in a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(path: str = VOCABULARY):
    """Bytes of each token id."""
    import numpy as np

    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], dtype=np.int64)
