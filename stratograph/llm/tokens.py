"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame

from stratograph.session import spread

#: Where the vocabulary files are, on every executor; a parameter of all operators that count tokens.
VOCABULARY = os.environ.get("STRATOGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that goes with byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SIZE_SCHEMA = "doc_id long, source string, tokens long, loss_tokens long"
#: Longest piece handed to the tokenizer at once: its merges are quadratic in runs without a break.
LONGEST_RUN = 4096
_FENCE = regex.compile(r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_RUN = regex.compile(rf"\S{{{LONGEST_RUN}}}|\s{{{LONGEST_RUN}}}")


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the byte length of each of its tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Tokens of the whole text; runs beyond ``LONGEST_RUN`` characters without a break are cut there."""
    enc, out, at = encoder(path)[0], [], 0
    for m in _RUN.finditer(text):
        out += enc.encode_ordinary(text[at:m.end()])
        at = m.end()
    return out + enc.encode_ordinary(text[at:])


def sizes(text: str, path: str = VOCABULARY) -> tuple[int, int]:
    """(tokens, loss-bearing tokens): the loss falls on prose; tokens that begin in fenced code bear none."""
    ids = encode(text, path)
    fences = [(m.start(), m.end()) for m in _FENCE.finditer(text)]
    if not fences:
        return len(ids), len(ids)
    starts = np.concatenate([[0], np.cumsum(encoder(path)[1][ids])[:-1]]) if ids else np.zeros(0)
    inside = np.zeros(len(ids), dtype=bool)
    for b, e in fences:
        lo, hi = len(text[:b].encode()), len(text[:e].encode())
        inside |= (starts >= lo) & (starts < hi)
    return len(ids), int(len(ids) - inside.sum())


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, loss_tokens), one row per document.

    ``source`` is trimmed and in lower case. A null text counts as empty: 0 tokens. Rows of null
    doc_id are left out; repeated rows of one id are one document.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, s.strip().lower() if s else s, *sizes(t or "", path)) for d, s, t in batch.itertuples(index=False)],
                               columns=["doc_id", "source", "tokens", "loss_tokens"])

    rows = documents.select("doc_id", "source", "text").filter("doc_id IS NOT NULL")
    return spread(rows).mapInPandas(run, SIZE_SCHEMA).dropDuplicates(["doc_id"])
