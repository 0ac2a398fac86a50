"""Operator 10: token counts of a document's sections, from one encoding of the whole document.

The document is encoded once, as a whole. A byte-level vocabulary's tokens are substrings of the UTF-8 text, so their
running lengths are their spans. A document's sections are intervals of its bytes, in order and without gaps: each
non-empty line with the newline after it (and the empty lines that follow) is one. Tokens are joined to the sections by a
sorted merge of the two lists of boundaries, and a token that crosses a boundary goes to the section that holds its first byte
("first"), its last byte ("last"), or the larger part of it, the earlier section on ties ("most"). The counts of a
document's sections always sum to its tokens.

Nulls: a null or empty text has no tokens and no sections. Special tokens in a text are ordinary text. Repeated rows get
the same counts. An empty table gives an empty result. The vocabulary's place is a parameter; executors read it from
their own installation. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import arrays, blocks

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder and the length in bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def sections(data: np.ndarray) -> np.ndarray:
    """Starts of a text's sections: its first byte, and each byte after a newline that is not itself a newline."""
    if not len(data):
        return np.zeros(0, np.int64)
    fresh = np.flatnonzero((data[1:] != 10) & (data[:-1] == 10)) + 1
    return np.concatenate(([0], fresh))


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary."""
    end = np.cumsum(lengths)
    begin = end - lengths
    at_first = np.searchsorted(starts, begin, "right") - 1
    at_last = np.searchsorted(starts, end - 1, "right") - 1
    crossing = at_first != at_last
    if rule == "first":
        owner = at_first
    elif rule == "last":
        owner = at_last
    elif rule == "most":
        owner = at_first.copy()
        bounds = np.append(starts, end[-1] if len(end) else 0)
        for i in np.flatnonzero(crossing):
            parts = np.minimum(bounds[at_first[i] + 1 : at_last[i] + 2], end[i]) - np.maximum(bounds[at_first[i] : at_last[i] + 1], begin[i])
            owner[i] = at_first[i] + int(np.argmax(parts))
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=len(starts)), int(crossing.sum())


def _count(batches: Iterator[pa.RecordBatch], path: str, rule: str) -> Iterator[pa.RecordBatch]:
    encoder, sizes = encoding(path)
    for batch in batches:
        for block in blocks(batch.column("text"), 4 << 20):
            n_tokens, crossing, per, first = [], [], [], [0]
            for i in range(block.hi - block.lo):
                text = block.data[block.offsets[i] : block.offsets[i + 1]]
                tokens = np.asarray(encoder.encode_to_numpy(text.tobytes().decode(), allowed_special=set(), disallowed_special=())).astype(np.int64) if len(text) else np.zeros(0, np.int64)
                counts, crossed = attribute(sizes[tokens], sections(text), rule)
                n_tokens.append(len(tokens))
                crossing.append(crossed)
                per.append(counts)
                first.append(first[-1] + len(counts))
            columns = [batch.column("doc_id").slice(block.lo, block.hi - block.lo), pa.array(n_tokens, pa.int64()), pa.array(np.diff(first)), pa.array(crossing, pa.int64())]
            columns.append(arrays(np.concatenate(per).astype(np.int64), np.array(first), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing (tokens over a boundary), section_tokens (tokens of each section in order)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _count(it, vocabulary, rule), f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")
