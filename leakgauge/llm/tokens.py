"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leakgauge.session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in stretches of about so many characters.
STRETCH = 100_000
#: A blank between two letters or digits begins a pre-token whatever stands around it, so a cut there changes no token.
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY) -> int:
    """Tokens of the whole text, the same as encoding it in one piece; 0 for NULL and the empty text."""
    if not text:
        return 0
    encode = encoder(path).encode_ordinary
    total, at = 0, 0
    while len(text) - at > STRETCH and (safe := _SAFE.search(text, at + STRETCH)):
        total += len(encode(text[at : safe.start()]))
        at = safe.start()
    return total + len(encode(text[at:]))


def token_sizes(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens of every row; the texts end here."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_tokens(t, vocabulary) for t in batch.column(n).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(j) for j in range(n)] + [sizes], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long")
