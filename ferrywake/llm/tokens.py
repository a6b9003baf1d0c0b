"""Token counts of whole texts with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary files lie; they are read, never copied.
TOKENIZER_DIR = os.environ.get("FERRYWAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    import base64

    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Longer texts are encoded in pieces of about this many characters, cut before a space, where no token of the vocabulary reaches over.
PIECE = 100_000


def count_tokens(encoding, text: str) -> int:
    """Tokens of the whole text. Pieces are cut between a non-space and a single space followed by a letter, where the pattern always splits."""
    import re

    if len(text) <= PIECE:
        return len(encoding.encode_ordinary(text))
    total, begin = 0, 0
    while begin < len(text):
        end = len(text)
        if end - begin > PIECE and (cut := re.compile(r"(?<=[^\W_]) (?=[^\W_])").search(text, begin + PIECE)):
            end = cut.start()
        total += len(encoding.encode_ordinary(text[begin:end]))
        begin = end
    return total


def with_tokens(documents: DataFrame, doc_id: str, text: str, keep: list[str] = (), folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the ``keep`` columns and ``tokens`` (bigint). A null or empty text has 0 tokens; texts are counted whole."""
    columns = [doc_id, *keep]
    source = documents.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in columns) + ", tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(folder, vocabulary)
        for b in batches:
            n = [count_tokens(encoding, t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(n, pa.int64())], [*columns, "tokens"])

    return source.mapInArrow(count, schema)
