"""Token counts: exact lengths of whole texts under a public byte-level vocabulary.

Method: an Arrow function groups the texts of a batch into calls of about equal bytes,
cuts long texts at safe boundaries and keeps lengths only.  A single blank or line end
between two letters or digits of any script is safe: the pre-tokenizer always starts a new
piece there.  A text without any, as of a script without blanks, is one piece.

Texts of Latin-1 characters are counted by the rank form of the same vocabulary, which
merges alike and much faster; pieces with any other character go to the tokenizer itself.
Both are compared in the tests.

Defined results: null counts as empty (0 bytes, 0 tokens); repeated rows get the same
counts; a special string inside a text is the special token, which is the library's default.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches

#: Bytes in one call of the encoder, and the most of one piece where a safe boundary exists.
CALL_BYTES, PIECE_CHARS = 1 << 18, 1 << 15
_SAFE = re.compile(r"(?<=[^\W_])[ \n](?=[^\W_])")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÿ]*")


@cache
def encoders(path: str):
    """The tokenizer of a .json file, and the same vocabulary as ranks (None where there is no such file)."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(path)
    file = Path(path).with_suffix(".tiktoken")
    if not file.exists():
        return whole, None
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read_bytes().splitlines())}
    special = {v.content: k for k, v in whole.get_added_tokens_decoder().items()}
    return whole, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(text: str) -> Iterator[str]:
    """Parts of a text whose token counts add up to that of the whole."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = _SAFE.search(text, start + PIECE_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def count_batch(texts: list[str], path: str) -> list[int]:
    """Tokens of every text; the calls take about CALL_BYTES each."""
    whole, ranks = encoders(path)
    counts = [0] * len(texts)
    calls: dict[bool, list] = {True: [], False: []}
    sizes = {True: 0, False: 0}

    def flush(plain: bool) -> None:
        got, calls[plain], sizes[plain] = calls[plain], [], 0
        if plain:
            for at, part in got:
                counts[at] += len(ranks.encode_to_numpy(part, allowed_special="all"))
        elif got:
            for (at, _), found in zip(got, whole.encode_batch_fast([x for _, x in got], add_special_tokens=False), strict=True):
                counts[at] += len(found)

    for at, text in enumerate(texts):
        for part in pieces(text):
            plain = ranks is not None and _PLAIN.fullmatch(part) is not None
            calls[plain].append((at, part))
            sizes[plain] += len(part) if part.isascii() else len(part.encode())
            if sizes[plain] >= CALL_BYTES:
                flush(plain)
    flush(True)
    flush(False)
    return counts


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; `tokenizer` is a path that every worker has."""

    def start() -> Callable[[pa.RecordBatch], list]:
        def work(batch: pa.RecordBatch) -> list:
            sizes = batch.column(1).to_pylist()
            return [batch.column(0), sizes, count_batch(batch.column(2).to_pylist(), tokenizer)]

        return work

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return map_batches(slim, _COUNTS, start).withColumn("over_limit", F.col("n_tokens") > limit)
