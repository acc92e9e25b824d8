"""Token counts by a public tokenizer, lengths only.

Texts are split at safe boundaries: white space, and the place between a letter
or digit and a run of punctuation that ends a word. No token of the vocabulary
spans either, so the counts of the pieces add up to the count of the whole text.
Texts are taken in groups of at most ``GROUP_BYTES`` (a longer text is a group of its
own). The pieces that a group needs and that are not known yet are encoded together,
in calls of equal bytes; only lengths are kept, and of pieces up to ``KNOWN_BYTES``
remembered. A run without white space is one piece, whatever its length.

Defined results: a null text counts as empty and has no token; special strings
inside a text become one token as the library does by default (a text that holds
one is encoded whole, between white space); repeated rows are counted each.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daygrid.llm.common import small_batches, texts_of

CALL_BYTES = 1 << 18
GROUP_BYTES = 1 << 22
KNOWN_BYTES = 64
KNOWN_PIECES = 600_000
LIMIT = 2048

# A run of these after a letter or digit and before white space is a piece of its own.
TAIL = re.compile(r"(?<=[^\W_])([.,;:!?%*#$&|]+)(?=[ \n\t]|$)")
_STATE: dict[str, tuple] = {}


def safe_pieces(text: str, special: tuple[str, ...]) -> list[str]:
    """Pieces whose token counts add up to that of the text."""
    if not any(s in text for s in special):
        text = TAIL.sub(r" \1", text)
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def byte_groups(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts of at most ``most`` bytes together; a longer one is a group of its own."""
    held, size = [], 0
    for t in texts:
        n = len(t.encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def byte_balanced(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """The pieces in as few calls of at most ``most`` bytes as they need, filled about equally."""
    total = sum(len(p.encode("utf-8", "surrogatepass")) for p in pieces)
    yield from byte_groups(pieces, math.ceil(total / max(1, math.ceil(total / most))) if total else most)


def _tokenizer(path: str):
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _STATE[path] = (lambda texts: list(map(len, model.encode(texts, num_threads=1))), (), None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            special = tuple(t.content for t in model.get_added_tokens_decoder().values())
            _STATE[path] = (lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)], special, {})
    return _STATE[path]


def lengths(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts."""
    encode, special, known = _tokenizer(path)
    if known is None:  # white space is part of the pieces there, so texts stay whole
        return list(chain.from_iterable(map(encode, byte_balanced(texts))))
    out = []
    for group in byte_groups(texts, GROUP_BYTES):
        if len(known) > KNOWN_PIECES:
            known.clear()
        cut = [safe_pieces(t, special) for t in group]
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in known]
        long: dict[str, int] = {}
        for call in byte_balanced(new):
            for p, n in zip(call, encode(call), strict=True):
                (known if len(p) <= KNOWN_BYTES else long)[p] = n
        out += [sum(known[p] if p in known else long[p] for p in pieces) for pieces in cut]
    return out


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``path`` is the tokenizer's file on the workers."""
    small_batches(docs.sparkSession)
    text_kind, id_kind = T.StringType(), docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_kind),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, "counted_text"):
            n = np.array(lengths(texts, path), dtype=np.int64)
            sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col), F.col(text_col).cast(text_kind).alias("counted_text")).mapInArrow(run, schema)
