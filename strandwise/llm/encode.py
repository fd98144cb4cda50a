"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Transducer, decode, load_ranks

#: Where the public tokenizers' files are; a parameter of every function.
TOKENIZERS = "/opt/tokenizers"


#: The tokenizers whose texts are split by PIECES before merging; others have rules of their own.
NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")


@lru_cache(maxsize=2)
def transducer(folder: str, name: str) -> Transducer:
    """One transducer for each worker process; its tables fill as texts come."""
    return Transducer(load_ranks(f"{folder}/{name}.tiktoken"))


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts one at a time, so that a batch of long texts isn't held twice; null is empty."""
    for value in column:
        yield value.as_py() or ""


def _encode(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(folder, name)
        for b in batches:
            parts, ends, total = [], [0], 0
            for text in _texts(b.column(1)):
                ids = np.array(t.encode(text), np.int32)
                parts.append(ids)
                total += len(ids)
                ends.append(total)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _count(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.count(x) for x in _texts(b.column(1))], pa.int32())], names=["doc_id", "n_tokens"])

    return run


def _same(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(folder, name)
        for b in batches:
            texts = list(_texts(b.column(1)))
            ids = [t.encode(x) for x in texts]
            same = ["".join(decode(i, t.spelling)) == x for i, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int32()), pa.array(same)], names=["doc_id", "n_tokens", "same"])

    return run


def _two(documents: DataFrame, name: str, id_col: str, text: str) -> tuple[DataFrame, str]:
    if name not in NAMES:
        raise ValueError(f"{name} isn't one of {', '.join(NAMES)}")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, without special tokens.

    Every row keeps its row; empty and null texts have an empty list.  Rows are
    independent, so there is no shuffle.  The vocabulary is read in the workers
    from ``folder``/``name``.tiktoken.
    """
    rows, kind = _two(documents, name, id_col, text)
    return rows.mapInArrow(_encode(folder, name), f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``; 0 for empty and null texts."""
    rows, kind = _two(documents, name, id_col, text)
    return rows.mapInArrow(_count(folder, name), f"doc_id {kind}, n_tokens int")


def round_trips(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, same``: whether decoding the ids as a stream gives the text back (null as empty)."""
    rows, kind = _two(documents, name, id_col, text)
    return rows.mapInArrow(_same(folder, name), f"doc_id {kind}, n_tokens int, same boolean")
