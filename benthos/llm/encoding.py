"""Problem 6: the ids of every text under a public byte-level tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benthos.llm import bpe
from benthos.session import ship_code, spread

TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each text. A null and an empty text give an empty list; a null key is kept; repeated rows each
    give a row; other columns of df don't matter. One pass over the rows, no shuffle unless df has fewer partitions than there
    are task slots; each text is encoded whole."""
    ship_code(df.sparkSession)
    path = vocabulary(name, folder)
    source = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                encoded = [tokenizer.encode(t.as_py()) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int32)
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in encoded if len(x)] or [np.empty(0, np.int32)])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 2000), ids], names=["key", "ids"])

    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens): as encode, but only the number of ids leaves the Python process."""
    ship_code(df.sparkSession)
    path = vocabulary(name, folder)
    source = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        for batch in batches:
            sizes = pa.array([tokenizer.count(t.as_py()) for t in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["key", "n_tokens"])

    return source.mapInArrow(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the text of each list of ids, by the vocabulary's offset table. A null or empty list gives ''."""
    ship_code(df.sparkSession)
    path = vocabulary(name, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        for batch in batches:
            lists = batch.column(1)
            texts = pa.array([tokenizer.decode(x.values.to_numpy() if x.is_valid else []) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
