"""Texts in blocks: one row holds the packed texts of some neighbouring rows of a partition.

Operators that must bring a corpus-wide answer back to the places of a text work on such blocks: a block
sends each distinct name once to the shard of that name, the shard answers with one entry per name of the
block, and the answers meet the block's row again. Only packed columns are shuffled, a name that a third
of all rows share costs one entry per block, and no task holds more than a block or a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.words import pack, session_limits, squeeze, unpack, unsqueeze
from foldwise.session import checkpoint_folder

BLOCK_BYTES = 12 << 20
TEXTS = "ids binary, known binary, sizes binary, texts binary, rest binary"


@dataclass
class Rows:
    """Consecutive rows: ids (0 where unknown), texts as bytes (null: size -1) and the other columns as JSON."""

    ids: np.ndarray
    known: np.ndarray
    texts: list
    rest: list

    def packed(self) -> dict:
        sizes = np.array([-1 if t is None else len(t) for t in self.texts], np.int64)
        rest = [x or b"" for x in self.rest]
        return {
            "ids": pack(self.ids),
            "known": pack(self.known.astype(np.uint8)),
            "sizes": pack(sizes),
            "texts": squeeze(b"".join(t or b"" for t in self.texts)),
            "rest": squeeze(b"\n".join(rest)),
        }

    @staticmethod
    def of(row: dict) -> Rows:
        sizes, data = unpack(row["sizes"]), unsqueeze(row["texts"])
        stop = np.cumsum(np.maximum(sizes, 0)).tolist()
        texts = [None if n < 0 else data[e - n : e] for n, e in zip(sizes.tolist(), stop)]
        return Rows(unpack(row["ids"]), unpack(row["known"]).astype(bool), texts, unsqueeze(row["rest"]).split(b"\n"))


def source(docs: DataFrame, id_col: str, text_col: str, rest: list[Column] = ()) -> DataFrame:
    """The columns that blocks are made of; ``rest`` travels as one JSON string."""
    session_limits(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        (F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")).cast("binary").alias("rest"),
    )


def read_blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Rows]]:
    """(block number, rows) from the columns of ``source``; a text beyond ``limit`` ends its block."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    ids, known, texts, rest, size = [], [], [], [], 0
    for batch in batches:
        column = batch.column(0)
        parts = (pc.fill_null(column, 0).to_pylist(), column.is_valid().to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for i, k, t, r in zip(*parts):
            ids.append(i), known.append(k), texts.append(t), rest.append(r)
            size += len(t or b"") + 64
            if size >= limit:
                yield number, Rows(np.array(ids, np.int64), np.array(known, bool), texts, rest)
                ids, known, texts, rest, size = [], [], [], [], 0
                number += 1
    if ids:
        yield number, Rows(np.array(ids, np.int64), np.array(known, bool), texts, rest)


def record(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def shard_count(total: int, each: int = 2_000_000) -> int:
    """Shards of about ``each`` entries; at least 64, so that cores have work."""
    return max(64, -(-int(total or 0) // each))


def write_table(df: DataFrame, name: str) -> str:
    """Write an intermediate table below the shared folder; the caller drops it when it is used up."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    return path


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
