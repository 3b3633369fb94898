"""Shared helpers of the corpus operators.

Conventions that hold in every operator of this package:

* a null text counts as an empty one, unless an operator says otherwise;
* a repeated row is scored on its own, so every input row has one output row;
* extra columns never take part: operators read the columns they name and
  return the columns they document;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the contracts: ASCII digits and letters, and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Bytes of text that a task turns into word lists at once.
CHUNK_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the session names; a temporary one only in local mode, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodegraph-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``files``: at most so many, for tables of a few rows.

    This cuts the lineage, so a lost executor costs no recomputation of what
    came before, and gives the planner true sizes: later joins broadcast the
    table only while it is below Spark's own size limit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER.decode(), _UPPER.lower().decode())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def hash64(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class WordHashes(dict):
    """A bounded memo of 64-bit word hashes."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = hash64(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8, about ``size`` bytes of text each; null is empty."""
    most = size
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        start, size = 0, 0
        for row, length in enumerate(np.diff(offsets).tolist(), 1):
            size += length
            if size >= most or row == batch.num_rows:
                yield batch.slice(start, row - start), [x or b"" for x in column.slice(start, row - start).to_pylist()]
                start, size = row, 0
