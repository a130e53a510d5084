"""Shared plumbing: the cluster's shared folder, written tables, tokenizing.

Intermediate tables that several stages read are written as Parquet under the folder
named by ``spark.checkpoint.dir``: executors can be lost afterwards without losing them.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where all runs on this machine and none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a file of a table whose size is known.
ROWS_A_FILE = 100_000


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    ``rows`` is the number of (short) rows at most, where it is known: small tables then
    make few files, and few tasks in the stage that writes them.
    """
    path = new_path(df.sparkSession, tag)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows of a batch for Python, unless the session sets them: texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


#: Bytes of a batch for Python, where rows can be large.
BATCH_BYTES = 4 << 20


def light_batches(spark: SparkSession) -> None:
    """Rows and bytes of a batch for Python, unless the session sets them: rows that hold many texts make batches of as much as a task reads else."""
    small_batches(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """What this worker's allocators hold without use goes back to the system: idle workers would keep it beside all later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (the fold rule of the fitted operators)."""
    return F.crc32(column.cast("string")) % modulus


def byte_letters() -> dict[int, int]:
    """What byte-level vocabularies write for bytes that aren't printable: letters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


class Pieces(dict):
    """Ids of white-space separated chunks, encoded on first use.

    The tokenizer drops white space and never joins text across it, so a text's ids are
    its chunks' ids in order. A chunk of Latin letters alone is one word to the tokenizer,
    and its model is asked for it directly; marks after it are a word of their own.
    Bounded: it is emptied when ``limit`` chunks are held.
    """

    #: Python's split() cuts at these four, the tokenizer doesn't take them for white space.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: Runs of these after a word are a word of their own.
    MARKS = ".,;:!?*#$%&|)(\"-"

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.letters = byte_letters()
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.split = self.tokenizer.model.tokenize

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, core: str) -> bytes:
        """Ids of a chunk of letters."""
        if core.isascii():
            written = low = core.lower()
        else:
            low = normalize("NFC", core).lower()
            if max(low) > "\u024f" or not low.isalpha():  # may be more than a word to the tokenizer
                return self.plain(core)
            written = low.encode().decode("latin-1").translate(self.letters)
        if low != core:
            return self[low]
        return array(self.code, [t.id for t in self.split(written)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64:
            return self.plain(chunk)
        if chunk.isalpha():
            ids = self.word(chunk)
        elif (core := chunk.rstrip(self.MARKS)).isalpha():
            ids = self[core] + self[chunk[len(core) :]]
        else:
            ids = self.plain(chunk)
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian integers of ``dtype``; null is empty."""
        if not text:
            return b""
        if any(c in text for c in self.ODD):
            return self.plain(text)
        return b"".join(map(self.__getitem__, text.split()))

    def encode_many(self, texts: Iterable[pa.StringScalar]) -> Iterator[bytes]:
        for text in texts:
            yield self.encode(text.as_py())


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One per Python worker and vocabulary file."""
    return Pieces(path)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
