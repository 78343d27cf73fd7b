"""Small helpers shared by the corpus operators: shared work folders, sizes, crc folds, text words."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.stages import drop_stage, new_dir, write_stage

__all__ = ["ascii_lower", "crc_fold", "drop_stage", "likely_in", "new_dir", "release_memory", "table", "text_batches", "tidy", "trim_memory", "write_stage"]

#: Characters between words, as the contracts fix them: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Slots of the filter that likely_in builds, at least and at most; each is a bit of a constant in the plan, which
#: the driver keeps in many copies, so it must stay small.
FEWEST_SLOTS, MOST_SLOTS = 1 << 12, 1 << 19


def likely_in(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A condition that holds for every id in the table, and for few others while the table is small.

    A hashed bitmap of bounded size, whatever the number of ids, becomes a constant of the plan: rows that a join
    would drop anyway needn't be shuffled. With many ids the bitmap fills up and lets all rows through, which
    changes the work and never the result. Only the bitmap reaches the driver.
    """
    n = ids.count()
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (4 * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(slots))
    place = slot(F.col(column)) + 1  # bitmap buckets count from 1
    parts = ids.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    mask = np.zeros(max(slots, 32_768), np.uint8)
    for r in parts:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        mask[(r.b - 1) * len(bits) :][: len(bits)] = bits
    constant = F.lit(bytearray(np.packbits(mask[:slots], bitorder="little").tobytes()))

    def holds(c: Column) -> Column:
        byte = F.conv(F.hex(F.substring(constant, (F.shiftright(slot(c), 3) + 1).cast("int"), F.lit(1))), 16, 10)
        return F.getbit(byte.cast("int"), (slot(c) % 8).cast("int")) == 1

    return holds


def crc_fold(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    """A-Z only, as the contracts say; other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def release_memory() -> None:
    """Gives a Python worker's memory back to the system; workers live on between tasks of different operators.

    The tables of pieces that tokenizing tasks hand on to each other go too, since another operator runs now.
    """
    if (tokens := sys.modules.get("periodica.llm.tokens")) is not None:
        tokens.forget_encoders()
    gc.collect()
    trim_memory()


def trim_memory() -> None:
    """Gives what a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(run):
    """Wraps a function over batches so that it releases memory before it starts and when it ends."""

    def wrapped(batches):
        release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def text_batches(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", most: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """(keys, texts) in pieces of about `most` characters, so that a worker's memory doesn't follow the batch size."""
    for batch in batches:
        keys, texts = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text))
        ids, rows, size = [], [], 0
        for i in range(batch.num_rows):
            ids.append(keys[i].as_py())
            rows.append(t := texts[i].as_py())
            size += len(t or "")
            if size >= most:
                yield ids, rows
                ids, rows, size = [], [], 0
        if ids:
            yield ids, rows
