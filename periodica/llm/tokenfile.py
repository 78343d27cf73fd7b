"""Token ids in binary files that one document can be read from.

A zstandard dictionary is trained on serialised id arrays of a bounded sample and shared by all files. Each
document is compressed on its own with it. A file is: magic, format version, id width and the dictionary's
SHA-256; then the documents' frames; then an index of (doc_id, offset, size, ids) and a footer that says where
the index starts. The dictionary lies beside the files under the name of its hash, and a reader refuses a file
whose hash it isn't. So one short document costs an index lookup and one range read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import new_dir, text_batches, trim_memory, write_stage
from periodica.llm.shared_files import new_file, open_file
from periodica.llm.tokens import encoder_for, forget_encoders

MAGIC, VERSION = b"PTOK", 1
HEAD = "<4sHH32s"
FOOT = "<QQ4s"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])
#: The dictionary's size, and the documents that it is trained on at most, with so many characters from a place of each.
DICT_BYTES, DICT_DOCS, DICT_CHARS, LEVEL = 64 << 10, 1000, 8192, 3


def width_of(vocabulary: int) -> int:
    """Bytes of an id: 2 where the vocabulary allows, else 4."""
    return 2 if vocabulary <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, sample_docs: int = DICT_DOCS) -> bytes:
    """A dictionary from about sample_docs documents by hash of doc_id; empty bytes where the sample is too small to train on.

    A long document takes part with DICT_CHARS characters from a place that its hash gives, so the sample's size is bounded.
    """
    n = docs.count()
    step = max(1, n // sample_docs)
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - DICT_CHARS, F.lit(1))) + 1
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.substring("text", place.cast("int"), F.lit(DICT_CHARS)).alias("text")).limit(sample_docs).collect()
    enc = encoder_for(tokenizer, "byte")
    flat, sizes = enc.encode([r.text or "" for r in rows])
    ends = np.cumsum(sizes)
    samples = [flat[e - s : e].astype(f"<u{width}").tobytes() for e, s in zip(ends, sizes, strict=True) if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Codec:
    """Compresses and decompresses one document's ids with the shared dictionary."""

    def __init__(self, dictionary: bytes, width: int):
        self.width, self.hash = width, hashlib.sha256(dictionary).digest()
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=LEVEL)  # else each document would digest the dictionary anew
        more = {"dict_data": d} if d else {}
        self._c = zstandard.ZstdCompressor(level=LEVEL, **more)
        self._d = zstandard.ZstdDecompressor(**more)

    def pack(self, ids: np.ndarray) -> bytes:
        return self._c.compress(ids.astype(f"<u{self.width}").tobytes())

    def unpack(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._d.decompress(frame), f"<u{self.width}").astype(np.uint32)


class Reader:
    """Random access to one file."""

    def __init__(self, folder: str, name: str, codec: Codec):
        self.f, self.codec = open_file(folder, name), codec
        magic, version, width, digest = struct.unpack(HEAD, self.f.read_at(struct.calcsize(HEAD), 0))
        if (magic, version, width) != (MAGIC, VERSION, codec.width):
            raise ValueError(f"{name} isn't a token file of this version and id width")
        if digest != codec.hash:
            raise ValueError(f"{name} was written with another dictionary")
        size = self.f.size()
        at, rows, magic = struct.unpack(FOOT, self.f.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
        if magic != MAGIC:
            raise ValueError(f"{name} is cut short")
        self.index = np.frombuffer(self.f.read_at(rows * INDEX.itemsize, at), INDEX)

    def at(self, row: int) -> np.ndarray:
        r = self.index[row]
        return self.codec.unpack(self.f.read_at(int(r["size"]), int(r["offset"])))

    def get(self, doc_id: int) -> np.ndarray:
        """The ids of one document."""
        row = int(np.searchsorted(self.index["doc_id"], doc_id))
        if row == len(self.index) or self.index["doc_id"][row] != doc_id:
            raise KeyError(doc_id)
        return self.at(row)

    def close(self) -> None:
        self.f.close()


def _write(tokenizer: str, folder: str, dictionary: bytes, width: int, end_id: int):
    """Rows come ordered by doc_id, a range of them to a task; each task writes one file, and reports it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, codec = encoder_for(tokenizer, "byte"), Codec(dictionary, width)
        slot, head = TaskContext.get().partitionId(), struct.pack(HEAD, MAGIC, VERSION, width, codec.hash)
        parts = text_batches(batches, most=2_000_000)
        part = next(parts, None)
        if part is None:
            return
        index, at, total = [], len(head), 0
        with new_file(folder, f"ids-{slot:06d}") as (out, name):
            out.write(head)
            while part:
                ids, texts = part
                flat, n = enc.encode([t or "" for t in texts])
                for d, e, s in zip(ids, np.cumsum(n).tolist(), n.tolist(), strict=True):
                    out.write(frame := codec.pack(np.append(flat[e - s : e], np.uint32(end_id))))
                    index.append((d, at, len(frame), s + 1))
                    at += len(frame)
                    total += s + 1
                part = next(parts, None)
            out.write(np.array(index, INDEX).tobytes())
            out.write(struct.pack(FOOT, at, len(index), MAGIC))
        del part, parts, flat, texts, ids, n
        trim_memory()  # workers live on, and an executor may have more of them than tasks
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([total], pa.int64())], names=["slot", "name", "docs", "ids"])

    return run


def _read(folder: str, dictionary: bytes, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()  # all is written by now
        trim_memory()
        codec = Codec(dictionary, width)
        for b in batches:
            for name, before in zip(b.column("name").to_pylist(), b.column("before").to_pylist(), strict=True):
                reader = Reader(folder, name, codec)
                doc, start, n, crc = [], [], [], []
                for i in range(len(reader.index)):
                    ids = reader.at(i)
                    doc.append(int(reader.index["doc_id"][i])), start.append(before), n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    before += len(ids)
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, vocabulary: int, end_id: int = 0, rows_per_file: int = 8192) -> tuple[DataFrame, bytes]:
    """(manifest, dictionary): writes ids in ascending doc_id order; manifest: slot, name, docs, ids of each file.

    Files follow each other by slot, and rows within a file by doc_id. Slots are range partitions of doc_id with about
    rows_per_file documents each; a task encodes and writes its range, so ids themselves are never shuffled. docs
    needs doc_id (unique, not null) and text; null text is empty, so a document has its end id at least. Rows without
    doc_id are left out, repeated rows are written each, and an empty table writes no file.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    width = width_of(vocabulary)
    dictionary = train_dictionary(docs, tokenizer, width)
    with new_file(folder, "dictionary-" + hashlib.sha256(dictionary).hexdigest()) as (out, _):
        out.write(dictionary)
    slots = max(1, -(-docs.count() // rows_per_file))
    ordered = docs.repartitionByRange(slots, "doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(_write(tokenizer, folder, dictionary, width, end_id), "slot long, name string, docs long, ids long")
    return write_stage(files, "token-files"), dictionary


#: Files of a group, whose ids are added up before the groups are; and files that a reading task gets, on average, where there are many.
GROUP_FILES, TASK_FILES = 1024, 4


def file_offsets(manifest: DataFrame) -> DataFrame:
    """slot, name, before: the ids in all files before each. Files add up within groups, and only the groups' sums in one task."""
    m = manifest.select("slot", "name", "ids", F.floor(F.col("slot") / GROUP_FILES).alias("g"))
    sums = m.groupBy("g").agg(F.sum("ids").alias("s"))
    sums = sums.select("g", F.coalesce(F.sum("s").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("own", own).join(sums, "g").select("slot", "name", (F.col("own") + F.col("groups")).cast("long").alias("before"))


def read_token_files(manifest: DataFrame, dictionary: bytes, folder: str, vocabulary: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    files = manifest.count()
    tasks = max(1, -(-files // TASK_FILES), min(files, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = file_offsets(manifest).repartition(tasks, "slot")  # a number of its own, so that small rows aren't gathered in one task
    return dealt.select("name", "before").mapInArrow(_read(folder, dictionary, width_of(vocabulary)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def roundtrip(spark: SparkSession, docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0) -> DataFrame:
    """Write token files to the shared folder and read them back; rows as write_token_files takes them."""
    folder = new_dir(spark, "token-files")
    manifest, dictionary = write_token_files(docs, tokenizer, folder, vocabulary, end_id)
    return read_token_files(manifest, dictionary, folder, vocabulary)
