"""Best-fit packing of documents into sequences, by minimum bin slack.

Documents longer than a sequence are cut into full pieces and a rest; full pieces fill sequences of their own.
What remains is a histogram of lengths, of which there are fewer than `size` however many documents there are.
Minimum bin slack runs on that histogram: the longest remaining length opens a bin, and a subset-sum dynamic
program over the available lengths, whose states are the bits of one integer, finds the fullest feasible
filling. The combination is taken as often as the counts allow, so the plan is a short list of (combination,
repeats). Each piece then finds its place by its rank among the pieces of its length: no piece meets another.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import text_batches, write_stage
from periodica.llm.tokens import encoder_for

SIZE = 2048


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats) of a fullest feasible filling of `room`; longer lengths are preferred.

    Bit s of a state says that the sum s can be reached. Lengths come in falling order, each with as many
    copies as there are and fit; the states before each copy are kept to read the choice back.
    """
    mask = (1 << (room + 1)) - 1
    reach, trail, full = 1, [], 1 << room
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            nxt = (reach | (reach << length)) & mask
            if nxt == reach:
                break
            trail.append((length, reach))
            reach = nxt
            if reach & full:
                break
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not (before >> at) & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a bin in order, how many such bins) for all pieces of the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    if any(k > size for k in left):
        raise ValueError("a piece is longer than a sequence")
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        rest = fullest(left, size - first)
        left[first] += 1
        need = Counter([first, *rest])
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((sorted(need.elements(), reverse=True), times))
    return out


@dataclass
class Places:
    """For each length: rank -> (sequence, offset). Arrays of one entry for each (length, combination)."""

    length: np.ndarray
    first_rank: np.ndarray
    per_bin: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, bins: list[tuple[list[int], int]]) -> Places:
        rows, seen, at = [], Counter(), 0
        for lengths, times in bins:
            offset = 0
            for k, n in sorted(Counter(lengths).items(), reverse=True):
                rows.append((k, seen[k], n, at, offset))
                seen[k] += n * times
                offset += k * n
            at += times
        rows.sort()
        return cls(*(np.array(x, np.int64) for x in zip(*rows, strict=True))) if rows else cls(*(np.empty(0, np.int64) for _ in range(5)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # rows are ordered by (length, first_rank): the last one not after (length, rank)
        big = int(max(self.first_rank.max(initial=0), rank.max(initial=0))) + 1
        row = np.searchsorted(self.length * big + self.first_rank, length * big + rank, side="right") - 1
        within = rank - self.first_rank[row]
        return self.first_bin[row] + within // self.per_bin[row], self.offset[row] + within % self.per_bin[row] * length


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(path, "word")
        for ids, texts in text_batches(batches):
            flat, n = enc.encode([t or "" for t in texts])
            ends = np.cumsum(n)
            doc, piece, start, length, crc = [], [], [], [], []
            for i, key in enumerate(ids):
                tokens = np.append(flat[ends[i] - n[i] : ends[i]], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(tokens), size)):
                    part = tokens[at : at + size]
                    doc.append(key), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def cut_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most `size` ids; each document ends with end_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(_cut(tokenizer, size, end_id), _PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, pieces_per_group: int = 50_000) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    docs needs doc_id (unique) and text; other columns are ignored. Null and empty texts are one end id. Pieces of
    equal length are interchangeable: they are ranked by (group, doc_id, piece), where a group is a slice of the
    hash of doc_id, so that ranking a very common length is spread over many tasks. Rows without doc_id are left out, repeated rows are packed each, and an empty table
    gives no rows.
    """
    pieces = write_stage(cut_documents(docs, tokenizer, size, end_id), "pack-pieces")
    groups = max(16, pieces.count() // pieces_per_group)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    per_group = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_group.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = Places.of(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    per_group = per_group.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(per_group, ["length", "group"]).withColumn("rank", (F.col("local") + F.col("before")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(places), _PIECES + ", sequence_id long, offset long")
