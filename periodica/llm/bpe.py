"""Byte-level BPE encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a batch lie one after another in one array of symbols. An index maps each rank that
is active (the rank of a pair of neighbours) to all positions of that pair. Ranks are applied in ascending
order: all occurrences of a pair merge in one vector step, left ones first where they overlap, and only the
lists of the pairs at the merged places' borders are extended. Entries that a merge has made stale are dropped
when their rank comes up. A pair that a merge creates always has a later rank than the merge, since its left or
right part didn't exist before.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import text_batches
from periodica.llm.tokens import BYTE_PATTERN, Grown, Numbered, byte_alphabet, byte_level_pieces, keep_first, ragged_gather

class Vocabulary:
    """What encoding and decoding need of a tokenizer file: byte symbols, merges as sorted pair keys, token bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order  # rank of a merge: its place in the file
        self.left, self.right, self.made = keys >> 32, keys & 0xFFFFFFFF, made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: i for i, c in enumerate(alphabet)}
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            try:
                self.token_bytes[i] = bytes(to_byte[c] for c in t)
            except KeyError:
                self.token_bytes[i] = t.encode()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where a pair doesn't merge or either side is no symbol (negative)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)


def _apart(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """From ascending occurrences of a pair of equal symbols, those that merge: every other one of a run of overlapping ones."""
    chosen, free = [], -1
    for p in pos.tolist():
        if p >= free:
            chosen.append(p)
            free = int(nxt[p]) + 1  # the pair's right symbol is taken
    return np.array(chosen, np.int64)


def merge_all(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Applies all merges to an array of symbols in which -1 separates pre-tokens (and stands at both ends); drops merged symbols."""
    n = len(sym)
    sym = sym.astype(np.int64)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(pos: np.ndarray) -> None:
        """Enters the pairs that start at these positions into the index."""
        r = v.rank_of(sym[pos], sym[nxt[pos]])
        ok = r >= 0
        pos, r = pos[ok], r[ok]
        if not len(pos):
            return
        if len(pos) == 1:
            groups = [(int(r[0]), pos)]
        else:
            order = np.argsort(r, kind="stable")
            r, pos = r[order], pos[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            groups = zip(r[np.concatenate(([0], cut))].tolist(), np.split(pos, cut), strict=True)
        for rank, where in groups:
            if rank in index:
                index[rank].append(where)
            else:
                index[rank] = [where]
                heapq.heappush(heap, rank)

    note(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        lists = index.pop(rank)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = int(v.left[rank]), int(v.right[rank])
        pos = pos[alive[pos] & (sym[pos] == a)]
        pos = pos[sym[nxt[pos]] == b]
        if a == b and len(pos) > 1:
            pos = _apart(np.sort(pos), nxt)
        if not len(pos):
            continue
        gone = nxt[pos]
        sym[pos] = v.made[rank]
        alive[gone] = False
        after = nxt[gone]
        nxt[pos] = after
        prv[after] = pos
        note(np.unique(np.concatenate((prv[pos], pos))))
    return sym[alive]


class PairIndexEncoder:
    """encode(texts) -> (flat ids, number of ids of each text); distinct pieces of text are encoded once for each worker."""

    def __init__(self, v: Vocabulary, most: int = 300_000):
        self.v, self.most = v, most
        self.cut = regex.compile(BYTE_PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.known = Numbered()
        self.flat, self.starts, self.sizes = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces: all their distinct pre-tokens in one pass of merge_all."""
        if not new:
            return
        tokens: dict[str, int] = {}
        cuts = [self.cut(x) for x in new]
        idx = np.fromiter((tokens.setdefault(t, len(tokens)) for c in cuts for t in c), np.int64)
        joined = b"".join(t.encode("utf-8") for t in tokens)
        sizes = np.fromiter((len(t.encode("utf-8")) for t in tokens), np.int64, len(tokens))
        sym = np.full(len(joined) + len(tokens) + 1, -1, np.int64)
        place = np.arange(len(joined)) + np.repeat(np.arange(1, len(tokens) + 1), sizes)
        sym[place] = self.v.byte_ids[np.frombuffer(joined, np.uint8)]
        merged = merge_all(self.v, sym)
        marks = np.flatnonzero(merged < 0)
        starts, lengths = marks[:-1] + 1, np.diff(marks) - 1
        per_piece = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = ragged_gather(merged, starts[idx], lengths[idx]).astype(np.uint32)
        ends = np.concatenate(([0], np.cumsum(lengths[idx])))[np.concatenate(([0], np.cumsum(per_piece)))]
        self.starts.extend(self.flat.n + ends[:-1])
        self.sizes.extend(np.diff(ends))
        self.flat.extend(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most:
            keep_first(self.known, self.flat, self.starts, self.sizes, self.most // 2)
        known, idx, counts = self.known, [], []
        for t in texts:
            if self.split and any(s in t for s in self.v.special):
                p = [x for part in self.split.split(t) if part for x in ([part] if part in self.v.special else self._pieces(part))]
            else:
                p = self._pieces(t)
            counts.append(len(p))
            idx.append(known.numbers(p))
        new, at = known.take_new(), 0
        for i in [*(i for i, x in enumerate(new) if x in self.v.special), len(new)]:
            self._learn(new[at:i])
            if i < len(new):
                self.starts.extend(np.array([self.flat.n]))
                self.sizes.extend(np.array([1]))
                self.flat.extend(np.array([self.v.special[new[i]]], np.uint32))
            at = i + 1
        idx = np.concatenate(idx) if idx else np.empty(0, np.int64)
        sizes = self.sizes.data[idx]
        flat = ragged_gather(self.flat.data, self.starts.data[idx], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return flat, np.diff(ends)

    def _pieces(self, t: str) -> list[str]:
        p = byte_level_pieces(t)
        return self.cut(t) if p is None else p


def decode_bytes(v: Vocabulary, ids) -> bytes:
    """The text of ids in UTF-8; bytes that aren't valid become U+FFFD. Special tokens appear as their strings."""
    raw = b"".join(map(v.token_bytes.__getitem__, ids))
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode("utf-8")


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        enc = PairIndexEncoder(v)
        for keys, texts in text_batches(batches, most=8_000_000):
            flat, n = enc.encode([t or "" for t in texts])
            ends = np.cumsum(n)
            sha, back = [], []
            for e, s in zip(ends, n, strict=True):
                ids = flat[e - s : e]
                sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(decode_bytes(v, ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PairIndexEncoder(Vocabulary(path))
        for keys, texts in text_batches(batches):
            flat, n = enc.encode([t or "" for t in texts])
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(path)
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else decode_bytes(v, i).decode() for i in ids], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int). Null and empty texts give an empty array; other columns are ignored; equal texts get equal ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give a null text."""
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(path), "doc_id long, text string")


def roundtrip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text without shipping ids between workers."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
