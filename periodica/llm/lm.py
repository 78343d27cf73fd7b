"""Scoring texts with a language model smoothed by deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates: bigram, unigram and uniform. Mixture
weights depend on the frequency bucket of the context, and are learned by expectation-maximisation on deleted
counts: each training occurrence is scored with itself left out of all counts.

The weights are learned on a histogram: occurrences whose context falls in one bucket and whose estimates fall in
the same half-octave bins are taken together, with the mean of their estimates. That makes its size fixed, whatever
the corpus; the estimates that a text is scored with are exact.

Counts cover the whole corpus and never come together in one place. Documents are cut into chunks of bounded size.
A chunk sends its distinct n-grams, as sorted 64-bit hashes with its training counts, up a tree: a node of a level
merges the lists that a group of the nodes below has for one range of hashes, and sends the merged list on, cut into
smaller ranges, to fewer groups. At the top one node for each range adds up the whole corpus. Totals go the same way
down, to those who asked. Each chunk then holds all counts that its texts need. A node gets as many rows as it has
nodes below, FAN at most, and about as many keys as a chunk has, so rows grow with the chunks times the levels, one
level for each power of FAN. A key is sent once by a chunk however often it occurs there, so very frequent words and
word pairs weigh no more than others. What reaches the driver is the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import drop_stage, text_batches, tidy, write_stage
from periodica.llm.shingles import mix

#: Characters of text in a chunk, and nodes that a node of the tree has below it, at most.
CHUNK_CHARS, FAN = 10_000_000, 256
#: Context buckets: 0 for contexts never seen, else 1 + floor(log2(count)), this many at most.
BUCKETS = 20
#: Half-octave bins of an estimate in the histogram; bin 0 is the estimate 0.
BINS = 64
END_HASH, START_HASH = 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B


def pack(a: np.ndarray) -> bytes:
    """An integer array, by byte planes, so that small numbers cost little."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return bytes([a.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) ^ mix(right + np.uint64(0xD6E8FEB86659FD93)))


@dataclass
class Chunk:
    """Tokens of some documents. words: sorted hashes of the distinct ones; tokens: places in words."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    train: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    def contexts(self) -> np.ndarray:
        """Place in words of each token's predecessor; -1 at the start of a document."""
        out = np.empty(len(self.tokens), np.int64)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.lengths) - self.lengths] = -1
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes of the distinct bigrams, place of each token's bigram in them)."""
        ctx = self.contexts()
        left = np.where(ctx >= 0, self.words[ctx], np.uint64(START_HASH))
        return np.unique(pair_hash(left, self.words[self.tokens]), return_inverse=True)

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0

    def begin():
        return {b"\n": 0}, [], [], [], 0  # a word has no line feed, so the end token has a place of its own

    def row() -> pa.RecordBatch:
        nonlocal made
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
        h[0] = END_HASH
        words, place = np.unique(h, return_inverse=True)
        c = Chunk(np.array(ids, np.int64), np.array([len(t) for t in toks], np.int64), np.array(train, bool), words, place[np.concatenate(toks)])
        out = pa.RecordBatch.from_arrays([
            pa.array([part << 24 | made], pa.int64()), pa.array([int(c.lengths[c.train].sum())], pa.int64()),
            pa.array([c.doc_ids.tobytes()], pa.binary()), pa.array([pack(c.lengths)], pa.binary()), pa.array([c.train.tobytes()], pa.binary()),
            pa.array([pack_sorted(c.words)], pa.binary()), pa.array([pack(c.tokens.astype(np.uint32))], pa.binary()),
        ], names=["chunk", "train_tokens", "doc_ids", "lengths", "train", "words", "tokens"])
        made += 1
        return out

    known, ids, toks, train, size = begin()
    for batch in batches:
        flags = batch.column("train").to_pylist()
        at = 0
        for keys, texts in text_batches(iter([batch])):
            for key, t in zip(keys, texts, strict=True):
                w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
                try:
                    found = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                except KeyError:
                    for x in w:
                        if x not in known:
                            known[x] = len(known)
                    found = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                ids.append(key), train.append(bool(flags[at])), toks.append(np.append(found, 0))
                at += 1
                size += len(t or "") + 1
                if size >= CHUNK_CHARS:
                    yield row()
                    known, ids, toks, train, size = begin()
    if ids:
        yield row()


_CHUNKS = "chunk long, train_tokens long, doc_ids binary, lengths binary, train binary, words binary, tokens binary"


def _chunk_of(batch, i: int = 0) -> Chunk:
    get = lambda c: batch.column(c)[i].as_py()
    return Chunk(np.frombuffer(get("doc_ids"), np.int64), unpack(get("lengths"), np.int64), np.frombuffer(get("train"), bool), unpack_sorted(get("words")), unpack(get("tokens"), np.uint32).astype(np.int64))


@dataclass(frozen=True)
class Tree:
    """`levels` of nodes over chunks: a node of level l is one of fan**(levels - l) groups and one of fan**l ranges of hashes."""

    levels: int
    fan: int

    @classmethod
    def over(cls, chunks: int, most: int) -> Tree:
        levels = 1
        while most**levels < chunks:
            levels += 1
        fan = 1
        while fan**levels < chunks:
            fan += 1
        return cls(levels, fan)

    def group_of(self, chunk: int) -> int:
        """The group of a chunk at level 1, by its hash."""
        h = int(mix(np.array([chunk], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0])
        return h * self.fan ** (self.levels - 1) >> 64

    def cuts(self, keys: np.ndarray, level: int, first: int) -> np.ndarray:
        """Where the ranges first, ..., first + fan - 1 of a level begin in sorted keys of theirs, and where the last ends."""
        n = self.fan**level
        bounds = np.array([-(-(i << 64) // n) for i in range(first + 1, first + self.fan)], np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


_ASKED = "node long, child long, words binary, words_n binary, pairs binary, pairs_n binary, starts long"
_ANSWERS = "child long, part long, words_n binary, pairs_n binary, vocabulary long, starts long"


def _sent(tree: Tree, level: int, group: int, first: int, child: int, words, words_n, pairs, pairs_n, starts: int) -> Iterator[list]:
    """Rows to the nodes of `level` in `group`: the keys of each range from `first` on, but for empty ones. starts goes with the first row."""
    wc, pc = tree.cuts(words, level, first), tree.cuts(pairs, level, first)
    for i in range(tree.fan):
        w, p = slice(wc[i], wc[i + 1]), slice(pc[i], pc[i + 1])
        if w.stop > w.start or p.stop > p.start:
            yield [group * tree.fan**level + first + i, child, pack_sorted(words[w]), pack(words_n[w]), pack_sorted(pairs[p]), pack(pairs_n[p]), starts]
            starts = 0


def _asked_batch(rows: list[list]) -> dict:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return {c.split()[0]: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(_ASKED.split(", "), kinds, strict=True))}


def _ask(tree: Tree):
    """What each chunk sends to the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, chunk = _chunk_of(b, i), b.column("chunk")[i].as_py()
                train = c.in_training()
                pairs, which = c.pairs()
                words_n = np.bincount(c.tokens[train], minlength=len(c.words)).astype(np.uint64)
                pairs_n = np.bincount(which[train], minlength=len(pairs)).astype(np.uint64)
                for row in _sent(tree, 1, tree.group_of(chunk), 0, chunk, c.words, words_n, pairs, pairs_n, int(c.train.sum())):
                    yield pa.RecordBatch.from_pydict(_asked_batch([row]))

    return run


def _merged(t: pa.Table, kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each child, all of them sorted, their total counts)."""
    lists = [unpack_sorted(x) for x in t.column(kind).to_pylist()]
    counts = np.concatenate([unpack(x, np.uint64) for x in t.column(f"{kind}_n").to_pylist()])
    keys, inv = np.unique(np.concatenate(lists), return_inverse=True)
    order = np.argsort(inv, kind="stable")
    total = np.add.reduceat(counts[order], np.searchsorted(inv[order], np.arange(len(keys)))) if len(keys) else np.empty(0, np.uint64)
    return lists, keys, total


def _up(tree: Tree, level: int):
    """A node of `level` sends its children's merged keys to the next."""

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node")[0].as_py()
        group, here = divmod(node, tree.fan**level)
        (_, words, words_n), (_, pairs, pairs_n) = _merged(t, "words"), _merged(t, "pairs")
        return pa.table(_asked_batch(list(_sent(tree, level + 1, group // tree.fan, here * tree.fan, node, words, words_n, pairs, pairs_n, sum(t.column("starts").to_pylist())))))

    return run


def _answers(t: pa.Table, part: int, lists: dict, keys: dict, totals: dict, vocabulary: int | None = None) -> pa.Table:
    """To each child its own keys' totals; with a vocabulary, a row of its own (child -1) for that and for how many documents begin."""
    of = lambda kind, i: pack(totals[kind][np.searchsorted(keys[kind], lists[kind][i])])
    rows = [[c, part, of("words", i), of("pairs", i), 0, 0] for i, c in enumerate(t.column("child").to_pylist())]
    if vocabulary is not None:
        rows.append([-1, part, b"", b"", vocabulary, sum(t.column("starts").to_pylist())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(_ANSWERS.split(", "), kinds, strict=True))})


def _top(tree: Tree):
    """A node of the last level has the counts of the whole corpus for its range."""

    def run(t: pa.Table) -> pa.Table:
        found = {k: _merged(t, k) for k in ("words", "pairs")}
        lists, keys, totals = ({k: f[i] for k, f in found.items()} for i in range(3))
        return _answers(t, t.column("node")[0].as_py() % tree.fan**tree.levels, lists, keys, totals, int(np.count_nonzero(totals["words"])))

    return run


def _in_order(t: pa.Table, kind: str) -> np.ndarray:
    order = np.argsort(t.column("part").to_numpy())
    return np.concatenate([unpack(t.column(kind)[int(i)].as_py(), np.uint64) for i in order])


def _down(tree: Tree, level: int):
    """A node of `level` gets the totals of its merged keys, range by range, and hands them to its children."""

    def run(asked: pa.Table, got: pa.Table) -> pa.Table:
        lists = {k: [unpack_sorted(x) for x in asked.column(k).to_pylist()] for k in ("words", "pairs")}
        keys = {k: np.unique(np.concatenate(v)) for k, v in lists.items()}
        totals = {k: _in_order(got, f"{k}_n") for k in keys}
        return _answers(asked, asked.column("node")[0].as_py() % tree.fan**level, lists, keys, totals)

    return run


def _counted(chunks: DataFrame, tree: Tree) -> tuple[DataFrame, int, int, list[DataFrame]]:
    """(answers to the chunks, size of the vocabulary, documents that begin in training, tables to drop at the end)."""
    asked = [write_stage(chunks.mapInArrow(tidy(_ask(tree)), _ASKED), "lm-asked")] if tree.levels > 1 else [chunks.mapInArrow(tidy(_ask(tree)), _ASKED)]
    for level in range(1, tree.levels):
        up = asked[-1].groupBy("node").applyInArrow(_up(tree, level), _ASKED)
        asked.append(write_stage(up, "lm-asked") if level + 1 < tree.levels else up)
    answers = write_stage(asked[-1].groupBy("node").applyInArrow(_top(tree), _ANSWERS), "lm-counts")
    about = answers.where("child = -1").agg(F.sum("vocabulary").alias("v"), F.sum("starts").alias("s")).first()
    stages = [*asked[:-1], answers]
    answers = answers.where("child >= 0")
    for level in range(tree.levels - 1, 0, -1):
        nodes = asked[level - 1].groupBy("node").cogroup(answers.groupBy("child"))
        stages.append(write_stage(nodes.applyInArrow(_down(tree, level), _ANSWERS), "lm-counts"))
        answers = stages[-1]
    return answers, int(about.v or 0), int(about.s or 0), stages


_JOINED = "chunk long, doc_ids binary, lengths binary, train binary, tokens binary, words_n binary, pairs_n binary"


def _join(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's tokens with the counts of its words and, token by token, of its bigrams."""
    names = [x.split()[0] for x in _JOINED.split(", ")]
    if not left.num_rows:
        return pa.table({n: pa.array([], pa.int64() if n == "chunk" else pa.binary()) for n in names})
    c = _chunk_of(left)
    _, which = c.pairs()
    get = lambda n: left.column(n)[0].as_py()
    return pa.table({n: pa.array([v], pa.int64() if n == "chunk" else pa.binary()) for n, v in zip(names, [get("chunk"), get("doc_ids"), get("lengths"), get("train"), get("tokens"), pack(_in_order(right, "words_n")), pack(_in_order(right, "pairs_n")[which])], strict=True)})


def _counts(b: pa.RecordBatch, i: int, starts: int):
    """(doc_ids, lengths, train, count of each token, of its context, of its bigram)."""
    get = lambda c: b.column(c)[i].as_py()
    lengths, tokens, words_n = unpack(get("lengths"), np.int64), unpack(get("tokens"), np.uint32), unpack(get("words_n"), np.uint64).astype(np.float64)
    own = words_n[tokens]
    ctx = np.empty_like(own)
    ctx[1:] = own[:-1]
    ctx[np.cumsum(lengths) - lengths] = starts
    return np.frombuffer(get("doc_ids"), np.int64), lengths, np.frombuffer(get("train"), bool), own, ctx, unpack(get("pairs_n"), np.uint64).astype(np.float64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Frequency bucket of context counts."""
    _, e = np.frexp(context)  # 2**(e-1) <= context < 2**e
    return np.where(context > 0, np.minimum(e, BUCKETS - 1), 0).astype(np.int64)


def estimates(own, ctx, pair, tokens: int):
    """Bigram and unigram maximum-likelihood estimates."""
    return np.divide(pair, ctx, out=np.zeros_like(pair), where=ctx > 0), own / max(tokens, 1)


def _bin(p: np.ndarray) -> np.ndarray:
    safe = np.where(p > 0, p, 1.0)
    return np.where(p > 0, np.clip(BINS - 1 + np.floor(2 * np.log2(safe)), 1, BINS - 1), 0).astype(np.int64)


def _histogram(starts: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS * BINS * BINS))
        for b in batches:
            for i in range(b.num_rows):
                _, lengths, train, own, ctx, pair = _counts(b, i, starts)
                use = np.repeat(train, lengths)
                # the occurrence itself is left out of every count
                own, ctx, pair = own[use] - 1, ctx[use] - 1, pair[use] - 1
                p2, p1 = estimates(own, ctx, pair, tokens - 1)
                cell = (bucket_of(ctx) * BINS + _bin(p2)) * BINS + _bin(p1)
                for k, w in enumerate((None, p2, p1)):
                    total[k] += np.bincount(cell, w, minlength=total.shape[1])
        cells = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(total[k][cells]) for k in range(3))], names=["cell", "n", "p2", "p1"])

    return run


def mixture(cells: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, rounds: int = 50) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform by expectation-maximisation. A bucket without counts takes those of the nearest one with counts."""
    p = np.stack([p2, p1, np.full_like(p1, p0)], axis=1)
    bucket = cells // (BINS * BINS)
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0.0, 0.5, 0.5)
    seen = []
    for k in range(BUCKETS):
        own = bucket == k
        if not n[own].sum():
            continue
        seen.append(k)
        for _ in range(rounds):
            share = p[own] * out[k]
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            out[k] = (share * n[own, None]).sum(axis=0) / n[own].sum()
        out[k] = np.maximum(out[k], (0.0 if k == 0 else 1e-6, 1e-6, 1e-6))  # no text gets probability 0
        out[k] /= out[k].sum()
    for k in range(1, BUCKETS):
        if k not in seen and (near := [j for j in seen if j > 0]):
            out[k] = out[min(near, key=lambda j: abs(j - k))]
    return out


def _score(starts: int, tokens: int, vocabulary: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, lengths, _, own, ctx, pair = _counts(b, i, starts)
                p2, p1 = estimates(own, ctx, pair, tokens)
                w = weights[bucket_of(ctx)]
                logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1))
                base = np.log10((own + 1) / (tokens + vocabulary + 1))
                at = np.cumsum(lengths) - lengths
                known = np.add.reduceat((own > 0).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document, learning from those where `train` holds.

    docs needs doc_id (not null) and text; other columns are ignored. Only A-Z are lower-cased; words are split
    at space and U+0009 to U+000D, and one end token follows. Null and empty texts are the end token alone.
    Repeated rows are scored, and counted, each. Without training documents every token has the uniform
    estimate. Rows without doc_id are left out. An empty table gives an empty result.
    """
    chunks = write_stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train")).where("doc_id is not null").mapInArrow(tidy(_chunks), _CHUNKS), "lm-chunks")
    totals = chunks.agg(F.count("*").alias("chunks"), F.sum("train_tokens").alias("tokens")).first()
    tokens = int(totals.tokens or 0)
    body = chunks.select("chunk", "doc_ids", "lengths", "train", "words", "tokens")
    answers, vocabulary, starts, stages = _counted(body, Tree.over(totals.chunks, FAN))
    joined = body.groupBy("chunk").cogroup(answers.select(F.col("child").alias("chunk"), "part", "words_n", "pairs_n").groupBy("chunk")).applyInArrow(_join, _JOINED)
    joined = write_stage(joined, "lm-joined")
    for stage in (chunks, *stages):
        drop_stage(stage)
    seen = joined.mapInArrow(_histogram(starts, tokens), "cell long, n double, p2 double, p1 double")
    rows = seen.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").collect()  # BUCKETS * BINS * BINS cells at most
    cells, n, p2, p1 = (np.array([r[i] for r in rows], np.int64 if i == 0 else np.float64) for i in range(4))
    weights = mixture(cells, n, p2 / np.maximum(n, 1), p1 / np.maximum(n, 1), 1.0 / (vocabulary + 1))
    return joined.mapInArrow(_score(starts, tokens, vocabulary, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double").withColumn("train_tokens", F.lit(tokens).cast("long"))
