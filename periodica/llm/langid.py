"""Language identification by a linear-chain conditional random field over the words of a text.

Every word has a language as its hidden label. Emissions are log-linear in hashed features: all character
n-grams of the padded word, its prefixes and suffixes of four and five letters, and a lexicon entry for the whole
word. Transitions between labels are learned weights. Both are trained by gradient ascent on the conditional
likelihood: observed less expected features and label pairs, with word and pair marginals from forward-backward.
Training sequences mix stretches of different languages, as code-switched text does. A document's language is
the one with the highest mean posterior over its words, and that mean is the score.

The model is fitted on a bounded sample of labelled rows: pieces of up to PIECE_CHARS characters, cut anywhere
in the whole texts of at most DOCS_PER_LANG documents of each language, PIECES_PER_LANG of them at most. Any
number of languages is learned; a language costs 256 kB of the model.

Texts are labelled whole: forward-backward runs over the full word sequence of each document, in batches whose
documents step forward together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import text_batches, tidy
from periodica.llm.tokens import ragged_gather

#: Bounds of the training sample for each language, which has no other: documents, pieces of their texts, characters of a piece.
DOCS_PER_LANG, PIECES_PER_LANG, PIECE_CHARS = 150, 700, 400
#: Letters of the longest prefixes and suffixes; shorter ones than four are n-grams that touch the word's boundary.
AFFIXES = (4, 5)
BUCKETS = 1 << 16
SEGMENT = 48
WORD = regex.compile(r"\p{L}+")
UNDETERMINED = "und"

_P = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def features(words: list[str]) -> np.ndarray:
    """(len(words), n) feature buckets; BUCKETS stands for no feature. All words must have like lengths (see by_length)."""
    width = max(map(len, words))
    c = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    lengths = (c != 0).sum(axis=1)
    padded = np.zeros((len(words), width + 2), np.uint32)
    padded[:, 0] = 1
    padded[:, 1 : width + 1] = c
    padded[np.arange(len(words)), lengths + 1] = 2
    out = []
    for n in (1, 2, 3, 4):
        m = width + 3 - n
        if m <= 0:
            continue
        h = np.full((len(words), m), n * 0x01000193 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ padded[:, k : k + m]) * _P[k]
            h ^= h >> np.uint32(13)
        ids = _finish(h)
        ids[(np.arange(m) + n)[None, :] > (lengths + 2)[:, None]] = BUCKETS
        out.append(ids)
    # prefixes and suffixes, beyond those that the n-grams at the boundary give
    for n in AFFIXES:
        for kind, at in ((0x51ED270B, np.zeros(len(words), np.int64)), (0x2545F491, lengths - n)):
            h = np.full(len(words), kind + n, np.uint32)
            for k in range(n):
                h = (h ^ np.take_along_axis(c, np.clip(at + k, 0, width - 1)[:, None], 1)[:, 0]) * _P[k % 5]
                h ^= h >> np.uint32(13)
            out.append(np.where(lengths > n, _finish(h), BUCKETS)[:, None].astype(np.uint32))
    # the whole word: its lexicon entry
    h = np.full(len(words), 0x811C9DC5, np.uint32)
    for k in range(width):
        step = (h ^ c[:, k]) * _P[k % 5]
        h = np.where(k < lengths, step ^ (step >> np.uint32(13)), h)
    out.append(_finish(h)[:, None])
    return np.concatenate(out, axis=1)


def by_length(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of words of like length, so that feature tables stay narrow."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault((len(w) - 1) // 8 if len(w) <= 64 else 8 + (len(w)).bit_length(), []).append(i)
    for idx in groups.values():
        step = max(1, 2_000_000 // (8 * max(len(words[i]) for i in idx)))
        for a in range(0, len(idx), step):
            part = idx[a : a + step]
            yield part, [words[i] for i in part]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + 1, K), the last row zero
    transitions: np.ndarray  # (K, K) log weights

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.langs)), np.float32)
        for idx, part in by_length(words):
            out[idx] = self.weights[features(part)].sum(axis=1)
        return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Posteriors (like emit) of sequences that lie one after another in emit; lengths must be positive.

    With `pairs` also the (K, K) sum of all pair marginals: how often each label is expected to follow each other one.
    Sequences are ordered by falling length and step together, so each step is one small matrix product.
    """
    order = np.argsort(-lengths, kind="stable")
    n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
    at = np.cumsum(active) - active
    place = np.empty(len(emit), np.int64)  # packed position -> position in emit
    for t in range(steps):
        place[at[t] : at[t] + active[t]] = starts[: active[t]] + t
    e = emit[place]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    trans = np.exp(transitions).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[: active[0]]
    a = a / a.sum(axis=1, keepdims=True)
    alpha[: active[0]] = a
    for t in range(1, steps):
        m = active[t]
        a = (a[:m] @ trans) * e[at[t] : at[t] + m]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t] + m] = a
    expected = np.zeros((e.shape[1], e.shape[1]))
    for t in range(steps - 2, -1, -1):
        m, nxt = active[t + 1], slice(at[t + 1], at[t + 1] + active[t + 1])
        w = e[nxt] * beta[nxt]
        b = w @ trans.T
        beta[at[t] : at[t] + m] = b / b.sum(axis=1, keepdims=True)
        if pairs:
            # a pair's marginal is alpha[t] * transition * emission[t + 1] * beta[t + 1], over its sum
            own = alpha[at[t] : at[t] + m]
            expected += (own / (own * b).sum(axis=1, keepdims=True)).T @ w * trans
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    out = np.empty_like(post)
    out[place] = post
    return (out, expected) if pairs else out


def _sums(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, K) sums of the rows of each group."""
    return np.stack([np.bincount(group, rows[:, j], n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


def gradients(emit: np.ndarray, gold: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood of the labels `gold` by the emissions and by the transitions."""
    post, expected = forward_backward(emit, lengths, transitions, pairs=True)
    by_emit = -post
    by_emit[np.arange(len(gold)), gold] += 1
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - 1] = False
    now = np.flatnonzero(inner)
    seen = np.zeros_like(expected)
    np.add.at(seen, (gold[now], gold[now + 1]), 1)
    return by_emit, seen - expected


def fit(texts: list[str], labels: list[str], epochs: int = 4, seed: int = 7) -> Model:
    """A model from labelled texts; every word takes its text's label."""
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    runs: list[tuple[list[str], int]] = []  # stretches of 4 to SEGMENT words
    for t, lab in zip(texts, labels, strict=True):
        w = WORD.findall(t.lower())
        while w:
            n = int(rng.integers(4, SEGMENT + 1))
            runs.append((w[:n], number[lab]))
            w = w[n:]
    model = Model(langs, np.zeros((BUCKETS + 1, k), np.float32), np.zeros((k, k), np.float32))
    if not runs or k == 1:
        return model
    known: dict[str, int] = {}
    seqs = [(np.array([known.setdefault(x, len(known)) for x in w]), np.full(len(w), y)) for w, y in runs]
    words = list(known)
    feats = [None] * len(words)
    for idx, part in by_length(words):
        f = features(part)
        for i, row in zip(idx, f, strict=True):
            feats[i] = row[row < BUCKETS]
    sizes = np.array([len(f) for f in feats])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(feats).astype(np.int64)
    g2, g2t = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(seqs))
        for at in range(0, len(order), 256):
            some = [seqs[i] for i in order[at : at + 256]]
            joined, i = [], 0
            while i < len(some):  # one to three stretches in a row make a sequence
                n = int(rng.integers(1, 4))
                joined.append((np.concatenate([s[0] for s in some[i : i + n]]), np.concatenate([s[1] for s in some[i : i + n]])))
                i += n
            ids, gold = np.concatenate([j[0] for j in joined]), np.concatenate([j[1] for j in joined])
            lengths = np.array([len(j[0]) for j in joined])
            uniq, inv = np.unique(ids, return_inverse=True)
            own = ragged_gather(flat, starts[uniq], sizes[uniq])  # feature buckets of the batch's words, one after another
            ends = np.cumsum(sizes[uniq]) - sizes[uniq]
            emit = np.add.reduceat(model.weights[own], ends, axis=0)[inv]
            grad, gt = gradients(emit, gold, lengths, model.transitions)
            # only buckets that the batch has a part in are moved
            used, slot = np.unique(own, return_inverse=True)
            g = _sums(slot, np.repeat(_sums(inv, grad, len(uniq)), sizes[uniq], axis=0), len(used))
            g = g / len(ids) - 1e-7 * model.weights[used]
            g2[used] += g * g * 100
            model.weights[used] += 0.5 * g / np.sqrt(g2[used])
            gt = (gt / len(ids)).astype(np.float32)
            g2t += gt * gt * 100
            model.transitions += 0.3 * gt / np.sqrt(g2t)
    return model


def fit_on(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, pieces_per_lang: int = PIECES_PER_LANG) -> Model:
    """Fit on pieces of at most docs_per_lang documents of each language (the least by a hash of doc_id), pieces_per_lang of them at most (by another hash).

    Only text and lang of rows with both are used; any number of languages is learned. Pieces are cut by characters
    and lose the word that a cut goes through, but for pieces that are one word. Repeated rows count as one document
    each. Without such rows, or in an empty table, the model knows no language.
    """
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # a hash range that holds about twice the wanted number of a language's documents, then the least hashes of it
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    near = labelled.join(F.broadcast(sizes.where(f"n > {2 * docs_per_lang}")), "lang", "left").where(h < F.coalesce(F.lit(2.0 * docs_per_lang) / F.col("n"), F.lit(2.0)))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= docs_per_lang)
    cut = first.select("lang", "r", "text", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / PIECE_CHARS).cast("int"))).alias("p"))
    piece = F.substring("text", F.col("p") * PIECE_CHARS + 1, F.lit(PIECE_CHARS))
    cut = cut.select("lang", "r", "p", F.when(F.col("p") > 0, F.regexp_replace(piece, r"^\S+(?=\s)", "")).otherwise(piece).alias("piece"), (F.char_length("text") > (F.col("p") + 1) * PIECE_CHARS).alias("goes_on"))
    cut = cut.select("lang", "r", "p", F.when(F.col("goes_on"), F.regexp_replace("piece", r"(?<=\s)\S+$", "")).otherwise(F.col("piece")).alias("piece"))
    some = cut.withColumn("o", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("r", "p"), "r", "p"))).where(F.col("o") <= pieces_per_lang)
    rows = sorted(some.select("lang", "o", "piece").collect())
    if not rows:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros((0, 0), np.float32))
    return fit([r.piece for r in rows], [r.lang for r in rows])


def label(model: Model, texts: list[str | None], cache: dict[str, int], emits: np.ndarray) -> tuple[list[str], list[float], np.ndarray]:
    """Language and score of each text; cache and emits remember words that were seen before."""
    ids, lengths, has = [], [], []
    new: list[str] = []
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower()) if t else []
        if not w:
            continue
        has.append(i)
        lengths.append(len(w))
        try:
            ids.append(np.fromiter(map(cache.__getitem__, w), np.int32, len(w)))
        except KeyError:
            for x in w:
                if x not in cache:
                    cache[x] = len(cache)
                    new.append(x)
            ids.append(np.fromiter(map(cache.__getitem__, w), np.int32, len(w)))
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if new:
        emits = np.concatenate((emits, model.emissions(new)))
    if has and model.langs:
        n = np.array(lengths)
        post = forward_backward(emits[np.concatenate(ids)], n, model.transitions)
        mean = np.add.reduceat(post.astype(np.float64), np.cumsum(n) - n, axis=0) / n[:, None]
        best = mean.argmax(axis=1)
        for j, i in enumerate(has):
            langs[i], scores[i] = model.langs[best[j]], float(min(1.0, mean[j, best[j]]))
    return langs, scores, emits


def _predict(model: Model, most_words: int = 300_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        emits = np.empty((0, len(model.langs)), np.float32)
        for ids, texts in text_batches(batches, most=6_000_000):
            if len(cache) > most_words:
                cache, emits = {}, emits[:0]
            langs, scores, emits = label(model, texts, cache, emits)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def _determined(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        emits = np.empty((0, len(model.langs)), np.float32)
        for b in batches:
            at = 0
            for _, texts in text_batches(iter([b]), most=3_000_000):
                if len(cache) > 200_000:
                    cache, emits = {}, emits[:0]
                part, at = b.slice(at, len(texts)), at + len(texts)
                if model.langs:
                    langs, scores, emits = label(model, texts, cache, emits)
                    kept = [x > 0 and x >= least - 1e-6 for x in scores]
                    lang = part.schema.get_field_index("lang")
                    if lang >= 0:
                        known = [old if old is not None else new for old, new in zip(part.column(lang).to_pylist(), langs, strict=True)]
                        part = part.set_column(lang, part.schema.field(lang), pa.array(known, part.schema.field(lang).type))
                else:
                    kept = [bool(t and WORD.search(t)) for t in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return run


#: What a text's language must have of its words' posteriors, on average, for the language to count as determined.
LEAST_SCORE = 0.5


def keep_determined(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is determined; a null `lang` becomes the predicted one.

    A text is rejected if it is null or has no letter, or if its best language has less than least_score of its words,
    as in strings of symbols and codes and in text mixed of several languages. With one or two languages nothing falls
    below a half; a model without languages keeps every text with letters and sets no language. Repeated rows are
    judged alike, a very long text as a whole; an empty table gives an empty result.
    """
    return docs.mapInArrow(tidy(_determined(model, least_score)), docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row, null and repeated keys included; other columns are ignored, whatever their names.

    Texts that are null or have no letter give `und` with score 0; so does a model without languages. Of languages with
    equal posteriors the first by name is taken. Texts are labelled whole, however long; an empty table gives an empty
    result.
    """
    return docs.select("doc_id", "text").mapInArrow(tidy(_predict(model)), "doc_id long, lang_pred string, score double")
