"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles, `bands * rows` minima, band keys (64-bit hashes of `rows`
   minima), and a packed signature that retains only the low `bits` bits of every minimum.
2. Documents with equal sets form a class; only its smallest doc_id goes on.
3. Band candidates: every member of a band bucket is paired with the bucket's smallest member (a star, so a
   bucket of n members makes n-1 pairs). The collision-corrected similarity of a pair is estimated from the
   bit counts of the packed signatures; pairs far below the threshold fall out there.
4. Remaining pairs are confirmed on the full shingle sets, and components are formed from confirmed links.
5. Buckets whose members are still in different components are searched again, in bounded blocks: their
   documents get a longer packed signature, which a task compares by bit counts, and only pairs of different
   components whose estimate passes are confirmed, each in the first band that the two share. So no link
   between different texts hangs on the choice of a bucket's leader.

Nothing is capped: a bucket of any size is covered by blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import drop_stage, likely_in, text_batches, tidy, write_stage
from periodica.llm.shingles import WordHasher, jaccard_at_least, mix, shingle_set
from periodica.operators.components import connected_components

#: Probability that a pair at similarity 0.8 shares no band: (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS, BITS = 40, 6, 4
#: Standard deviations of the estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 4.5
#: The longer signature of step 5, as bands, rows and bits; and the members that a block holds at most, on average.
LONG = (256, 8, 2)
BLOCK = 512


class Signer:
    """Minima of bands*rows hash functions over a shingle set; band keys; packed low bits."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        if 8 % bits or (bands * rows * bits) % 64:
            raise ValueError("bits must divide 8, and a signature must fill 64-bit words")
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)
        self.weights = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """Least products, modulo 2**32, of mixed hashes with odd constants; in slices that stay in the processor's cache."""
        s, out = s.astype(np.uint32), np.full(len(self.mul), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(s), 256):
            np.minimum(out, (s[i : i + 256, None] * self.mul).min(axis=0), out=out)
        return out.astype(np.uint64)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = mix(minima + np.uint64(0x9E3779B97F4A7C15)).reshape(self.bands, self.rows)
        return mix((m * self.weights).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def pack(self, minima: np.ndarray) -> bytes:
        low = (mix(minima) & np.uint64(2**self.bits - 1)).astype(np.uint8).reshape(-1, 8 // self.bits)
        return np.bitwise_or.reduce(low << (np.arange(8 // self.bits, dtype=np.uint8) * np.uint8(self.bits)), axis=1).astype(np.uint8).tobytes()

    def agreeing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many minima agree in their low bits, by bit counts of packed signatures (64-bit words, last axis)."""
        x = a ^ b
        mask = {1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111, 8: 0x0101010101010101}[self.bits]
        shift = self.bits >> 1
        while shift:
            x = x | (x >> np.uint64(shift))
            shift >>= 1
        return self.bands * self.rows - np.bitwise_count(x & np.uint64(mask)).sum(axis=-1, dtype=np.int64)

    def estimate(self, agreeing: np.ndarray) -> np.ndarray:
        """Similarity corrected for minima that agree by chance, with probability 2**-bits."""
        c = 2.0**-self.bits
        return (agreeing / (self.bands * self.rows) - c) / (1 - c)

    def least_agreeing(self, threshold: float) -> int:
        """Fewest agreeing minima that a pair at the threshold shows, but for SLACK standard deviations."""
        k, c = self.bands * self.rows, 2.0**-self.bits
        p = threshold + (1 - threshold) * c
        return int(np.floor(k * p - SLACK * np.sqrt(k * p * (1 - p))))


_SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>"


def _sign(signer: Signer, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for ids, texts in text_batches(batches):
            n, f1, f2, sigs, bands = [], [], [], [], []
            for t in texts:
                s = shingle_set(t, hasher, width)
                n.append(len(s))
                if not len(s):
                    f1.append(None), f2.append(None), sigs.append(None), bands.append([])
                    continue
                # two independent 64-bit sums stand for the set: equal sets agree, different ones don't
                f1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)))
                m = signer.minima(s)
                sigs.append(signer.pack(m))
                bands.append(signer.band_keys(m))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"])

    return run


def _words(batch: pa.RecordBatch, name: str, signer: Signer) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(col), np.uint64).reshape(len(col), -1)


def _estimated(signer: Signer, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = signer.agreeing(_words(b, "sig_a", signer), _words(b, "sig_b", signer)) >= least
                yield b.filter(pa.array(ok)).select(["a", "b"])

    return run


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, kept = WordHasher(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb, ok = batch.column("text_a"), batch.column("text_b"), []
            for i in range(batch.num_rows):
                if a[i] != last:  # the pairs of a leader stand together
                    last, kept = a[i], shingle_set(ta[i].as_py(), hasher, width)
                ok.append(jaccard_at_least(kept, shingle_set(tb[i].as_py(), hasher, width), percent))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; texts are fetched, and shuffled, for these pairs only, but for few."""
    wanted = likely_in(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "doc_id")
    d = docs.select("doc_id", "text").where(wanted(F.col("doc_id")))
    with_b = pairs.join(d.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    both = with_b.join(d.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_confirmed(width, percent)), "a long, b long")


def _long_signatures(signer: Signer, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for ids, texts in text_batches(batches):
            sigs = [signer.pack(signer.minima(shingle_set(t, hasher, width))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], names=["rep", "long_sig"])

    return run


def _block_pairs(signer: Signer, least: int):
    """Within two blocks of a bucket: pairs of different components whose estimate passes and that share no earlier band."""

    def run(t: pa.Table) -> pa.Table:
        side, rep, comp = (t.column(c).to_numpy() for c in ("side", "rep", "comp"))
        band = t.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(t.column("long_sig").to_pylist()), np.uint64).reshape(len(rep), -1)
        keys = np.array(t.column("bands").to_pylist(), np.int64)
        at = int(np.flatnonzero(keys[0] == band)[0])
        rows, cols = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        out_a, out_b = [], []
        for i in rows:  # side 1: a block against itself
            j = cols[(comp[cols] != comp[i]) & ((side[i] == 0) | (rep[cols] > rep[i]))]
            j = j[~(keys[j, :at] == keys[i, :at]).any(axis=1)]
            j = j[signer.agreeing(sig[i], sig[j]) >= least]
            out_a.append(np.minimum(rep[i], rep[j])), out_b.append(np.maximum(rep[i], rep[j]))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"a": cat(out_a), "b": cat(out_b)})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    docs needs doc_id (unique, not null) and text; other columns are ignored, whatever their names. Texts that
    are null or have no words have an empty set, link with nothing and are kept. class_id is the smallest doc_id
    with the same set. Two documents link when 100 * intersection >= percent * union of their shingle sets.
    An empty table gives an empty result. Repeated texts are one class; ties go to the smallest doc_id. Rows without
    doc_id are left out, and repeated rows give repeated results.
    """
    signer = Signer(bands, rows, bits)
    least = signer.least_agreeing(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id is not null")
    signed = write_stage(docs.mapInArrow(tidy(_sign(signer, width)), _SIGNED), "minhash-signed")
    classes = signed.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    members = write_stage(signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "minhash-members")
    reps = members.where("doc_id = rep and n_shingles > 0").select("rep")
    reps = write_stage(signed.join(reps, signed.doc_id == reps.rep, "left_semi").select(F.col("doc_id").alias("rep"), "sig", "bands"), "minhash-reps")
    drop_stage(signed)
    in_band = reps.select("rep", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = write_stage(in_band.join(buckets, "band"), "minhash-shared")
    star = shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    sig = reps.select("rep", "sig")
    star = star.join(sig.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b").select("a", "b", "sig_a", "sig_b")
    star = write_stage(star.mapInArrow(_estimated(signer, least), "a long, b long"), "minhash-star")
    links = write_stage(_confirm(star, docs, width, percent), "minhash-links")
    comp = write_stage(connected_components(links), "minhash-comp")

    placed = shared.select("band", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = write_stage(placed, "minhash-placed")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    left = write_stage(placed.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")), "minhash-mixed")
    longer = Signer(*LONG)
    again = left.select("rep").distinct()
    longs = docs.where(likely_in(again, "rep")(F.col("doc_id"))).join(again, docs.doc_id == again.rep, "left_semi").mapInArrow(_long_signatures(longer, width), "rep long, long_sig binary")
    longs = write_stage(longs.join(reps.select("rep", "bands"), "rep"), "minhash-long")
    # a block meets itself (side 1), those after it (side 0) and those before it (side 2)
    dealt = left.join(longs, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2).alias("side"), "rep", "comp", "long_sig", "bands"
    )
    more = dealt.groupBy("band", "i", "j").applyInArrow(_block_pairs(longer, longer.least_agreeing(percent / 100)), "a long, b long")
    more = write_stage(more.join(star, ["a", "b"], "left_anti"), "minhash-more")
    found = write_stage(_confirm(more, docs, width, percent), "minhash-found")
    if found.isEmpty():
        final = comp
    else:
        final = write_stage(connected_components(links.union(found)), "minhash-comp")
    for s in (shared, star, links, placed, left, longs, more, reps):
        drop_stage(s)
    # a class's smallest document is its node, so the component of a document is that of its class
    return members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
