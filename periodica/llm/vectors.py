"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors of a label form a class that counts with its size; only its smallest vec_id goes on.
2. Labels are cut into overlapping cluster shards, level by level: a shard that is too large gets centroids from a
   bounded sample of its own, and each of its vectors goes on to the shards of its nearest few. The nearest one of
   each level is a vector's home. Centroids lie in files of the shared folder, which tasks open by name, so any
   number of labels and centroids is covered and none of them reaches the driver.
3. A shard gives a flat graph: each node's nearest candidates, thinned by robust pruning (a neighbour that a kept
   one is much closer to is dropped), and reverse edges. Adjacency lists of a node from all of its shards are united.
4. A vector is searched for at home, in the united graph: over the shard's nodes and, beyond its border, the
   neighbours that an in-range node can lead to. Search runs from the medoid and some spread entries: greedy steps
   lead all queries together to their surroundings, then every node within range is expanded until no new one
   turns up. Only what was measured is kept; beside it there is a flag for each query and node.
5. Pairs found are verified in double precision and counted for the query, so counts need no pair table; a task
   reports one row for each node. Recall is audited against brute force for every vec_id divisible by 50, and a
   search that falls short is repeated with more overlap and more patience.

A shard that can't be cut further, as a large group of near copies, is searched in blocks: each block of queries in
each block of nodes. Blocks bound a task's memory whatever the shard's size.
"""

from __future__ import annotations

import itertools
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import drop_stage, new_dir, write_stage
from periodica.llm.shared_files import new_file, open_file
from periodica.llm.tokens import ragged_gather
from periodica.operators.components import connected_components

log = logging.getLogger(__name__)

#: Nodes of a block on average; vectors of a shard that each of its centroids stands for; centroids of a shard at most; rows that they are fitted on, about.
BLOCK, PER_CENTROID, FAN, SAMPLE = 2048, 512, 256, 20_000
#: Neighbours of a node, candidates before pruning, pruning slack, entries of a block.
DEGREE, CANDIDATES, ALPHA, ENTRIES = 24, 64, 1.2, 8
#: Below the threshold by so much, a node is still expanded; open nodes that a query keeps.
MARGIN, BEAM = 0.05, 32
#: Queries that are audited in one pass over the table, and the least id's divisor of the audited ones.
AUDIT_BLOCK, AUDIT_EVERY = 20_000, 50


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps vectors that may link, with their unit form in double precision."""
    for b in batches:
        ids, labels, units, dims = [], [], [], []
        for i, v, lab in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
            if v is None or lab is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            m = np.abs(x).max()
            if not np.isfinite(m) or m == 0:
                continue
            x = x / m  # keeps squares within range
            ids.append(i), labels.append(lab), units.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes()), dims.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "unit"])


def _matrix(col) -> np.ndarray:
    rows = col.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; begins with evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (own := x[near == j]).size and (n := np.linalg.norm(s := own.sum(axis=0))) > 0:
                c[j] = s / n
    return c


def _fit(folder: str):
    """Centroids of a sampled shard, written to a file of their own; a row tells its name."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x, k = _matrix(t.column("unit")), t.column("k")[0].as_py()
        c = centroids(x, min(k, len(x)))
        with new_file(folder, "centroids") as (out, name):
            out.write(c.tobytes())
        return pa.table({"label": t.column("label")[:1], "dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "model": pa.array([name])})

    return run


def _assign(folder: str, overlap: int):
    """Rows come ordered by model; those with one go on to the shards of their nearest centroids, the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, c = None, None
        for b in batches:
            models, dims, old, home = (b.column(k).to_pylist() for k in ("model", "dim", "shard", "home"))
            rows, shards, homes = [], [], []
            for m, at in itertools.groupby(range(b.num_rows), key=models.__getitem__):
                at = list(at)
                if m is None:
                    rows += at
                    shards += [old[i] for i in at]
                    homes += [home[i] for i in at]
                    continue
                if m != name:
                    f = open_file(folder, m)
                    name, c = m, np.frombuffer(f.read(), np.float64).reshape(-1, dims[at[0]])
                    f.close()
                top = np.argsort(-(_matrix(b.column("unit").take(pa.array(at))) @ c.T), axis=1, kind="stable")[:, :overlap]
                for i, t in zip(at, top.tolist(), strict=True):
                    rows += [i] * len(t)
                    shards += [old[i] * (FAN + 1) + j + 1 for j in t]
                    homes += [home[i] and n == 0 for n in range(len(t))]
            out = b.take(pa.array(rows, pa.int64()))
            keep = ["vec_id", "label", "dim", "unit", "weight"]
            yield pa.RecordBatch.from_arrays([*(out.column(k) for k in keep), pa.array(shards, pa.int64()), pa.array(homes, pa.bool_())], names=[*keep, "shard", "home"])

    return run


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """(n, degree) neighbours by place, -1 where there are fewer. Distances are squared chords of unit vectors."""
    n = len(x)
    m = min(candidates, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if m <= 0:
        return out
    x = x.astype(np.float32)
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -np.inf
        cand = np.argpartition(-s, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(s, cand, 1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, 1)
        dist = 2 - 2 * np.take_along_axis(s, cand, 1)
        between = 2 - 2 * np.einsum("rid,rjd->rij", x[cand], x[cand])
        open_, filled = np.ones(cand.shape, bool), np.zeros(len(rows), np.int64)
        for j in range(m):  # nearest first, all rows together
            take = open_[:, j] & (filled < degree)
            r = np.flatnonzero(take)
            out[rows[r], filled[r]] = cand[r, j]
            filled[r] += 1
            open_[r] &= ~(alpha * between[r, j] <= dist[r])
    return out


def search(queries: np.ndarray, nodes: np.ndarray, adjacency: tuple[np.ndarray, np.ndarray], entries: np.ndarray, threshold: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) places of pairs at or above the threshold. All queries step together.

    adjacency: (starts, places): the neighbours of node i are places[starts[i] : starts[i + 1]]. A query goes on while
    one of its last `patience` steps came closer.
    """
    q, x = queries.astype(np.float32), nodes.astype(np.float32)
    nq, n = len(q), len(x)
    starts, places = adjacency
    degrees = np.diff(starts)
    seen = np.zeros(nq * n, bool)
    close_r, close_c, todo_r, todo_c = [], [], [], []  # pairs at the threshold, but for rounding; pairs in range to expand

    def see(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Measures the pairs that weren't seen before."""
        flat = r * n + c
        flat = np.unique(flat[~seen[flat]])
        seen[flat] = True
        r, c = np.divmod(flat, n)
        sim = np.concatenate([np.einsum("ij,ij->i", q[r[a : a + 200_000]], x[c[a : a + 200_000]]) for a in range(0, len(r), 200_000)] or [np.empty(0, np.float32)])
        near = sim >= threshold - 1e-3
        close_r.append(r[near]), close_c.append(c[near])
        wide = sim >= threshold - MARGIN
        todo_r.append(r[wide]), todo_c.append(c[wide])
        return r, c, sim

    def expand(r: np.ndarray, c: np.ndarray) -> list:
        """Measures the neighbours of node c for query r, in slices of bounded size."""
        cut = np.searchsorted(np.cumsum(degrees[c]), np.arange(1_000_000, int(degrees[c].sum()), 1_000_000))
        return [see(np.repeat(rs, degrees[cs]), ragged_gather(places, starts[cs], degrees[cs])) for rs, cs in zip(np.split(r, cut), np.split(c, cut), strict=True)]

    every = np.arange(nq)
    r, c, sim = see(np.repeat(every, len(entries)), np.tile(entries, nq))
    best, waited = np.full(nq, -np.inf, np.float32), np.zeros(nq, np.int64)
    while len(r):
        order = np.lexsort((-sim, r))
        r, c, sim = r[order], c[order], sim[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))  # each query's best open node
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        tops, heads = r[first], sim[first]
        better = heads > best[tops]
        waited[tops] = np.where(better, 0, waited[tops] + 1)
        best[tops] = np.maximum(best[tops], heads)
        go = waited[tops] <= patience
        new = expand(tops[go], c[first][go])
        keep = (rank > 0) & (rank < BEAM) & (waited[r] <= patience)
        r, c, sim = (np.concatenate([own[keep], *(x[i] for x in new)]) for i, own in enumerate((r, c, sim)))
    done = np.zeros(0, np.int64)
    while True:  # range expansion
        flat = np.unique(np.concatenate(todo_r) * n + np.concatenate(todo_c))
        todo_r, todo_c = [], []
        flat = flat[~np.isin(flat, done, assume_unique=True)]
        if not len(flat):
            break
        done = np.concatenate([done, flat])
        expand(*np.divmod(flat, n))
        todo_r.append(np.empty(0, np.int64)), todo_c.append(np.empty(0, np.int64))
    r, c = np.concatenate(close_r), np.concatenate(close_c)
    ok = np.concatenate([np.einsum("ij,ij->i", queries[r[a : a + 100_000]], nodes[c[a : a + 100_000]]) for a in range(0, len(r), 100_000)] or [np.empty(0)]) >= threshold
    return r[ok], c[ok]


def _build(bound: float):
    """Neighbours of each node, and those of them that are close enough to lead a search over a shard's border."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x, ids = _matrix(t.column("unit")), t.column("vec_id").to_numpy()
        near = robust_prune(x)
        a, at = np.nonzero(near >= 0)
        b = near[a, at]
        flat = np.unique(np.concatenate((a * len(x) + b, b * len(x) + a)))
        a, b = np.divmod(flat, len(x))
        sim = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 100_000]], x[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)] or [np.empty(0)])
        split = lambda use: np.split(ids[b[use]], np.searchsorted(a[use], np.arange(1, len(x))))
        lists = {"near": split(np.ones(len(a), bool)), "close": split(sim >= bound)}
        return pa.table({"vec_id": pa.array(ids, pa.int64()), **{k: pa.array(v, pa.list_(pa.int64())) for k, v in lists.items()}})

    return run


def _components(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each place's component."""
    lab = ids.copy()
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == lab).all():
            return lab
        lab = new


def _search(threshold: float, patience: int):
    """A group holds a block of queries (ask) and a block of nodes with their united lists (own); a row may be both."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ask, own = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("ask", "own"))
        ids, weight = t.column("vec_id").to_numpy(), t.column("weight").to_numpy()
        names = {"vec_id": pa.int64(), "links": pa.int64(), "other": pa.int64()}
        if not len(ask) or not len(own):
            return pa.table({k: pa.array([], v) for k, v in names.items()})
        x = _matrix(t.column("unit"))
        lists = t.column("near").take(pa.array(own)).combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.searchsorted(ids[own], flat := lists.flatten().to_numpy())
        here = (at < len(own)) & (ids[own][np.minimum(at, len(own) - 1)] == flat)
        counts = np.bincount(np.repeat(np.arange(len(own)), sizes)[here], minlength=len(own))
        adj = np.concatenate(([0], np.cumsum(counts))), at[here]
        nodes = x[own]
        medoid = int((nodes @ nodes.mean(axis=0)).argmax())
        entries = np.unique(np.concatenate(([medoid], np.linspace(0, len(own) - 1, ENTRIES).astype(np.int64))))
        found = []
        for a in range(0, len(ask), 1024):
            r, c = search(x[ask[a : a + 1024]], nodes, adj, entries, threshold, patience)
            found.append((ask[a : a + 1024][r], own[c]))
        r, c = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        # a vector that asks and is a node in different rows of the group is one; it doesn't link with itself
        r, c = r[ids[r] != ids[c]], c[ids[r] != ids[c]]
        links = np.bincount(r, weight[c], len(ids)).astype(np.int64)
        other = _components(len(ids), r, c, ids)
        hit = np.unique(np.concatenate((r, c)))
        return pa.table({"vec_id": pa.array(ids[hit], pa.int64()), "links": pa.array(links[hit]), "other": pa.array(other[hit], pa.int64())})

    return run


def placed_in_shards(reps: DataFrame, overlap: int) -> DataFrame:
    """vec_id, label, dim, unit, weight, shard, home: a row for each shard of a vector, one of which is its home."""
    spark, key = reps.sparkSession, ["label", "dim", "shard"]
    folder = new_dir(spark, "vec-centroids")
    placed = write_stage(reps.select("vec_id", "label", "dim", "unit", "weight", F.lit(0).cast("long").alias("shard"), F.lit(True).alias("home")), "vec-shards")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level_of = 0
    while True:
        sizes = placed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 2 * PER_CENTROID)
        most = sizes.agg(F.max("n")).first()[0]
        # shards that levels enough for their size haven't cut are groups of near copies
        if level_of == 0:
            levels = 0 if most is None else 1 + (most > PER_CENTROID * FAN) + (most > PER_CENTROID * FAN * FAN) + (most > PER_CENTROID * FAN**3)
        if most is None or level_of == levels:
            return placed
        level_of += 1
        sample = placed.join(sizes, key).where(F.pmod(F.xxhash64("vec_id", F.lit(level_of)), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))) == 0)
        sample = sample.withColumn("k", F.least(F.lit(FAN), F.ceil(F.col("n") / PER_CENTROID)).cast("int"))
        models = write_stage(sample.select(*key, "k", "vec_id", "unit").groupBy(*key).applyInArrow(_fit(folder), "label string, dim int, shard long, model string"), "vec-models")
        dealt = placed.join(models, key, "left").repartition(parts, "model", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).sortWithinPartitions("model")
        nxt = write_stage(dealt.mapInArrow(_assign(folder, overlap if level_of == levels else 2), "vec_id long, label string, dim int, unit binary, weight long, shard long, home boolean"), "vec-shards")
        drop_stage(placed)
        drop_stage(models)
        placed = nxt


def link(reps: DataFrame, threshold: float, overlap: int, patience: int) -> DataFrame:
    """(vec_id, links, other): for each node and task, links counted there and the least id that they lead to."""
    key = ["label", "dim", "shard"]
    shards = placed_in_shards(reps, overlap)
    blocks = shards.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    placed = shards.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    # an in-range node leads to a match only over an edge no wider than both angles together
    bound = math.cos(min(math.pi, math.acos(max(-1.0, threshold - MARGIN)) + math.acos(min(1.0, threshold))))
    graph = placed.select(*key, "block", "vec_id", "unit").groupBy(*key, "block").applyInArrow(_build(bound), "vec_id long, near array<long>, close array<long>")
    graph = graph.groupBy("vec_id").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")))
    graph = write_stage(graph.join(reps.select("vec_id", "unit", "weight"), "vec_id"), "vec-graph")
    members = placed.select("vec_id", *key, "block", "nb", "home").join(graph.select("vec_id", "near", "close"), "vec_id")
    members = write_stage(members, "vec-members")
    # nodes beyond a shard's border that one of its nodes is close to
    beyond = members.select(*key, "nb", "block", F.explode("close").alias("vec_id")).groupBy(*key, "nb", "vec_id").agg(F.min("block").alias("block"))
    beyond = beyond.join(members.select(*key, "vec_id"), [*key, "vec_id"], "left_anti").join(graph.select("vec_id", "near"), "vec_id")
    nodes = members.select(*key, "nb", "block", "vec_id", "near", "home").unionByName(beyond.withColumn("home", F.lit(False)))
    # a block of queries meets every block of nodes, of its shard
    own = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(*key, "i", F.col("block").alias("j"), "vec_id", "near", (F.col("home") & (F.col("i") == F.col("block"))).alias("ask"), F.lit(True).alias("own"))
    more = nodes.where("home and nb > 1").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("j <> block").select(*key, F.col("block").alias("i"), "j", "vec_id", F.array().cast("array<bigint>").alias("near"), F.lit(True).alias("ask"), F.lit(False).alias("own"))
    dealt = own.unionByName(more).join(graph.select("vec_id", "unit", "weight"), "vec_id")
    out = write_stage(dealt.groupBy(*key, "i", "j").applyInArrow(_search(threshold, patience), "vec_id long, links long, other long"), "vec-links")
    for stage in (shards, graph, members):
        drop_stage(stage)
    return out


def _brute(queries: list, threshold: float):
    """Counts links of some queries over all rows."""
    by: dict = {}
    for r in queries:
        by.setdefault((r.label, r.dim), []).append(r)
    by = {k: (np.array([r.vec_id for r in v]), np.array([np.frombuffer(r.unit) for r in v])) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v[0]), np.int64) for k, v in by.items()}
        for b in batches:
            rows: dict = {}
            for i, k in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)):
                if k in by:
                    rows.setdefault(k, []).append(i)
            for k, at in rows.items():
                ids, x = by[k]
                own, w, y = b.column("vec_id").to_numpy()[at], b.column("weight").to_numpy()[at], _matrix(b.column("unit").take(pa.array(at)))
                for a in range(0, len(ids), 1024):
                    hit = (x[a : a + 1024] @ y.T >= threshold) & (ids[a : a + 1024, None] != own)
                    total[k][a : a + 1024] += hit @ w
        ids, n = [np.concatenate([np.empty(0, np.int64), *c]) for c in ([by[k][0] for k in total], list(total.values()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["vec_id", "true_links"])

    return run


def audit_recall(reps: DataFrame, links: DataFrame, threshold: float, every: int = AUDIT_EVERY) -> float:
    """Mean of the share of its links that was found, over the vectors with links whose id is divisible by `every`; 1 if none has any.

    They are compared with all rows, AUDIT_BLOCK of them in a pass.
    """
    asked = write_stage(reps.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0), "vec-audit")
    found = links.groupBy("vec_id").agg(F.sum("links").alias("f"))
    total = n = 0.0
    blocks = max(1, -(-asked.count() // (AUDIT_BLOCK // 2)))  # by hash, so a block has half of what it may have, on average
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()
        if rows:
            true = reps.mapInArrow(_brute(rows, threshold), "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("t"))
            r = true.join(found, "vec_id", "left").agg(F.sum(F.least(F.col("t"), F.coalesce("f", F.lit(0))) / F.col("t")).alias("share"), F.count("*").alias("n")).first()
            total, n = total + (r.share or 0.0), n + r.n
    drop_stage(asked)
    return total / n if n else 1.0


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, overlap: int = 3, patience: int = 6, least_recall: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors needs vec_id (unique, not null), embedding (array of numbers) and label; other columns are ignored.
    Vectors link only when labels are equal and not null, lengths are equal, and the cosine in double precision
    is at least the threshold. Vectors that are null, empty or zero, or hold null or non-finite numbers, link with
    nothing and are kept. Equal vectors of a label link with each other. Rows without vec_id are left out; repeated
    rows give repeated results, each counted as a vector. An empty table gives an empty result. Where the audited
    recall stays below least_recall after three rounds, an error is raised.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).where("vec_id is not null")
    units = write_stage(v.mapInArrow(_valid, "vec_id long, label string, dim int, unit binary"), "vec-units")
    classes = units.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    members = write_stage(units.join(classes, ["label", "dim", "unit"]).select("vec_id", "rep", "weight", "label", "dim", F.when(F.col("vec_id") == F.col("rep"), F.col("unit")).alias("unit")), "vec-members")
    drop_stage(units)
    reps = write_stage(members.where("vec_id = rep").select("vec_id", "label", "dim", "unit", "weight").dropDuplicates(["vec_id"]), "vec-reps")
    for _ in range(3):
        links = link(reps, threshold, overlap, patience)
        recall = audit_recall(reps, links, threshold)
        log.info("recall %.4f with overlap %d and patience %d", recall, overlap, patience)
        if recall >= least_recall:
            break
        overlap, patience = 2 * overlap, 2 * patience
    else:
        raise RuntimeError(f"recall {recall:.4f} of the vector search stays below {least_recall}")
    comp = write_stage(connected_components(links.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))), "vec-comp")
    count = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    whole = members.select("vec_id", "rep", "weight").join(count.withColumnRenamed("vec_id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id")).dropDuplicates(["vec_id"])
    out = v.select("vec_id").join(whole, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
