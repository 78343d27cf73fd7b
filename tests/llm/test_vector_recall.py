"""The audit of the approximate vector search."""

import numpy as np
import pytest

from periodica.llm import vectors


def test_hot_group_does_not_hide_lost_pairs(spark):
    rng, rows = np.random.default_rng(0), []
    for group, n in enumerate([100] + [2] * 40):
        for _ in range(n):
            v = np.zeros(64)
            v[group] = 1.0
            v += rng.normal(0, 1e-3, 64)
            rows.append((len(rows), "a", 64, bytearray((v / np.linalg.norm(v)).tobytes()), 1))
    reps = spark.createDataFrame(rows, "vec_id long, label string, dim int, unit binary, weight long")
    links = lambda n: spark.createDataFrame([(i, 99 if i < 100 else 1, 0) for i in range(n)], "vec_id long, links long, other long")
    assert vectors.audit_recall(reps, links(180), 0.93, every=1) == 1.0
    assert vectors.audit_recall(reps, links(100), 0.93, every=1) == pytest.approx(100 / 180)


def test_low_recall_raises(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vectors, "link", lambda *_: spark.createDataFrame([], "vec_id long, links long, other long"))
    table = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [1.0, 0.01], "a")], "vec_id long, embedding array<double>, label string")
    with pytest.raises(RuntimeError, match="recall 0.0000"):
        vectors.near_duplicate_vectors(table).collect()


def planted(groups, size, labels, hot, dim=32, seed=0):
    """(ids, vectors, labels): clusters of near copies, a hot one of them with `hot` members, in a label each."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    sizes = np.full(groups, size)
    sizes[0] = hot
    x = np.repeat(centre / np.linalg.norm(centre, axis=1, keepdims=True), sizes, axis=0)
    x += rng.normal(size=x.shape) * np.repeat(rng.uniform(0.02, 0.07, groups), sizes)[:, None]
    lab = np.repeat(np.arange(groups) % labels, sizes)
    order = rng.permutation(len(x))
    return np.arange(len(x)), x[order], lab[order]


def true_links(x, lab, threshold=0.93):
    u, out = x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x), int)
    for k in np.unique(lab):
        at = np.flatnonzero(lab == k)
        for a in range(0, len(at), 2048):
            out[at[a : a + 2048]] = (u[at[a : a + 2048]] @ u[at].T >= threshold).sum(axis=1) - 1
    return out


@pytest.mark.parametrize(("groups", "size", "labels", "hot"), [(3000, 4, 1, 700), (600, 10, 80, 300)], ids=["one label, two levels", "many labels"])
def test_planted_clusters(spark, monkeypatch, groups, size, labels, hot):
    """Nested shards, blocks of a hot group, and more labels than once had shards of their own."""
    monkeypatch.setattr(vectors, "PER_CENTROID", 40)
    monkeypatch.setattr(vectors, "FAN", 16)
    monkeypatch.setattr(vectors, "BLOCK", 256)
    ids, x, lab = planted(groups, size, labels, hot)
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), lab.tolist(), strict=True)), "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicate_vectors(df).orderBy("vec_id").toPandas()
    want = true_links(x, lab)
    assert (got.n_links <= want).all() and got.n_links.sum() >= 0.95 * want.sum()
    some = want > 0
    assert (got.n_links[some] / want[some]).mean() >= 0.95
