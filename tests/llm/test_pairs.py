from pathlib import Path

import numpy as np
import pytest

from featherbit.functions import planning
from featherbit.llm import clusters, neighbours, pairs, vectors


def frame(spark, x, first=0):
    df = spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "word_id long, embeddings array<float>").repartition(3)
    return vectors.usable(df, "word_id", "embeddings")


def truth(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -1)
    return s


def labels(s, least):
    label = np.arange(len(s))
    while True:
        new = np.array([min(label[i], *label[s[i] >= least]) if (s[i] >= least).any() else label[i] for i in range(len(s))])
        if (new == label).all():
            return label
        label = new


def mixed(seed, dims=64, copies=True):
    """Random directions, clusters, a dense ball, a half of all within 0.6 of one another, and copies (some scaled)."""
    rng = np.random.default_rng(seed)
    ball, near = rng.standard_normal((2, dims))
    x = [rng.standard_normal((150, dims)), ball + 0.3 * rng.standard_normal((130, dims)), near + 0.8 * rng.standard_normal((250, dims))]
    x += [c + 0.4 * rng.standard_normal((4, dims)) for c in rng.standard_normal((20, dims))]
    x = np.concatenate(x)[rng.permutation(610)].astype(np.float32)
    return np.concatenate([x, *([x[:7], 4 * x[:30], x[:1], x[:1]] if copies else [])])


@pytest.mark.parametrize("block, tile", [(8192, 1024), (64, 16), (50, 13)])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, block, tile):
    """Whatever the blocks and tiles, and dense tiles too."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "LEAST_BLOCK", block)
    monkeypatch.setattr(pairs, "TILE", tile)
    x = mixed(block)
    label = labels(truth(x), 0.8)
    sizes = np.bincount(label, minlength=len(x))
    assert {tuple(r) for r in clusters.cluster_members(frame(spark, x)).collect()} == {(int(c), i) for i, c in enumerate(label) if sizes[c] >= 3}


def test_clusters_take_little_disk(spark):
    """What p1_found leaves in the checkpoint folder is a small multiple of the vectors, not of lists and meetings of them."""
    x = np.random.default_rng(2).standard_normal((2500, 64)).astype(np.float32)
    x[:200] = x[0] + 0.2 * x[:200]
    folder = Path(planning.shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert clusters.cluster_members(frame(spark, x)).count() >= 200
    assert size() - before < 4 * x.nbytes


@pytest.mark.parametrize("block, tile", [(8192, 1024), (64, 16), (50, 13)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, block, tile):
    """All of them with their similarities and ranks, ties by id, also links just over 0.8 and in dense tiles."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(pairs, "TILE", tile)
    x = mixed(block)
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    far = [0.8001 * base[0] + np.sqrt(1 - 0.8001**2) * d for d in base[1:]]  # 63 vectors barely linked with one
    x = np.concatenate([x, [base[0]], far]).astype(np.float32)
    s = truth(x)
    want = {}
    for i in range(len(x)):
        best = [j for j in np.lexsort((np.arange(len(x)), -s[i])) if s[i, j] >= 0.8][:5]
        want |= {(i, int(j), n + 1): s[i, j] for n, j in enumerate(best)}
    got = {(r["id"], r["other"], r["rank"]): r["similarity"] for r in neighbours.nearest(frame(spark, x)).collect()}
    assert got.keys() == want.keys() and max(abs(got[y] - want[y]) for y in want) < 1e-8


def test_pairs_just_over_the_threshold_are_found(spark):
    """400 pairs of random directions at a cosine of 0.8001, which binary codes within a radius miss in part."""
    rng = np.random.default_rng(9)
    u, d = rng.standard_normal((2, 400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d -= (d * u).sum(1, keepdims=True) * u
    x = np.concatenate([u, 0.8001 * u + 0.5999 * d / np.linalg.norm(d, axis=1, keepdims=True)]).astype(np.float32)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(truth(x) >= 0.8), strict=True)}
    assert len(want) == 800 and {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, x)).collect()} == want
