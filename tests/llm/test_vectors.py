import numpy as np

from featherbit.llm import clusters, neighbours, vectors


def made(n_clusters=12, hot=150, copies=20, seed=0):
    """Vectors in clusters of 1 to 9, one hot region, exact copies (some scaled) and unusable rows."""
    rng = np.random.default_rng(seed)
    x = []
    for _ in range(n_clusters):
        c = rng.standard_normal(64)
        x += [c + rng.uniform(0.1, 0.35) * rng.standard_normal(64) for _ in range(rng.integers(1, 10))]
    c = rng.standard_normal(64)
    x += [c + 0.2 * rng.standard_normal(64) for _ in range(hot)] + [x[0] * 2.0**k for k in range(-2, copies - 2)]
    x = np.array(x, dtype=np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    return x, rows + [rows[3], (9000, None), (9001, [0.0] * 64), (9002, [1.0] * 9), (None, [1.0] * 64), (9003, [float("nan")] * 64), (9004, [None, *[1.0] * 63])]


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "word_id long, embeddings array<float>, c int, n double")
    return vectors.usable(df, "word_id", "embeddings")


def truth(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.round(u @ u.T, 9)


def test_nearest(spark):
    x, rows = made()
    s = truth(x)
    want = {i: [j for j in np.lexsort((np.arange(len(x)), -s[i])) if j != i and s[i, j] >= 0.8][:5] for i in range(len(x))}
    got = {i: [] for i in want}
    for r in sorted(neighbours.nearest(frame(spark, rows)).collect(), key=lambda r: r["rank"]):
        got[r["id"]].append(r["other"])
    hit = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hit >= 0.97 * sum(map(len, want.values())) and got[0] == want[0] and all(len(v) <= 5 for v in got.values())
    assert neighbours.nearest(frame(spark, rows[-6:])).count() == 0


def test_blocks_and_prefixes_do_not_matter(spark, monkeypatch):
    _, rows = made(6, 60, 5)
    df = frame(spark, rows)
    once = sorted(map(tuple, neighbours.nearest(df).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    assert sorted(map(tuple, neighbours.nearest(df).collect())) == once


def test_many_copies_and_large_k(spark):
    """20 equal vectors and k = 10: each has ten neighbours; k over the number of vectors gives all."""
    rng = np.random.default_rng(1)
    x = [rng.standard_normal(64).tolist()] * 20 + rng.standard_normal((5, 64)).tolist()
    df = frame(spark, list(enumerate(x)))
    got = {}
    for r in sorted(neighbours.nearest(df, k=10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {i: [j for j in range(20) if j != i][:10] for i in range(20)}
    assert neighbours.nearest(df, k=50).count() == 20 * 19


def test_clusters(spark):
    x, rows = made()
    s = truth(x)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([label[np.flatnonzero(s[i] >= 0.8)].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    sizes = np.bincount(label, minlength=len(x))
    want = {(int(c), i) for i, c in enumerate(label) if sizes[c] >= 3}
    df = frame(spark, rows)
    assert {tuple(r) for r in clusters.cluster_members(df).collect()} == want
    report = clusters.cluster_report(df).collect()
    assert sum(r["size"] for r in report) == sum(n for n in sizes if n >= 2)
    hot = max(report, key=lambda r: r["size"])
    assert len(hot["typical"]) == 5 and len(set(label[hot["typical"]])) == 1
    assert clusters.cluster_members(frame(spark, rows[-6:])).count() == 0


def test_clusters_of_more_links_than_a_list_holds(spark, monkeypatch):
    """Subgroups of over k vectors fill one another's lists; all pairs are linked, so all are one cluster."""
    rng = np.random.default_rng(4)
    hub = rng.standard_normal(64)
    hub /= np.linalg.norm(hub)
    far = rng.standard_normal((300, 64))
    x = []
    for _ in range(6):
        off = rng.standard_normal(64)
        x += [hub + 0.36 * off / np.linalg.norm(off) + 0.004 * rng.standard_normal(64) for _ in range(20)]
    x = np.array([*x, *far, far[0] + 0.1, far[0] - 0.1], dtype=np.float32)
    s = truth(x)
    assert s[:120, :120].min() >= 0.8
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for size in (1024, 16):  # one block, and many
        monkeypatch.setattr(clusters, "LEAST_BLOCK", size)
        got = {tuple(r) for r in clusters.cluster_members(df).collect()}
        assert got == {(0, i) for i in range(120)} | {(120, i) for i in (120, 420, 421)}
        _, inner, found = clusters.similarity_clusters(df)
        m = {r["c"]: r["m"] for r in found.collect()}
        same = np.array([[m[i] == m[j] and i != j for j in range(len(x))] for i in range(len(x))])
        want = np.where(same & (s >= 0.8), s, 0).sum(1)
        w = {r["c"]: r["w"] for r in inner.collect()}
        assert np.allclose([w.get(i, 0.0) for i in range(len(x))], want)


def test_one_bridge_joins_two_balls(spark):
    """Two balls of 40 fill their lists with one another; the one link between them, at 0.81, is found all the same."""
    rng = np.random.default_rng(7)
    base = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    angle = np.arccos(0.81)
    a, b = base[0], np.cos(angle) * base[0] + np.sin(angle) * base[1]
    away = lambda c, d: np.cos(0.5) * c + np.sin(0.5) * d
    balls = [away(c, d) + 0.002 * rng.standard_normal(64) for c, d in ((a, base[2]), (b, base[3])) for _ in range(40)]
    x = np.array([a, b, *balls], dtype=np.float32)
    s = truth(x)
    assert s[0, 1] >= 0.8 and (s[:, 2:42][1].max() < 0.8) and s[2:42, 42:].max() < 0.8 and s[0, 2:42].min() >= 0.8
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert {tuple(r) for r in clusters.cluster_members(df).collect()} == {(0, i) for i in range(82)}
    report = clusters.cluster_report(df).collect()
    assert sum(r["size"] for r in report) == 82 and {r["cluster_id"] for r in report} == {0}


def test_modularity_by_levels(spark):
    """A ring of 24 cliques of 5: the modularity said is that of the labels, and levels raise it."""
    links = []
    for g in range(24):
        v = list(range(5 * g, 5 * g + 5))
        links += [(i, j, 1.0) for i in v for j in v if i < j] + [tuple(sorted((v[0], (5 * g + 9) % 120))) + (1.0,)]
    df = spark.createDataFrame(links, "a long, b long, w double")
    for levels in (1, 4):
        labels, said = clusters.communities(df, levels=levels)
        m = {r["c"]: r["m"] for r in labels.collect()}
        k, whole = {}, 2.0 * len(links)
        for a, b, _ in links:
            k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
        q = sum(2 for a, b, _ in links if m[a] == m[b]) / whole - sum((sum(k[c] for c in k if m[c] == x) / whole) ** 2 for x in set(m.values()))
        assert len(m) == 120 and abs(said[-1][2] - q) < 1e-9 and said[-1][1] == len(set(m.values()))
    assert said[-1][2] > 0.8 and all(x[2] < y[2] for x, y in zip(said, said[1:], strict=False))
    assert clusters.communities(df.limit(0))[0].count() == 0


def test_large_cells_are_split(spark, monkeypatch):
    """Cells far over their size still give the neighbours: recall of the lists on one dense region."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal(64) + 0.5 * rng.standard_normal((600, 64))).astype(np.float32)
    monkeypatch.setattr(clusters, "CELL", 16)
    monkeypatch.setattr(clusters, "PIVOTS", 2)
    dirs = vectors.directions(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]))[0]
    s = truth(x)
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, axis=1)[:, :12]
    got = {r["c"]: {y["o"] for y in r["l"]} for r in clusters.neighbour_graph(dirs).collect()}
    assert np.mean([len(got[i] & set(near[i].tolist())) / 12 for i in range(len(x))]) > 0.9
