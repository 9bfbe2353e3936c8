import numpy as np

from maternis.llm import itq as I


def brute(rows):
    """Links, by vec_id, of usable rows with equal labels."""
    items = [(k, y, u) for k, y, v in rows if k is not None and y is not None and (u := I.usable(v)) is not None]
    links = set()
    for y in {i[1] for i in items}:
        mine = [(k, u) for k, q, u in items if q == y]
        x = np.stack([u for _, u in mine])
        for a, b in zip(*np.nonzero(x @ x.T >= I.COSINE)):
            if mine[a][0] < mine[b][0]:
                links.add((mine[a][0], mine[b][0]))
    return links


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        r, s = sorted((find(a), find(b)))
        parent[s] = r
    return {i: find(i) for i in ids}


def planted(seed=4, groups=25, alone=400):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=64)
        for _ in range(int(rng.integers(2, 90))):
            rows.append((int(g % 3), base + rng.normal(size=64) * rng.uniform(0, 0.13) * np.linalg.norm(base) / 8))
    rows += [(int(i % 3), rng.normal(size=64)) for i in range(alone)]
    return [(int(k), y, [float(f) for f in np.float32(v)]) for k, (y, v) in zip(rng.permutation(len(rows)), rows)]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 16)
    rows = planted()
    want = brute(rows)
    got = {r.vec_id: r for r in I.near_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")).collect()}
    assert len(got) == len(rows) and len(want) > 5000
    degree = {k: 0 for k in got}
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    assert all(got[k].n_links <= degree[k] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(want)
    right = classes(list(got), want)
    assert np.mean([got[k].component_id == right[k] for k in got]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_every_length_is_coded_and_found(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n, groups in ((64, 60), (24, 40), (130, 3), (1, 2), (7, 5)):
        for g in range(groups):
            base = rng.normal(size=n)
            rows += [(len(rows), 0, [float(x) for x in base * s]) for s in (1.0, 2.5)] if n > 1 else [(len(rows), 0, [float(g + 1)])]
    rows = [(k, y, v) for k, (_, y, v) in enumerate(rows)]
    got = {r.vec_id: r for r in I.near_vectors(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")).collect()}
    links = set()
    for a, _, u in rows:
        for b, _, v in rows:
            if a < b and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= I.COSINE:
                links.add((a, b))
    degree = np.zeros(len(rows), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert [got[k].n_links for k in range(len(rows))] == degree.tolist() and len(links) > 100


def test_rotation_is_orthogonal_and_lowers_the_error():
    x = np.random.default_rng(0).normal(size=(500, 16)) * np.linspace(3, 0.2, 16)
    mean, p = I.learn_rotation(x)
    assert np.allclose(p.T @ p, np.eye(16))
    error = lambda q: np.square(np.where((x - mean) @ q >= 0, 1, -1) - (x - mean) @ q).sum()
    assert error(p) < error(np.linalg.svd(x - mean)[2].T)


def test_query_against_brute_force(spark):
    from maternis.llm.queries import op9_itq
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op9_itq(spark, sf).collect()}
    links = brute(rows)
    degree = {k: 0 for k, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    c = classes(list(degree), links)
    assert got == {k: (degree[k], c[k]) for k in degree}


def test_unusable_vectors_repeats_clashes_and_empty_table(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, 0, v, 1), (2, 0, [2.0, 0.0, 1.0], 2), (2, 0, [2.0, 0.0, 1.0], 2), (3, 1, v, 3), (4, None, v, 4), (5, 0, None, 5),
            (6, 0, [0.0, 0.0, 0.0], 6), (7, 0, [1.0, None, 0.5], 7), (8, 0, [float("nan"), 0.0, 0.5], 8),
            (9, 0, [float("inf"), 0.0, 0.5], 9), (10, 0, [], 10), (11, 0, [1.0, 0.0], 11), (None, 0, v, 12),
            (12, 0, [1e-30, 0.0, 5e-31], 13), (13, 0, [3.0, 0.0], 14), (14, 1, [1.0, 0.0], 15)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, code int")
    out = I.near_vectors(df).collect()
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in out)
    # rows 11 and 13 are of another length than most, and equal in direction and label
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 14)] + [(11, 1, 11, True), (13, 1, 11, False)]
    assert got == sorted([(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (12, 2, 1, False)] + alone)
    assert I.near_vectors(df.limit(0)).collect() == []
