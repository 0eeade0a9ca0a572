import numpy as np

from quarrylane.llm import embedding_dedup as E


def brute(ids, vectors, threshold=0.9):
    """(n_links, component) by all pairs."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    n = len(ids)
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    small = {}
    for i in range(n):
        small[label[i]] = min(small.get(label[i], ids[i]), ids[i])
    return {ids[i]: (links[i], small[label[i]]) for i in range(n)}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_matches_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert found(E.near_duplicates(table)) == want
    assert found(E.near_duplicates(table, tile_rows=70)) == want


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1.0]), (12, [-1.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, uid string, h int")
    assert found(E.near_duplicates(table)) == brute([i for i, _ in rows], [v for _, v in rows])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(empty).collect() == []
    none = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in E.near_duplicates(none).collect()) == [(0, 0, True), (1, 0, True)]


def test_bounds_drop_no_link():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = base[rng.integers(0, 40, 300)] + 0.15 * rng.normal(size=(300, 16))
    tile = E.Tile(x, E.principal_basis(x))
    i, j = E.linked(tile, tile, slice(0, 300))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(unit @ unit.T >= 0.9))))


def test_merge_labels():
    label = np.arange(8)
    E.merge_labels(label, np.array([7, 5, 3]), np.array([5, 3, 6]))
    assert label.tolist() == [0, 1, 2, 3, 4, 3, 3, 3]


def clustered(groups=24, each=60, dim=32):
    """Vectors in groups that lie apart."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, groups * each)] + 0.12 * rng.normal(size=(groups * each, dim))
    return x.astype(np.float32).astype(float)


def test_tile_bounds_drop_no_pair():
    x = clustered()
    curve = E.Curve.fit(x[:500])
    code, y, rest = curve.place(x)
    order = np.argsort(code, kind="stable")
    tiles = [order[at : at + 40] for at in range(0, len(x), 40)]
    box = [np.array([f(y[t], axis=0) for t in tiles]) for f in (np.min, np.max)]
    far = np.array([rest[t].max() for t in tiles])
    near = E.near_boxes(*box, far, *box, far)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    reach = np.array([[(unit[a] @ unit[b].T).max() >= 0.9 for b in tiles] for a in tiles])
    assert (near >= reach).all() and near.mean() < 0.7


def test_far_tiles_are_not_compared(spark, monkeypatch):
    """On vectors in groups most pairs of tiles are left out, fewer of them the more tiles there are, and nothing is lost."""
    x = clustered()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(E, "PAGE_TILES", 5)
    kept = []
    real = E.tile_pairs

    def counted(placed, tiles, *rest):
        out = real(placed, tiles, *rest)
        kept.append(out.count() / (tiles * (tiles + 1) / 2))
        return out

    monkeypatch.setattr(E, "tile_pairs", counted)
    want = brute(list(range(len(x))), x.tolist())
    assert found(E.near_duplicates(table, tile_rows=60)) == want
    assert found(E.near_duplicates(table, tile_rows=20)) == want
    monkeypatch.setattr(E, "BROADCAST_PAIRS", 1)
    assert found(E.near_duplicates(table, tile_rows=60)) == want
    assert kept[0] < 0.9 and kept[1] < 0.7 * kept[0]


def test_huge_and_tiny_components(spark):
    """Components whose squares overflow or vanish link like any other."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2.1e200]), (3, [1e-200, 1e-200]), (4, [1e200, -1e200]), (5, [3.0, 3.0]), (6, [5e-324, 0.0])]
    got = found(E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (0, 6)}


def test_wide_vectors(spark):
    """At 3,072 dimensions a tile holds fewer rows."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(6, 3072))
    rows = [(i, [float(x) for x in base[i % 6] + (0.1 if i < 12 else 3.0) * rng.normal(size=3072)]) for i in range(18)]
    assert E.TILE_BYTES // (8 * 3072) < E.TILE_ROWS
    assert found(E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile_rows=5)) == brute([i for i, _ in rows], [v for _, v in rows])


def test_common_vectors_come_to_their_copies(spark, monkeypatch):
    """Copies and components beyond the bound take the broadcast path, and give what the shuffle gives."""
    from quarrylane.llm import staging

    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(12, 6))
    near = [vectors[0] + rng.normal(size=6) * 0.01 for _ in range(30)]
    rows = [(i, (near[i % 30] if i % 3 else vectors[i % 4]).tolist()) for i in range(240)] + [(900 + i, None) for i in range(40)] + [(500 + i, [0.0] * 6) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute([i for i, _ in rows], [v for _, v in rows])
    assert found(E.near_duplicates(table)) == want
    monkeypatch.setattr(staging, "HOT_ROWS", 9)
    assert found(E.near_duplicates(table)) == want
    assert staging.hot_bound(10**12, 100) == 10**10 and staging.hot_bound(5, 100) == 9
