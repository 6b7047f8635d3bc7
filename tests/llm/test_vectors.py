"""Searches and codes over integer vectors against brute force: skewed, empty, broken and repeated rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from regfeed.llm import norm_topk, shared_lists, trie_codes, vector_lists

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def rows_of(seed, n=900, size=8):
    """Vectors of very different lengths around a few directions; a third of them are one vector, and some are broken."""
    rnd = np.random.default_rng(seed)
    centers = rnd.standard_normal((5, size))
    rows = []
    for k in range(n):
        v = centers[k % 5] * rnd.lognormal(0, 1) + rnd.standard_normal(size) * 0.1
        if k % 3 == 0:
            v = centers[0] * 0.7
        rows.append((k, [float(np.float32(x)) for x in v], int(rnd.integers(0, 3)) if k % 2 else 1))
    broken = [(-7, None, 1), (n, [NAN] * size, 1), (n + 1, [1.0, INF] + [0.0] * (size - 2), 1), (n + 2, [None] * size, 1), (None, [1.0] * size, 1)]
    odd = [(n + 20, [0.0] * size, 2), (2 * n, [1.0] * (size // 2), 1), (2 * n + 100, [], 1), (2 * n + 101, [], 0), (n + 40, [3e30] + [-3e30] * (size - 1), None)]
    # Repeated rows, and an id with several vectors and labels.
    again = [rows[40], rows[40], rows[300], (100, [0.5] * size, 0), (100, [-0.5] * size, 2)]
    return rows + broken + odd + again


def whole(rows, scale, by_label=True):
    """One row for each id, the least by label and components: whole components and label."""
    out = {}
    order = lambda r: ((r[1] is not None, r[1]) if by_label else 0, r[0])
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        top = math.isqrt(2**60 // max(len(v), 1))
        row = (tuple(max(-top, min(top, math.floor(x * scale))) for x in v), label)
        out[i] = min(out.get(i, row), row, key=order)
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def best(rows, query_every, k, scale):
    known = whole(rows, scale, False)
    out = set()
    for q, (v, _) in known.items():
        if q % query_every == 0:
            found = sorted((-dot(v, w), i) for i, (w, _) in known.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("limits", [(4_096, 256, 512), (50, 7, 16)])
def test_top_inner_products(spark, monkeypatch, limits):
    rows = rows_of(1)
    for name, value in zip(("ROWS", "BLOCK", "CHUNK"), limits, strict=True):
        monkeypatch.setattr(norm_topk, name, value)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as query_id", "3 as part").repartition(5)
    got = [tuple(r) for r in norm_topk.top_inner_products(frame, 20, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == best(rows, 20, 5, 64)


def test_search_stops_at_the_bound():
    """A query that long vectors satisfy looks at no later chunk, and what it finds is exact."""
    rnd = np.random.default_rng(3)
    x = rnd.integers(-9, 10, (4_000, 6)) * np.repeat([50, 1], [100, 3_900])[:, None]
    x = x[np.argsort(-(x**2).sum(1), kind="stable")].astype(np.int16)
    make = lambda m, ids: vector_lists.Block({"n": len(m), "size": 6, "ids": ids.astype(np.int64).tobytes(), "ints": m.tobytes(), "kind": m.dtype.str})
    segment, query = make(x, np.arange(4_000)), make(x[:3], np.arange(10_000, 10_003))
    seen = []
    best_ = vector_lists.Best(5, np.full(3, vector_lists.NOTHING))
    rotation = norm_topk.rotations([{"size": 6, "ints": r} for r in x[::7].tolist()])[6]
    head, tail = norm_topk.turned(segment.ints, segment.norms, rotation)
    real = vector_lists.exact
    norm_topk.exact = lambda a, b: seen.append(len(b)) or real(a, b)
    try:
        norm_topk.search_segment(segment, head, tail, query, *norm_topk.turned(query.ints, query.norms, rotation), best_)
    finally:
        norm_topk.exact = real
    assert sum(seen) <= norm_topk.CHUNK
    scores = x[:3].astype(int) @ x.astype(int).T
    for k in range(3):
        order = np.lexsort((np.arange(4_000), -scores[k]))[:5]
        assert best_.id[best_.member == k].tolist() == order.tolist()


def mined(rows, anchor_every, scale=256):
    known = whole([r for r in rows if r[2] is not None], scale)
    known = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in known.items()}
    out = set()
    for a, (v, label) in known.items():
        if a % anchor_every:
            continue
        scored = sorted((-dot(v, w), i) for i, (w, _) in known.items() if i != a and len(w) == len(v))
        positives = [(i, -s) for s, i in scored if known[i][1] == label][:5]
        for p, score in positives:
            negatives = [(i, -s) for s, i in scored if known[i][1] != label and 80 * score <= -100 * s <= 100 * score][:5]
            out |= {(a, p, n + 1, i, score, s) for n, (i, s) in enumerate(negatives)}
    return out


@pytest.mark.parametrize("limits", [(2_048, 256, 512), (40, 5, 16)])
def test_hard_negatives(spark, monkeypatch, limits):
    rows = rows_of(2)
    for name, value in zip(("ROWS", "BLOCK", "CHUNK"), limits, strict=True):
        monkeypatch.setattr(shared_lists, name, value)
    monkeypatch.setattr(shared_lists, "ANCHORS_A_CLUSTER", 8)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cluster", "2 as size", "3 as peak").repartition(5)
    got = [tuple(r) for r in shared_lists.hard_negatives(frame, 20).collect()]
    want = mined(rows, 20)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want


def test_bounds_hold_for_every_member():
    rnd = np.random.default_rng(5)
    anchors, x = rnd.integers(-99, 100, (200, 7)), rnd.integers(-99, 100, (500, 7))
    x[0] = 0
    fitted = shared_lists.centroids([{"size": 7, "ints": r} for r in anchors.tolist()], 6)
    near = shared_lists.cosines(anchors, fitted[7])
    cluster = near.argmax(1)
    spread = {(7, c): float(np.arccos(near[cluster == c, c].min())) for c in set(cluster.tolist())}
    block = vector_lists.Block({"n": 500, "size": 7, "ids": np.arange(500).tobytes(), "ints": x.tobytes(), "kind": "<i8"})
    lists = shared_lists.Lists(fitted, spread)
    for q, c in zip(anchors, cluster.tolist(), strict=True):
        assert (x @ q <= np.sqrt((q**2).sum()) * lists.bounds(block, c) + 1e-6).all()


def coded(rows, scale=1_024):
    """Codes of the vectors of the commonest length by plain loops over all entries."""
    known = sorted((i, v, label) for i, (v, label) in whole(rows, scale).items() if len(v) == 8)
    books = [[v[2 * p : 2 * p + 2] for _, v, _ in known[:256]] for p in range(4)]

    def assign():
        out = []
        for p in range(4):
            entries = np.array(books[p], object)
            distance = [((np.array(v[2 * p : 2 * p + 2], object) - entries) ** 2).sum(1) for _, v, _ in known]
            out.append([(int(np.argmin(d)), int(min(d))) for d in distance])
        return out

    for _ in range(4):
        found = assign()
        for p in range(4):
            for e in range(len(books[p])):
                mine = [v[2 * p : 2 * p + 2] for (_, v, _), (c, _) in zip(known, found[p], strict=True) if c == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    found = assign()
    errors = [sum(found[p][k][1] for p in range(4)) for k in range(len(known))]
    sums = {}
    for (_, _, label), e in zip(known, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = {(i, "".join(f"{found[p][k][0]:02x}" for p in range(4)), errors[k], min(sums[label], 2**63 - 1)) for k, (i, _, label) in enumerate(known)}
    return codes, digest


@pytest.mark.parametrize("leaves", [512, 4])
def test_codes(spark, monkeypatch, leaves):
    rows = rows_of(4, 400)
    monkeypatch.setattr(trie_codes, "LEAVES", leaves)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as code").repartition(5)
    out, books = trie_codes.compress(frame)
    got = [tuple(r) for r in out.collect()]
    want, digest = coded(rows)
    assert trie_codes.digest(books) == digest
    other = {(i, None, None, None) for i, (v, _) in whole(rows, 1_024).items() if len(v) != 8}
    assert len(got) == len(set(got)) and set(got) == want | other and len(other) == 3


@pytest.mark.parametrize("leaves", [1, 3, 512])
def test_trie_finds_the_nearest_entry(monkeypatch, leaves):
    monkeypatch.setattr(trie_codes, "LEAVES", leaves)
    rnd = np.random.default_rng(6)
    for size, spread, n in ((4, 3, 700), (1, 50, 300), (3, 1 << 27, 200), (5, 2, 1), (2, 1, 400)):
        parts = np.unique(rnd.integers(-spread, spread + 1, (n, size)), axis=0)
        entries = rnd.integers(-spread, spread + 1, (40, size))
        distance = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        code, least = trie_codes.nearest(parts, entries)
        assert code.tolist() == distance.argmin(1).tolist() and least.tolist() == distance.min(1).tolist()


def test_children_share_their_prefix(monkeypatch):
    """Dimensions are added once for each different prefix, not once for each part."""
    made = []
    real = np.cumsum
    monkeypatch.setattr(trie_codes.np, "cumsum", lambda a: made.append(int(np.count_nonzero(a))) or real(a))
    parts = np.array([(1, 2, 3, k) for k in range(100)])
    trie_codes.nearest(parts, np.zeros((3, 4), int))
    assert made == [1, 1, 1, 100]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert norm_topk.top_inner_products(none).count() == 0
    assert shared_lists.hard_negatives(none).count() == 0
    codes, books = trie_codes.compress(none)
    assert codes.count() == 0 and trie_codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_one_label_and_few_rows(spark):
    rnd = random.Random(1)
    rows = [(k * 100 + 1, [rnd.random() for _ in range(4)], 1) for k in range(3)] + [(0, [1.0, 1.0, 1.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert shared_lists.hard_negatives(frame).count() == 0
    assert {(r.query_id, r.vec_id) for r in norm_topk.top_inner_products(frame).collect()} == {(0, 1), (0, 101), (0, 201)}


def test_exact_products():
    rnd = np.random.default_rng(7)
    for top in (9, 2**20, 2**28):
        a, b = rnd.integers(-top, top, (5, 16)), rnd.integers(-top, top, (7, 16))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert vector_lists.exact(vector_lists.narrow(a), b).tolist() == want
