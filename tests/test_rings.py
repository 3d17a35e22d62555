"""Rings around regions and their simplification, against plain versions that hold a whole image."""

import numpy as np
import pytest

from slidespark.operators import rings


def mask_of(spark, image):
    rows = [(int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(image) if v >= 0]
    return spark.createDataFrame(rows, "y int, x int, label int").repartition(3)


def rings_of(df):
    out = {}
    for r in df.orderBy("label", "ring", "i").collect():
        out.setdefault((r["label"], r["ring"]), []).append((r["x"], r["y"]))
        assert r["i"] == len(out[r["label"], r["ring"]]) - 1
    return out


def plain(image):
    """Rings by walking along unit sides, the region to the right, turning right where two ways are open."""
    found = set()
    h, w = image.shape
    same = lambda y, x, v: 0 <= y < h and 0 <= x < w and image[y, x] == v
    for v in set(image.ravel().tolist()) - {-1}:
        sides = {}
        for y, x in zip(*np.nonzero(image == v), strict=True):
            y, x = int(y), int(x)
            for d, (dy, dx), a in ((0, (-1, 0), (x, y)), (1, (0, 1), (x + 1, y)), (2, (1, 0), (x + 1, y + 1)), (3, (0, -1), (x, y + 1))):
                if not same(y + dy, x + dx, v):
                    sides[a, d] = (a[0] + rings.STEPS[d][0], a[1] + rings.STEPS[d][1])
        while sides:
            a, d = min(sides)
            ring, came = [], None
            while (a, d) in sides:
                to = sides.pop((a, d))
                if d != came:
                    ring.append((a, d))
                came, a = d, to
                ways = [k for k in range(4) if (a, k) in sides]
                d = ways[0] if len(ways) == 1 else (d + 1) % 4
            # the first corner is one only if the ring turns there
            if ring and ring[0][1] == came:
                ring.pop(0)
            k = ring.index(min(ring))
            found.add((v, tuple(a for a, _ in ring[k:] + ring[:k])))
    return found


@pytest.mark.parametrize("square", (512, 5, 1))
def test_trace(spark, square):
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 2, (17, 13)), rng.integers(0, 3, (9, 20)) - 1, np.zeros((6, 6), int), np.array([[1, 0, 1], [0, 1, 0], [1, 0, 1]])]
    for image in {512: images[:1], 5: images[:2], 1: images[2:]}[square]:
        found = rings_of(rings.trace(mask_of(spark, image), square))
        assert {(label, tuple(p)) for (label, _), p in found.items()} == plain(image)
        assert len(found) == len({(label, tuple(p)) for (label, _), p in found.items()})


def test_trace_of_a_long_ring(spark):
    """A spiral: one ring through many squares, many rounds of doubling."""
    image, y, x, step = -np.ones((41, 41), int), 0, 0, 0
    image[0, :] = 1
    n, y, x = 40, 0, 40
    for d in (1, 2, 3, 0) * 10:
        dx, dy = rings.STEPS[d]
        for _ in range(n):
            y, x = y + dy, x + dx
            image[y, x] = 1
        step += 1
        n -= 2 * (step % 2 == 0)
        if n <= 0:
            break
    found = rings_of(rings.trace(mask_of(spark, image), 4))
    assert {(label, tuple(p)) for (label, _), p in found.items()} == plain(image)
    assert rings.trace(mask_of(spark, image).limit(0)).count() == 0


def far(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = np.hypot(dx, dy)
    return abs((p[0] - a[0]) * dy - (p[1] - a[1]) * dx) / n if n else np.hypot(p[0] - a[0], p[1] - a[1])


def thin(ring, epsilon):
    """Douglas and Peucker by recursion."""

    def arc(a, b):
        inner = list(range(a + 1, b))
        if not inner:
            return []
        k = max(inner, key=lambda i: (far(ring[i % len(ring)], ring[a % len(ring)], ring[b % len(ring)]), -i))
        if far(ring[k % len(ring)], ring[a % len(ring)], ring[b % len(ring)]) <= epsilon:
            return []
        return [*arc(a, k), k, *arc(k, b)]

    top = max(range(len(ring)), key=lambda i: (np.hypot(ring[i][0] - ring[0][0], ring[i][1] - ring[0][1]), -i))
    return [0, *arc(0, top), *([top] if top else []), *arc(top, len(ring))]


@pytest.mark.parametrize("few", (4096, 0))
def test_simplify(spark, few):
    rng = np.random.default_rng(9)
    yy, xx = np.indices((40, 44))
    image = np.where((yy - 19) ** 2 + (xx - 21) ** 2 < 300 + rng.integers(-60, 60, (40, 44)), 1, 0)
    traced = rings.trace(mask_of(spark, image))
    held = rings_of(traced)
    for epsilon in (1.0, 2.5) if few else (2.5,):
        got = {}
        for r in rings.simplify(traced, epsilon, few=few).orderBy("label", "ring", "i").collect():
            got.setdefault((r["label"], r["ring"]), []).append((r["i"], r["x"], r["y"]))
        assert got == {k: [(i, *map(float, p[i])) for i in thin(p, epsilon)] for k, p in held.items()}
    share = rings.simplify(traced, 0.01, of_length=True, few=few)
    length = {k: sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:] + p[:1], strict=True)) for k, p in held.items()}
    want = {k: [i for i in thin(p, 0.01 * length[k])] for k, p in held.items()}
    got = {}
    for r in share.orderBy("label", "ring", "i").collect():
        got.setdefault((r["label"], r["ring"]), []).append(r["i"])
    assert got == want


def test_simplify_of_a_triangle(spark):
    corners = [(0, 0), (4, 0), (8, 0), (8, 8), (4, 4)]
    df = spark.createDataFrame([("a", 7, i, x, y) for i, (x, y) in enumerate(corners)], "label string, ring long, i int, x int, y int")
    assert [(r["x"], r["y"]) for r in rings.simplify(df, 0.5).orderBy("i").collect()] == [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0)]
    assert rings.simplify(df, 0.5, few=0).count() == 3 and rings.simplify(df.limit(0)).count() == 0
