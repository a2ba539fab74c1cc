"""Admission by two coupled limits against a plain loop, over many segments of time; regions around drawings against a plain loop over captions."""

import random
from collections import Counter

from brindle.operators import layout, logs


def loop(rows, per_owner, in_all):
    held, out = Counter(), {}
    for owner, _, i, change in sorted(rows, key=lambda r: (r[1], r[2])):
        ok = held[owner] < per_owner and sum(held.values()) < in_all if change > 0 else held[owner] > 0
        held[owner] += change if ok else 0
        out[i] = ok, held[owner]
    return out


def test_admission(spark):
    random.seed(8)
    for starts, sizes in ((0.5, (10_000, 97)), (0.9, (150,))):
        rows = [(f"o{random.randint(0, 9)}", float(random.randint(0, 400)), i, 1 if random.random() < starts else -1) for i in range(900)]
        log = spark.createDataFrame(rows, "owner string, at double, id long, change int")
        want = loop(rows, 3, 11)
        for size in sizes:
            got = {r.id: (r.admitted, r.running) for r in logs.admitted(log, 3, 11, segment_rows=size).collect()}
            assert got == want, (starts, size)
    assert logs.admitted(log.limit(0)).count() == 0


def test_a_segment_that_must_be_settled_in_turn(spark):
    """A house that stays full: each segment's decisions depend on the first rows."""
    rows = [("a", float(i), i, 1) for i in range(6)] + [(f"b{i % 40}", 10.0 + i, 6 + i, 1) for i in range(200)] + [("a", 300.0, 206, -1), ("z", 301.0, 207, 1), ("z", 302.0, 208, 1)]
    got = {r.id: (r.admitted, r.running) for r in logs.admitted(spark.createDataFrame(rows, "owner string, at double, id long, change int"), 6, 24, segment_rows=60).collect()}
    assert got == loop(rows, 6, 24) and got[207] == (True, 1) and got[208] == (False, 1)


def test_vector_regions(spark):
    random.seed(9)
    box = lambda w, h: (lambda x, y: (x, y, x + random.randint(5, w), y + random.randint(5, h)))(random.randint(0, 300), random.randint(0, 600))
    captions = [(d, p, n, *map(float, box(200, 14))) for d in range(3) for p in range(3) for n in range(5)]
    drawings = [(d, p, *map(float, box(150, 120))) for d in range(3) for p in range(3) for _ in range(9)]
    regions = [(d, p, *map(float, box(250, 200))) for d in range(3) for p in range(2)]
    want = set()
    for d in range(3):
        for p in range(3):
            kept = [r[2:] for r in regions if r[:2] == (d, p)]
            for _, _, n, x0, y0, x1, y1 in sorted(c for c in captions if c[:2] == (d, p)):
                taken = False
                for a0, b0, a1, b1 in kept:
                    if min(x1, a1) > max(x0, a0) and (y0 >= b1 - 8 or y1 <= b0 + 8):
                        taken |= max(0, y0 - b1 if y0 >= b1 - 8 else b0 - y1) <= 90
                parts = [g[2:] for g in drawings if g[:2] == (d, p) and y0 - 260 <= g[3] < y0 and g[5] <= y0 + 3 and g[4] > x0 and g[2] < x1]
                if taken or not parts:
                    continue
                a, b, c, e = min(g[0] for g in parts), min(g[1] for g in parts), max(g[2] for g in parts), max(g[3] for g in parts)
                if c - a < 40 or e - b < 30:
                    continue
                r = (a - 4, b - 4, c + 4, e + 4)
                area = (r[2] - r[0]) * (r[3] - r[1])
                if any(max(0, min(r[2], k[2]) - max(r[0], k[0])) * max(0, min(r[3], k[3]) - max(r[1], k[1])) >= 0.8 * area for k in kept):
                    continue
                kept.append(r)
                want.add((d, p, n, *r))
    kind = "x0 double, y0 double, x1 double, y1 double"
    got = layout.vector_regions(spark.createDataFrame(captions, f"doc long, page int, n long, {kind}"), spark.createDataFrame(drawings, f"doc long, page int, {kind}"), spark.createDataFrame(regions, f"doc long, page int, {kind}"))
    assert want and {tuple(r) for r in got.select("doc", "page", "caption", "x0", "y0", "x1", "y1").collect()} == want
