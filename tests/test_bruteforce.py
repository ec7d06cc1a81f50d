"""Operators against plain Python on small random inputs, skew paths included."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.boxes import Box, box_iou
from tessera.functions.losses import contrastive
from tessera.operators import components as cc
from tessera.operators import matching, neighbours, ranking, sampling
from tessera.operators import morphology as mo
from tessera.operators import range_join as rj
from tessera.operators.contours import outline_parts, outlines
from tessera.operators.flood import split_by_markers
from tessera.operators.runs import local_runs, to_pixels, to_runs
from tessera.operators.series import smoothed
from tessera.operators.stencil import binomial, correlation, entropy, median, stencil


def pixels(spark, images):
    rows = [(i, x, y) for i, px in images.items() for x, y in px]
    return spark.createDataFrame(rows, "image_id int, x int, y int")


def noise(seed, w, h, share):
    rnd = random.Random(seed)
    return {(x, y) for x in range(w) for y in range(h) if rnd.random() < share}


def flood(px):
    """Component of every pixel, named after its first pixel in raster order."""
    left, out = set(px), {}
    for start in sorted(px, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        todo = [start]
        left.discard(start)
        while todo:
            x, y = todo.pop()
            out[(x, y)] = start[1] * 2**32 + start[0]
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return out


def as_sets(df, value=None):
    out = collections.defaultdict(dict)
    for r in df.collect():
        out[r["image_id"]][(r["x"], r["y"])] = r[value] if value else 1
    return out


@pytest.mark.parametrize("block", [8, 512])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(cc, "BLOCK", block)
    spiral = {(x, 0) for x in range(30)} | {(29, y) for y in range(30)} | {(x, 29) for x in range(4, 30)} | {(4, y) for y in range(4, 30)} | {(x, 4) for x in range(4, 26)}
    images = {1: noise(1, 40, 33, 0.6), 2: noise(2, 25, 25, 0.4), 3: spiral, 4: {(0, 0)}}
    got = as_sets(cc.label_pixels(pixels(spark, images), ["image_id"]), "comp")
    for i, px in images.items():
        assert got[i] == flood(px)


def test_star_contraction_of_long_chains(spark):
    rnd = random.Random(5)
    order = list(range(400))
    rnd.shuffle(order)
    edges = [(1, max(a, b), min(a, b)) for a, b in zip(order[:250], order[1:251])] + [(1, 900, 800)]
    df = spark.createDataFrame(edges, "k int, a bigint, b bigint")
    got = {(r.a, r.b) for r in cc.contract(df, ["k"]).collect()}
    nodes = set(order[:251])
    assert got == {(n, min(nodes)) for n in nodes if n != min(nodes)} | {(900, 800)}


def dilated(px, element, w, h):
    return {(x, y) for x in range(w) for y in range(h) if any((x + dx, y + dy) in px for dy, lo, hi in element for dx in range(lo, hi + 1))}


def eroded(px, element, w, h, outside):
    inside = lambda x, y: 0 <= x < w and 0 <= y < h
    ok = lambda x, y: (x, y) in px if inside(x, y) else outside
    return {(x, y) for x, y in ((x, y) for x in range(w) for y in range(h)) if all(ok(x + dx, y + dy) for dy, lo, hi in element for dx in range(lo, hi + 1))}


def filled(px):
    if not px:
        return set()
    xs, ys = [x for x, _ in px], [y for _, y in px]
    x0, x1, y0, y1 = min(xs) - 1, max(xs) + 1, min(ys) - 1, max(ys) + 1
    seen, todo = {(x0, y0)}, [(x0, y0)]
    while todo:
        x, y = todo.pop()
        for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if x0 <= q[0] <= x1 and y0 <= q[1] <= y1 and q not in px and q not in seen:
                seen.add(q)
                todo.append(q)
    return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - seen


def small_holes_filled(px, w, h, limit):
    unset = flood({(x, y) for x in range(w) for y in range(h)} - px)
    size = collections.Counter(unset.values())
    return px | {p for p, c in unset.items() if size[c] < limit}


def without_small(px, limit):
    comp = flood(px)
    size = collections.Counter(comp.values())
    return {p for p, c in comp.items() if size[c] >= limit}


ELEMENTS = [mo.ellipse(3), mo.ellipse(11), mo.ellipse(10), mo.ellipse(1), mo.disk(3)]


@pytest.mark.parametrize("n", range(len(ELEMENTS)))
def test_dilate_erode(spark, n):
    element, w, h = ELEMENTS[n], 30, 26
    images = {1: noise(3, w, h, 0.1), 2: dilated(noise(4, w, h, 0.04), mo.disk(4), w, h), 3: {(x, y) for x in range(w) for y in range(h)}}
    frames = spark.createDataFrame([(i, w, h) for i in images], "image_id int, w int, h int")
    runs = to_runs(pixels(spark, images), ["image_id"]).join(frames, "image_id")
    big = as_sets(to_pixels(mo.dilate(runs, ["image_id"], element, framed=True), ["image_id"]))
    kept = as_sets(to_pixels(mo.erode(runs, ["image_id"], element, framed=True), ["image_id"]))
    bare = as_sets(to_pixels(mo.erode(runs, ["image_id"], element), ["image_id"]))
    for i, px in images.items():
        assert set(big[i]) == dilated(px, element, w, h)
        assert set(kept[i]) == eroded(px, element, w, h, True)
        assert set(bare[i]) == eroded(px, element, w, h, False)
        assert set(kept[i]) <= px <= set(big[i]) or n == 2


def test_fill_holes(spark):
    images = {1: noise(7, 30, 30, 0.6), 2: {(x, y) for x in range(9) for y in range(9) if max(abs(x - 4), abs(y - 4)) in (1, 4)}, 3: {(0, 0), (1, 5), (4, 5)}}
    runs = to_runs(pixels(spark, images), ["image_id"])
    got = as_sets(to_pixels(mo.fill_holes(runs, ["image_id"]), ["image_id"]))
    for i, px in images.items():
        assert set(got[i]) == filled(px)


def test_refine_tissue(spark):
    w = h = 40
    images = {1: dilated(noise(8, w, h, 0.05), mo.disk(3), w, h), 2: dilated(noise(9, w, h, 0.02), mo.disk(4), w, h)}
    frames = spark.createDataFrame([(i, w, h) for i in images], "image_id int, w int, h int")
    got = as_sets(mo.refine_tissue(pixels(spark, images), frames, radius=1, limit=20))
    for i, px in images.items():
        want = eroded(px, mo.disk(1), w, h, False)
        want = without_small(small_holes_filled(want, w, h, 20), 20)
        want = filled(small_holes_filled(dilated(want, mo.disk(1), w, h), w, h, 20))
        assert set(got[i]) == want


def test_grow_instances(spark):
    w, h, size, limit = 44, 40, 3, 6
    images = {1: noise(11, w, h, 0.35), 2: {(x, y) for x in range(w) for y in range(h) if (x - 20) ** 2 + (y - 20) ** 2 in range(90, 170)}}
    frames = spark.createDataFrame([(i, w, h) for i in images], "image_id int, w int, h int")
    got = as_sets(mo.grow_instances(pixels(spark, images), frames, size, limit), "comp")
    for i, px in images.items():
        comp, want = flood(px), {}
        for c in sorted(set(comp.values())):
            own = {p for p, k in comp.items() if k == c}
            if len(own) < limit:
                continue
            x0, x1 = min(x for x, _ in own), max(x for x, _ in own) + 1
            y0, y1 = min(y for _, y in own), max(y for _, y in own) + 1
            pad = 2 * size
            x0, y0 = (x0 - pad if x0 >= pad else x0), (y0 - pad if y0 >= pad else y0)
            x1, y1 = (x1 + pad if x1 + pad <= w - 1 else x1), (y1 + pad if y1 + pad <= h - 1 else y1)
            grown = {p for p in dilated(own, mo.ellipse(size), w, h) if x0 <= p[0] < x1 and y0 <= p[1] < y1}
            for p in filled(grown):
                want[p] = c
        assert got[i] == want


def test_nuclei_from_heads(spark):
    rnd, w, h = random.Random(21), 30, 28
    blobs = [(rnd.randrange(w), rnd.randrange(h), rnd.randrange(2, 5)) for _ in range(14)]
    scores = {}
    for x in range(w):
        for y in range(h):
            d = min(math.hypot(x - a, y - b) / r for a, b, r in blobs)
            scores[(x, y)] = (0.9 if d < 0.55 else 0.1, 0.8 if 0.55 <= d < 1.1 else 0.05)
    df = spark.createDataFrame([(1, x, y, i, r) for (x, y), (i, r) in scores.items()], "image_id int, x int, y int, inner double, ring double")
    frames = spark.createDataFrame([(1, w, h)], "image_id int, w int, h int")
    got = as_sets(mo.nuclei_from_heads(df, frames), "marker")[1]
    mask = without_small(eroded({p for p, (i, r) in scores.items() if i + r > 0.5}, mo.ellipse(3), w, h, True), 8)
    seeds = flood(filled(without_small({p for p, (i, _) in scores.items() if i > 0.5}, 4)))
    want = {p: c for p, c in seeds.items() if p in mask}
    ring = dict(want)
    while ring:
        fresh = {}
        for (x, y), c in ring.items():
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in mask and q not in want:
                    fresh[q] = min(c, fresh.get(q, c))
        want.update(fresh)
        ring = fresh
    assert len(set(want.values())) > 3 and got == want


def boxes(spark, seed, n, sizes=(3, 40, 900, 5000)):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choice(sizes)
        x, y = rnd.randrange(-200, 6000), rnd.randrange(0, 6000)
        rows.append((i % 2, i, x, y, x + rnd.randrange(1, s + 1), y + rnd.randrange(1, s + 1)))
    return rows, spark.createDataFrame(rows, "slide_id int, id int, x_min int, y_min int, x_max int, y_max int")


@pytest.mark.parametrize("split", [False, True])
def test_box_pairs_of_all_sizes(spark, monkeypatch, split):
    monkeypatch.setattr(rj, "CELL_BUDGET", 20)
    la, a = boxes(spark, 1, 160)
    lb, b = boxes(spark, 2, 140)
    got = [(r.l_id, r.r_id) for r in rj.box_pairs(a, b, ["slide_id"], keep_left=["id"], keep_right=["id"], cell=64, split_crowded=split).collect()]
    want = {(p[1], q[1]) for p in la for q in lb if p[0] == q[0] and p[2] <= q[4] and p[4] >= q[2] and p[3] <= q[5] and p[5] >= q[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_box_iou(spark):
    df = spark.createDataFrame([(0, 0, 4, 4, 2, 2, 6, 6), (0, 0, 2, 2, 5, 5, 6, 6)], "ax int, ay int, bx int, by int, cx int, cy int, dx int, dy int")
    got = [r[0] for r in df.select(box_iou(Box("ax", "ay", "bx", "by"), Box("cx", "cy", "dx", "dy"))).collect()]
    assert got == [pytest.approx(4 / 28), 0.0]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_numbering_with_one_hot_key(spark, limit):
    """Both routes: plain window, and range partitions with offsets."""
    rows = [(1 if i % 3 else i % 7, (i * 7919) % 3001, i % 5) for i in range(3001)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = ranking.running_totals(df, ["k"], [F.col("o").desc()], {"rn": F.lit(1).cast("long"), "s": F.col("v").cast("long")}, window_rows=limit)
    seen = {(r.k, r.o): (r.rn, r.s) for r in got.collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for n, (o, v) in enumerate(sorted(((r[1], r[2]) for r in rows if r[0] == k), reverse=True), 1):
            total += v
            assert seen[(k, o)] == (n, total)


def shapes_of_all_kinds():
    """Instances as pixel sets: a frame around others, a comb, a bar over many blocks, neighbours and a stray pixel."""
    frame = {(x, y) for x in range(10, 70) for y in range(10, 60) if x in (10, 69) or y in (10, 59)}
    comb = {(x, 75) for x in range(0, 60)} | {(x, y) for x in range(0, 60, 6) for y in range(76, 84)}
    bar = {(x, y) for x in range(0, 90) for y in (88, 89)}
    return {1: frame, 2: {(30, 30), (31, 30), (30, 31)}, 3: comb, 4: bar, 5: {(40 + i, 20 + i) for i in range(20)}, 6: {(88, 2)}}


@pytest.mark.parametrize("block", [16, 512])
def test_two_nearest(spark, block):
    shapes, margin, w, h = shapes_of_all_kinds(), 4, 92, 90
    rows = [(1, i, x, y) for i, px in shapes.items() for x, y in px] + [(2, 1, 3, 3)]
    px = spark.createDataFrame(rows, "image_id int, inst_id long, x int, y int")
    frames = spark.createDataFrame([(1, w, h), (2, 9, 9)], "image_id int, w int, h int")
    got = {(r.image_id, r.x, r.y): (r.d1, r.d2) for r in neighbours.two_nearest(px, frames, margin, block).collect()}
    want = collections.defaultdict(list)
    for p in shapes.values():
        xs, ys = [x for x, _ in p], [y for _, y in p]
        for x in range(max(min(xs) - margin, 0), min(max(xs) + margin, w - 1) + 1):
            for y in range(max(min(ys) - margin, 0), min(max(ys) + margin, h - 1) + 1):
                want[1, x, y].append(min((x - a) ** 2 + (y - b) ** 2 for a, b in p))
    assert got == {k: (sorted(v)[0], sorted(v)[1] if len(v) > 1 else -1) for k, v in want.items()}


def test_parts_hold_every_row_once(spark):
    for n in (0, 5, 21, 1003):
        parts = [[r.id for r in ranking.nth_part(spark.range(n), ["id"], i, 8).collect()] for i in range(1, 9)]
        assert sum((sorted(p) for p in parts), []) == list(range(n))
        assert max(map(len, parts)) - min(map(len, parts)) <= 1


def test_two_nearest_over_many_partitions(spark):
    """The instances of a block meet in one task also when partitions are not put together."""
    rows = [(1, 4 * j + i, 8 * i + x, 8 * j + y) for i in range(4) for j in range(4) for x in range(3) for y in range(3)]
    px = spark.createDataFrame(rows, "image_id int, inst_id long, x int, y int")
    frames = spark.createDataFrame([(1, 32, 32)], "image_id int, w int, h int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = neighbours.two_nearest(px, frames, 4, 16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = collections.defaultdict(list)
    for i, j in [(i, j) for i in range(4) for j in range(4)]:
        for x in range(max(8 * i - 4, 0), min(8 * i + 6, 31) + 1):
            for y in range(max(8 * j - 4, 0), min(8 * j + 6, 31) + 1):
                away = lambda v, lo: max(lo - v, v - lo - 2, 0) ** 2
                want[x, y].append(away(x, 8 * i) + away(y, 8 * j))
    assert len(got) == len(want)
    assert {(r.x, r.y): (r.d1, r.d2) for r in got} == {k: (sorted(v)[0], sorted(v)[1] if len(v) > 1 else -1) for k, v in want.items()}


def test_envelope_is_brute_force(monkeypatch):
    rnd = np.random.default_rng(2)
    for n in (1, 5, 300):
        y, x0 = rnd.integers(-200, 200, n), rnd.integers(-50, 90, n)
        x1 = x0 + rnd.integers(0, 9, n)
        xs, ys = np.arange(0, 64), np.arange(-20, 80)
        gap = np.maximum(np.maximum(x0[:, None] - xs, xs - x1[:, None]), 0)
        want = ((ys[None, :, None] - y[:, None, None]) ** 2 + (gap * gap)[:, None, :]).min(axis=0)
        for at_once in (0, 10**9):
            monkeypatch.setattr(neighbours, "_AT_ONCE", at_once)
            monkeypatch.setattr(neighbours, "_PORTION", 128)
            best = np.full((len(ys), len(xs)), np.iinfo("int64").max)
            neighbours.lower(best, xs, ys, y, x0, x1)
            assert np.array_equal(best, want)


def reached(mask, markers):
    """Least (steps, marker) by whole rings."""
    out, ring = {}, {}
    for p, m in markers:
        if p in mask:
            ring[p] = min(m, ring.get(p, m))
    while ring:
        out |= ring
        ahead = {}
        for (x, y), m in ring.items():
            for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if q in mask and q not in out:
                    ahead[q] = min(m, ahead.get(q, m))
        ring = ahead
    return out


@pytest.mark.parametrize("size", [8, 512])
def test_split_by_markers(spark, size):
    """A path that winds through many blocks and back, ties, markers off the mask, two on one pixel, parts without any."""
    rnd = random.Random(6)
    snake = {(x, y) for y in range(0, 40, 4) for x in range(40)} | {(39 if k % 2 == 0 else 0, 4 * k + i) for k in range(9) for i in range(1, 4)}
    images = {1: noise(3, 45, 37, 0.65), 2: snake, 3: noise(4, 30, 30, 0.9), 4: {(1, 1)}}
    marks = {i: [((rnd.randrange(45), rnd.randrange(40)), rnd.randrange(100)) for _ in range(12)] for i in (1, 3)} | {2: [((0, 0), 9), ((0, 0), 7), ((5, 36), 3)]}
    given = spark.createDataFrame([(i, x, y, m) for i, ps in marks.items() for (x, y), m in ps], "image_id int, x int, y int, marker long")
    twice = pixels(spark, images).unionByName(pixels(spark, {1: {(0, 0)} & images[1]}))
    got = as_sets(split_by_markers(twice, given, size), "marker")
    for i in images:
        assert got.get(i, {}) == reached(images[i], marks.get(i, []))
    none = spark.createDataFrame([], "image_id int, x int, y int")
    assert split_by_markers(none, given, size).count() == 0


def test_overlaps_of_runs(spark):
    """Maps whose instances overlap themselves, across blocks, classes and shuffled partitions, against pixel pairs."""
    rnd = random.Random(12)

    def blobs(n, first):
        rows = []
        for i in range(n):
            x, y, w, h, cls = rnd.randrange(480, 540), rnd.randrange(490, 530), rnd.randrange(1, 40), rnd.randrange(1, 30), rnd.randrange(1, 3)
            rows += [(i % 2, cls, first + i, a, b) for a in range(x, x + w) for b in range(y, y + h) if (a * b) % 7]
        rnd.shuffle(rows)
        return rows

    left, right = blobs(20, 0), blobs(20, 100)
    frame = lambda rows: spark.createDataFrame(rows, "image_id int, cls int, inst_id long, x int, y int").repartition(5)
    key = ["image_id", "cls", "inst_id"]
    got = {tuple(r)[:4]: r.inter for r in matching.overlaps(matching.runs_of_both(frame(left), frame(right))).collect()}
    at = collections.defaultdict(list)
    for i, c, t, x, y in right:
        at[i, c, x, y].append(t)
    want = collections.Counter((i, c, p, t) for i, c, p, x, y in left for t in at[i, c, x, y])
    assert got == want
    runs = local_runs(frame(left), key)
    assert runs.agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == len(left)
    assert matching.iou_pairs(frame(left).limit(0), frame(right)).count() == 0


def windowed(px, radius, wrap):
    """Values round every pixel; beyond 0..w-1, 0..h-1 the border's pixel repeats if ``wrap``."""
    w, h = max(x for x, _ in px) + 1, max(y for _, y in px) + 1
    at = (lambda v, n: min(max(v, 0), n - 1)) if wrap else (lambda v, n: v)
    span = range(-radius, radius + 1)
    return {p: {(i, j): px.get((at(p[0] + i, w), at(p[1] + j, h))) for i in span for j in span} for p in px}


@pytest.mark.parametrize("size", [8, 256])
def test_windows_over_rasters_with_missing_pixels(spark, size):
    """Odd kernels 3, 5, 7 across blocks; a hole does not move the pixels next to it."""
    rnd = random.Random(size)
    px = {(x, y): rnd.randrange(256) for x in range(21) for y in range(17) if rnd.random() < 0.9 or x in (0, 20) or y == 0}
    df = spark.createDataFrame([(1, x, y, v, f"t{v}") for (x, y), v in px.items()], "image_id int, x int, y int, v int, tag string")
    for radius in (1, 2, 3):
        hood = windowed(px, radius, True)
        got = stencil(df, ["v"], radius, binomial, [T.StructField("b", T.IntegerType())], replicate=True, size=size)
        got = {(r.x, r.y): r for r in stencil(got, ["v"], radius, median, [T.StructField("m", T.IntegerType())], replicate=True, size=size).collect()}
        assert set(got) == set(px)
        for p, near in hood.items():
            weights = {o: math.comb(2 * radius, o[0] + radius) * math.comb(2 * radius, o[1] + radius) for o, v in near.items() if v is not None}
            total = sum(weights.values())
            seen = sorted(v for v in near.values() if v is not None)
            assert (got[p].v, got[p].tag) == (px[p], f"t{px[p]}")
            assert got[p].b == (2 * sum(w * near[o] for o, w in weights.items()) + total) // (2 * total)
            assert got[p].m == seen[(len(seen) - 1) // 2]
    few = df.withColumn("v", F.col("v") % 5)
    got = {(r.x, r.y): r.entropy for r in stencil(few, ["v"], 3, entropy, [T.StructField("entropy", T.DoubleType())], size=size).collect()}
    for p, near in windowed(px, 3, False).items():
        seen = collections.Counter(v % 5 for (i, j), v in near.items() if v is not None and i * i + j * j <= 9)
        n = sum(seen.values())
        assert got[p] == pytest.approx(-sum(c / n * math.log2(c / n) for c in seen.values()), abs=1e-9)
    weights = np.arange(15.0).reshape(3, 5)[:, 1:4]
    got = {(r.x, r.y): r.c for r in stencil(df, ["v"], 1, correlation([weights]), [T.StructField("c", T.DoubleType())], size=size).collect()}
    for p, near in windowed(px, 1, False).items():
        assert got[p] == pytest.approx(sum(weights[j + 1, i + 1] * (v or 0) for (i, j), v in near.items()))


@pytest.mark.parametrize("tile", [3, 1024])
def test_contrastive_loss_in_tiles(spark, tile):
    rnd = np.random.default_rng(9)
    rows = [(b, s, v, rnd.normal(size=4).tolist()) for b in (1, 2) for s in range(3 + 4 * b) for v in range(2 + s % 2)]
    df = spark.createDataFrame(rows, "batch int, sample int, view int, feature array<double>")
    got = {r.batch: r.loss for r in contrastive(df, 0.5, 0.07, tile).collect()}
    for b in (1, 2):
        losses = []
        mine = [r for r in rows if r[0] == b]
        for _, s, v, f in mine:
            others = [(t == s, np.dot(f, g) / 0.5) for _, t, w, g in mine if (t, w) != (s, v)]
            losses.append(math.log(sum(math.exp(p) for _, p in others)) - np.mean([p for own, p in others if own]))
        assert got[b] == pytest.approx(np.mean(losses) * 0.5 / 0.07)


def test_a_large_contrastive_batch(spark):
    """20,000 views of one batch: no pair of views is a row."""
    views = spark.range(20_000).select(
        F.lit(1).alias("batch"), F.floor(F.col("id") / 2).alias("sample"), (F.col("id") % 2).alias("view"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k)).alias("feature")
    )
    loss = contrastive(views, 1.0, 1.0).first().loss
    ids = np.arange(20_000)
    f = np.sin(ids[:, None] * np.arange(1, 9))
    norm, own = np.empty(len(ids)), (f[0::2] * f[1::2]).sum(axis=1).repeat(2)
    for a in range(0, len(ids), 2000):
        products = f[a : a + 2000] @ f.T
        products[np.arange(2000), np.arange(a, a + 2000)] = -np.inf
        norm[a : a + 2000] = np.log(np.exp(products).sum(axis=1))
    assert loss == pytest.approx((norm - own).mean(), rel=1e-9)


def test_distinct_picks_are_uniform(spark):
    """Every index is as likely in every place, and no draw repeats one."""
    rows = spark.range(12_000).select(sampling.distinct_picks(3, F.lit(7).cast("long"), 4, "id").alias("p")).collect()
    assert all(len(set(r.p)) == 4 and set(r.p) <= set(range(7)) for r in rows)
    for place in range(4):
        seen = collections.Counter(r.p[place] for r in rows)
        assert all(abs(seen[i] - 12_000 / 7) < 5 * math.sqrt(12_000 / 7) for i in range(7))
    assert len({frozenset(r.p) for r in rows}) == math.comb(7, 4)
    everything = spark.range(5).select(sampling.distinct_picks(3, F.lit(4).cast("long"), 4, "id").alias("p")).collect()
    assert all(sorted(r.p) == [0, 1, 2, 3] for r in everything)


def test_greedy_matching(spark):
    rnd = random.Random(4)
    rows = [(1, 1, p, 100 + t, rnd.randrange(1, 12) / 12) for p in range(12) for t in range(10) if rnd.random() < 0.5]
    df = spark.createDataFrame(rows, "image_id int, cls int, pid int, tid int, iou double")
    got = {(r.pid, r.tid) for r in matching.mutual_best(df).collect()}
    want, used_p, used_t = set(), set(), set()
    for _, _, p, t, _ in sorted(rows, key=lambda r: (-r[4], r[2], r[3])):
        if p not in used_p and t not in used_t:
            want.add((p, t))
            used_p.add(p)
            used_t.add(t)
    assert got == want


def test_smoothing_across_chunks(spark):
    n, alpha = 2500, 0.9
    values = [((i * 37) % 101) / 7 for i in range(n)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 5.0)], "s string, i int, v double")
    got = {(r.s, r.i): r.smooth for r in smoothed(df, "s", "i", "v", alpha).collect()}
    state = None
    for i, v in enumerate(values):
        state = v if state is None else alpha * state + (1 - alpha) * v
        assert math.isclose(got[("a", i)], state, rel_tol=1e-12)
    assert got[("b", 0)] == 5.0


AROUND = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # (x, y), clockwise from the west


def walked(px):
    """Outer outlines by walking around each piece (corners connect), pixel by pixel, from its first pixel in raster order."""
    left, rings = set(px), []
    for start in sorted(px, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        todo = [start]
        left.discard(start)
        while todo:
            x, y = todo.pop()
            for dx, dy in AROUND:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        at, back, first, ring = start, 0, None, []
        while True:
            turn = next((k for k in ((back + k) % 8 for k in range(1, 9)) if (at[0] + AROUND[k][0], at[1] + AROUND[k][1]) in px), None)
            if turn is None:
                ring = [start]
                break
            if at == start:
                if first == turn:
                    break
                first = turn if first is None else first
            ring.append(at)
            at = (at[0] + AROUND[turn][0], at[1] + AROUND[turn][1])
            back = (turn + 5) % 8 if turn % 2 else (turn + 6) % 8
        rings.append(ring)
    return rings


def corners_of(ring):
    step = lambda a, b: (b[0] - a[0], b[1] - a[1])
    n = len(ring)
    return [p for i, p in enumerate(ring) if n < 3 or step(ring[i - 1], p) != step(p, ring[(i + 1) % n])]


@pytest.mark.parametrize("size", [4, 512])
def test_outlines(spark, size):
    shapes = {
        1: {(5, 5)},
        2: {(x, 3) for x in range(4)},
        3: {(x, y) for x in range(5) for y in range(4)},
        4: {(x, y) for x in range(15) for y in range(15) if (x - 7) ** 2 + (y - 7) ** 2 <= 40},
        5: {(0, 0), (1, 0), (2, 0), (1, 1), (1, 2), (0, 3), (1, 3), (2, 3)},
        6: noise(9, 30, 26, 0.5),
        7: noise(10, 33, 20, 0.75),
        8: {(x, y) for x in range(40) for y in range(30) if x in (0, 39) or y in (0, 29) or (x, y) in ((20, 15), (21, 16))},
        9: {(i, i) for i in range(20)} | {(39 - i, i) for i in range(20)},
    }
    px = pixels(spark, shapes)
    for simplify in (False, True):
        rows = outlines(px, ["image_id"], simplify, size).collect()
        got = collections.Counter((r.image_id, tuple((p.x, p.y) for p in r.contour)) for r in rows)
        want = collections.Counter((i, tuple(corners_of(ring) if simplify else ring)) for i, s in shapes.items() for ring in walked(s))
        assert got == want
    parts = outline_parts(px, ["image_id"], False, size)
    assert parts.agg(F.max(F.size("points"))).first()[0] <= max(2 * size * size, 8) or size == 512
    assert outlines(px.limit(0), ["image_id"]).count() == 0
