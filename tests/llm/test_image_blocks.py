"""Images met block by block: the same links as all pairs of corners give, on little disk."""

import os

import numpy as np

from chronovox.llm import images
from chronovox.llm.components import components


def tiles(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(24):
        big = np.kron(rng.integers(0, 256, (12, 12)), np.ones((6, 6))).astype(np.uint8)
        for k, image in enumerate((big, big[6:, 3:-3] * 0.8 + 30)[: 1 + (i % 2)]):
            px = np.ascontiguousarray(image.astype(np.uint8))
            rows.append((10 * i + k, px.shape[1], px.shape[0], bytearray(px.tobytes())))
    return rows


def by_tables(points):
    """Links by all pairs of corners that are near and have two equal bands."""
    a, b, pa, pb = [], [], [], []
    for i in range(len(points)):
        x = points[i:][:, 5:] ^ points[i, 5:]
        near = np.bitwise_count(x.view(np.uint64)).sum(axis=1) <= images.MAX_DISTANCE
        equal = (np.ascontiguousarray(x).view(np.uint16).reshape(len(x), 8) == 0).sum(axis=1) >= 2
        for j in (i + np.flatnonzero(near & equal & (points[i:, 0] != points[i, 0]))).tolist():
            p, q = sorted((points[i], points[j]), key=lambda r: r[0])
            a, b, pa, pb = [*a, p[0]], [*b, q[0]], [*pa, p[1:5]], [*pb, q[1:5]]
    return {tuple(r) for r in images.agreed(np.array(a), np.array(b), np.array(pa).T, np.array(pb).T).tolist()}


def test_image_blocks(spark, monkeypatch):
    """Blocks of a few images give the components of all links, and what is written stays a small multiple of the corners."""
    pics = spark.createDataFrame(tiles(5), "image_id long, width int, height int, pixels binary").cache()
    points = images.corners(pics).dropDuplicates(["class", "x", "y", "scale"]).cache()
    all_points = np.array([tuple(r) for r in points.collect()], np.int64)
    want = by_tables(all_points)
    wrote = []

    def saved(df, what, save=images.saved):
        out = save(df, what)
        wrote.append(sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(out.scratch_path) for f in files if f.endswith(".parquet") and os.path.getsize(os.path.join(at, f)) > 2000))
        return out

    monkeypatch.setattr(images, "saved", saved)
    monkeypatch.setattr(images, "BLOCK", len(all_points) // 5, raising=False)
    found, steps = images.class_links(points)
    got = {tuple(sorted(r)) for r in found.collect()}
    assert got <= want and len(want) >= 11
    roots = lambda links: {(r.node, r.root) for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert roots(got) == roots(want)
    # 26 bytes a corner, and links; 28 keys a corner would be more than that many times as much
    assert sum(wrote) < 3 * 26 * len(all_points)


def test_shuffle_files_setting_comes_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    images.copies(spark.createDataFrame(tiles(6)[:3], "image_id long, width int, height int, pixels binary")).count()
    assert spark.conf.get(key, None) == before
