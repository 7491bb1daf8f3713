"""Copies of images by local descriptors.

Corners are found at several scales, one at most for each cell of an image, turned by the direction of
their patch's centre of gravity and described by 128 comparisons of smoothed pixels.  Every two of the
descriptor's BANDS bands are the key of a Hamming table: descriptors meet for certain when they differ
in up to BANDS - 2 bits, and with more, up to MAX_DISTANCE, as long as two bands are equal.  Matches of two images vote for scale, turn and shift, and a pair
with enough votes for one of them is a copy, cropped or edited as it may be.

Images with equal pixels are one class.  Classes are compared in blocks, a task for every two of them
(`corner_blocks`); links alone leave a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovox.llm.common import batched, forget, saved, table
from chronovox.llm.components import components
from chronovox.llm.corner_blocks import ANGLES, BITS, MAX_DISTANCE, MIN_VOTES, RADIUS, SHIFT_BIN, Block, agreed, links

#: Edge of the cells that give one corner each, pixels; number of scales, each half the one before.
CELL, SCALES = 24, 2
_MIN_CORNER = 40.0
#: Corners of a block of classes, and blocks that a small input is dealt over, of so many corners at least.
BLOCK, FEW, SMALL = 100_000, 8, 10_000
#: Links that one task joins: 16 bytes a link, and what is found of its ends.
ONE_TASK = 500_000
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _tests() -> np.ndarray:
    """Offsets of the compared pixels for every angle: (ANGLES, BITS, 2, 2), fixed by a seed."""
    rng = np.random.default_rng(128)
    pairs = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS + 2, RADIUS - 2)
    turn = 2 * np.pi * np.arange(ANGLES) / ANGLES
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    x, y = pairs[None, :, :, 0], pairs[None, :, :, 1]
    return np.rint(np.stack([c * x - s * y, s * x + c * y], axis=-1)).astype(int)


_TESTS = _tests()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID**2).sum(axis=0) <= RADIUS**2


def _box(a: np.ndarray, r: int = 1) -> np.ndarray:
    """Sums over squares of edge 3; the border is repeated."""
    p = np.empty((a.shape[0] + 2, a.shape[1] + 2), a.dtype)
    p[1:-1, 1:-1] = a
    p[0, 1:-1], p[-1, 1:-1] = a[0], a[-1]
    p[:, 0], p[:, -1] = p[:, 1], p[:, -2]
    rows = p[:-2] + p[1:-1]
    rows += p[2:]
    out = rows[:, :-2] + rows[:, 1:-1]
    out += rows[:, 2:]
    return out


def _slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences down and across: central ones, one-sided at the edges."""
    gy, gx = np.empty_like(a), np.empty_like(a)
    np.subtract(a[2:], a[:-2], out=gy[1:-1])
    gy[1:-1] *= 0.5
    gy[0], gy[-1] = a[1] - a[0], a[-1] - a[-2]
    np.subtract(a[:, 2:], a[:, :-2], out=gx[:, 1:-1])
    gx[:, 1:-1] *= 0.5
    gx[:, 0], gx[:, -1] = a[:, 1] - a[:, 0], a[:, -1] - a[:, -2]
    return gy, gx


def _largest_about(a: np.ndarray, r: int) -> np.ndarray:
    """The largest value in the square of edge 2r+1 about each place, by doubling; beyond the edge lies nothing."""
    out = a
    for axis in (0, 1):
        shape = list(a.shape)
        shape[axis] += 2 * r
        p = np.zeros(shape, a.dtype)
        put = [slice(None), slice(None)]
        put[axis] = slice(r, r + a.shape[axis])
        p[tuple(put)] = out
        cut = lambda x, i, j, axis=axis: x[i:j] if axis == 0 else x[:, i:j]
        done = 1
        while done < 2 * r + 1:
            step = min(done, 2 * r + 1 - done)
            n = p.shape[axis]
            p = np.maximum(cut(p, 0, n - step), cut(p, step, n))
            done += step
        out = p
    return out


def describe(image: np.ndarray):
    """(x, y, scale, angle, descriptor words) of an image's corners; x, y in its own pixels.

    Grey levels, their slopes and sums are exact in single precision at both scales.
    """
    out = []
    level = image.astype(np.float32)
    for scale in range(SCALES):
        h, w = level.shape
        if min(h, w) < 2 * RADIUS + 3:
            break
        gy, gx = _slopes(level)
        a, b, c = _box(gx * gx), _box(gy * gy), _box(gx * gy)
        strength = a + b
        a *= b
        c *= c
        a -= c
        strength += np.float32(1e-9)
        corner = np.divide(a, strength, out=a)  # the harmonic mean of both directions' strengths
        corner[:RADIUS] = corner[-RADIUS:] = 0
        corner[:, :RADIUS] = corner[:, -RADIUS:] = 0
        # a corner is the largest of its neighbourhood, wherever the image's edge lies
        y, x = np.nonzero((corner > _MIN_CORNER) & (corner >= _largest_about(corner, CELL // 4)))
        if len(x):
            smooth = _box(level).ravel()
            at = y * w + x
            patch = level.ravel()[at[:, None] + (_GRID[0] * w + _GRID[1])[_DISC]]
            turn = np.arctan2(patch @ _GRID[0][_DISC].astype(np.float32), patch @ _GRID[1][_DISC].astype(np.float32))
            angle = np.rint(turn / (2 * np.pi) * ANGLES).astype(int) % ANGLES
            # tests stay within RADIUS of a corner, and corners as far from the edge
            places = at[:, None, None] + (_TESTS[..., 0] + _TESTS[..., 1] * w)[angle]
            v = smooth[places]
            words = np.packbits(v[..., 0] < v[..., 1], axis=1).view("<i8")
            out.append((x << scale, y << scale, np.full(len(x), scale), angle, words))
        even = level[: h // 2 * 2, : w // 2 * 2]
        level = (even[::2, ::2] + even[1::2, ::2] + even[::2, 1::2] + even[1::2, 1::2]) * np.float32(0.25)
    if not out:
        return None
    return tuple(np.concatenate([o[i] for o in out]) for i in range(5))


def image_classes(images: DataFrame) -> DataFrame:
    """image_id and class (a digest of size and pixels; null without pixels) of every row."""
    return images.select(F.col("image_id").cast("long").alias("image_id"), _class().alias("class"))


def _class() -> Column:
    known = F.col("pixels").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.length("pixels") == F.col("width") * F.col("height"))
    return F.when(known, F.xxhash64("width", "height", F.sha2("pixels", 256)))


def described(images: DataFrame) -> DataFrame:
    """image_id, class and corners of every row: bits, their descriptors, and places, the bytes of x, y,
    scale and angle, each byte of all corners after the other.  A task describes a class once; its
    further rows, and rows without corners, have null bits."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            bits: list[bytes | None] = []
            places: list[bytes | None] = []
            for key, w, h, px in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                got = None
                if key is not None and key not in seen:
                    seen.add(key)
                    got = describe(np.frombuffer(px, np.uint8).reshape(h, w))
                bits.append(None if got is None else got[4].tobytes())
                places.append(None if got is None else _planes(*got[:4]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array(places, pa.binary())], names=["image_id", "class", "bits", "places"])

    rows = images.select(F.col("image_id").cast("long").alias("image_id"), _class().alias("class"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), "pixels")
    return rows.mapInArrow(run, "image_id long, class long, bits binary, places binary")


def _planes(x: np.ndarray, y: np.ndarray, scale: np.ndarray, angle: np.ndarray) -> bytes:
    """The bytes of x, y (four each), scale and angle of some corners, each of all after the other."""
    wide = np.stack([x, y]).astype("<i4").view(np.uint8).reshape(2, len(x), 4).transpose(0, 2, 1).reshape(8, len(x))
    return np.concatenate([wide, np.stack([scale, angle]).astype(np.uint8)]).tobytes()


def _unpacked(bits: list[bytes], places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, places (x, y, scale, angle as rows) and descriptor words of all corners of some images."""
    counts = [len(b) // (BITS // 8) for b in bits]
    planes = np.concatenate([np.frombuffer(p, np.uint8).reshape(10, -1) for p in places], axis=1)
    x, y = (np.ascontiguousarray(planes[k : k + 4].T).view("<i4").ravel() for k in (0, 4))
    words = np.frombuffer(b"".join(bits), "<i8").reshape(-1, BITS // 64)
    return np.repeat(np.arange(len(counts)), counts), np.stack([x, y, planes[8], planes[9]]).astype(np.int64), words


_POINTS = "class long, x int, y int, scale byte, angle byte, d0 long, d1 long"


def corners(images: DataFrame) -> DataFrame:
    """class, x, y, scale, angle, d0, d1 of every corner of the rows with pixels; a class may come again."""

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            image, places, words = _unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            found = [key[image], *(places[i].astype(t) for i, t in enumerate((np.int32, np.int32, np.int8, np.int8))), words[:, 0].copy(), words[:, 1].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["class", "x", "y", "scale", "angle", "d0", "d1"])

    return described(images).where("bits IS NOT NULL").select("class", "bits", "places").mapInArrow(run, _POINTS)


def _packed(points: DataFrame) -> DataFrame:
    """class, bits and places, as `described` gives them, of the corners of every class."""

    def run(rows: pa.Table) -> pa.Table:
        x, y, scale, angle, d0, d1 = (rows.column(c).to_numpy() for c in ("x", "y", "scale", "angle", "d0", "d1"))
        return pa.table({"class": rows.column("class").slice(0, 1), "bits": pa.array([np.stack([d0, d1], axis=1).tobytes()], pa.binary()), "places": pa.array([_planes(x, y, scale, angle)], pa.binary())})

    return points.groupBy("class").applyInArrow(run, "class long, bits binary, places binary")


def _meet(rows: pa.Table) -> pa.Table:
    """Links between two blocks of images, or within one, as rows a, b.  Rows without bits give roots."""
    u, v = rows.column("u")[0].as_py(), rows.column("v")[0].as_py()
    known = rows.filter(pc.is_null(rows.column("bits")))
    known_class, known_root = known.column("class").to_numpy(), known.column("root").to_numpy()
    by = np.argsort(known_class)
    known_class, known_root = known_class[by], known_root[by]
    rows = rows.filter(pc.is_valid(rows.column("bits")))
    blocks, roots = [], []
    for block in (u, v) if u != v else (u,):
        mine = rows.filter(pc.equal(rows.column("block"), block))
        classes, first = np.unique(mine.column("class").to_numpy(), return_index=True)
        mine = mine.take(pa.array(first))
        if not len(classes):
            continue
        by = np.lexsort((classes, -pc.binary_length(mine.column("bits")).to_numpy()))  # those of most corners first
        mine, classes = mine.take(pa.array(by)), classes[by]
        blocks.append(Block(classes, *_unpacked(mine.column("bits").to_pylist(), mine.column("places").to_pylist())))
        at = np.minimum(np.searchsorted(known_class, classes), max(len(known_class) - 1, 0))
        roots.append(np.where(known_class[at] == classes, known_root[at], classes) if len(known_class) else classes)
    if len(blocks) < (2 if u != v else 1):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    found = links(blocks[0], blocks[1] if u != v else None, np.concatenate(roots))
    return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})


def _votes(matches: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of matches that agree on scale, turn and shift often enough.

    A match may come either way round; all of a pair's are turned the same way before they vote."""
    sides = {c: F.when(F.col("a") > F.col("b"), F.col(o)).otherwise(F.col(c)) for p, q in ("ab", "ba") for c, o in ((p + k, q + k) for k in ("", "x", "y", "s", "a", "0", "1"))}
    matches = matches.where("a != b").select(*[v.alias(c) for c, v in sides.items()])
    near = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) <= MAX_DISTANCE

    def run(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy().astype(np.int64)
        got = agreed(column("a"), column("b"), *(np.stack([column(p + c) for c in "xysa"]) for p in "ab"))
        return pa.table({"a": got[:, 0].copy(), "b": got[:, 1].copy()})

    return matches.where(near).groupBy("a", "b").applyInArrow(run, "a long, b long")


def class_links(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between classes that make the same components as all links do, and the written steps
    that they are read from; points as `corners` gives them, each once."""
    rows = saved(_packed(points), "image-corners")
    found, steps = _block_links(rows)
    return found, [rows, *steps]


def _block_links(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links between the classes of rows (class, bits, places; a written step), and the written steps
    that they are read from.

    Classes are dealt by their numbers of corners over blocks of about BLOCK corners, and every two blocks
    meet in a task.  Those of most corners are in the first blocks and come first, as they soon join.  Jobs
    take some pairs of blocks each, so that no more than about one copy of the corners is shuffled at a
    time (of a small input, eight in one job); the components of what has been found go to the later ones,
    which pass over what is joined.
    """
    spark = rows.sparkSession
    rows = rows.where("bits IS NOT NULL").select("class", F.lit(None).cast("long").alias("root"), "bits", "places")
    # a row for each number of corners that an image has
    sizes = sorted(((r.n, r.corners) for r in rows.groupBy(F.length("bits").alias("n")).agg(F.sum(F.length("bits") / (BITS // 8)).cast("long").alias("corners")).collect()), reverse=True)
    total = sum(n for _, n in sizes)
    blocks = max(-(-total // BLOCK), min(-(-total // SMALL), FEW))
    before = np.cumsum([0, *(n for _, n in sizes)])
    deal = F.broadcast(spark.createDataFrame([(n, int(b), corners) for (n, corners), b in zip(sizes, before, strict=False)], "n int, before long, corners long"))
    place = (F.col("before") + F.col("corners") * (F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / (1 << 20))) * blocks / max(total, 1)
    rows = rows.withColumn("n", F.length("bits")).join(deal, "n").withColumn("block", F.least(F.floor(place).cast("int"), F.lit(blocks - 1))).select("class", "root", "bits", "places", "block")
    dealt = saved(rows.select("class", "block"), "image-blocks")
    pairs = [(u, v) for u in range(blocks) for v in range(u + 1, blocks)]
    most = max(blocks // 2, 24)
    alone = [(u, u) for u in range(blocks)]
    jobs = [alone + pairs] if 0 < blocks <= FEW else [alone] * (blocks > 0) + [pairs[i : i + most] for i in range(0, len(pairs), most)]
    found, roots, steps = spark.createDataFrame([], "a long, b long"), None, [dealt]
    for n, job in enumerate(jobs):
        meets = spark.createDataFrame([(g, u, v, s) for (u, v), s in zip(job, _slots(spark, len(job)), strict=True) for g in {u, v}], "block int, u int, v int, slot long")
        known = rows
        if roots is not None:
            known = rows.unionByName(dealt.distinct().join(roots.withColumnRenamed("node", "class"), "class"), allowMissingColumns=True)
        known = known.join(F.broadcast(meets), "block").repartition(len(job), "slot")
        steps.append(saved(known.groupBy("slot").applyInArrow(_meet, "a long, b long"), "image-links"))
        found = found.unionByName(steps[-1])
        if n & (n + 1) == 0 and n + 1 < len(jobs):  # after the first job, the second, the fourth and so on
            roots = saved(_components(found), "image-roots")
            steps.append(roots)
    return found, steps


def _components(links: DataFrame) -> DataFrame:
    """As `components`; up to ONE_TASK links are joined in one task, without rounds."""
    if links.count() > ONE_TASK:
        return components(links)

    def run(batches):
        root: dict[int, int] = {}
        for batch in batches:
            for ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted(_root(root, x) for x in ends)
                root[high] = low
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_root(root, x) for x in nodes], pa.int64())], names=["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node long, root long")


def _root(root: dict[int, int], x: int) -> int:
    """The smallest node that x leads to; ways are halved on the way."""
    root.setdefault(x, x)
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _slots(spark: SparkSession, n: int) -> list[int]:
    """Different numbers that Spark deals over n partitions by their hashes, one to each as far as possible."""
    rows = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    ids = sorted(r.id for r in rows)
    return ids + [32 * n + i for i in range(n - len(ids))]


def copies(images: DataFrame) -> DataFrame:
    """image_id, class, component_id of every row of images (image_id, width, height, pixels: one byte
    a pixel, row by row); component_id is the smallest image_id that copies lead to.

    An image without pixels, or whose size and pixels disagree, has no class and is its own component;
    so is one without corners, but for equal ones.  Repeated rows give repeated results.
    """
    with _swept(images.sparkSession):
        points = saved(described(images), "image-corners")
        classes = saved(points.select("image_id", "class"), "image-classes")
        found, steps = _block_links(points)
        roots = saved(_components(found), "image-roots")
        forget(points, *steps)
    first = classes.where("class IS NOT NULL").groupBy("class").agg(F.min("image_id").alias("first"))
    first = first.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = first.join(first.groupBy("root").agg(F.min("first").alias("component")), "root").select("class", "component")
    out = classes.join(named, "class", "left")
    return out.select("image_id", "class", F.coalesce("component", "image_id").alias("component_id"))


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query go when it ends: every step is written, and nothing reads them again."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


# -- images from vectors ----------------------------------------------------------------------------

#: Pixels of a tile's edge, and grey levels for one unit of a component.
TILE, CONTRAST = 4, 200.0
#: Of every so many vectors a cropped and brightened copy is made beside the vector's own image.
COPY_EVERY = 10


def vector_images(vectors: DataFrame) -> DataFrame:
    """An image of every vector: its four quarters as the rows, columns and both diagonals of a grid of
    tiles, each as bright as the sum of the four numbers that meet in it.  Vectors whose id
    is divisible by COPY_EVERY give a second image, id -1 - vec_id: the first without its edges,
    brighter and with less contrast.  A null vector gives an image without pixels."""

    def run(batches):
        for batch in batches:
            out = []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([c if c is not None else 0.0 for c in v or []], np.float64)
                if not len(x):
                    out.append((key, None))
                    continue
                n = -(-len(x) // 4)
                q = np.zeros(4 * n)
                q[: len(x)] = np.nan_to_num(x)
                i, j = np.mgrid[:n, :n]
                sums = q[i] + q[n + j] + q[2 * n + (i + j) % n] + q[3 * n + (i - j) % n]
                image = np.kron(np.clip(128 + CONTRAST * sums, 0, 255).astype(np.uint8), np.ones((TILE, TILE), np.uint8))
                out.append((key, image))
                if key is not None and key % COPY_EVERY == 0:
                    out.append((-1 - key, (image[3:-2, 2:-3] * 0.8 + 30).astype(np.uint8)))
            shape = [(0, 0) if i is None else i.shape for _, i in out]
            yield pa.RecordBatch.from_pydict({"image_id": pa.array([k for k, _ in out], pa.int64()), "width": pa.array([w for _, w in shape], pa.int32()), "height": pa.array([h for h, _ in shape], pa.int32()), "pixels": pa.array([None if i is None else np.ascontiguousarray(i).tobytes() for _, i in out], pa.binary())})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "image_id long, width int, height int, pixels binary")


# -- images from pages ------------------------------------------------------------------------------

#: Edge of a word's tile, pixels, and tiles in a row.
PAGE_TILE, TILES_WIDE = 6, 12


def page_images(pages: DataFrame) -> DataFrame:
    """An image of every page: its words in rows of tiles, each as dark as its word's hash says.
    Pages whose id is divisible by COPY_EVERY give a second image, id -1 - page_id: the inner part of
    the first, brighter and with less contrast."""

    def run(batches):
        for batch in batches:
            out = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (page or "").split()
                rows = max(4, -(-len(words) // TILES_WIDE))
                tone = np.full(rows * TILES_WIDE, 128, np.uint8)
                tone[: len(words)] = [zlib.crc32(w.encode("utf-8", "replace")) & 255 for w in words]
                image = np.kron(tone.reshape(rows, TILES_WIDE), np.ones((PAGE_TILE, PAGE_TILE), np.uint8))
                out.append((key, image))
                if key is not None and key % COPY_EVERY == 0:
                    part = image[PAGE_TILE : -PAGE_TILE if rows > 5 else None, PAGE_TILE // 2 : -PAGE_TILE // 2]
                    out.append((-1 - key, (part * 0.8 + 30).astype(np.uint8)))
            yield pa.RecordBatch.from_pydict({"image_id": pa.array([k for k, _ in out], pa.int64()), "width": pa.array([i.shape[1] for _, i in out], pa.int32()), "height": pa.array([i.shape[0] for _, i in out], pa.int32()), "pixels": [np.ascontiguousarray(i).tobytes() for _, i in out]})

    return batched(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))).mapInArrow(run, "image_id long, width int, height int, pixels binary")


def op6_image_copies(spark, sf_dir: str) -> DataFrame:
    return copies(page_images(table(spark, sf_dir, "pages"))).select("image_id", "component_id")
