"""Clustering of voice vectors, all recordings at once.

A group of up to SMALL windows is clustered in one task, on its own distance matrix, which that number
bounds.  Larger groups go in rounds: every round merges all pairs of clusters that are
each other's nearest, which gives the same tree as one merge at a time.  The nearest of each cluster is kept:
a round searches anew only for merged clusters and for those whose nearest was merged, as no other
cluster can have come nearer.  Groups of up to `small` windows (WHOLE in the plans) have their rounds in one task,
which holds their vectors and TILE products at a time, until SMALL clusters are left.  Those of still larger groups
are spread over tasks: a search compares blocks of BLOCK vectors, a task for each two blocks, and one row
a cluster leaves it; no table of pairs is made.  Once few clusters are left, one task ends the tree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.functions.vectors import centroid, cosine_distance, dot, l2_normalize
from chronovox.operators.intervals import KEYS
from chronovox.scratch import forget, saved
from chronovox.thresholds import DEFAULTS, Thresholds

#: Vectors of a block in the search for nearest clusters.
BLOCK = 8192
#: Products of vectors that a task holds at once: 32 MB.
TILE = 1 << 22
#: Windows of a group that one task clusters on its own: its distances take 32 MB.
SMALL = 2000
#: Windows of a group whose rounds one task can take, on their vectors: 8 MB for 64 components.
WHOLE = 16384
#: Windows of a cluster that are met with those of others at once.
DEEP = 64
#: Vectors below this length have no direction.
NO_LENGTH = 1e-8


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage between rounds: the step is written to the shared checkpoint folder."""
    return saved(df, "round")


def merge_tree(d: np.ndarray, how: str, limit: float = np.inf, leave: int = 1, size: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Merges (kept, gone, distance) of the closest pair, again and again, while its distance is below the
    limit and more than `leave` clusters stand; ties by the smaller places.  d, whole and symmetric, is used
    up; size: how many windows each row stands for."""
    n = len(d)
    d = np.round(d, 12)
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if size is None else size.astype(float)
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    out = []
    for _ in range(n - max(1, leave)):
        low = best.min()
        if not low < limit:
            break
        i = int(np.flatnonzero(best == low)[0])
        a, b = sorted((i, int(near[i])))
        if how == "average":
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            row = np.round(row, 12)
        else:
            row = np.maximum(d[a], d[b]) if how == "complete" else np.minimum(d[a], d[b])
        row[[a, b]] = np.inf
        size[a] += size[b]
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        out.append((a, b, float(low)))
        for j in {a, *np.flatnonzero((near == a) | (near == b)).tolist()} - {b}:
            near[j] = d[j].argmin()
            best[j] = d[j, near[j]]
        best[b] = np.inf
        # what came nearer than a row's nearest so far, or as near at a smaller place
        closer = (row < best) | ((row == best) & (a < near) & np.isfinite(row))
        near[closer], best[closer] = a, row[closer]
    return out


def _first_best(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest in each row of products; distances count to 12 places, ties by place."""
    j = p.argmax(axis=1)
    at = np.arange(len(p))
    early = np.flatnonzero((p >= (p[at, j] - 2e-12)[:, None]).argmax(axis=1) < j)
    if len(early):
        j[early] = np.round(1.0 - p[early], 12).argmin(axis=1)
    return j, np.round(1.0 - p[at, j], 12)


def nearest_means(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in y and distance of the nearest of each row of x, by products of means of unit vectors; own: the row's own place in y,
    or -1.  TILE products are held at a time."""
    near, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    step = max(1, TILE // max(1, len(y)))
    for lo in range(0, len(x), step):
        p = x[lo : lo + step] @ y.T
        mine = own[lo : lo + step]
        p[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -np.inf
        near[lo : lo + step], best[lo : lo + step] = _first_best(p)
    return near, best


def _stacked(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of the n windows of clusters that begin at `at`: the first window of every cluster, the longest clusters first, then the
    second ones, and so on up to DEEP, then the rest of each long one.  With it how many each step has, of the long
    ones, and the place of each cluster."""
    size = np.diff(at, append=n)
    order = np.argsort(-size, kind="stable")
    counts = np.array([np.count_nonzero(size > r) for r in range(min(DEEP, int(size.max())))])
    rest = size[order[: np.count_nonzero(size > DEEP)]] - DEEP
    parts = [at[order[:c]] + r for r, c in enumerate(counts)] + [at[order[i]] + DEEP + np.arange(m) for i, m in enumerate(rest)]
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    return np.concatenate(parts), counts, rest, place


def _least(p: np.ndarray, counts: np.ndarray, rest: np.ndarray, place: np.ndarray, axis: int) -> np.ndarray:
    """The least of each cluster's rows or columns of p, which are in _stacked's order; p is used up."""
    part = lambda lo, n: p[lo : lo + n] if axis == 0 else p[:, lo : lo + n]
    out, lo = part(0, counts[0]), counts[0]
    for c in counts[1:]:
        mine = part(0, c)
        np.minimum(mine, part(lo, c), out=mine)
        lo += c
    for i, m in enumerate(rest):
        mine = part(i, 1)
        np.minimum(mine, part(lo, m).min(axis=axis, keepdims=True), out=mine)
        lo += m
    return np.take(out, place, axis=axis)


def least_products(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray):
    """(clusters of x, their least products with the clusters of y), a few clusters at a time.  at_x, at_y: where the
    windows of each cluster begin; a cluster of many windows is met in parts."""
    step = max(1, TILE // max(1, len(y)))
    held = None  # least products of the first cluster's windows so far
    order, *plan = _stacked(at_y, len(y))
    flat = y[order].T
    for lo in range(0, len(x), step):
        hi = min(lo + step, len(x))
        first, last = int(np.searchsorted(at_x, lo, "right")) - 1, int(np.searchsorted(at_x, hi, "left")) - 1
        mine, *own = _stacked(np.maximum(at_x[first : last + 1] - lo, 0), hi - lo)
        p = _least(_least(x[lo:hi][mine] @ flat, *plan, axis=1), *own, axis=0)
        if held is not None:
            p[0] = np.minimum(p[0], held)
        going_on = hi < len(x) and (last + 1 == len(at_x) or at_x[last + 1] > hi)
        held = p[-1].copy() if going_on else None
        if going_on:
            p, last = p[:-1], last - 1
        if len(p):
            yield np.arange(first, last + 1), p


def tree_in_rounds(s: np.ndarray, how: str, limit: float = np.inf, size: np.ndarray | None = None, small: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merges of merge_tree (kept, gone, distance) below the limit, by rounds on the vectors, without their matrix of
    distances until `small` clusters are left; a merge stands after those of its parts.  s: unit vectors, or with
    size (average linkage) sums of so many."""
    small = SMALL if small is None else small
    name, tree = np.arange(len(s)), []
    n = np.ones(len(s)) if size is None else size.astype(float)
    if size is None and limit > 0:
        # copies first, so that they don't merge one a round
        s = s + 0.0
        _, first, back = np.unique(np.ascontiguousarray(s).view(np.dtype((np.void, s.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        to = np.where((s * s).sum(axis=1) > 0.5, first[back.ravel()], name)
        gone = np.flatnonzero(to != name)
        order = np.lexsort((gone, to[gone]))
        tree.append((to[gone][order], gone[order], np.zeros(len(gone))))
        n = np.bincount(to, minlength=len(s)).astype(float)
        name = np.flatnonzero(to == name)
        s, n = s[name], n[name]
    mean = how == "average"
    v = (s if size is None else s / n[:, None]) if mean else s
    of = np.arange(len(v))  # complete linkage: the cluster of each window, which stand in order

    def begins() -> np.ndarray:
        return np.flatnonzero(np.diff(of, prepend=-1))

    def search(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if mean:
            return nearest_means(v[which], v, which)
        rows = np.flatnonzero(np.isin(of, which))
        near, best = np.zeros(len(which), np.int64), np.full(len(which), np.inf)
        for x, p in least_products(v[rows], np.flatnonzero(np.diff(of[rows], prepend=-1)), v, begins()):
            p[np.arange(len(x)), which[x]] = -np.inf
            near[x], best[x] = _first_best(p)
        return near, best

    near, best, stale = np.zeros(len(name), np.int64), np.full(len(name), np.inf), np.arange(len(name))
    while len(name) > max(small, 1):
        near[stale], best[stale] = search(stale)
        here = np.arange(len(name))
        mutual = (best < limit) & (near[near] == here)
        a = np.flatnonzero(mutual & (here < near))
        if not len(a):
            break
        b = near[a]
        tree.append((name[a], name[b], best[a]))
        lost = mutual[near] & (best < limit)
        stands = best < limit  # whoever has nobody near enough now never will
        stands[b] = False
        if mean:
            whole = n[a] + n[b]
            v[a] = (n[a][:, None] * v[a] + n[b][:, None] * v[b]) / whole[:, None]
            n[a] = whole
            v = v[stands]
        new = np.cumsum(stands) - 1
        if not mean:
            to = here.copy()
            to[b] = a
            of = to[of]
            keep = stands[of]
            v, of = v[keep], new[of[keep]]
            order = np.argsort(of, kind="stable")
            v, of = v[order], of[order]
        name, n, best, lost = name[stands], n[stands], best[stands], lost[stands]
        near = new[near[stands]]
        stale = np.flatnonzero(lost)
    else:
        if len(name) > 1:
            if mean:
                d = 1.0 - v @ v.T
            else:
                d = np.empty((len(name), len(name)))
                for x, p in least_products(v, begins(), v, begins()):
                    d[x] = 1.0 - p
            end = merge_tree(d, how, limit, 1, n)
            if end:
                a, b, d = zip(*end, strict=True)
                tree.append((name[list(a)], name[list(b)], np.array(d)))
    return tuple(np.concatenate([t[i] for t in tree]) if tree else np.zeros(0, float if i == 2 else np.int64) for i in range(3))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is merged into."""
    name = np.arange(n)
    name[b] = a
    while (name[name] != name).any():
        name = name[name]
    return name


def _in_tasks(rows: DataFrame, group: list[str], how: str, limit: float, leave: int) -> DataFrame:
    """(group, c, cluster) for groups of bounded size (group, c, s): one task clusters a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c", kind="stable")
        v = np.stack(frame["s"].to_numpy())
        if len(v) > SMALL and how != "single":
            a, b, d = tree_in_rounds(v, how, limit)
            lowest = np.argsort(d, kind="stable")[: max(0, len(v) - leave)]
            name = _joined(len(v), a[lowest], b[lowest])
        else:
            name = np.arange(len(v))
            for a, b, _ in merge_tree(1.0 - v @ v.T, how, limit, leave):
                name[name == b] = a
        c = frame["c"].to_numpy()
        return pd.DataFrame({**{g: frame[g].to_numpy() for g in group}, "c": c, "cluster": c[name]})

    kinds = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in [*group, "c"])
    return rows.groupBy(*group).applyInPandas(run, f"{kinds}, cluster {rows.schema['c'].dataType.simpleString()}")


def _unit(windows: DataFrame, group: list[str], ident: str, empty: bool = False) -> DataFrame:
    """(group, c, s) with s of length 1; null vectors stay out, and those of no length if not `empty`."""
    fine = windows.where(F.col("embedding").isNotNull()).select(*group, F.col(ident).alias("c"), F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    if not empty:
        fine = fine.where(dot(F.col("s"), F.col("s")) > NO_LENGTH**2)
    return fine.select(*group, "c", l2_normalize(F.col("s")).alias("s"))


def _by_size(unit: DataFrame, group: list[str], small: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of up to `small` rows, and those of larger ones."""
    large = unit.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*group)
    return unit.join(large, group, "left_anti"), unit.join(large, group, "left_semi")


def _blocks(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """rows with _p, the number of blocks of their group, and _b, the block that `by` falls in."""
    per = rows.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_p"))
    return rows.join(per, group).withColumn("_b", F.pmod(F.xxhash64(*by), F.col("_p")).cast("int"))


def _cells(left: DataFrame, right: DataFrame, group: list[str], run, schema: str) -> DataFrame:
    """run(left rows, right rows) for every block of the left side with every block of the right one; both
    have _p and _b.  The rows of a cell are at most about BLOCK a side."""
    to = lambda df, other, mine, yours: df.join(other.select(*group, F.col("_p").alias("_q")).distinct(), group).withColumn(mine, F.col("_b")).withColumn(yours, F.explode(F.sequence(F.lit(0), F.col("_q") - 1))).drop("_p", "_q", "_b")
    a, b = to(left, right, "_i", "_j"), to(right, left, "_j", "_i")
    keys = [*group, "_i", "_j"]
    a = a.select([F.col(c).alias(c) for c in a.columns])  # both sides may be one table
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def _vectors(t: pa.Table) -> np.ndarray:
    col = t.column("s").combine_chunks()
    return np.asarray(col.flatten(), dtype=float).reshape(len(col), -1)


def _longs(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).to_numpy().astype(np.int64)


def _schema(rows: DataFrame, group: list[str], rest: str) -> tuple[str, list[str]]:
    return ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group) + ", " + rest, group


def _told(t: pa.Table, group: list[str], picked: np.ndarray, **cols) -> pa.Table:
    """The group's columns, `picked` rows of t, with the columns found."""
    own = t.select(group).take(pa.array(picked))
    for name, values in cols.items():
        own = own.append_column(name, pa.array(values))
    return own


def search_average(dirty: DataFrame, state: DataFrame, group: list[str], limit: float) -> DataFrame:
    """(group, x, y, d): the nearest cluster of each dirty one, below the limit; both (group, c, s, n) with
    sums of unit vectors and sizes.  Ties by the smaller number."""
    schema, _ = _schema(state, group, "x long, y long, d double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{g: pa.array([], left.schema.field(g).type) for g in group}, "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        right = right.sort_by("c")
        x, y = _longs(left, "c"), _longs(right, "c")
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        j, best = nearest_means(_vectors(left) / _longs(left, "n")[:, None], _vectors(right) / _longs(right, "n")[:, None], np.where(y[at] == x, at, -1))
        hit = np.flatnonzero(best < limit)
        return _told(left, group, hit, x=x[hit], y=y[j[hit]], d=best[hit])

    found = _cells(_blocks(dirty, group, ["c"]), _blocks(state, group, ["c"]), group, run, schema)
    return found.groupBy(*group, "x").agg(F.min(F.struct("d", "y")).alias("e")).select(*group, "x", "e.y", "e.d")


def search_complete(dirty: DataFrame, state: DataFrame, group: list[str], limit: float, every: bool = False) -> DataFrame:
    """search_average by the largest distance of members; both hold windows (group, c, s) of whole clusters.

    A cluster of up to BLOCK windows lies in one block, so that its distance to another such one is whole
    there and only the nearest leaves the cell.  Of the few larger ones each cell tells its part for every
    partner.  With `every` the distances of all pairs come out.
    """
    schema, _ = _schema(state, group, "x long, y long, d double, whole boolean")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{g: pa.array([], left.schema.field(g).type) for g in group}, "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "whole": pa.array([], pa.bool_())})
        left, right = left.sort_by("c"), right.sort_by("c")
        x, at_x = np.unique(_longs(left, "c"), return_index=True)
        y, at_y = np.unique(_longs(right, "c"), return_index=True)
        big_x, big_y = (t.column("big").to_numpy(zero_copy_only=False)[at] for t, at in ((left, at_x), (right, at_y)))
        out = []
        for i, p in least_products(_vectors(left), at_x, _vectors(right), at_y):
            p[x[i][:, None] == y[None, :]] = -np.inf
            some, j = np.nonzero(np.isfinite(p) & (big_x[i][:, None] | big_y[None, :] | every))
            out.append(_told(left, group, at_x[i[some]], x=x[i[some]], y=y[j], d=np.round(1.0 - p[some, j], 12), whole=np.zeros(len(j), bool)))
            if not every:
                p[big_x[i]], p[:, big_y] = -np.inf, -np.inf
                k, best = _first_best(p)
                hit = np.flatnonzero(best < limit)
                out.append(_told(left, group, at_x[i[hit]], x=x[i[hit]], y=y[k[hit]], d=best[hit], whole=np.ones(len(hit), bool)))
        return pa.concat_tables(out)

    def dealt(rows: DataFrame) -> DataFrame:
        size = rows.groupBy(*group, "c").agg((F.count("*") > BLOCK).alias("big"))
        rows = rows.join(size, [*group, "c"])
        return _blocks(rows, group, ["c", F.when(F.col("big"), F.col("m")).otherwise(F.lit(-1))])

    found = _cells(dealt(dirty), dealt(state), group, run, schema)
    whole = found.groupBy(*group, "x", "y").agg(F.max("d").alias("d"))
    if every:
        return whole
    return whole.where(F.col("d") < limit).groupBy(*group, "x").agg(F.min(F.struct("d", "y")).alias("e")).select(*group, "x", "e.y", "e.d")


def search_single(dirty: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """(group, x, y, d): the nearest window outside its cluster of each dirty window; both (group, m, c, s)."""
    schema, _ = _schema(state, group, "x long, y long, d double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({**{g: pa.array([], left.schema.field(g).type) for g in group}, "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        right = right.sort_by("m")
        x, y = _longs(left, "m"), _longs(right, "m")
        d = np.round(1.0 - _vectors(left) @ _vectors(right).T, 12)
        d[_longs(left, "c")[:, None] == _longs(right, "c")[None, :]] = np.inf
        j = d.argmin(axis=1)
        best = d[np.arange(len(x)), j]
        hit = np.flatnonzero(np.isfinite(best))
        return _told(left, group, hit, x=x[hit], y=y[j[hit]], d=best[hit])

    found = _cells(_blocks(dirty, group, ["m"]), _blocks(state, group, ["m"]), group, run, schema)
    return found.groupBy(*group, "x").agg(F.min(F.struct("d", "y")).alias("e")).select(*group, "x", "e.y", "e.d")


def _finish(state: DataFrame, group: list[str], how: str, limit: float) -> DataFrame:
    """(group, a, b, d): the merges of groups of few clusters (group, c, s, n; windows for complete
    linkage), each group in one task."""
    schema, _ = _schema(state, group, "a long, b long, d double")

    def told(frame: pd.DataFrame, names: np.ndarray, a, b, d) -> pd.DataFrame:
        rows = {g: [frame[g].iloc[0]] * len(a) for g in group}
        return pd.DataFrame({**rows, "a": names[a], "b": names[b], "d": d})

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c", kind="stable")
        v, n = np.stack(frame["s"].to_numpy()), frame["n"].to_numpy()
        return told(frame, frame["c"].to_numpy(), *tree_in_rounds(v, "average", limit, n))

    def complete(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(frame["x"].to_numpy())
        d = np.full((len(names), len(names)), np.inf)
        d[np.searchsorted(names, frame["x"]), np.searchsorted(names, frame["y"])] = frame["d"]
        merges = merge_tree(d, "complete", limit)
        a, b, d = zip(*merges, strict=True) if merges else ((), (), ())
        return told(frame, names, np.array(a, np.int64), np.array(b, np.int64), np.array(d, float))

    if how == "average":
        return state.groupBy(*group).applyInPandas(average, schema)
    return search_complete(state, state, group, limit, every=True).groupBy(*group).applyInPandas(complete, schema)


def merge_rounds(unit: DataFrame, group: list[str], how: str, limit: float = float("inf"), small: int = SMALL) -> DataFrame:
    """(group, a, b, d): all merges below the limit of unit (group, c, s), cluster b into a, each named by its
    smallest member.  As many rounds as the data need; what a round leaves behind is deleted with the next."""
    if how == "single":
        return _single_rounds(unit, group)
    state = settled(unit.withColumn("n", F.lit(1).cast("long")) if how == "average" else unit.withColumn("m", F.col("c")))
    search = search_average if how == "average" else search_complete
    least = small if how == "average" else min(small, SMALL)  # the matrix of complete linkage is made of rows
    near = settled(search(state, state, group, limit))
    tree = []
    while True:
        # whoever has nobody near enough now never will
        count = near.groupBy(*group).agg(F.count("*").alias("_k"))
        few = count.where(F.col("_k") <= least).select(*group)
        going = near
        if not few.isEmpty():
            few = settled(few)
            ends = near.join(few, group, "left_semi").select(*group, F.col("x").alias("c"))
            tree.append(settled(_finish(state.join(_shuffled(ends), [*group, "c"], "left_semi"), group, how, limit)))
            going = near.join(few, group, "left_anti")
        partner = going.select(*group, F.col("x").alias("y"), F.col("y").alias("_z"))
        pairs = settled(going.join(_shuffled(partner), [*group, "y"], "left").select(*group, "x", "y", "d", F.coalesce(F.col("_z") == F.col("x"), F.lit(False)).alias("mutual")))
        merges = pairs.where("mutual AND x < y").select(*group, F.col("x").alias("a"), F.col("y").alias("b"), "d")
        if merges.isEmpty():
            forget(state, near, few, pairs)
            break
        tree.append(merges)
        merged = pairs.where("mutual").select(*group, F.col("x").alias("y"), F.lit(True).alias("_hit"))
        # a merged cluster's nearest is a merged one
        fate = pairs.join(_shuffled(merged), [*group, "y"], "left").withColumn("_dirty", F.col("_hit").isNotNull())
        to = fate.select(*group, F.col("x").alias("c"), F.when(F.col("mutual"), F.least("x", "y")).otherwise(F.col("x")).alias("_to"), "_dirty")
        moved = state.drop("_dirty").join(_shuffled(to), [*group, "c"]).drop("c").withColumnRenamed("_to", "c")
        if how == "average":  # two rows at most meet in one cluster
            moved = moved.groupBy(*group, "c").agg(F.collect_list("s").alias("v"), F.sum("n").alias("n"), F.max("_dirty").alias("_dirty")).select(*group, "c", F.aggregate(F.slice("v", 2, F.size("v")), F.element_at("v", 1), _add).alias("s"), "n", "_dirty")
        after = settled(moved)
        kept = fate.where("NOT _dirty").select(*group, "x", "y", "d")
        again = settled(kept.unionByName(search(after.where("_dirty").drop("_dirty"), after.drop("_dirty"), group, limit)))
        forget(state, near, few)
        state, near = after, again
    return reduce(DataFrame.unionByName, tree) if tree else near.select(*group, F.col("x").alias("a"), F.col("y").alias("b"), "d").where("false")


def _shuffled(df: DataFrame) -> DataFrame:
    """A join's side that grows with the windows: no broadcast, so that it does not pass the driver."""
    return df.hint("shuffle_hash")


def _add(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _single_rounds(unit: DataFrame, group: list[str]) -> DataFrame:
    """(group, a, b, d): a least spanning tree of every group, by windows: in each round every cluster takes its
    shortest way out (ties by the smaller windows).  A window's nearest one is kept until both are of one cluster."""
    state = settled(unit.select(*group, F.col("c").alias("m"), "c", "s"))
    near = settled(search_single(state, state, group))
    tree = []
    while True:
        own = near.join(state.select(*group, F.col("m").alias("x"), "c"), [*group, "x"])
        edge = F.struct("d", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = settled(own.groupBy(*group, "c").agg(F.min(edge).alias("e")).select(*group, "e.*").distinct())
        if edges.isEmpty():
            forget(state, near, edges)
            break
        tree.append(edges)
        of = lambda name: state.select(*group, F.col("m").alias(name), F.col("c").alias(f"c{name}"))
        between = edges.join(of("a"), [*group, "a"]).join(of("b"), [*group, "b"]).select(*group, F.col("ca").alias("a"), F.col("cb").alias("b"))
        root = _roots(between, group)
        after = settled(state.join(root.withColumnRenamed("x", "c"), [*group, "c"], "left").withColumn("c", F.coalesce("to", "c")).drop("to"))
        of = lambda name: after.select(*group, F.col("m").alias(name), F.col("c").alias(f"c{name}"))
        both = settled(near.join(of("x"), [*group, "x"]).join(of("y"), [*group, "y"]))
        dirty = settled(after.join(both.where("cx = cy").select(*group, F.col("x").alias("m")), [*group, "m"], "left_semi"))
        again = settled(both.where("cx <> cy").select(*group, "x", "y", "d").unionByName(search_single(dirty, after, group)))
        forget(state, near, root, both, dirty)
        state, near = after, again
    return reduce(DataFrame.unionByName, [t.select(*group, "a", "b", "d") for t in tree]) if tree else state.select(*group, F.col("m").alias("a"), F.col("m").alias("b"), F.lit(0.0).alias("d")).where("false")


def agglomerate(windows: DataFrame, threshold: float = DEFAULTS.cluster, ident: str = "win_id", group: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """(group, ident, cluster): average linkage by cosine distance, merges below the threshold; a
    cluster is named by its smallest member.  Vectors that are null or of no length stay out."""
    group = list(group or KEYS)
    unit = settled(_unit(windows, group, ident))
    few, many = _by_size(unit, group, small)
    names = [*group, F.col("c").alias(ident), "cluster"]
    out = _in_tasks(few, group, "average", threshold, 1).select(*names)
    if many.isEmpty():
        return out
    many = settled(many)
    tree = settled(merge_rounds(many, group, "average", threshold, small))
    return out.unionByName(_labelled(many, tree, group).select(*names))


def _labelled(unit: DataFrame, merges: DataFrame, group: list[str]) -> DataFrame:
    """(group, c, cluster): the smallest member of each set that the merges join."""
    root = _roots(merges, group).withColumnRenamed("x", "c")
    return unit.select(*group, "c").join(_shuffled(root), [*group, "c"], "left").select(*group, "c", F.coalesce("to", "c").alias("cluster"))


def agglomerate_k(windows: DataFrame, k: int, linkage: str = "complete", ident: str = "win_id", small: int = SMALL) -> DataFrame:
    """(recording_id, ident, cluster): exactly k clusters (fewer windows: one each) by complete, average
    or single linkage; an unknown linkage is complete.  Null vectors stay out; one of no length is 1 from all.

    Recordings of more than `small` windows go in rounds (merge_rounds), with disk in proportion to the
    windows; of their merges the lowest are taken, as many as leave k clusters.
    """
    how = linkage if linkage in ("complete", "average", "single") else "complete"
    g = list(KEYS)
    unit = settled(_unit(windows, g, ident, empty=True))
    few, many = _by_size(unit, g, small)
    names = [*g, F.col("c").alias(ident), "cluster"]
    out = _in_tasks(few, g, how, float("inf"), k).select(*names)
    if many.isEmpty():
        return out
    many = settled(many)
    tree = settled(merge_rounds(many, g, how, small=small))
    n = many.groupBy(*g).agg(F.count("*").alias("n"))
    lowest = Window.partitionBy(*g).orderBy("d", "a", "b")
    kept = tree.join(n, g).withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= F.col("n") - k).select(*g, "a", "b")
    return out.unionByName(_labelled(many, settled(kept), g).select(*names))


def _roots(edges: DataFrame, g: list[str]) -> DataFrame:
    """(group, x, to): the smallest node that each node of the edges (a, b) leads to, in rounds that
    halve the ways: a node takes the smallest label about it, then that label's own."""
    both = settled(edges.select(*g, "a", "b").unionByName(edges.select(*g, F.col("b").alias("a"), F.col("a").alias("b"))))
    label = settled(both.groupBy(*g, "a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "x"))
    while True:
        seen = both.join(_shuffled(label.select(*g, F.col("x").alias("b"), F.col("to").alias("t"))), [*g, "b"]).groupBy(*g, F.col("a").alias("x")).agg(F.min("t").alias("t"))
        step = label.join(_shuffled(seen), [*g, "x"]).select(*g, "x", F.col("to").alias("old"), F.least("to", "t").alias("to"))
        jump = step.select(*g, F.col("x").alias("to"), F.col("to").alias("next"))
        after = settled(step.join(_shuffled(jump), [*g, "to"], "left").select(*g, "x", "old", F.least("to", F.coalesce("next", "to")).alias("to")))
        done = after.where("old != to").isEmpty()
        forget(label)
        label = after
        if done:
            forget(both)
            return after.select(*g, "x", "to")


def cap_clusters(windows: DataFrame, labels: DataFrame, most: int = DEFAULTS.max_clusters, ident: str = "win_id", small: int = SMALL) -> DataFrame:
    """Recordings with too many clusters are clustered again, into so many by average linkage."""
    g = list(KEYS)
    many = labels.groupBy(*g).agg(F.countDistinct("cluster").alias("k")).where(F.col("k") > most).select(*g)
    again = agglomerate_k(windows.join(many, g, "left_semi"), most, "average", ident, small)
    return labels.join(many, g, "left_anti").select(*g, ident, "cluster").unionByName(again)


def greedy_merge(windows: DataFrame, labels: DataFrame, limit: float = DEFAULTS.merge, ident: str = "win_id") -> DataFrame:
    """The first pair of clusters (by number) whose mean vectors are close becomes one, means are taken
    anew, and again until none is: one merge for every recording a round.

    Rounds work on one row a cluster, its sum and number of vectors, and on the recordings that still merge;
    windows are read once to make the rows and once to be labelled.
    """
    g = list(KEYS)
    rows = windows.select(*g, ident, "embedding").join(labels.select(*g, ident, "cluster"), [*g, ident])
    known = rows.where(F.col("embedding").isNotNull())
    parts = known.select(*g, "cluster", F.posexplode("embedding").alias("_p", "_x")).groupBy(*g, "cluster", "_p").agg(F.sum(F.col("_x").cast("double")).alias("_x"), F.count("*").alias("n"))
    state = settled(parts.groupBy(*g, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda x: x["_x"]).alias("s"), F.max("n").alias("n")))
    into = []
    while True:
        c = state.select(*g, "cluster", F.transform("s", lambda x: x / F.col("n")).alias("v"))
        a, b = c.toDF(*g, "a", "va"), c.toDF(*g, "b", "vb")
        close = a.join(b, g).where("a < b").where(cosine_distance(F.col("va"), F.col("vb")) < limit)
        pick = settled(close.groupBy(*g).agg(F.min(F.struct("a", "b")).alias("p")).select(*g, "p.a", F.col("p.b").alias("cluster")))
        if pick.isEmpty():
            forget(state, pick)
            break
        into.append(pick)
        # recordings without a close pair are done
        moved = state.join(pick.select(*g), g, "left_semi").join(pick, [*g, "cluster"], "left").withColumn("cluster", F.coalesce("a", "cluster"))
        after = settled(moved.groupBy(*g, "cluster").agg(F.collect_list("s").alias("v"), F.sum("n").alias("n")).select(*g, "cluster", F.aggregate(F.slice("v", 2, F.size("v")), F.element_at("v", 1), _add).alias("s"), "n"))
        forget(state)
        state = after
    if not into:
        return rows.select(*g, ident, "cluster")
    edges = reduce(DataFrame.unionByName, [p.select(*g, F.col("a").cast("long").alias("a"), F.col("cluster").cast("long").alias("b")) for p in into])
    root = _roots(settled(edges), g).select(*g, F.col("x").alias("cluster"), "to")
    return rows.join(root, [*g, "cluster"], "left").select(*g, ident, F.coalesce("to", "cluster").alias("cluster"))


def distance_matrix(vectors: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Each vector (id, embedding) against the references (name, ref_embedding) of its keys."""
    return vectors.join(refs, keys).withColumn("distance", cosine_distance(F.col("embedding"), F.col("ref_embedding")))


def detect_overlaps(windows: DataFrame, centroids: DataFrame, th: Thresholds = DEFAULTS, ident: str = "win_id") -> DataFrame:
    """Windows between two clusters: the nearest two centroids differ little for their distance, or the
    nearest is far; clarity is the gap over the distance.  One cluster alone overlaps with none."""
    g = list(KEYS)
    d = distance_matrix(windows.select(*g, ident, "embedding"), centroids.select(*g, "cluster", F.col("centroid").alias("ref_embedding")), g)
    top = d.groupBy(*g, ident).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "cluster"))), 1, 2).alias("t")).where(F.size("t") == 2)
    d1, d2 = F.col("t")[0]["distance"], F.col("t")[1]["distance"]
    hit = ((d2 - d1) < th.overlap_ratio * d1 + 0.015) | (d1 > th.overlap_far)
    return top.select(*g, ident, F.col("t")[0]["cluster"].alias("first"), F.col("t")[1]["cluster"].alias("second"), hit.alias("is_overlap"), F.when(d1 > 0, (d2 - d1) / d1).otherwise(1.0).alias("clarity"))


def cluster_balance(labels: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Sizes and shares of the clusters; with two or more and one that holds nearly all, naming is off."""
    g = list(KEYS)
    c = labels.groupBy(*g, "cluster").agg(F.count("*").alias("size"))
    w = Window.partitionBy(*g)
    c = c.withColumns({"share": F.col("size") / F.sum("size").over(w), "clusters": F.count("*").over(w)})
    top = F.max("share").over(w)
    block = (F.col("clusters") >= 2) & (top > th.naming_share)
    return c.withColumn("naming_block", F.when(block, F.concat(F.lit("cluster_collapse_"), F.round(top * 100).cast("int"), F.lit("%"))))


def split_by_cohesion(spans: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Spans (recording_id, cluster, span_id, embedding) of each cluster in voices: average linkage at
    the cohesion limit; single-span groups go; groups whose nearest others are all within the limit are
    one voice again.  Fail closed: a cluster without a group, or whose spread isn't tight, is unverified."""
    from chronovox.functions.vectors import pairwise_mean

    per = [*KEYS, "cluster"]
    got = _voices(spans, th, per)
    size = got.groupBy(*per, "voice").agg(F.count("*").alias("spans"))
    good = size.where("spans > 1")
    rows = spans.join(got.join(good.drop("spans"), [*per, "voice"]), [*per, "span_id"])
    c = centroid(rows, [*per, "voice"])
    a, b = c.select(*per, F.col("voice").alias("x"), F.col("centroid").alias("vx")), c.select(*per, F.col("voice").alias("y"), F.col("centroid").alias("vy"))
    near = a.join(b, per).where("x != y").groupBy(*per, "x").agg(F.min(cosine_distance(F.col("vx"), F.col("vy"))).alias("d"))
    one = near.groupBy(*per).agg(F.max("d").alias("d")).where(F.col("d") < th.cohesion).select(*per, F.lit(True).alias("_one"))
    rows = rows.join(one, per, "left").withColumn("voice", F.when(F.col("_one"), F.lit(-1)).otherwise(F.col("voice"))).drop("_one")
    tight = pairwise_mean(rows, [*per, "voice"])
    out = spans.select(*per).distinct().join(tight, per, "left")
    status = F.when(F.col("voice").isNull(), "unverified:no_group").when(F.col("mean_distance") > th.cohesion, "unverified:loose").otherwise("verified")
    return out.select(*per, "voice", F.col("n").alias("spans"), "mean_distance", status.alias("status"))


def _voices(spans: DataFrame, th: Thresholds, per: list[str]) -> DataFrame:
    keyed = spans.select(*[F.col(c).alias(f"_{c}") for c in per], "span_id", "embedding")
    got = agglomerate(keyed, th.cohesion, "span_id", [f"_{c}" for c in per], WHOLE)
    return got.select(*[F.col(f"_{c}").alias(c) for c in per], "span_id", F.col("cluster").alias("voice"))
