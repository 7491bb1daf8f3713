"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers.  The index holds, for every block of rows, one bitmap per component
and bit.  A query's score is summed with bitmap arithmetic alone: the slices of a component are shifted
by the set bits of the query's number, and full adders over whole bitmaps reduce each weight to one
slice.  The top rows are then selected from the most significant slice downward; rows tied at the
boundary are resolved by id, and the chosen rows' scores are read back from the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.llm.common import saved, table

SCALE = 1024
TOP = 10
#: Rows of an index block (a multiple of 64).
BLOCK_ROWS = 16384
#: Rows of a block of queries, and index blocks that a task holds while blocks of queries pass by.
QUERY_BLOCK, HELD_BLOCKS = 256, 16
#: Larger numbers count as this one, so that all are longs.
LARGEST = 1 << 62
QUERY_EVERY = 100


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component, at most LARGEST away from 0, without vectors that are
    null or hold a null or a number that isn't finite.  A vector without components has score 0 with all."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    most = float(LARGEST)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(most)), F.lit(-most))).cast("long")).alias("q"))


#: A block's row: of the index, or (dims -1) of queries with their lengths and numbers in slices.
_RIDE = "n int, ids binary, dims int, low long, width int, slices binary"


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: n, ids, dims, low (taken off every number), width (bits), slices."""

    def run(batches):
        ids, held, size = [], [], 0

        def block(i: np.ndarray, v: np.ndarray):
            order = np.argsort(i, kind="stable")
            i, v = i[order], v[order]
            n, dims = v.shape
            low = int(v.min(initial=0))
            u = v.astype(np.uint64) - np.uint64(low % 2**64)
            width = max(1, int(u.max(initial=0)).bit_length())
            padded = -(-n // 64) * 64
            bits = np.zeros((dims, width, padded), np.uint8)
            for b in range(width):
                bits[:, b, :n] = ((u >> np.uint64(b)) & np.uint64(1)).T
            return pa.RecordBatch.from_pydict(
                {"n": pa.array([n], pa.int32()), "ids": [i.astype("<i8").tobytes()], "dims": pa.array([dims], pa.int32()), "low": pa.array([low], pa.int64()), "width": pa.array([width], pa.int32()), "slices": [np.packbits(bits, axis=2, bitorder="little").tobytes()]}
            )

        for batch in batches:
            col = batch.column(1)
            count = np.asarray(col.value_lengths()).astype(int)
            flat = np.asarray(col.flatten()).astype(np.int64)
            keys = np.asarray(batch.column(0))
            ends = np.cumsum(count)
            for dims in np.unique(count).tolist():  # a block holds vectors of one length
                mine = np.flatnonzero(count == dims)
                v = flat[(ends[mine] - dims)[:, None] + np.arange(dims)]
                for a in range(0, len(mine), block_rows):
                    if held and (held[0].shape[1] != dims or size + len(mine[a : a + block_rows]) > block_rows):
                        yield block(np.concatenate(ids), np.concatenate(held))
                        ids, held, size = [], [], 0
                    ids.append(keys[mine[a : a + block_rows]])
                    held.append(v[a : a + block_rows])
                    size += len(held[-1])
        if held:
            yield block(np.concatenate(ids), np.concatenate(held))

    return rows.mapInArrow(run, _RIDE)


def products(v: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as longs; what a long can't hold is the long nearest to it."""
    most = max(1, v.shape[1]) * max((int(abs(x).max(initial=0)) for x in (v, query)), default=0) ** 2
    if most < 2**62:
        return v @ query
    exact = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in v]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], np.int64)


class Block:
    """A block of the index in memory: its slices and their complements, 64 rows a word."""

    def __init__(self, row: dict):
        self.n, self.dims, self.width, self.low = row["n"], row["dims"], row["width"], row["low"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        slices = np.frombuffer(row["slices"], "<u8").reshape(self.dims * self.width, -(-self.n // 64))
        self.bitmaps = np.concatenate([slices, ~slices])
        self.valid = np.zeros(slices.shape[1] * 64, np.uint8)
        self.valid[: self.n] = 1
        self.valid = np.packbits(self.valid, bitorder="little").view("<u8")

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * u), u the number or (where q is negative) its complement: the order of
        the scores.  Missing components of either count as 0."""
        query = query[: self.dims]
        size = np.abs(query).astype(np.int64)
        base = np.arange(len(query)) * self.width + np.where(query < 0, self.dims * self.width, 0)
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max()).bit_length() if len(size) else 0):
            rows = base[(size >> j) & 1 == 1]
            if len(rows):
                for i in range(self.width):
                    columns.setdefault(i + j, []).append(rows + i)
        if not columns:
            return []
        out, carry, p = [], [], min(columns)
        out += [np.zeros(self.bitmaps.shape[1], np.uint64)] * p
        top = max(columns)
        while p <= top or carry:
            here = [self.bitmaps[np.concatenate(columns[p])]] if p in columns else []
            x = np.concatenate(here + carry) if here or carry else np.zeros((0, self.bitmaps.shape[1]), np.uint64)
            carry = []
            while len(x) > 2:
                m = len(x) // 3
                a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                ab = a ^ b
                carry.append((a & b) | (c & ab))
                ab ^= c
                x = np.concatenate([ab, x[3 * m :]])
            if len(x) == 2:
                carry.append((x[0] & x[1])[None])
                out.append(x[0] ^ x[1])
            else:
                out.append(x[0] if len(x) else np.zeros(self.bitmaps.shape[1], np.uint64))
            p += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of the block, the query's own left out."""
        open_ = self.valid.copy()
        for own in np.flatnonzero(self.ids == query_id).tolist():
            open_[own >> 6] &= ~np.uint64(1 << (own & 63))
        sure = np.zeros_like(open_)
        for s in reversed(self.sums(query)):
            with_bit = open_ & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(with_bit).sum())
            if n > k:
                open_ = with_bit
            elif n < k:
                sure |= with_bit
                open_ &= ~s
            else:
                sure |= with_bit
                open_ = np.zeros_like(open_)
                break
        chosen = self._places(sure)
        # what is still open ties at the boundary; rows stand in order of id
        chosen = np.concatenate([chosen, self._places(open_)[: max(0, k - len(chosen))]])
        return self.ids[chosen], products(self.values(chosen)[:, : len(query)], query[: self.dims])

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The quantised numbers of some rows, from their bits."""
        half = self.bitmaps[: self.dims * self.width]
        bits = (half[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        weight = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        u = (bits.reshape(self.dims, self.width, len(rows)) * weight[None, :, None]).sum(axis=1, dtype=np.uint64).T
        return (u + np.uint64(self.low % 2**64)).astype(np.int64)


def _query_blocks(queries: DataFrame, block: int) -> DataFrame:
    """Blocks of about `block` queries in the columns of _RIDE."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                ids, q = batch.column(0).slice(a, block), batch.column(1).slice(a, block)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "ids": [np.asarray(ids).astype("<i8").tobytes()], "dims": pa.array([-1], pa.int32()), "low": pa.array([0], pa.int64()), "width": pa.array([0], pa.int32()), "slices": [np.concatenate([np.asarray(q.value_lengths()).astype("<i8"), np.asarray(q.flatten()).astype("<i8")]).tobytes()]})

    return queries.select("vec_id", "q").mapInArrow(run, _RIDE)


def search(index: DataFrame, queries: DataFrame, k: int = TOP, block: int = QUERY_BLOCK, held: int = HELD_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score: every query's k best rows of the index (all, if fewer), ties to
    the smaller vec_id; a row with the query's own vec_id is no candidate.  Scores beyond a long are the
    nearest long, and such rows rank by that.

    queries: vec_id, q; of rows with the same vec_id one is asked, repeated rows of the index all stand.
    Both sides are tables of blocks: up to `held` index blocks, fewer where there are more cores than that
    gives parts, make a part, to which every block of
    queries goes; a task holds its part's index blocks while the queries pass, and sends k rows of each.
    """
    index = index.withColumn("name", F.xxhash64("ids"))
    names = index.select("name").distinct()  # one row a block
    parts = max(1, min(names.count(), max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // held))))
    names = names.withColumn("part", F.pmod(F.row_number().over(Window.orderBy("name")), F.lit(parts)).cast("int"))
    own = index.join(names, "name").drop("name").withColumn("kind", F.lit(0))
    asked = _query_blocks(queries.dropDuplicates(["vec_id"]), block)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(1))
    # a key for each part and row kind, so that a task meets a part's index before its queries
    dealt = own.unionByName(asked).repartition(4 * parts, "part").sortWithinPartitions("part", "kind")

    def run(batches):
        part, here = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if row["part"] != part:
                    part, here = row["part"], []
                if row["kind"] == 0:
                    here.append(Block(row))
                    continue
                ids = np.frombuffer(row["ids"], "<i8")
                lengths, flat = np.split(np.frombuffer(row["slices"], "<i8"), [len(ids)])
                found = []
                for query_id, q in zip(ids.tolist(), np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                    got = [b.top(query_id, q, k) for b in here]
                    v, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([g[0] for g in got], [g[1] for g in got]))
                    keep = np.lexsort((v, -s.astype(object) if len(s) and s.min() == -(2**63) else -s))[:k]
                    found.append((np.full(len(keep), query_id), v[keep], s[keep]))
                query_ids, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict({"query_id": query_ids.astype(np.int64), "vec_id": v, "score": s})

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return search(saved(build_index(rows), "slices"), rows.where(F.col("vec_id") % QUERY_EVERY == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         coalesce(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
