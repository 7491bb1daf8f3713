"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes its set of distinct word shingles.  A first exchange counts in how many sets each
shingle occurs; shingles that occur once can't be shared, so only the others go on.  In order of
rising frequency a set's prefix of |set| - least overlap + k shingles must share k shingles with any
partner's; each document picks its k by the cost that its prefix's frequencies lead one to expect.

Documents with equal sets are one class.  Within the classes, each (prefix shingle, size) group first
compares its members with its most typical one; what that links is one component.  Then only pairs
of different components that share enough prefix shingles are compared, so that a group of n near
copies costs about n comparisons, and yet no link between components is left out.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronovox.llm.common import batched, forget, partitions, saved, table
from chronovox.llm.components import components
from chronovox.llm.words import ascii_words, text_slices

WORDS, PERCENT = 4, 85
#: Largest k of a prefix, and what a comparison costs in posting rows.
MAX_MATCHES, COMPARE_COST = 8, 5.0
SLICE = 4 << 20
#: A task sends its shingles on when it holds so many; places of sets in a flush take two bytes.
FLUSH_SHINGLES, FLUSH_DOCS = 600_000, 16_000
#: A shingle in so many sets of a flush is sent on once, with its count.
OFTEN = 16
#: Text that one bucket of shingles stands for: its numbers are in one task's memory.
BUCKET_BYTES = 24 << 20
_TOKEN_BITS = np.uint64(40)
_TOKEN = np.uint64((1 << 40) - 1)
#: Kinds of rows between the exchanges: a flush's sets, places of its frequent shingles, (shingle, place)
#: lists and counts of frequent shingles.
HEAD, PLACES, LIST, COUNTS = range(4)
FREQ_BYTES = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a set's mark: bit i tells whether an odd number of its shingles fall to i.  Two sets differ
#: in as many shingles at least as their marks differ in bits.
_MARKS = 256
#: Bits of the mark that is kept with a set; its parts of _MARKS bits, taken together by xor, are the shorter one.
_WIDE = 1024
#: Ratio of neighbouring size groups.
_SIZE_STEP = 1.08


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """The sorted distinct 64-bit shingle hashes of each text, A-Z as a-z."""
    counts, split = ascii_words(pc.ascii_lower(texts))
    coded = split.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    per_word = pd.util.hash_array(names.astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    w = per_word[np.asarray(coded.indices)] if len(split) else np.zeros(0, np.uint64)
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for k in range(words):
            h = h * _ODD + w[k : len(w) - words + 1 + k]
        h = _mix(h)
    ends = np.cumsum(counts)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            yield np.unique(h[end - n : end - words + 1])
        elif n:
            one = np.uint64(n)
            for x in w[end - n : end]:
                one = np.uint64((int(one) * int(_ODD) + int(x)) & (2**64 - 1))
            yield _mix(np.array([one], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> int:
    """A 63-bit number for a shingle set; sets of over 1e6 classes are not expected to share one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def document_classes(docs: DataFrame, words: int = WORDS, *more: str) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set) of every row, and more long columns as they are."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, texts in text_slices(batch, SLICE):
                sets = list(shingle_sets(texts, words))
                cols = {"doc_id": ids.slice(first, len(sets)), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array([digest(s) if len(s) else None for s in sets], pa.int64())}
                yield pa.RecordBatch.from_pydict(cols | {c: batch.column(batch.schema.get_field_index(c)).slice(first, len(sets)) for c in more})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return batched(rows).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "class", *more)))


# -- coding of (shingle, document) lists ----------------------------------------------------------


def _planes(x: np.ndarray, width: int) -> bytes:
    """Bytes of the numbers, lowest bytes first: planes of zeros cost nothing once compressed."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _pack(token: np.ndarray, *more: tuple[np.ndarray, int]) -> bytes:
    """Shingles in order, and numbers of so many bytes that go with them."""
    return b"".join([np.uint32(len(token)).tobytes(), _planes(np.diff(token, prepend=np.uint64(0)), 5), *[_planes(x, width) for x, width in more]])


def _unpack(data: bytes, *widths: int) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    view = memoryview(data)[4:]
    out, at = [np.cumsum(_unplanes(view, n, 5), dtype=np.uint64)], 5 * n
    for width in widths:
        out.append(_unplanes(view[at:], n, width))
        at += width * n
    return out


def _marks(sets: list[np.ndarray]) -> bytes:
    """The marks of some sets, one after another; a few sets at a time."""
    out, step = [], 1024
    for a in range(0, len(sets), step):
        part = sets[a : a + step]
        place = np.repeat(np.arange(len(part)) * _WIDE, [len(s) for s in part])
        odd = np.bincount(place + (np.concatenate(part) % np.uint64(_WIDE)).astype(np.int64), minlength=len(part) * _WIDE) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(len(part), _WIDE), axis=1).tobytes())
    return b"".join(out)


def shared_shingles(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """class, n, m, k, prefix, tokens, marks of every class that has enough shared shingles for a link.

    tokens holds all shingles of the set that occur in other sets, prefix those of them in the prefix,
    marks the bitmap of the whole set.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * partitions(spark), size // BUCKET_BYTES)

    def send(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        sets, keys, held = [], [], 0

        def flush():
            h = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            key = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)) << _TOKEN_BITS
            key |= _mix(h * _ODD) & _TOKEN
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            del h, order
            name = int.from_bytes(hashlib.blake2b(f"{part}:{number}:{keys[0]}".encode(), digest_size=8).digest(), "little") >> 1
            home = int(name % buckets)
            starts = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)))
            counts = np.diff(starts, append=len(key))
            often = counts >= OFTEN
            seldom = ~np.repeat(often, counts)
            # frequent shingles' places wait for their frequencies where the flush is put together again
            rows = [(home, name, HEAD, np.array(keys, "<i8").tobytes() + np.array([len(s) for s in sets], "<u4").tobytes() + _marks(sets))]
            if often.any():
                rows.append((home, name, PLACES, np.uint32(often.sum()).tobytes() + counts[often].astype("<u4").tobytes() + place[~seldom].astype("<u2").tobytes()))
            for kind, k, more, width in ((LIST, key[seldom], place[seldom], 2), (COUNTS, key[starts[often]], counts[often], FREQ_BYTES)):
                bucket = k >> _TOKEN_BITS
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1), append=bucket[-1:] + np.uint64(1)))
                rows += [(int(bucket[a]), name, kind, _pack(k[a:b] & _TOKEN, (more[a:b], width))) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_pydict(
                {"bucket": pa.array([r[0] for r in rows], pa.int32()), "flush": pa.array([r[1] for r in rows], pa.int64()), "kind": pa.array([r[2] for r in rows], pa.int32()), "data": [r[3] for r in rows]}
            )

        known: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch, SLICE):
                for s in shingle_sets(texts, words):
                    if not len(s):
                        continue
                    key = digest(s)
                    if key in known:
                        continue  # equal sets of one flush count once
                    known.add(key)
                    sets.append(s)
                    keys.append(key)
                    held += len(s)
                    if held >= FLUSH_SHINGLES or len(sets) >= FLUSH_DOCS:
                        yield flush()
                        sets, keys, held, number = [], [], 0, number + 1
                        known.clear()
        if sets:
            yield flush()

    def count(key, frame):
        """In one bucket: the frequency of each shingle, back to the senders where it is over 1."""
        kind = frame["kind"]
        out = [tuple(r) for r in frame[kind <= PLACES][["flush", "kind", "bucket", "data"]].itertuples(index=False)]
        frame = frame[kind > PLACES]
        if len(frame):
            got = [_unpack(d, 2 if k == LIST else FREQ_BYTES) for k, d in zip(frame["kind"], frame["data"], strict=True)]
            distinct, back = np.unique(np.concatenate([t for t, _ in got]), return_inverse=True)
            times = np.concatenate([np.ones(len(t), np.uint64) if k == LIST else c for k, (t, c) in zip(frame["kind"], got, strict=True)])
            freq = np.zeros(len(distinct), np.uint64)
            np.add.at(freq, back, times)
            at = 0
            for f, k, (t, x) in zip(frame["flush"], frame["kind"], got, strict=True):
                mine = freq[back[at : at + len(t)]]
                at += len(t)
                ok = mine > 1
                if ok.any():
                    out.append((int(f), int(k), int(key[0]), _pack(t[ok], (mine[ok], FREQ_BYTES), *[(x[ok], 2)] * (k == LIST))))
        return pd.DataFrame(out, columns=["flush", "kind", "bucket", "data"])

    def choose(frame):
        """For one flush: its sets' shared shingles, prefixes and k."""
        of = lambda kind: frame[frame["kind"] == kind].sort_values("bucket")
        head = of(HEAD)["data"].iloc[0]
        n_docs = len(head) // (12 + _WIDE // 8)
        keys = np.frombuffer(head, "<i8", n_docs)
        sizes = np.frombuffer(head, "<u4", n_docs, 8 * n_docs).astype(np.int64)
        marks = np.frombuffer(head, "<i8", n_docs * _WIDE // 64, 12 * n_docs).reshape(n_docs, -1)
        token, place, freq = [], [], []
        for b, d in zip(of(LIST)["bucket"], of(LIST)["data"], strict=True):
            t, q, p = _unpack(d, FREQ_BYTES, 2)
            token.append(t | (np.uint64(b) << _TOKEN_BITS))
            place.append(p)
            freq.append(q)
        for d in of(PLACES)["data"]:
            n = int(np.frombuffer(d, "<u4", 1)[0])
            counts = np.frombuffer(d, "<u4", n, 4)
            known = [(t | (np.uint64(b) << _TOKEN_BITS), q) for b, c in zip(of(COUNTS)["bucket"], of(COUNTS)["data"], strict=True) for t, q in [_unpack(c, FREQ_BYTES)]]
            token.append(np.repeat(np.concatenate([t for t, _ in known]), counts))
            place.append(np.frombuffer(d, "<u2", int(counts.sum()), 4 + 4 * n).astype(np.uint64))
            freq.append(np.repeat(np.concatenate([q for _, q in known]), counts))
        out = []
        if token:
            token, place, freq = (np.concatenate(x) for x in (token, place, freq))
            m = np.bincount(place.astype(np.int64), minlength=n_docs)
            enough = 100 * m >= percent * sizes
            keep = enough[place.astype(np.int64)]
            token, place, freq = token[keep], place[keep], freq[keep]
            order = np.lexsort((token, freq, place))
            token, place, freq = token[order], place[order], freq[order]
            at = np.searchsorted(place, np.arange(n_docs + 1))
            for i in np.flatnonzero(enough).tolist():
                t, q, n = token[at[i] : at[i + 1]], freq[at[i] : at[i + 1]], int(sizes[i])
                least = -(-percent * n // 100)
                spare = n - least - (n - len(t))  # prefix places that shared shingles get, without k
                sums = np.cumsum(q)
                best = min((c, k) for k in range(1, min(MAX_MATCHES, len(t) - spare) + 1) for c in [float(sums[spare + k - 1]) * (1 + COMPARE_COST / k)])
                k = best[1]
                out.append((int(keys[i]), n, len(t), k, t[: spare + k].astype(np.int64), np.sort(t).tobytes(), marks[i]))
        return pd.DataFrame(out, columns=["class", "n", "m", "k", "prefix", "tokens", "marks"])

    sent = batched(text).mapInArrow(send, "bucket int, flush long, kind int, data binary")
    counted = sent.groupBy("bucket").applyInPandas(count, "flush long, kind int, bucket int, data binary")
    return counted.groupBy("flush").applyInPandas(choose, "class long, n int, m int, k int, prefix array<long>, tokens binary, marks array<long>")


def _links(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = nodes.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = nodes.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            keep = []
            for x, y, n, m in zip(rows["t_a"], rows["t_b"], rows["n_a"], rows["n_b"], strict=True):
                s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                both = int((t[at] == s).sum())
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_pydict({"a": pa.array(rows["a"], pa.int64()), "b": pa.array(rows["b"], pa.int64())}).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def class_links(nodes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between classes that make the same components as all links do, and the written steps
    that they are read from."""
    spark = nodes.sparkSession
    share = float(percent)
    size = lambda n: F.floor(F.log(n) / float(np.log(_SIZE_STEP))).cast("int")
    # a partner of size x needs an overlap of percent / (100 + percent) * (n + x), of m at most
    most = F.floor(F.col("m") * (100.0 + share) / share + 1e-9) - F.col("n")
    longs = _MARKS // 64
    marks = [reduce(lambda x, y: x.bitwiseXOR(y), [F.col("marks")[j] for j in range(i, _WIDE // 64, longs)]) for i in range(longs)]
    posted = nodes.select("class", "n", "m", "k", *[x.alias(f"x{i}") for i, x in enumerate(marks)], F.explode("prefix").alias("token"), most.cast("long").alias("most"))
    probe = posted.withColumn("low", F.ceil(F.col("n") * share / 100.0 - 1e-9)).withColumn("high", F.least("n", "most")).where("low <= high")
    probe = probe.withColumn("size", F.explode(F.sequence(size(F.col("low")), size(F.col("high")))))
    probe = probe.select("token", "size", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("most").alias("most_a"), "low", *[F.col(f"x{i}").alias(f"xa{i}") for i in range(len(marks))])
    index = posted.select("token", size(F.col("n")).alias("size"), F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), F.col("most").alias("most_b"), (F.col("m") / F.col("n")).alias("typical"), *[F.col(f"x{i}").alias(f"xb{i}") for i in range(len(marks))])
    fits = (F.col("n_b") >= F.col("low")) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    # sets of n_a and n_b that differ in d shingles share (n_a + n_b - d) / 2
    both = F.col("n_a") + F.col("n_b")

    def alike(xs, ys):
        differ_by = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(xs, ys, strict=True)), F.lit(0))
        return (both - differ_by) * (100 + percent) >= 2 * percent * both

    short = alike([F.col(f"xa{i}") for i in range(longs)], [F.col(f"xb{i}") for i in range(longs)])
    wide = alike([F.col("wa")[i] for i in range(_WIDE // 64)], [F.col("wb")[i] for i in range(_WIDE // 64)])
    once = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    # each group's most typical member against all others
    hub = index.groupBy("token", "size").agg(F.max_by(F.struct("b", "n_b", "most_b", *[f"xb{i}" for i in range(len(marks))]), F.struct("typical", "b")).alias("h")).select("token", "size", "h.*")
    stars = probe.join(hub, ["token", "size"]).where(fits & short & (F.col("a") != F.col("b")))
    stars = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = saved(_links(stars, nodes, percent), "stars")
    roots = saved(components(found), "roots")
    # then pairs of different components: one side is outside its shingle's largest component
    part = lambda df, c, out: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    index = part(index.drop("typical", *[f"xb{i}" for i in range(longs)]), "b", "root_b")
    per = index.groupBy("token", "root_b").agg(F.countDistinct("b").alias("c"))
    per = per.groupBy("token").agg(F.max_by("root_b", F.struct("c", "root_b")).alias("major"), F.count("*").alias("roots")).where("roots > 1").select("token", "major")
    # only what is left meets its whole mark: the short one hardly tells long sets apart
    whole = lambda df, c, out: df.join(per, "token").join(nodes.select(F.col("class").alias(c), F.col("marks").alias(out)), c)
    index = saved(whole(index, "b", "wb"), "index")
    probe = saved(part(whole(probe.drop(*[f"xa{i}" for i in range(longs)]), "a", "wa"), "a", "root_a"), "probe")
    differ = F.col("root_a") != F.col("root_b")
    one = probe.where("root_a != major").join(index.drop("major"), ["token", "size"]).where(fits & wide & once & differ)
    two = probe.where("root_a = major").drop("major").join(index.where("root_b != major"), ["token", "size"]).where(fits & wide & once & differ)
    cols = ["token", "a", "b", F.least("k_a", "k_b").alias("k")]
    pairs = one.select(*cols).unionByName(two.select(*cols)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("k").alias("k")).where("shared >= k").select("a", "b")
    return found.unionByName(_links(pairs, nodes, percent)), [found, roots, index, probe]


def class_roots(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) for every class that is linked with another."""
    nodes = saved(shared_shingles(docs, words, percent).dropDuplicates(["class"]), "nodes")
    links, steps = class_links(nodes, percent)
    roots = components(links)  # these have been written: the steps before go
    forget(nodes, *steps)
    return roots


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    A null or empty text, or one without words, has no shingles and its own doc_id as component_id; so
    has a text that is linked with none.  A null doc_id stays null, and counts for no component_id but
    where a component has no other.  Repeated rows give repeated results; other columns play no part.
    """
    docs = docs.select("doc_id", "text")
    classes = saved(document_classes(docs, words), "classes")
    roots = class_roots(docs, words, percent)
    # the smallest doc_id of each class, then of each component
    first = classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    first = first.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = first.groupBy("root").agg(F.min("first").alias("component"))
    named = first.join(least, "root").select("class", "component")
    out = classes.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, in its columns, with one row of each component of texts: the one with the smallest doc_id,
    one without doc_id where no row has any.  Rows without shingles all stay.

    Only texts decide what belongs together: rows that repeat a doc_id, or have none, stay as long as
    their texts are not linked.
    """
    # columns go by place, so that no name of docs can be taken for one of these
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    # a row's own digest, by which it is found again; rows that share one are equal in all columns
    marked = rows.withColumn("_row", F.xxhash64(*[x for c in names for x in (F.col(c).isNull(), F.col(c))]))
    classes = saved(document_classes(marked.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "_row"), words, "_row"), "classes")
    roots = class_roots(docs.select("text"), words, percent)
    each = classes.where("class IS NOT NULL").groupBy("class", "doc_id", "_row").agg(F.count("*").alias("n"))
    each = each.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class", "_row", "n")).alias("m"))
    kept = first.select("m._row", (F.col("m.n") > 1).alias("_many"))
    kept = saved(kept.unionByName(classes.where("class IS NULL").select("_row", F.lit(False).alias("_many")).distinct()), "kept")
    out = marked.join(kept.where("NOT _many"), "_row", "left_semi")
    if not kept.where("_many").isEmpty():
        out = out.unionByName(marked.join(kept.where("_many"), "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*names).toDF(*docs.columns)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
