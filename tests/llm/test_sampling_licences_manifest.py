"""Importance resampling, licence scan and Merkle manifest against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronovox.llm import importance, licenses, merkle
from chronovox.llm.common import numbered, saved, table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, nothing, ties, repeated rows, other scripts, a very long text.
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, "the MIT License of some words here", "en", "a", 9), (2, "the MIT License of some words here", "en", "a", 9), (3, "the MIT License of some words here", "en", None, 9),
    (None, "Another\ntext é ß ÀB, it says", "fr", "b", 9), (4, "word " * 60_000 + "Licensed under the Apache License, Version 2.0", "de", "c", 5), (5, "日本語 テスト 👩‍👩‍👧", None, "c", 9), (6, "x " * 30, "en", "b", 1), (7, "x " * 30, "en", "b", 1),
]
CLASH = ("w", "f", "line", "times", "bucket", "gains", "score", "rank", "_number", "_at", "_part", "leaf", "changed", "tree", "n", "size", "digest", "level", "block", "members", "places", "near", "start", "root")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def rows(df):
    return sorted(map(str, df.collect()))


# -- 11 ---------------------------------------------------------------------------------------------


def brute_scores(docs, target, most, buckets, percent, least):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    def count(texts):
        n = [0] * buckets
        for t in texts:
            for f in features(t):
                n[zlib.crc32(f.encode()) % buckets] += 1
        return n

    s, t = count(d[1] for d in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d in docs:
        f = features(d[1])
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d[1]))])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resampling_against_brute_force(spark, odd, clashing, most):
    """Runs of several words cross lines, empty lines too; hot lines; ties; nulls."""
    rng = random.Random(most)
    docs = [(i, "\n".join(" ".join(rng.choice(["Alpha", "beta", "c3", "d-e", "É"]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 9))), "en", "a", 0) for i in range(120)] + ODD[:3] + ODD[4:6]
    target = ["alpha beta c3", None, "d\ne c3 É alpha"]
    got = importance.resample(spark.createDataFrame(docs, DOC), spark.createDataFrame([(x,) for x in target], "text string"), most, 97, 40, 3)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_scores(docs, target, most, 97, 40, 3)


def test_resampling_of_odd_rows(spark, odd, clashing):
    target = table(spark, SF, "benchmark")
    got = importance.resample(odd, target, percent=50, least=1)
    assert got.count() == len(ODD) and rows(importance.resample(clashing, target, percent=50, least=1)) == rows(got)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 4
    assert importance.resample(odd.where("false"), target).count() == 0
    assert {r.weight for r in importance.resample(odd.where("doc_id = 1"), target.where("false")).collect()} == {0}


def test_distinct_lines_are_counted_once_each(spark):
    """A line of many documents is one row with its occurrences before words are made of it."""
    docs = spark.createDataFrame([(i, f"the same line\nown {i % 7}") for i in range(500)], "doc_id long, text string")
    got = {r.bucket: r.n for r in importance.bucket_counts(docs).collect()}
    assert sum(got.values()) == 2500 and got[zlib.crc32(b"same") % 10_000] == 500


def test_numbers_in_order(spark):
    rng = random.Random(3)
    df = saved(spark.createDataFrame([(rng.randint(0, 50), i) for i in range(2000)], "k int, i long").repartition(5), "unordered")
    out, size = numbered(df, [F.col("k").desc(), F.col("i")])
    got = [(r["k"], r["i"]) for r in out.orderBy("_number").collect()]
    assert size == 2000 and got == sorted(got, key=lambda x: (-x[0], x[1])) and [r[0] for r in out.select("_number").orderBy("_number").collect()] == list(range(2000))
    empty, none = numbered(df.where("false"), [F.col("k")])
    assert none == 0 and empty.count() == 0


# -- 12 ---------------------------------------------------------------------------------------------


def test_licences_against_brute_force(spark, odd, clashing):
    docs = table(spark, SF, "documents").unionByName(odd)
    got = [tuple(r)[:6] for r in licenses.scan_licenses(docs, licenses.build_index(docs)).collect()]
    want = []
    for d in docs.collect():
        w = words(d.text)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        want.append((d.doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(map(str, got)) == sorted(map(str, want))
    index = licenses.build_index(docs)
    assert rows(licenses.scan_licenses(clashing, index)) == rows(licenses.scan_licenses(odd, index))
    assert licenses.scan_licenses(odd.where("false"), index).count() == 0 and licenses.build_index(odd.where("false")).templates


def test_notices_are_found_by_position(spark):
    """Each notice within other text, with words missing and inserted; shuffled words are none; near ones have no label."""
    rng = random.Random(12)
    filler = [f"w{i}" for i in range(400)]
    made, want = [], {}
    for i, (label, text, _) in enumerate(licenses.NOTICES):
        before, after = rng.choices(filler, k=rng.randint(0, 300)), rng.choices(filler, k=50)
        made.append((i, " ".join([*before, text.upper(), *after])))
        want[i] = (label, len(before))
        mixed = text.split()
        rng.shuffle(mixed)
        made.append((1000 + i, " ".join([*before, *mixed, *after])))
    mit = licenses.NOTICES[1][1].split()
    made += [(2000, " ".join([*filler, *mit[:30], "copyright", "holder", "says", *mit[30:45], *mit[47:]])), (2001, " ".join(mit[:12] * 2)), (2002, " ".join(x for k in range(300) for x in ("license", "version", "2", "0", "under")))]
    made += [(3000, " ".join([licenses.NOTICES[3][1], *licenses.NOTICES[4][1].split()[23:]]))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    index = licenses.build_index(docs)
    got = {r.doc_id: r for r in licenses.find_licenses(docs, index).collect()}
    for i, (label, start) in want.items():
        own = [p for p in got[i].places if p.label == label and not p.base]
        assert own and abs(own[0].start - start) <= licenses.SLACK, (i, label, got[i])
        assert own[0].share > 0.999
    assert not any(p for i in range(len(licenses.NOTICES)) for p in got[1000 + i].places if not p.base and len(licenses.NOTICES[i][1].split()) > 12)
    assert [p.label for p in got[2000].places] == ["mit"] and not got[2001].places and not got[2002].places
    assert {p.label for p in got[3000].places} == {"bsd-3-clause"}
    scored = {r.doc_id: r.score for r in licenses.scan_licenses(docs, index).collect()}
    assert all(0 <= x <= 1 for x in scored.values()) and scored[1] > 0.99


def test_document_frequencies_count_every_text(spark):
    docs = spark.createDataFrame([(1, "license License mit"), (2, "x\nLICENSE"), (3, None), (4, "licenses é license2")], "doc_id long, text string")
    n, df = licenses.document_frequencies(docs, ["license", "mit", "public"])
    assert n == 4 and df == {"license": 2, "mit": 1, "public": 0}


# -- 13 ---------------------------------------------------------------------------------------------


def brute_manifest(docs):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, text):
        return h(field(d[0]), field(d[3]), field(d[2]), field(d[4]), field(text))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i, fold):
        siblings = []
        for level in levels[:-1]:
            lo = i // 8 * 8
            run = level[lo : lo + 8]
            siblings += run[: i - lo] + run[i - lo + 1 :]
            fold, i = h(*run[: i - lo], fold, *run[i - lo + 1 :]), i // 8
        return siblings, fold

    per = {}
    for d in docs:
        per.setdefault(d[2], []).append(d)
    langs = sorted(per, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(per[lang], key=lambda d: (d[0] is None, d[0] or 0, leaf(d, d[1])))
        trees[lang] = (ordered, tree([leaf(d, d[1]) for d in ordered]))
    top = tree([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        ordered, levels = trees[lang]
        for i, d in enumerate(ordered):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
            changed = leaf(d, d[1].translate(LOW) if hit and d[1] is not None else d[1])
            a, fold = path(levels, i, changed)
            b, fold = path(top, k, fold)
            out.append((d[0], leaf(d, d[1]), levels[-1][0], top[-1][0], h(*a, *b), fold, fold == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_manifest_against_brute_force(spark, n, monkeypatch):
    """Trees of all heights with last runs of one; many languages; runs stored for several blocks of leaves."""
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = random.Random(n)
    docs = [(i, rng.choice(["Ab c", None, "", "É x", "Tq"]) , rng.choice(["en"] * 9 + ["de", None, "", "é", *[f"l{k}" for k in range(9)]]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(n)]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(docs, DOC)).collect()]
    assert sorted(map(str, got)) == brute_manifest(docs)


def test_manifest_of_one_long_language(spark, monkeypatch):
    """Five levels, of which the upper ones are stored once for each block."""
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = [(i, f"Text {i}", "en", "s", i) for i in range(4100)]
    assert sorted(str(tuple(r)) for r in merkle.manifest(spark.createDataFrame(docs, DOC).repartition(5)).collect()) == brute_manifest(docs)


def test_manifest_of_odd_rows(spark, odd, clashing):
    got = merkle.manifest(odd)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_manifest(ODD)
    assert rows(merkle.manifest(clashing)) == rows(got)
    assert merkle.manifest(odd.where("false")).count() == 0


# -- SQL --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11", "op13"])
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query, sql = {"op11": (importance.op11_importance, importance.OP11_SQL), "op13": (merkle.op13_merkle, merkle.OP13_SQL)}[name]
    df, cur = query(spark, SF), duck.execute(sql)
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(r) for r in cur.fetchall())
