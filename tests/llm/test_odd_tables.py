"""Every operator and stage on empty tables, clashing names, repeated rows, nulls and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronovox.llm import binary_output, html_text, images, jaccard, langid, mixing, secrets, sentencepiece_bpe, toxicity
from chronovox.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASH = ("score", "held_out", "spans", "ids", "class", "flush", "kind", "bucket", "part", "block", "size", "target", "rate", "number", "_copies", "_row", "root", "component_id", "n_shingles", "predicted", "toxic", "label", "key", "at")


@pytest.fixture(scope="module")
def models(spark):
    docs = table(spark, SF, "documents")
    return langid.train(docs), toxicity.train(docs, table(spark, SF, "labels")), secrets.learn(docs)


@pytest.fixture(scope="module")
def operators(models):
    lang, toxic, grammar = models
    return {
        "op2": lambda d: secrets.find_secrets(d, grammar), "op3": lambda d: langid.identify(d, lang), "op4": jaccard.near_duplicates, "op7": sentencepiece_bpe.encode_decode, "op8": mixing.mix_sizes,
        "op5": lambda d: binary_output.read_ids(d.sparkSession, binary_output.write_ids(d)), "op9": lambda d: toxicity.score(d, toxic),
    }


@pytest.fixture(scope="module")
def stages(models):
    lang, _, grammar = models
    return {"language_id": lambda d: langid.keep_identified(d, lang), "near_copies": lambda d: jaccard.representatives(d, 5, 80), "redact_secrets": lambda d: secrets.redact_documents(d, grammar), "mix_sources": mixing.mix}


ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the same text of some words here", "en", "a", 9), (2, "the same text of some words here", "en", "a", 9), (3, "the same text of some words here", "en", None, 9), (None, "another text, password = hunter2secret9 it says", "fr", "b", 9)]


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op7", "op8", "op9"])
def test_operators(spark, operators, name):
    run = operators[name]
    plain = spark.createDataFrame(ROWS, DOC)
    assert run(plain.where("false")).count() == 0
    key = lambda df: sorted(map(str, df.collect()))
    got = run(plain)
    assert got.count() == len(ROWS)
    names = [c for c in CLASH if c not in ("doc_id", "text")]
    clashing = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    assert key(run(clashing).select(got.columns)) == key(got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, stages, name):
    plain = spark.createDataFrame(ROWS, DOC)
    names = [c for c in CLASH if c not in plain.columns]
    wide = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    run = stages[name]
    assert run(wide.where("false")).count() == 0
    out = run(wide)
    assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
    kept = sorted(str(r[:5]) for r in out.collect())
    assert kept == sorted(str(r[:5]) for r in run(plain).collect())
    if name == "near_copies":
        assert sum("the same text" in k for k in kept) == 1 and len(kept) == 4


def test_images_of_odd_rows(spark):
    """No rows; rows without pixels; repeated rows and ties; names that the operator uses."""
    kind = "image_id long, width int, height int, pixels binary"
    none = spark.createDataFrame([], kind)
    assert images.copies(none).count() == 0
    rng = np.random.default_rng(4)
    big = np.kron(rng.integers(0, 256, (16, 16)), np.ones((6, 6))).astype(np.uint8)
    px = bytearray(big.tobytes())
    rows = [(7, 96, 96, px), (7, 96, 96, px), (5, 96, 96, px), (None, 96, 96, px), (9, None, 3, bytearray(3)), (10, 96, 96, None), (11, 0, 0, bytearray()), (12, 2, 2, bytearray(4)), (13, 84, 96, bytearray(np.ascontiguousarray(big[:, 6:-6]).tobytes()))]
    df = spark.createDataFrame(rows, kind).select("*", *[F.lit(1).alias(c) for c in ("class", "root", "band", "key", "x", "y", "scale", "angle", "d0", "d1", "hub")])
    got = sorted((r.image_id or -1, r.component_id if r.component_id is not None else -1) for r in images.copies(df).collect())
    assert got == [(-1, 5), (5, 5), (7, 5), (7, 5), (9, 9), (10, 10), (11, 11), (12, 12), (13, 5)]


def test_pages_of_odd_rows(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(p).count() == 0 and images.copies(images.page_images(p)).count() == 0


def test_two_labels_for_one_document(spark):
    """It is toxic, whatever the order."""
    docs = spark.createDataFrame([(i, f"plain{i} words number{i} of no harm{i} here") for i in range(200)] + [(1000 + i, f"so{i} you grobnik{'' if i % 2 else 's'} x{i} and you y{i} a blorf z{i} too") for i in range(60)], "doc_id long, text string")
    labels = [(i, 0) for i in range(200)] + [(1000 + i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(60)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[1000 + i] == 1 for i in range(60)) and sum(got[i] for i in range(200)) == 0
