"""Language identification: the mean of hashed subword embeddings through a linear softmax, trained
by stochastic gradient descent in numpy, with a temperature and a rejection level set on held-back rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched, held_out, table, text_views, train_row

BUCKET_BITS = 15
DIM = 16
#: Subwords are runs of so many bytes within a word and its two borders.
NGRAMS = (2, 3, 4)
#: Documents per language that the classifier is fitted on, about; chosen by a hash of doc_id and text.
SAMPLE_PER_LANG = 1200
#: Bytes of text of the sample at most, about.
SAMPLE_BYTES = 48 << 20
EPOCHS, RATE, SEED = 4, 0.6, 7
#: Share of the correctly labelled held-back rows that rejection may cost at most.
REJECT_SHARE = 0.002
#: The level is never above this, so that short clean texts stay.
MAX_REJECT = 0.35
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, their document's place) for UTF-8 bytes of several texts.

    Bytes that are no letters are word borders; a subword may begin or end with one border but holds
    none inside, and a repeated border makes none.
    """
    n_docs = len(offsets) - 1
    # a border before the first text and after each one keeps texts apart
    size = len(data) + n_docs + 1
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(n_docs), np.diff(offsets))
    chars = np.zeros(size, np.uint32)
    chars[at] = np.where(_LETTER[data], _FOLD[data], 0)
    border = chars == 0
    doc = np.zeros(size, np.int32)
    doc[at] = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets))
    inside = np.concatenate([[0], np.cumsum(border, dtype=np.int32)]).astype(np.int32)
    out, docs = [], []
    for n in NGRAMS:
        if size < n:
            continue
        # below 2 ** 32 for up to four bytes
        key = np.zeros(size - n + 1, np.uint32)
        for k in range(n):
            key = (key << np.uint32(8)) + chars[k : size - n + 1 + k]
        key += np.uint32(n * 0x9E3779B1 % (1 << 32))
        # no border strictly inside, and a letter at least
        count = size - n + 1
        ok = inside[n - 1 : n - 1 + count] == inside[1 : 1 + count] if n > 2 else ~(border[:count] & border[1:])
        mid = np.flatnonzero(ok)
        bucket = (key[mid] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
        out.append(bucket.astype(np.int32))
        docs.append(np.where(border[mid], doc[np.minimum(mid + 1, size - 1)], doc[mid]))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(docs)


class Model:
    """P[bucket, language]: the embeddings already through the linear layer; a document's logits are
    the mean of its subwords' rows plus the bias, divided by the temperature."""

    def __init__(self, langs: list[str], table_: np.ndarray, bias: np.ndarray, temperature: float, reject: float):
        self.langs, self.table, self.bias, self.temperature, self.reject = langs, table_, bias, temperature, reject

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets, doc = subwords(data, offsets)
        n = len(offsets) - 1
        size = np.bincount(doc, minlength=n).astype(float)
        mean = np.stack([np.bincount(doc, weights=self.table[buckets, k], minlength=n) for k in range(len(self.langs))], axis=1)
        return mean / np.maximum(size, 1)[:, None] + self.bias, size

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z, _ = self.logits(data, offsets)
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Model:
    """The classifier from labelled texts; every fifth one is held back for temperature and rejection."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    size = 1 << BUCKET_BITS
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1, 1, (size, DIM)) / DIM
    out, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        b, _ = subwords(raw, np.array([0, len(raw)]))
        ids, n = np.unique(b, return_counts=True)
        rows.append((ids, n / max(1, n.sum())))
    back = [i for i in range(len(rows)) if i % 5 == 0]
    train = np.array([i for i in range(len(rows)) if i % 5])
    total, done = EPOCHS * max(1, len(train)), 0
    # rare languages weigh as much as frequent ones
    weight = len(y) / (len(names) * np.maximum(1, np.bincount(y, minlength=len(names))))
    for _ in range(EPOCHS):
        for i in rng.permutation(train).tolist():
            ids, w = rows[i]
            if not len(ids):
                continue
            rate = RATE * (1 - done / total)
            done += 1
            h = w @ emb[ids]
            g = _softmax(h @ out + bias)
            g[y[i]] -= 1
            g *= min(4.0, weight[y[i]])
            grad_h = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            emb[ids] -= rate * len(ids) ** 0.5 * w[:, None] * grad_h
    tab = emb @ out
    z = np.array([rows[i][1] @ tab[rows[i][0]] + bias for i in back if len(rows[i][0])]).reshape(-1, len(names))
    yb = np.array([y[i] for i in back if len(rows[i][0])], int)
    if not len(yb):
        return Model(names, tab, bias, 1.0, 0.0)
    grid = np.geomspace(0.05, 5, 40)
    loss = [-np.log(_softmax(z / t)[np.arange(len(yb)), yb] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    right = p.argmax(axis=1) == yb
    level = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    return Model(names, tab, bias, temperature, min(level, MAX_REJECT) * 0.999)


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on rows with a language whose crc32 remainder is not 2: a hash picks about per_lang of each
    language (all, where there are fewer), and about SAMPLE_BYTES of text at most, shared evenly.  One
    row a language comes to the driver beside them."""
    rows = docs.where(train_row() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    space = 1 << 24
    share = {r.lang: min(per_lang / r.n, SAMPLE_BYTES / len(counts) / max(1, r.bytes)) for r in counts}
    level = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(min(space, int(space * v) + 1)))]) if counts else None
    if level is None:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), 1.0, 0.0)
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    chosen = rows.where(F.pmod(key, F.lit(space)) < level[F.col("lang")]).select("text", "lang", key.alias("key")).collect()
    chosen.sort(key=lambda r: (r.key, r.text))
    return fit([r.text for r in chosen], [r.lang for r in chosen])


_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs.

    A null text, one without a letter, or a model without languages gives 'und', score 0, rejected.
    Otherwise lang_pred is the likeliest learned language and score its calibrated probability;
    rejected says that the score is below the calibrated level.  A null doc_id is not held out;
    repeated rows give repeated results; long texts are read whole.
    """
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids, held, col = (batch.column(names.index(c)) for c in ("doc_id", "held_out", "text"))
            for first, end, data, off in text_views(batch):
                n = end - first
                lang, score = [UNKNOWN] * n, np.zeros(n)
                known = _has_letter(data, off, col.slice(first, n))
                if model.langs and known.any():
                    p = model.probabilities(data, off)
                    best = p.argmax(axis=1)
                    score = np.where(known, p[np.arange(n), best], 0.0)
                    lang = [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                reject = ~known | (score < model.reject) if model.langs else np.ones(n, bool)
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, n), "held_out": held.slice(first, n), "lang_pred": lang, "score": pa.array(score), "rejected": pa.array(reject)})

    return batched(rows).mapInArrow(run, _SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, in its columns, whose language is not rejected; see identify.

    Null texts and those without a letter go; repeated rows share their fate; other columns ride along,
    whatever their names; without rows to learn from, no row stays."""
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            keep = []
            for first, end, data, off in text_views(batch):
                known = _has_letter(data, off, col.slice(first, end - first))
                sure = model.probabilities(data, off).max(axis=1) >= model.reject if model.langs else np.zeros(end - first, bool)
                keep.append(known & sure)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return batched(docs).mapInArrow(run, docs.schema)


def _has_letter(data: np.ndarray, off: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    known = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~known & (high[off[1:]] > high[off[:-1]])).tolist():
        known[i] = any(c.isalpha() for c in texts[i].as_py())
    return known


def op3_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
