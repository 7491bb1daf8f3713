"""Toxicity: a lexicon learned from labels, met in texts by Levenshtein automata over its trie, and a
logistic score over the hits' context windows that tells quotation from abuse."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched, held_out, table, train_row
from chronovox.llm.words import WordTable, ascii_words, text_slices

#: Labelled rows that lexicon and weights are fitted on, of each class at most, about (chosen by hash).
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
#: Bytes of text of that sample at most, about.
SAMPLE_BYTES = 48 << 20
#: A lexicon entry: rows of class 1 that hold it, and how much likelier it is there than elsewhere.
MIN_ROWS, MIN_SHARE, MIN_RATIO, LEXICON_SIZE = 4, 0.003, 8.0, 20_000
#: Stems (beginnings of words) of so many characters may be entries, too.
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Entries this long may be met with one or two edits.
ONE_EDIT, TWO_EDITS = 5, 10
#: Words on each side of a hit that its context is read from.
WINDOW = 6
THRESHOLD = 0.3
SLICE = 2 << 20
AUTOMATON_STATES = 200_000

#: Verbs that introduce a quotation, and second-person words that mark address.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported word term sagte schrieb nannte zitiert wort dijo escribió llamó palabra dit écrit appelé mot".split())
ADDRESS = frozenset("you your you're yours u ur du dich dein deine sie ihr tu te tú usted vous toi ton ta".split())
_QUOTES = "\"'“”„«»‘’`"
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")


class Lexicon:
    """A trie of entries (whole words, or stems that any word may begin with) and the automaton that
    is its intersection with the entries' Levenshtein automata, made state by state as words need it.

    A state is the set of (trie node, edits, kind of step) that a word's beginning may stand for.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.weight: list[float] = []
        self.next: list[dict[str, int]] = [{}]
        self.entry: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.reach: list[int] = [0]
        for store, entries in ((self.entry, words), (self.stem, stems)):
            for text, weight in sorted(entries.items()):
                node = 0
                edits = 2 if len(text) >= TWO_EDITS else 1 if len(text) >= ONE_EDIT else 0
                self.reach[0] = max(self.reach[0], edits)
                for c in text:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.entry.append(-1)
                        self.stem.append(-1)
                        self.reach.append(0)
                    node = self.next[node][c]
                    self.reach[node] = max(self.reach[node], edits)  # edits that some entry below allows
                store[node] = len(self.weight)
                self.weight.append(weight)
        lengths = [len(t) for t in sorted(words)] + [len(t) for t in sorted(stems)]
        self.edits = [2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0 for n in lengths]
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems_at: list[tuple[int, int] | None] = []
        self.first = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of nodes with their fewest edits, closed under skipped letters."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node, 9) < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.ends.append(self._best(key, self.entry))
            self.stems_at.append(self._best(key, self.stem))
        return self.number[key]

    def _best(self, key: frozenset, store: list[int]) -> tuple[int, int] | None:
        found = [(e, store[n]) for n, e in key if store[n] >= 0 and e <= self.edits[store[n]]]
        return min(found) if found else None

    def _move(self, state: int, c: str) -> int:
        """State after c; -1 where no entry is left."""
        nodes: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e if letter == c else e + 1  # the letter itself, or another in its place
                if cost <= self.reach[child] and cost < nodes.get(child, 9):
                    nodes[child] = cost
            if e + 1 <= self.reach[node] and e + 1 < nodes.get(node, 9):
                nodes[node] = e + 1  # a letter too many
        return self._state(nodes) if nodes else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry that the word or its beginning stands for."""
        if len(self.sets) > AUTOMATON_STATES:
            self._clear()
        state, best = self.first, None
        for c in word:
            moves = self.moves[state]
            to = moves.get(c)
            if to is None:
                to = moves[c] = self._move(state, c)
            if to < 0:
                return best
            state = to
            at = self.stems_at[state]
            if at is not None and (best is None or at < best):
                best = at
        at = self.ends[state]
        return at if at is not None and (best is None or at < best) else best


def normal(word: str) -> str:
    """A word as the lexicon knows it: lower case, without marks at its ends, look-alike digits and
    marks as letters where letters are about."""
    word = _EDGE.sub("", word.lower())
    if not word.isalpha():
        plain = word.translate(_LEET)
        if any(c.isalpha() for c in word):
            word = plain
    return word


#: Features: hits by nearness (0 edits, more) and by context (plain, addressed, quoted).
FEATURES = 6
#: What the weights shrink to: abuse counts, quotation hardly, misspelled less than exact.
PRIOR = np.array([2.0, 2.5, 0.3, 1.0, 1.5, 0.1])


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias
        self._table: WordTable | None = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "bias": self.bias, "_table": None}

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One id per word that meets an entry: 2 * entry + (1 if with edits); none for the rest."""
        lengths, flat = np.zeros(len(words), np.int64), []
        for i, w in enumerate(words):
            got = self.lexicon.match(normal(w))
            if got is not None:
                lengths[i] = 1
                flat.append(2 * got[1] + (got[0] > 0))
        return lengths, np.asarray(flat, np.int64)

    def features(self, texts: pa.Array) -> np.ndarray:
        """Weighted hit counts of each text, FEATURES columns."""
        if self._table is None:
            self._table = WordTable(self._encode)
        counts, words = ascii_words(texts)
        per_word, flat = self._table.expand(words)
        out = np.zeros((len(counts), FEATURES))
        hits = np.flatnonzero(per_word)
        if not len(hits):
            return out
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, hits, "right")
        weight = np.asarray(self.lexicon.weight)
        for at, d, code in zip(hits.tolist(), doc.tolist(), flat.tolist(), strict=True):
            lo, hi = max(int(ends[d] - counts[d]), at - WINDOW), min(int(ends[d]), at + WINDOW + 1)
            near = words.slice(lo, hi - lo).to_pylist()
            out[d, 3 * (code & 1) + context(near, at - lo)] += weight[code >> 1]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(x) @ self.weights + self.bias)))


def context(words: list[str], at: int) -> int:
    """0 plain, 1 addressed to someone, 2 quoted or reported; from the words about the one at `at`."""
    before, word, after = words[:at], words[at], words[at + 1 :]
    opened = sum(w[0] in _QUOTES for w in [*before, word]) - sum(len(w) > 1 and w.rstrip(".,;:!?")[-1:] in _QUOTES for w in before)
    closed = any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in [word, *after])
    near = {_EDGE.sub("", w.lower()) for w in before[-3:]}
    if (opened > 0 and closed) or near & REPORTING:
        return 2
    return 1 if {_EDGE.sub("", w.lower()) for w in before[-3:] + after[:3]} & ADDRESS else 0


def fit(texts: list[str], labels: list[int], prior: float = 0.0) -> Model:
    """Lexicon and weights from labelled texts; every third row is kept from the lexicon, so that the
    weights see words that it did not learn from.  prior: log odds to add for rows left out of the sample."""
    y = np.asarray(labels)
    fresh = _fresh(texts)
    toxic, clean, stems_t, stems_c = Counter(), Counter(), Counter(), Counter()
    learn = [i for i in range(len(texts)) if i % 3 and fresh[i]]
    for i in learn:
        seen = {normal(w) for w in texts[i].split()}
        seen = {w for w in seen if len(w) >= 3}
        starts = {w[:n] for w in seen for n in STEM_LENGTHS if len(w) >= n}
        (toxic if y[i] else clean).update(seen)
        (stems_t if y[i] else stems_c).update(starts)
    n_t, n_c = max(1, sum(y[i] for i in learn)), max(1, sum(1 - y[i] for i in learn))

    def chosen(t: Counter, c: Counter, least: int) -> dict[str, float]:
        ratio = lambda w: ((t[w] + 0.1) / (n_t + 0.2)) / ((c[w] + 0.1) / (n_c + 0.2))
        kept = [w for w, n in t.items() if n >= least and ratio(w) >= MIN_RATIO]
        kept = sorted(kept, key=lambda w: (-t[w], w))[:LEXICON_SIZE]
        return {w: min(1.0, float(np.log(ratio(w)) / np.log(200))) for w in kept}

    least = max(MIN_ROWS, int(MIN_SHARE * n_t))
    words = chosen(toxic, clean, least)
    stems = chosen(stems_t, stems_c, 3 * least)
    # of stems within each other the shortest stays; a stem must begin several words
    tails: dict[str, set[str]] = {}
    for w in toxic:
        for n in STEM_LENGTHS:
            if len(w) > n and w[:n] in stems:
                tails.setdefault(w[:n], set()).add(w)
    stems = {s: v for s, v in stems.items() if len(tails.get(s, ())) >= 4}
    stems = {s: v for s, v in stems.items() if not any(s[:n] in stems for n in STEM_LENGTHS if n < len(s))}
    words = {w: v for w, v in words.items() if not any(w[:n] in stems for n in STEM_LENGTHS if n <= len(w))}
    model = Model(Lexicon(words, stems), PRIOR.copy(), -3.0)
    x = np.log1p(np.concatenate([model.features(pa.array(texts[i : i + 500], pa.large_string())) for i in range(0, len(texts), 500)])) if texts else np.zeros((0, FEATURES))
    held = np.array([i for i in range(len(texts)) if i % 3 == 0 and fresh[i]], int)
    if len(held) and 0 < y[held].sum() < len(held):
        model.weights, model.bias = _logistic(x[held], y[held])
        model.bias += prior
    return model


def _fresh(texts: list[str]) -> list[bool]:
    """False for texts that share one of their four smallest five-word hashes with an earlier one:
    the words of a text with many copies are no evidence of their own."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words = t.split()
        marks = sorted({zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))})[:4]
        out.append(not any(m in seen for m in marks))
        seen.update(marks)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 2.0) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic regression whose weights are pulled to PRIOR."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, mean = np.append(PRIOR, -3.0), np.append(PRIOR, 0.0)
    reg = np.append(np.full(FEATURES, pull), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + reg * (w - mean)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(reg)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Fit on labelled rows whose crc32 remainder is not 2; a hash picks about so many of each class, and
    about SAMPLE_BYTES of text at most.  A document with both labels is toxic."""
    marked = labels.where(train_row() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(marked, "doc_id")
    n = {r.toxic: r for r in sizes.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    space = 1 << 24
    share = {k: min(most / n[k].n, SAMPLE_BYTES * most / (toxic + clean) / max(1, n[k].bytes or 0)) if k in n else 1.0 for k, most in ((0, clean), (1, toxic))}
    part = {k: min(space, int(space * x) + 1) for k, x in share.items()}
    key = F.xxhash64(F.col("doc_id").cast("string"))
    picked = marked.where(F.pmod(key, F.lit(space)) < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    # at most about toxic + clean ids: small enough to send to every task
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic", key.alias("key")).collect()
    rows.sort(key=lambda r: (r.key, r.text, r.toxic))
    return fit([r.text for r in rows], [r.toxic for r in rows], math.log(part[0] / part[1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    A null or empty text has no hit and gets the score of one; a null doc_id is not held out;
    repeated rows give repeated results; long texts are read whole; other columns play no part.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            ids, held = (batch.column(names.index(c)) for c in ("doc_id", "held_out"))
            for first, texts in text_slices(batch, SLICE):
                s = model.scores(model.features(texts))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(s)), "held_out": held.slice(first, len(s)), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return batched(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
