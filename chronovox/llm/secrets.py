"""Secret scans: fixed patterns, and probabilistic automata inferred from what they find.

Labelled credentials (the values of the fixed patterns, by kind) form one prefix tree per kind over
character classes.  States whose outgoing frequencies are statistically compatible (Hoeffding bounds,
recursively) are merged, the red-blue way.  In every run of credential characters of every text, each
stretch between two marks (or the run's ends) is then scored by its likelihood per symbol under each
automaton against a background: class bigrams of all other runs of whole texts, without the labelled
credentials and the run itself.  A key within a URL, before a full stop or after a `=` is such a stretch.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched
from chronovox.llm.words import text_slices

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_HEX = 24
_HINT = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: Shortest runs of credential characters that the kinds' automata judge.
SHORTEST = {"assign": MIN_ASSIGN, "access": MIN_ACCESS, "hex": MIN_HEX}
MIN_CANDIDATE = min(SHORTEST.values())
#: Longest credential that automata are learned from; runs of any length are judged.
MAX_LEARNED = 4096
#: Judged class sequences that a worker remembers; the memory is emptied when full.
CACHE_RUNS = 200_000
#: Runs up to this length are first judged together, by numpy, on a bound; longer ones each by themselves.
TOGETHER = 64
#: Runs up to this length are told apart by one number, four bits a class.
PACKED = 15
#: Labelled credentials that a kind's own automaton needs; with fewer it takes those of all kinds.
ENOUGH = 8
#: Labelled credentials per kind that an automaton is learned from (the smallest md5 values).
SAMPLE_PER_KIND = 400
#: Significance of the Hoeffding test of two states.
ALPHA = 0.05
#: A candidate counts when it scores no less than this share of the labelled credentials do.
QUANTILE = 0.01
SLICE = 4 << 20
#: What stands in a redacted text for a secret.
MARK = "[SECRET]"
_SMOOTH = 1e-3

# character classes of the automata's alphabet
_CLASS = np.full(256, -1, np.int8)
_NAMES = "hlHUd+/_.=-"
for _c in range(256):
    _ch = chr(_c)
    if _ch in "abcdef":
        _CLASS[_c] = 0
    elif "g" <= _ch <= "z":
        _CLASS[_c] = 1
    elif _ch in "ABCDEF":
        _CLASS[_c] = 2
    elif "G" <= _ch <= "Z":
        _CLASS[_c] = 3
    elif "0" <= _ch <= "9":
        _CLASS[_c] = 4
    elif _ch in "+/_.=-":
        _CLASS[_c] = _NAMES.index(_ch)
SYMBOLS = len(_NAMES)
#: The first class that is a mark: a stretch begins after one, and ends before one.
_MARKS = _NAMES.index("+")
#: Characters that a class stands for; a class's likelihood is shared by them.
_SPREAD = np.log2(np.array([6, 20, 6, 20, 10, 1, 1, 1, 1, 1, 1], float))


def base_spans(text: bytes, assign: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) in bytes, sorted by start, then kind."""
    out = []
    if assign:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                out.append((m.start(), 0, m.end(), *m.span(2)))
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= MIN_ACCESS:
                out.append((m.start(), 1, m.end(), *m.span()))
    return out


def runs(mask: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values that no cut divides, of some length at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    through = np.unique(cuts[mask[cuts - 1] & mask[cuts]])
    if len(through):
        starts, ends = np.sort(np.concatenate([starts, through])), np.sort(np.concatenate([ends, through]))
    long = ends - starts >= least
    return starts[long], ends[long]


class Automaton:
    """A probabilistic automaton from a prefix tree by merging compatible states."""

    def __init__(self, words: list[bytes], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, float]] = [defaultdict(float)]
        self.stop: list[float] = [0.0]
        for w in words:
            q = 0
            for s in _CLASS[np.frombuffer(w, np.uint8)].tolist():
                if s not in self.next[q]:
                    self.next[q][s] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(float))
                    self.stop.append(0.0)
                self.count[q][s] += 1
                q = self.next[q][s]
            self.stop[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._tabulate()

    def _total(self, q: int) -> float:
        return self.stop[q] + sum(self.count[q].values())

    def _differs(self, a: float, n: float, b: float, m: float) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self._total(p), self._total(q)
            if self._differs(self.stop[p], n, self.stop[q], m):
                return False
            for s in self.next[p].keys() | self.next[q].keys():
                if self._differs(self.count[p].get(s, 0), n, self.count[q].get(s, 0), m):
                    return False
                if s in self.next[p] and s in self.next[q] and self.next[p][s] != self.next[q][s]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to p; q's tree holds no merged state."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.stop[p] += self.stop[q]
            for s, c in self.count[q].items():
                self.count[p][s] += c
            for s, r in self.next[q].items():
                if s in self.next[p]:
                    todo.append((self.next[p][s], r))
                else:
                    self.next[p][s] = r

    def _merge_states(self) -> None:
        red = [0]
        seen = {0}
        while True:
            blue = [(q, s, r) for q in red for s, r in sorted(self.next[q].items()) if r not in seen]
            if not blue:
                break
            q, s, r = max(blue, key=lambda x: self._total(x[2]))
            for p in red:
                if self._compatible(p, r):
                    self.next[q][s] = p
                    self._fold(p, r)
                    break
            else:
                red.append(r)
                seen.add(r)
        self.states = red

    def _tabulate(self) -> None:
        at = {q: i for i, q in enumerate(self.states)}
        n = len(self.states)
        self.move = np.full((n + 1, SYMBOLS), n, np.int32)
        self.log = np.full((n + 1, SYMBOLS), math.log2(_SMOOTH / SYMBOLS)) - _SPREAD
        self.log_stop = np.full(n + 1, math.log2(_SMOOTH))
        for q, i in at.items():
            total = self._total(q)
            self.log_stop[i] = math.log2((self.stop[q] + _SMOOTH) / (total + _SMOOTH * (SYMBOLS + 1)))
            for s in range(SYMBOLS):
                self.log[i, s] = math.log2((self.count[q].get(s, 0) + _SMOOTH) / (total + _SMOOTH * (SYMBOLS + 1))) - _SPREAD[s]
                if s in self.next[q]:
                    self.move[i, s] = at[self.next[q][s]]

    def score(self, classes: np.ndarray) -> float:
        """log2 likelihood, the end included."""
        q, total = 0, 0.0
        for s in classes.tolist():
            total += self.log[q, s]
            q = self.move[q, s]
        return total + self.log_stop[q]


class Grammar:
    """The automata, the background of other runs, and each kind's threshold."""

    def __init__(self, credentials: dict[str, list[bytes]], bigrams: np.ndarray):
        # bigrams: how often each class follows each other, or (last row) begins a run
        self.bigrams = bigrams
        self.back = self._background(bigrams)
        self.automata, self.least, self.shortest = [], [], []
        self.judged: dict[bytes, list[tuple[int, int]]] = {}
        for kind in KINDS:
            found = credentials.get(kind, [])
            if not found:
                continue
            if len(found) < ENOUGH:
                found = [w for k in KINDS for w in credentials.get(k, [])]
            # learn on two of three, set the threshold on the rest; a handful serves for both
            few = len(found) < ENOUGH
            auto = Automaton([w for i, w in enumerate(found) if few or i % 3])
            self.automata.append(auto)
            kept = [self._one(auto, _CLASS[np.frombuffer(w, np.uint8)]) for i, w in enumerate(found) if few or not i % 3]
            self.least.append(max(0.25, float(np.quantile(kept, QUANTILE))))
            self.shortest.append(SHORTEST[kind])
        self.tables = [(a.log.tolist(), a.move.tolist(), a.log_stop.tolist()) for a in self.automata]

    @staticmethod
    def _background(bigrams: np.ndarray) -> np.ndarray:
        back = bigrams + 0.5
        return np.log2(back / back.sum(axis=1, keepdims=True)) - _SPREAD

    def _one(self, auto: Automaton, classes: np.ndarray) -> float:
        """log2 likelihood ratio per symbol, the end included."""
        prev = np.concatenate([[SYMBOLS], classes[:-1]])
        return (auto.score(classes) - float(self.back[prev, classes].sum())) / (len(classes) + 1)

    def _without(self, classes: np.ndarray) -> np.ndarray:
        """The background without a run that is in it, as the labelled credentials are not: a rare
        class's bigrams would else be the run's own."""
        own = np.zeros_like(self.bigrams)
        np.add.at(own, (np.concatenate([[SYMBOLS], classes[:-1]]), classes), 1)
        return self._background(np.maximum(self.bigrams - own, 0))

    def _possible(self, runs: np.ndarray) -> np.ndarray:
        """Which of these runs of one length (a row each) may hold an accepted stretch: the background is
        taken as if the whole run were any one of its bigrams, so that no ratio is below the true one."""
        many, size = runs.shape
        low = np.log2((np.maximum(self.bigrams - size, 0) + 0.5) / (self.bigrams + 0.5).sum(axis=1, keepdims=True)) - _SPREAD
        prev = np.concatenate([np.full((many, 1), SYMBOLS), runs[:, :-1]], axis=1)
        begins = prev >= _MARKS
        begins[:, 0] = True
        ends = np.concatenate([runs[:, 1:] >= _MARKS, np.ones((many, 1), bool)], axis=1)
        start, row = np.nonzero(begins.T)  # by start
        upto = np.searchsorted(start, np.arange(size), "right")
        against = low[prev, runs]
        out = np.zeros(many, bool)
        for auto, least, shortest in zip(self.automata, self.least, self.shortest, strict=True):
            state, excess = np.zeros(len(row), np.int32), np.zeros(len(row))
            for i in range(size):
                n = upto[i]
                r, q = row[:n], state[:n]
                s = runs[r, i]
                excess[:n] += auto.log[q, s] - against[r, i] - least
                state[:n] = q = auto.move[q, s]
                m = np.searchsorted(start[:n], i + 1 - shortest, "right")  # those that are long enough
                if m > 0:
                    out[r[:m][ends[r[:m], i] & (excess[:m] + auto.log_stop[q[:m]] - least >= -1e-6)]] = True
        return out

    def _best(self, kind: int, classes: list[int], back: list[list[float]]) -> list[tuple[float, int, int]]:
        """For each end of a stretch the accepted one of largest excess over the threshold: (excess, start, end).

        Stretches that are in one state go on alike, so that of those which are long enough one stays for a
        state: the work is linear in the run, whatever the number of its marks.
        """
        (log, move, stop), least, shortest = self.tables[kind], self.least[kind], self.shortest[kind]
        live: dict[int, list[tuple[float, int]]] = {}
        out, before, size = [], SYMBOLS, len(classes)
        for i, s in enumerate(classes):
            if i == 0 or _MARKS <= before:
                live.setdefault(0, []).append((0.0, -i))
            against = back[before][s] + least
            moved: dict[int, list[tuple[float, int]]] = {}
            for q, held in live.items():
                gain = log[q][s] - against
                moved.setdefault(move[q][s], []).extend([(e + gain, a) for e, a in held])
            for q, held in moved.items():
                if len(held) > 1:
                    old = [x for x in held if i + 1 + x[1] >= shortest]
                    if len(old) > 1:
                        moved[q] = [max(old), *(x for x in held if i + 1 + x[1] < shortest)]
            live, before = moved, s
            if i + 1 == size or classes[i + 1] >= _MARKS:
                ready = [(e + stop[q] - least, a) for q, held in live.items() for e, a in held if i + 1 + a >= shortest]
                if ready and max(ready)[0] >= 0:
                    e, a = max(ready)
                    out.append((e, -a, i + 1))
        return out

    def _judge(self, run: bytes) -> list[tuple[int, int]]:
        classes = np.frombuffer(run, np.int8)
        back = self._without(classes).tolist()
        found = [x for k in range(len(self.automata)) for x in self._best(k, classes.tolist(), back)]
        taken: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda x: (-x[0], x[1], -x[2])):
            at = bisect.bisect(taken, (a, b))
            if not (at and taken[at - 1][1] > a) and not (at < len(taken) and taken[at][0] < b):
                taken.insert(at, (a, b))
        return taken

    def stretches(self, found: list[bytes]) -> list[list[tuple[int, int]]]:
        """For each run of classes its accepted stretches, apart from each other, the best ones first taken."""
        out = [self.judged.get(r) for r in found]
        new = {r for r, known in zip(found, out, strict=True) if known is None} if self.automata else set()
        lengths = defaultdict(list)
        for r in new:
            lengths[len(r)].append(r)
        told = {}
        for size, group in lengths.items():
            told |= dict.fromkeys(group, [])
            if size <= TOGETHER:
                maybe = self._possible(np.frombuffer(b"".join(group), np.int8).reshape(-1, size).astype(np.int64))
                group = [group[i] for i in np.flatnonzero(maybe)]
            told |= {r: self._judge(r) for r in group}
        if len(self.judged) + len(told) > CACHE_RUNS:
            self.judged.clear()
        self.judged |= told
        return [told.get(r, []) if known is None else known for r, known in zip(found, out, strict=True)]


    def found(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, end) of the accepted stretches of all these runs of a slice, by start.

        Short runs are told apart by their classes as one number; only different ones are judged.
        """
        kinds, size = classes.tobytes(), ends - starts
        short = np.flatnonzero(size <= PACKED)
        code = np.zeros(len(short), np.int64)
        for j in range(PACKED):
            on = np.flatnonzero(size[short] > j)
            code[on] = code[on] * 16 + classes[starts[short[on]] + j] + 1
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        judged = self.stretches([kinds[starts[r] : ends[r]] for r in short[first].tolist()])
        hit = np.array([bool(x) for x in judged], bool)
        out = [(starts[short[r]] + a, starts[short[r]] + b) for r in (np.flatnonzero(hit[which]) if len(hit) else []) for a, b in judged[which[r]]]
        rest = np.flatnonzero(size > PACKED).tolist()
        for r, told in zip(rest, self.stretches([kinds[starts[r] : ends[r]] for r in rest]), strict=True):
            out += [(starts[r] + a, starts[r] + b) for a, b in told]
        return np.array(sorted(out), np.int64).reshape(-1, 2)


def labelled_values(docs: DataFrame) -> DataFrame:
    """kind, value, n: every credential that the fixed patterns find (n is 1), and for each task how
    often classes follow each other in all other runs of its texts (kind 'back', value 'before:after')."""

    def run(batches):
        pairs = np.zeros((SYMBOLS + 1) * SYMBOLS, np.int64)
        for batch in batches:
            kinds, values = [], []
            for _, texts in text_slices(batch, SLICE):
                for text, spans, _ in _scan(texts, None):
                    if not text:
                        continue
                    classes = _CLASS[np.frombuffer(text, np.uint8)].astype(np.int64)
                    for _, kind, _, a, b in spans:
                        kinds.append(KINDS[kind])
                        values.append(text[a:b].decode("ascii"))
                        classes[a:b] = -1
                    before = np.concatenate([[-1], classes[:-1]])
                    before[before < 0] = SYMBOLS
                    inside = classes >= 0
                    pairs += np.bincount(before[inside] * SYMBOLS + classes[inside], minlength=len(pairs))
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "value": pa.array(values, pa.string()), "n": pa.array([1] * len(kinds), pa.int64())})
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["back"] * len(at), pa.string()), "value": pa.array([f"{i // SYMBOLS}:{i % SYMBOLS}" for i in at.tolist()], pa.string()), "n": pa.array(pairs[at], pa.int64())})

    return batched(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "kind string, value string, n long")


def learn(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> Grammar:
    """Automata from per_kind distinct credentials of each kind at most, those of smallest md5."""
    found = labelled_values(docs).where(F.length("value") <= MAX_LEARNED)
    found = found.withColumn("key", F.md5(F.col("value").cast("binary")))
    held: dict[str, list[bytes]] = defaultdict(list)
    bigrams = np.zeros((SYMBOLS + 1, SYMBOLS))
    # one value for each of the 4,096 beginnings of a key: a bounded sample, and no group is gathered
    salt = F.when(F.col("kind") == "back", F.col("value")).otherwise(F.substring("key", 1, 3)).alias("salt")
    small = found.groupBy("kind", salt).agg(F.min_by("value", "key").alias("value"), F.min("key").alias("key"), F.sum("n").alias("n"))
    for r in small.collect():
        if r.kind == "back":
            before, after = map(int, r.value.split(":"))
            bigrams[before, after] = r.n
        else:
            held[r.kind].append((r.key[3:], r.value.encode()))
    return Grammar({k: [v for _, v in sorted(held[k])[:per_kind]] for k in KINDS}, bigrams)


def _scan(texts: pa.Array, grammar: Grammar | None):
    """(text bytes, base spans, learned spans) of each text, spans in bytes."""
    hint = np.asarray(pc.match_substring_regex(texts, pattern=_HINT))
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    classes = _CLASS[data]
    # a run must not span two texts
    h_start, h_end = runs((classes == 0) | (classes == 4), off, MIN_HEX)
    more_at = grammar.found(classes, *runs(classes >= 0, off, MIN_CANDIDATE)) if grammar else np.zeros((0, 2), np.int64)
    h_at = np.searchsorted(h_start, off)
    m_at = np.searchsorted(more_at[:, 0], off)
    view = data.tobytes()
    for i in range(len(texts)):
        a, b = int(off[i]), int(off[i + 1])
        text = view[a:b]
        spans = base_spans(text, bool(hint[i]))
        for s, e in zip(h_start[h_at[i] : h_at[i + 1]].tolist(), h_end[h_at[i] : h_at[i + 1]].tolist(), strict=True):
            spans.append((s - a, 2, e - a, s - a, e - a))
        spans.sort()
        more = [(s - a, 3, e - a) for s, e in more_at[m_at[i] : m_at[i + 1]].tolist() if not any(x[0] < e - a and s - a < x[2] for x in spans)]
        yield text, spans, more


def _points(text: bytes) -> np.ndarray | None:
    """Code points before each byte; None where bytes are code points."""
    if text.isascii():
        return None
    raw = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, grammar: Grammar | None = None, redact: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, counts per kind, base_sha256, spans (kind:start:end by start,
    then kind; whole matches in code points, end exclusive) and, with redact, the text with that mark
    in place of every secret's value.

    A null text is empty (redacted: null); no span gives the digest of the empty string and empty
    spans; a null doc_id stays null; repeated rows give repeated results; other columns play no part.
    """
    grammar = grammar or learn(docs)
    names = (*KINDS, LEARNED)
    schema = _SCHEMA + (", text string" if redact is not None else "")

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            nulls = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
            for first, texts in text_slices(batch, SLICE):
                out = defaultdict(list)
                for i, (text, spans, more) in enumerate(_scan(texts, grammar)):
                    counts = [0, 0, 0, len(more)]
                    base, every, hidden = "", "", text
                    if spans or more:
                        at = _points(text)
                        put = lambda x, at=at: f"{names[x[1]]}:{x[0] if at is None else at[x[0]]}:{x[2] if at is None else at[x[2]]}"
                        for x in spans:
                            counts[x[1]] += 1
                        base = ",".join(map(put, spans))
                        every = ",".join(map(put, sorted([x[:3] for x in spans] + more)))
                        if redact is not None:
                            hidden = _redacted(text, [(x[3], x[4]) for x in spans] + [(x[0], x[2]) for x in more], redact.encode())
                    for n, c in zip(("n_assign", "n_access", "n_hex", "n_learned"), counts, strict=True):
                        out[n].append(c)
                    out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                    out["spans"].append(every)
                    if redact is not None:
                        out["text"].append(None if nulls[first + i] else hidden.decode())
                cols = {"doc_id": ids.slice(first, len(texts))}
                cols |= {k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(cols)

    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, schema)


def _redacted(text: bytes, spans: list[tuple[int, int]], mark: bytes) -> bytes:
    out, done = [], 0
    for a, b in sorted(spans):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return b"".join([*out, text[done:]])


def redact_documents(docs: DataFrame, grammar: Grammar | None = None, mark: str = MARK) -> DataFrame:
    """docs, in its columns, with the mark in place of every secret's value; n_chars (if there is
    such a column) counts the new text.  A null text stays null, one without a secret as it is; repeated
    rows stay repeated; other columns ride along, whatever their names; no rows give no rows."""
    grammar = grammar or learn(docs)
    counted = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            for first, texts in text_slices(batch, SLICE):
                part = batch.slice(first, len(texts))
                old = part.column(at)
                new = [_redacted(t, [(x[3], x[4]) for x in spans] + [(x[0], x[2]) for x in more], mark.encode()).decode() if spans or more else None for t, spans, more in _scan(texts, grammar)]
                text = pc.coalesce(pa.array(new, old.type), old)
                part = part.set_column(at, batch.schema.field(at), text)
                if counted:
                    k = names.index("n_chars")
                    size = pc.utf8_length(text).cast(part.column(k).type)
                    changed = pa.array([x is not None for x in new])
                    part = part.set_column(k, batch.schema.field(k), pc.if_else(changed, size, part.column(k)))
                yield part

    return batched(docs).mapInArrow(run, docs.schema)


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    from chronovox.llm.common import table

    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
