"""SentencePiece encoding for merge-type vocabularies: an agenda of adjacent symbol pairs in score
order, in numpy over all new words of an Arrow batch, checked against the sentencepiece library.

A vocabulary whose pieces never hold a space mark after another character can only merge within
(space marks)(other characters): such chunks are encoded once each and remembered by the worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched, ragged
from chronovox.llm.words import WordTable, text_slices

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
SLICE = 2 << 20
#: Chunks between spaces that a task remembers at most.
CHUNKS = 400_000
#: Chunks of more symbols than this use the scalar agenda.
MATRIX_SYMBOLS = 64
_NONE = np.int32(2**31 - 1)
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Piece types of the sentencepiece model format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class UnsupportedVocabulary(ValueError):
    """Not a merge-type vocabulary without normalisation and user-defined pieces."""


class Vocabulary:
    """The pieces of a model file: symbols, mergeable pairs in score order, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or _USER in kinds or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise UnsupportedVocabulary(path)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.size = len(model.pieces)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise UnsupportedVocabulary("a piece spans a space")
        # rank of a piece: place in score order, so that one number orders the agenda
        scores = {i: model.pieces[i].score for i in self.id_of.values()}
        self.rank = np.full(self.size, _NONE, np.int32)
        last, place = None, -1
        for i in sorted(scores, key=lambda i: -scores[i]):
            if scores[i] != last:
                last, place = scores[i], place + 1
            self.rank[i] = place
        keys, made = [], []
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                x, y = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                if x is not None and y is not None:
                    keys.append(x * self.size + y)
                    made.append(i)
        self.pair = dict(zip(keys, made, strict=True))
        self._hash(np.asarray(keys, np.int64), np.asarray(made, np.int32))

    def _hash(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open table of the pairs: slot of the key's hash, then the next ones."""
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        self.shift = np.uint64(64 - bits)
        self.table_key = np.full((1 << bits) + 64, -1, np.int64)
        self.table_id = np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1
        for key, piece, slot in zip(keys.tolist(), made.tolist(), self._slot(keys).tolist(), strict=True):
            n = 0
            while self.table_key[slot + n] != -1:
                n += 1
            self.table_key[slot + n], self.table_id[slot + n] = key, piece
            self.probes = max(self.probes, n + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; -1 for none.  Negative symbols make none."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) * self.size + right)
        slot = self._slot(keys)
        out = np.full(keys.shape, -1, np.int32)
        for n in range(self.probes):
            np.copyto(out, self.table_id[slot + n], where=self.table_key[slot + n] == keys)
        return out

    # -- encoding of chunks -----------------------------------------------------------------

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each chunk, all ids)."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        lengths = np.zeros(len(chunks), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (6, 10, 16, 32, MATRIX_SYMBOLS):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(rows):
                n, flat = self._matrix([chunks[i] for i in rows], sizes[rows])
                lengths[rows] = n
                parts.append((rows, n, flat))
        for i in np.flatnonzero(sizes > MATRIX_SYMBOLS).tolist():
            ids = np.asarray(self.agenda(chunks[i]), np.int64)
            lengths[i] = len(ids)
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int64)
        for rows, n, flat in parts:
            out[ragged(starts[rows], n)] = flat
        return lengths, out

    def _matrix(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows are chunks, columns their symbols; every round takes the best pair of each row's
        agenda (the leftmost of equals), merges it and looks its two neighbours up anew."""
        w, width = len(chunks), int(sizes.max())
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = np.unique(points, return_inverse=True)
        ids = np.array([self.id_of.get(chr(c), -2 - int(c)) for c in distinct], np.int32)
        sym = np.full((w, width), -1, np.int32)
        cols = np.arange(width)
        sym[cols < sizes[:, None]] = ids[back]
        made = self.merged(sym[:, :-1], sym[:, 1:])
        rank = np.where(made < 0, _NONE, self.rank[made])
        out = np.full((w, width), -1, np.int32)
        rows = np.arange(w)
        while True:
            if rank.shape[1] == 0:
                out[rows, : sym.shape[1]] = sym
                break
            at = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), at] < _NONE
            if not live.all():
                out[rows[~live], : sym.shape[1]] = sym[~live]
                rows, sym, made, rank, at = rows[live], sym[live], made[live], rank[live], at[live]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            piece = made[r, at]
            # close the gap: columns after the pair's left symbol move one to the left
            k = np.arange(sym.shape[1] - 1)
            sym = np.where(k <= at[:, None], sym[:, :-1], sym[:, 1:])
            sym[r, at] = piece
            if made.shape[1] == 1:
                made, rank = made[:, :0], rank[:, :0]
                continue
            k = np.arange(made.shape[1] - 1)
            keep = k < at[:, None]
            made = np.where(keep, made[:, :-1], made[:, 1:])
            rank = np.where(keep, rank[:, :-1], rank[:, 1:])
            for side in (0, -1):
                col = at + side
                ok = (col >= 0) & (col < made.shape[1])
                if ok.any():
                    rr, cc = r[ok], col[ok]
                    m = self.merged(sym[rr, cc], sym[rr, cc + 1])
                    made[rr, cc] = m
                    rank[rr, cc] = np.where(m < 0, _NONE, self.rank[m])
        flat = out[out != -1].astype(np.int64)
        n = (out != -1).sum(axis=1)
        return self._bytes(n, flat)

    def _bytes(self, n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become their UTF-8 bytes' pieces, or the unknown id."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return n, flat
        bytes_of = [self._fallback(chr(-2 - int(flat[i]))) for i in odd]
        counts = np.ones(len(flat), np.int64)
        counts[odd] = [len(b) for b in bytes_of]
        row = np.repeat(np.arange(len(n)), n)
        out = np.repeat(flat, counts)
        at = np.cumsum(counts) - counts
        for i, b in zip(odd.tolist(), bytes_of, strict=True):
            out[at[i] : at[i] + len(b)] = b
        return np.bincount(row, weights=counts, minlength=len(n)).astype(np.int64), out

    def _fallback(self, c: str) -> list[int]:
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in c.encode("utf-8", "replace")]

    def agenda(self, chunk: str) -> list[int]:
        """The same for one chunk of any length: a heap of (rank, place) over linked symbols."""
        sym = [self.id_of.get(c, -2 - ord(c)) for c in chunk]
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                piece = self.pair.get(sym[i] * self.size + sym[j])
                if piece is not None:
                    heapq.heappush(heap, (int(self.rank[piece]), i, sym[i], sym[j], piece))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the pair has merged meanwhile
            sym[i], sym[j] = piece, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        out: list[int] = []
        i = 0 if n else -1
        while i >= 0:
            out += [sym[i]] if sym[i] >= 0 else self._fallback(chr(-2 - sym[i]))
            i = right[i]
        return out


_LOADED: dict[str, tuple[Vocabulary, WordTable]] = {}


def load(path: str) -> tuple[Vocabulary, WordTable]:
    if path not in _LOADED:
        voc = Vocabulary(path)
        _LOADED[path] = (voc, WordTable(voc.encode_chunks, CHUNKS))
    return _LOADED[path]


def chunks_of(text: str, prefix: str) -> list[str]:
    if not text:
        return []
    marked = prefix + text.replace(" ", SPACE)
    if "  " in text or SPACE in text or text[0] == " " or text[-1] == " " or not prefix:
        return _CHUNK.findall(marked)
    return [SPACE + w for w in text.split(" ")]


def encode_batch(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, with begin and end ids."""
    voc, chunk_table = load(path)
    pieces = [chunks_of(t, voc.prefix) for t in texts]
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    per_chunk, flat = chunk_table.expand(pa.array([c for p in pieces for c in p], pa.large_string()))
    upto = np.concatenate([[0], np.cumsum(per_chunk)])
    ends = upto[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    frame = (np.array([voc.begin]), np.array([voc.end]))
    return [np.concatenate([frame[0], flat[a:b], frame[1]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class LibraryMismatch(AssertionError):
    """The agenda's ids of a text are not the library's."""


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str | None = None, check: bool = True, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (with keep also ids and decoded).

    A null text is empty and has the begin and end ids only; a null doc_id stays null; repeated rows
    give repeated results; other columns play no part.  With check, every Arrow batch's ids are held
    against the library's and a difference stops the job.
    """
    path = path or default_path()
    schema = _SCHEMA + (", ids array<int>, decoded string" if keep else "")

    def run(batches):
        voc, known = load(path)
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            for first, col in text_slices(batch, SLICE):
                texts = col.to_pylist()
                ids = encode_batch(texts, path)
                if check:
                    theirs = voc.library.encode(texts, num_threads=1, add_bos=True, add_eos=True)
                    sizes = list(map(len, theirs))
                    if sizes != list(map(len, ids)) or not np.array_equal(np.concatenate(ids), np.fromiter(chain.from_iterable(theirs), np.int64, sum(sizes))):
                        raise LibraryMismatch(next(t[:200] for t, a, b in zip(texts, ids, theirs, strict=True) if a.tolist() != b))
                decoded = voc.library.decode([a.tolist() for a in ids], num_threads=1)
                out = {
                    "doc_id": doc_ids.slice(first, len(texts)),
                    "n_tokens": pa.array([len(a) for a in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded],
                }
                if keep:
                    out |= {"ids": pa.array([a.astype(np.int32) for a in ids], pa.list_(pa.int32())), "decoded": decoded}
                yield pa.RecordBatch.from_pydict(out)
        known.clear()  # the worker may go on with another operator

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return batched(rows).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from chronovox.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents"))
