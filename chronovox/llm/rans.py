"""Static range asymmetric numeral system over blocks of token ids, in numpy.

A block is coded by LANES interleaved coders that share one frequency table: symbol i belongs to
lane i mod LANES, so one numpy step moves all lanes on.  The encoder runs backwards, the decoder
forwards; 32-bit words are shared by the lanes in the order in which the decoder asks for them.

Block layout (little-endian): magic, version, lanes, number of symbols, number of words, number of
checkpoints, crc32 of what follows; then for every CHECKPOINT-th step the position in the words and
all lane states, so that decoding may start at any of them; then the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"CVR1", 1
LANES = 1024
#: Frequencies sum to 2 ** SCALE_BITS.
SCALE_BITS = 20
#: Steps between two checkpoints.
CHECKPOINT = 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIQQII")


class CorruptBlock(ValueError):
    """A block whose checksum, header or length is wrong."""


def frequency_table(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Integer frequencies summing to 2 ** bits; every counted symbol gets 1 at least."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint32)
    if used.sum() > 1 << bits:
        raise ValueError("more symbols than slots")
    room = (1 << bits) - int(used.sum())
    share = counts / counts.sum() * room
    freq = np.floor(share).astype(np.int64) + used
    left = (1 << bits) - int(freq.sum())
    if left > 0:  # the largest remainders, ties to the smaller symbol
        best = np.lexsort((np.arange(len(counts)), -(share - np.floor(share)) * used))[:left]
        freq[best] += 1
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, symbols: np.ndarray) -> bytes:
        n = len(symbols)
        steps = -(-n // LANES)
        state = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        written = 0
        shift32 = np.uint64(32)
        for k in range(steps - 1, -1, -1):
            syms = symbols[k * LANES : (k + 1) * LANES]
            m = len(syms)
            f, x = self.freq[syms], state[:m]
            # a lane gives up its low word where coding would push it beyond 63 bits
            over = x >= (f << (np.uint64(63) - self.bits))
            if over.any():
                words.append(x[over].astype(np.uint32)[::-1])
                written += int(over.sum())
                x = np.where(over, x >> shift32, x)
            state[:m] = ((x // f) << self.bits) + (x % f) + self.start[syms]
            if k % CHECKPOINT == 0:
                marks.append((written, state.copy()))
        flat = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
        marks.reverse()
        if not marks:
            marks = [(0, state)]
        body = b"".join(struct.pack("<Q", len(flat) - at) + s.astype("<u8").tobytes() for at, s in marks)
        body += flat.astype("<u4").tobytes()
        return _HEAD.pack(MAGIC, VERSION, LANES, n, len(flat), len(marks), zlib.crc32(body)) + body

    @staticmethod
    def header(block: bytes) -> tuple[int, int, int]:
        """(symbols, words, checkpoints) of a block, after checking it."""
        if len(block) < _HEAD.size:
            raise CorruptBlock("short header")
        magic, version, lanes, n, n_words, marks, crc = _HEAD.unpack_from(block)
        if magic != MAGIC or version != VERSION or lanes != LANES:
            raise CorruptBlock("unknown format")
        if zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
            raise CorruptBlock("checksum")
        return n, n_words, marks

    def decode(self, block: bytes, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
        """Symbols of a block, or of so many checkpoint intervals from the given one on."""
        n, n_words, marks = self.header(block)
        size = 8 + 8 * LANES
        at = _HEAD.size + checkpoint * size
        pos = struct.unpack_from("<Q", block, at)[0]
        state = np.frombuffer(block, "<u8", LANES, at + 8).astype(np.uint64)
        words = np.frombuffer(block, "<u4", n_words, _HEAD.size + marks * size)
        first = checkpoint * CHECKPOINT * LANES
        end = n if checkpoints is None else min(n, first + checkpoints * CHECKPOINT * LANES)
        out = np.empty(max(0, end - first), np.uint32)
        shift32 = np.uint64(32)
        for k in range(0, len(out), LANES):
            m = min(LANES, len(out) - k)
            x = state[:m]
            slot = x & self.mask
            syms = self.slots[slot]
            out[k : k + m] = syms
            x = self.freq[syms] * (x >> self.bits) + slot - self.start[syms]
            short = x < _LOW
            c = int(short.sum())
            if c:
                x[short] = (x[short] << shift32) | words[pos : pos + c]
                pos += c
            state[:m] = x
        return out
