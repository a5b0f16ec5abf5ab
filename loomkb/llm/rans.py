"""Static range asymmetric numeral coding of token ids in independent interleaved blocks.

A block is

    header      magic "RANS", version, lanes, symbols, rows between checkpoints,
                number of checkpoints, words, crc32 of the ids, crc32 of what follows
    checkpoints for each: word position and the lanes' states (64 bits each)
    words       32-bit stream that the lanes share

Symbol i belongs to lane i % lanes. A row is one symbol of each lane; the last
row is filled up with the table's first symbol. Checkpoint 0 is the start of
the block, so decoding may begin at any checkpoint, in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sHHIHHIII")
MAGIC, VERSION = b"RANS", 1
LANES = 1024
CHECKPOINT_ROWS = 128


class Table:
    """Frequencies of the symbols met in a corpus, scaled to 2**SCALE slots, one at least each."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        total, slots = int(counts.sum()), 1 << SCALE
        if len(symbols) > slots // 2:
            raise ValueError(f"more than {slots // 2} symbols")
        freq = np.maximum(1, np.floor(counts * (slots / max(total, 1))).astype(np.int64))
        while (over := int(freq.sum()) - slots) > 0:  # taken from the most frequent
            k = np.argsort(-freq, kind="stable")[: max(1, min(over, len(freq) // 4 + 1))]
            freq[k] = np.maximum(1, freq[k] - max(1, over // len(k)))
        if len(freq):
            freq[int(freq.argmax())] += slots - int(freq.sum())
        self.symbols = symbols.astype(np.uint32)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.index = np.full(int(symbols.max()) + 1 if len(symbols) else 1, -1, np.int64)
        self.index[symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.uint32), freq)

    def pack(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.tobytes() + self.freq.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Table:
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One block of the given ids (at least one)."""
    n = len(ids)
    lanes = int(min(LANES, max(1, n // 64)))
    rows = -(-n // lanes)
    at = np.zeros(rows * lanes, np.int64)
    at[:n] = table.index[ids]
    if (at < 0).any():
        raise ValueError("an id is not in the frequency table")
    at = at.reshape(rows, lanes)
    freq, start = table.freq, table.start
    shift, word, top = np.uint64(SCALE), np.uint64(32), np.uint64(31 - SCALE + 32)
    state, out, words, checkpoints = np.full(lanes, LOW, np.uint64), [], 0, []
    for r in range(rows - 1, -1, -1):
        f = freq[at[r]]
        full = state >= (f << top)
        if full.any():
            low = state[full].astype(np.uint32)
            out.append(low)
            words += len(low)
            state[full] >>= word
        q = state // f
        state = (q << shift) + (state - q * f) + start[at[r]]
        if r % CHECKPOINT_ROWS == 0:
            checkpoints.append((words, state.copy()))
    checkpoints.reverse()
    body = b"".join(struct.pack("<I", words - done) + s.tobytes() for done, s in checkpoints)
    body += b"".join(x.tobytes() for x in reversed(out))
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEADER.pack(MAGIC, VERSION, lanes, n, CHECKPOINT_ROWS, len(checkpoints), words, crc, zlib.crc32(body)) + body


def segment_of(raw: bytes, k: int, segments: int) -> tuple[int, int, int, int]:
    """Of ``segments`` equal parts of a block's checkpoints, the k-th: first checkpoint, rows, first id and the id after the last."""
    _, _, lanes, n, every, points, *_ = HEADER.unpack_from(raw)
    first, last = k * points // segments, (k + 1) * points // segments
    return first, (last - first) * every, min(n, first * every * lanes), min(n, last * every * lanes)


def decode_block(raw: bytes, table: Table, checkpoint: int = 0, rows: int | None = None) -> np.ndarray:
    """Ids (uint32) from a checkpoint on; a whole block is held against both checksums."""
    magic, version, lanes, n, every, points, words, crc, body_crc = HEADER.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    if zlib.crc32(memoryview(raw)[HEADER.size :]) != body_crc:
        raise ValueError("the block is damaged")
    size = 4 + 8 * lanes
    own = HEADER.size + checkpoint * size
    position = struct.unpack_from("<I", raw, own)[0]
    state = np.frombuffer(raw, "<u8", lanes, own + 4).copy()
    stream = np.frombuffer(raw, "<u4", words, HEADER.size + points * size)
    first, last = checkpoint * every, -(-n // lanes)
    last = last if rows is None else min(last, first + rows)
    shift, word, mask = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
    out = np.empty((last - first, lanes), np.uint32)
    for r in range(last - first):
        low = state & mask
        at = table.slot[low]
        out[r] = table.symbols[at]
        state = table.freq[at] * (state >> shift) + low - table.start[at]
        short = state < LOW
        k = int(np.count_nonzero(short))
        if k:
            state[short] = (state[short] << word) | stream[position : position + k]
            position += k
    ids = out.reshape(-1)[: max(0, n - first * lanes)]
    if checkpoint == 0 and rows is None and zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the decoded ids do not match their checksum")
    return ids


def _times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from their crc32s and the second's length.

    Appending ``length`` zero bytes is a linear map over the field of two
    elements; it is squared along the bits of the length.
    """
    step = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
    for _ in range(3):
        step = [_times(step, x) for x in step]
    while length:
        if length & 1:
            first = _times(step, first)
        step = [_times(step, x) for x in step]
        length >>= 1
    return first ^ second
