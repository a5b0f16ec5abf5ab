"""A minimal acyclic transducer from frequent words to token ids, as flat arrays that can be memory-mapped.

Words (byte strings) share prefixes and suffixes. Each arc carries how many
words come before those below it, so the outputs along a word's path add up to
the word's number, which addresses its ids.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

MAGIC = b"LXC1"


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``words`` and their ids, by incremental minimisation of the sorted words."""
    ordered = sorted(words)
    known: dict[tuple, int] = {}
    kids: list[tuple] = []  # of finished states: ((byte, state), ...), final, words below

    def finish(arcs: list, final: bool) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(kids)
            kids.append((tuple(arcs), final, final + sum(kids[s][2] for _, s in arcs)))
        return known[key]

    path: list[list] = [[[], False]]  # open states along the last word: arcs, final
    last = b""
    for w in ordered:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        for k in range(len(last), same, -1):
            arcs, final = path.pop()
            path[-1][0].append((last[k - 1], finish(arcs, final)))
        path.extend([[], False] for _ in range(len(w) - same))
        path[-1][1] = True
        last = w
    for k in range(len(last), 0, -1):
        arcs, final = path.pop()
        path[-1][0].append((last[k - 1], finish(arcs, final)))
    root = finish(*path[0])

    n = len(kids)
    first, labels, targets, outputs = np.zeros(n + 1, np.int64), [], [], []
    for s, (arcs, final, _) in enumerate(kids):
        number = int(final)
        for label, to in arcs:
            labels.append(s * 256 + label)
            targets.append(to)
            outputs.append(number)
            number += kids[to][2]
        first[s + 1] = len(labels)
    ends = np.cumsum([0, *[len(words[w]) for w in ordered]])
    arrays = [
        np.array(labels, "<u8"),  # ascending: state * 256 + byte
        np.array(targets, "<u4"),
        np.array(outputs, "<u4"),
        np.array([f for _, f, _ in kids], "u1"),
        ends.astype("<u4"),
        np.array([i for w in ordered for i in words[w]], "<u4"),
    ]
    raw = struct.pack("<4sI6Q", MAGIC, root, *map(len, arrays))
    for a in arrays:
        raw += b"\0" * (-len(raw) % 8) + a.tobytes()
    return raw


class Lexicon:
    """Look-ups in a compiled lexicon."""

    def __init__(self, raw):
        magic, self.root, *sizes = struct.unpack_from("<4sI6Q", raw)
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at, arrays = struct.calcsize("<4sI6Q"), []
        for size, kind in zip(sizes, ("<u8", "<u4", "<u4", "u1", "<u4", "<u4"), strict=True):
            at += -at % 8
            arrays.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.arcs, self.targets, self.outputs, self.final, self.ends, self.ids = arrays

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """A lexicon in a memory map of an unnamed file, whose pages the system may drop and read again."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it isn't in the lexicon; all words take their next byte together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.arcs) or not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        for k in range(int(sizes.max(initial=0)) + 1):
            done = sizes[live] == k
            if done.any():
                w = live[done]
                w = w[self.final[state[w]] == 1]
                out[w] = total[w]
                live = live[~done]
            if not len(live):
                break
            key = state[live].astype(np.uint64) * np.uint64(256) + flat[starts[live] + k]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key
            live, arc = live[hit], arc[hit]
            state[live] = self.targets[arc]
            total[live] += self.outputs[arc]
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.ends[number] : self.ends[number + 1]]
