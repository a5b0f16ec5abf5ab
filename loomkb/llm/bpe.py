"""Byte-level BPE: a lexicon of frequent words, exact merges for the others, and decoding."""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, Scratch, slices
from .lexicon import Lexicon, compile_lexicon
from .tokens import ASCII_BYTE_WORDS, BYTE_WORDS, LONG_UNIT, byte_letters, spaced_units

#: Frequent words in the lexicon at most.
LEXICON_WORDS = 1 << 16
#: Words longer than this many bytes are merged through a heap.
WIDE = 48
#: Above all ranks.
NONE = 1 << 62
#: Slots of the table of pairs: a power of two, several times the merges.
SLOT_BITS = 18


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters, vocab = {c: b for b, c in byte_letters().items()}, data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (k, vocab[a + b])
        # pairs by the hash of both ids, the next free slot where one is taken, and what each makes behind its rank: the least merges next
        bits = max(SLOT_BITS, 2 + len(self.rank).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        taken: dict[int, int] = {}
        for k, slot in enumerate(self._slots(keys).tolist()):
            while slot in taken:
                slot = slot + 1 & self.last
            taken[slot] = k
        if taken:
            at, own = np.array(list(taken)), list(self.rank.values())
            self.pairs[at], self.next[at] = keys[list(taken.values())], [own[k][0] << 20 | own[k][1] for k in taken.values()]

    def one(self, word: bytes) -> list[int]:
        """Ids of one word of any length: the lowest-ranked pair merges first, the leftmost of equals."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*self.rank[p], k) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.rank]
        heap = [(r, k, made) for r, made, k in heap]
        heapq.heapify(heap)
        while heap:
            r, k, made = heapq.heappop(heap)
            to = right[k]
            if ids[k] < 0 or to >= n or self.rank.get((ids[k], ids[to])) != (r, made):
                continue
            ids[k], ids[to] = made, -1
            right[k] = right[to]
            if right[k] < n:
                left[right[k]] = k
                if p := self.rank.get((made, ids[right[k]])):
                    heapq.heappush(heap, (p[0], k, p[1]))
            if left[k] >= 0 and (p := self.rank.get((ids[left[k]], made))):
                heapq.heappush(heap, (p[0], left[k], p[1]))
        return [i for i in ids if i >= 0]

    def many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: all short words take their next merge together."""
        out = [[] if len(w) <= WIDE else self.one(w) for w in words]
        short = sorted((k for k, w in enumerate(words) if 0 < len(w) <= WIDE), key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):
            own = short[at : at + 4096]
            for k, ids in zip(own, self._together([words[k] for k in own]), strict=True):
                out[k] = ids
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair makes, behind its rank; NONE where it doesn't merge or an id is negative."""
        keys = np.where((a < 0) | (b < 0), -2, a << 20 | b)
        slots = self._slots(keys)
        out, met = self.next[slots], self.pairs[slots]
        left = np.flatnonzero(met != keys)
        out[left] = NONE
        left = left[met[left] >= 0]
        while len(left):
            slots = slots[left] if len(slots) == len(keys) else slots
            slots = slots + 1 & self.last
            met = self.pairs[slots]
            hit = met == keys[left]
            out[left[hit]] = self.next[slots[hit]]
            more = ~hit & (met >= 0)
            left, slots = left[more], slots[more]
        return out

    def _together(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that are not empty. A word's symbols stay in its row of slots; each knows the slots beside it that are left."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max()) + 1  # the last slot stays empty
        ids = np.full((len(words), width), -1, np.int64)
        ids[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        made = np.full(ids.shape, NONE)
        made[:, :-1] = self._made(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        slots = np.arange(ids.size).reshape(ids.shape)
        left, right = slots - 1, slots + 1
        left[:, 0] = right[:, -1] = slots[:, -1]
        ids, left, right, rows = ids.ravel(), left.ravel(), right.ravel(), np.arange(len(words))
        flat = made.ravel()
        while True:
            at = rows * width + made[rows].argmin(axis=1)
            best = flat[at]
            go = best < NONE
            rows, at, best = rows[go], at[go], best[go]
            if not len(rows):
                break
            gone = right[at]
            beyond = right[gone]
            ids[at], ids[gone], flat[gone] = best & 0xFFFFF, -1, NONE
            right[at] = beyond
            left[beyond] = at
            before = left[at]
            flat[at], flat[before] = self._made(ids[at], ids[beyond]), self._made(ids[before], ids[at])
        kept = ids >= 0
        ends = np.cumsum(kept.reshape(-1, width).sum(axis=1)).tolist()
        found = ids[kept].tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


class Encoder:
    """Ids and decoded bytes of whole texts; distinct units of text are looked up once."""

    def __init__(self, spec: str, lexicon: bytes, most: int = 250_000):
        self.merges, self.most = Merges(spec), most
        self.lexicon = Lexicon.mapped(lexicon)
        self.split = regex.compile(BYTE_WORDS)
        added = sorted(self.merges.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.decimals = {i: f"{i}," for i in self.merges.pieces}
        # of units and words met lately, in two generations: ids as decimals, each followed by a comma, and the bytes they decode to
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def words(self, unit: str) -> list[str]:
        """Pre-tokens of a unit; added tokens stand alone."""
        if (unit[1:] if unit[:1] == " " else unit).isalpha():
            return [unit]
        if self.added is None or not self.added.search(unit):
            return (ASCII_BYTE_WORDS if unit.isascii() and unit.isprintable() else self.split).findall(unit)
        return [w for k, s in enumerate(self.added.split(unit)) for w in ([s] if k % 2 else self.split.findall(s))]

    def ids_of(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens: from the automaton, else by merging."""
        out = {w: [self.merges.added[w]] for w in words if w in self.merges.added}
        words = [w for w in words if w not in out]
        raw = [w.encode() for w in words]
        numbers = self.lexicon.numbers(raw)
        hits = np.flatnonzero(numbers >= 0)
        low, high = (self.lexicon.ends[numbers[hits] + k].tolist() for k in (0, 1))
        out |= {words[k]: self.lexicon.ids[a:b].tolist() for k, a, b in zip(hits.tolist(), low, high, strict=True)}
        unseen = np.flatnonzero(numbers < 0).tolist()
        out |= {words[k]: ids for k, ids in zip(unseen, self.merges.many([raw[k] for k in unseen]), strict=True)}
        return out

    def unknown(self, units: set[str]) -> list[str]:
        """Those of ``units`` that were not met lately; what the older generation knows is taken over."""
        new = []
        for u in units.difference(self.known):
            if (x := self.older.get(u)) is None:
                new.append(u)
            else:
                self.known[u] = x
        return new

    def learn(self, units: list[str]) -> list[str]:
        """Encode and decode new units, whose words are kept as units of one word; what is too long to keep."""
        split = [self.words(u) for u in units]
        pieces, decimals, known = self.merges.pieces.__getitem__, self.decimals.__getitem__, self.known
        words = self.unknown(set().union(*split))
        for w, ids in self.ids_of(words).items():
            known[w] = "".join(map(decimals, ids)), b"".join(map(pieces, ids))
        for u, s in zip(units, split, strict=True):
            if len(s) != 1:
                own = [known[w] for w in s]
                known[u] = "".join([x for x, _ in own]), b"".join([x for _, x in own])
            elif s[0] != u:
                known[u] = known[s[0]]
        return [x for x in {*units, *words} if len(x) > LONG_UNIT]

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids (decimals joined by commas) and the bytes decoded from them."""
        split = [spaced_units(t) for t in texts]
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        long = self.learn(self.unknown(set().union(*split)))
        get = self.known.__getitem__
        for s in split:
            shown, raw = zip(*map(get, s), strict=True)
            yield "".join(shown)[:-1], b"".join(raw)
        for x in long:
            del self.known[x]


def _words(batches: Iterator[pa.RecordBatch], text_col: str, least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the task's words (units of one pre-token) that it met ``least`` times or more."""
    counts: Counter[str] = Counter()

    def out():
        kept = [(w, n) for w, n in counts.items() if n >= least]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "size"])

    for batch in batches:
        for part in slices(batch, text_col):
            for t in part.column(text_col).to_pylist():
                counts.update(spaced_units(t or ""))
            if len(counts) > 500_000:
                yield out()
    yield out()


def frequent_words(docs: DataFrame, text_col: str, most: int) -> list[str]:
    """At most ``most`` words of the corpus, the most frequent, counted over all documents.

    The least count is read off the histogram of counts, so that the driver
    gets no more words than that.
    """
    counts = docs.select(text_col).mapInArrow(lambda b: _words(b, text_col, 1), "word string, size long").where("length(word) BETWEEN 1 AND 32").groupBy("word").agg(F.sum("size").alias("size")).where("size > 1")
    scratch = Scratch(docs.sparkSession, "bpe-words")
    counts = scratch.write(counts, "counts")
    sizes = counts.groupBy(F.least("size", F.lit(1 << 20)).alias("size")).count().orderBy(F.desc("size"))
    least, total = None, 0
    for size, n in sizes.toLocalIterator():
        total += n
        if total > most:
            break
        least = size
    words = [] if least is None else [r[0] for r in counts.where(F.col("size") >= least).select("word").collect()]
    scratch.clear()
    return words


def _encode(key: str, spec_of, lexicon_of, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = HELD.of(f"bpe {key}", "encoder", lambda: Encoder(spec_of.value, lexicon_of.value))
        for batch in batches:
            for part in slices(batch, text_col, 2_000_000):
                rows = list(encode([t or "" for t in part.column(text_col).to_pylist()]))
                sizes = [x.count(",") + 1 if x else 0 for x, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())],
                    names=["doc_id", "n_ids", "ids", "decoded"],
                )

    return run


def bpe_round_trip(spark: SparkSession, docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_ids, ids, decoded) of every document: how many ids, these as decimals joined by commas, and the bytes they decode to.

    The corpus' most frequent words, counted over all documents, are compiled
    with their ids into a minimal acyclic transducer of bounded size, which
    tasks memory-map; other words are merged exactly, many at a time. Added
    tokens in a text have their own id, as in the library. Null and empty
    texts give no ids; null ids and repeated rows are kept; other columns are
    ignored.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    merges = Merges(spec)
    split = regex.compile(BYTE_WORDS)
    words = {w for u in frequent_words(docs, text_col, lexicon_words) for w in split.findall(u)}
    raw = sorted(w.encode() for w in words if w not in merges.added)
    lexicon = compile_lexicon(dict(zip(raw, merges.many(raw), strict=True)))
    spec_of, lexicon_of = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(lexicon)
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return narrow.mapInArrow(_encode(uuid.uuid4().hex, spec_of, lexicon_of, id_col, text_col), "doc_id long, n_ids long, ids string, decoded binary")
