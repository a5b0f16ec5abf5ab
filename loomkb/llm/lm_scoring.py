"""Language-model scores of texts: causal self-attention over subword ids, mixed with the words' shares of the corpus."""

from __future__ import annotations

import array
import contextlib
import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .attention import BEGIN, SYMBOLS, WINDOW
from .common import HELD, Scratch, slices
from .tokens import SpacedTable, UnitEncoder, byte_letters, distinct, runs_of, spaced_units

#: Words that tasks know the counts of: at most so many of at most so many bytes each (some 4 MB are sent).
LEXICON, LONG_WORD = 1 << 17, 64
#: Counts are dealt to so many steps for each doubling to find the lexicon's least count.
STEPS = 16
#: The shares of a word's probability that come from the attention and from the text's own words so far; the rest is the word's share of the training tokens.
SHARE, RECENT = 0.6, 0.1
#: Learning rates of the rounds (each takes its part of a task's windows), windows of a step, and steps below which a task takes all its windows in a round.
RATES, STEP_WINDOWS, LEAST_STEPS = (6e-3, 6e-3, 4e-3, 3e-3, 2e-3, 1e-3), 64, 120
#: Windows in one row (1 MB with inputs, targets and weights).
ROW_WINDOWS = 8192
#: Parameters that are averaged in one row.
PIECE = 4096
#: A text's end among the words, which are never empty.
END = b""
#: Words that a task counts before it begins anew, whose subwords it knows beside the lexicon's, and that the encoder keeps.
HELD_WORDS, KNOWN_WORDS, ENCODED_WORDS = 300_000, 400_000, 100_000
#: Text bytes whose words are held at once.
PIECE_BYTES = 4_000_000


def word_key(word: bytes) -> bytes:
    """The word, or for a long one its digest behind a space, which no word holds."""
    return word if len(word) <= LONG_WORD else b" " + hashlib.sha256(word).digest()


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's words with A-Z lower-cased, in lists of bounded size (bytes.lower and split know ASCII alone)."""
    text, at = text or b"", 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def lower_words(texts: pa.Array) -> pa.Array:
    """The words of a column's texts in lists, A-Z lower-cased; an empty one where white space begins or ends a text."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))


class Subwords:
    """Subword ids of words, each written behind one space, by a tokenizer file."""

    def __init__(self, path: str):
        self.encoder = UnitEncoder(path, spaced_units)
        self.size = self.encoder.library.get_vocab_size(with_added_tokens=True)
        letters = "abcdefghijklmnopqrstuvwxyz"
        e = self.encoder  # a word of these letters alone goes to the model as it is, where the file's kind is known
        self.plain = e.words is not None and not e.lower and not (e.added and e.added.search(letters))
        self.model, self.blank = e.library.model, byte_letters()[32]

    def raw(self, word: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.plain and word.isalpha():  # of bytes: ASCII letters
            return array.array("I", [t.id for t in self.model.tokenize(self.blank + word.decode())]).tobytes()
        if len(self.encoder.of_word) > ENCODED_WORDS:
            self.encoder.of_word.clear()
        return self.encoder._encode(" " + word.decode())

    def __call__(self, word: bytes) -> np.ndarray:
        return np.frombuffer(self.raw(word), "<u4")

    def table(self) -> SpacedTable:
        """An empty table of words by what stands behind the space."""
        return SpacedTable(self.encoder)


def _subwords(path: str) -> Subwords:
    return HELD.of("lm", ("subwords", path), lambda: Subwords(path))


def _counted(path: str, text_col: str):
    """(kind, key, n): occurrences of words (kind 0) and of the pairs of subwords in long words (kind 1), added up in the task."""

    def batch(kind: int, found: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["kind", "key", "n"])

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])

    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        for b in added(held).to_batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(b), np.int32)), b.column("key"), b.column("n")], names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, within, held = Counter(), Counter(), []
        for whole in batches:
            for part in slices(whole, text_col):
                found[END] += len(part)
                words, n = pc.value_counts(lower_words(part.column(text_col)).flatten()).flatten()
                words = words.cast(pa.binary())
                sizes = pc.binary_length(words).to_numpy()
                long = pa.array(sizes > LONG_WORD)
                for w, times in zip(words.filter(long).to_pylist(), n.filter(long).to_pylist(), strict=True):
                    ids = [FIRST, *_subwords(path)(w).tolist(), LAST]
                    for pair in zip(ids, ids[1:], strict=False):
                        within[b"%d %d" % pair] += times
                    found[word_key(w)] += times
                short = pa.array((sizes > 0) & (sizes <= LONG_WORD))
                held.append(pa.table({"key": words.filter(short), "n": n.filter(short)}))
                if sum(map(len, held)) > 2 * HELD_WORDS:
                    held = [added(held)]
                    if len(held[0]) > HELD_WORDS:
                        yield from out(held)
                        held = []
                if len(found) > HELD_WORDS:
                    yield batch(0, found)
                    found = Counter()
        if held:
            yield from out(held)
        yield batch(0, found)
        yield batch(1, within)

    return run


#: What stands for a word's beginning and its end among subword ids.
FIRST, LAST = -1, -2


def _pair_counts(path: str):
    """(before, id, n): how often subwords follow each other within all counted words, added up in the task; a text's end is a word of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = _subwords(path)
        for b in batches:
            kinds, keys, n = b.column("kind").to_numpy(), b.column("key").to_numpy(zero_copy_only=False), b.column("n").to_numpy()
            short = (kinds == 0) & np.fromiter((k[:1] != b" " and k != END for k in keys), bool, len(keys))
            words, table = np.array([k.decode() for k in keys[short]], object), subwords.table()
            at = table.places(words)
            sizes, ids = np.array(table.sizes, np.int64), np.array(table.ids, np.int64)
            starts = (np.cumsum(sizes) - sizes)[at]
            sizes = sizes[at]
            before, after = np.full(int(sizes.sum()) + len(at), FIRST), np.full(int(sizes.sum()) + len(at), LAST)
            inside = np.ones(len(before), bool)
            inside[np.cumsum(sizes + 1) - 1] = False  # a word's last pair
            after[inside] = ids[runs_of(starts, sizes)]
            first = np.cumsum(sizes + 1) - sizes - 1
            before[1:] = after[:-1]
            before[first] = FIRST
            more = [(FIRST, subwords.size, int(c)) if not kind else (*map(int, key.split()), int(c)) for kind, key, c in zip(kinds[~short], keys[~short], n[~short], strict=True) if kind or key == END]
            before, after, times = (np.concatenate([x, np.array([m[k] for m in more], np.int64)]) for k, x in enumerate((before, after, np.repeat(n[short], sizes + 1))))
            pairs, place = np.unique((before - LAST) << 32 | after - LAST, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32) + LAST), pa.array((pairs & 0xFFFFFFFF) + LAST), pa.array(added_up(place, times, len(pairs)))], names=["before", "id", "n"])

    return run


def added_up(place: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """The sum of ``times`` at each place, in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, times)
    return out


def _symbol_pairs(alphabet_of):
    """The pairs with symbols for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol_of = alphabet_of.value.symbol_of.astype(np.int64)
        for b in batches:
            columns = [np.array(b.column(c)) for c in ("before", "id")]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.where(c < 0, c, symbol_of[np.maximum(c, 0)])) for c in columns], b.column("n")], names=["before", "id", "n"])

    return run


def followers(pairs: pa.Table) -> np.ndarray:
    """How often each symbol follows each (the last row: a text's beginning), from pairs within words; a word's first symbol follows every last one in the same shares."""
    before, after, n = (np.array(pairs.column(c)) for c in ("before", "id", "n"))
    out, starts, ends = np.zeros((SYMBOLS + 1, SYMBOLS)), np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    inside = (before >= 0) & (after >= 0)
    np.add.at(out, (before[inside], after[inside]), n[inside])
    np.add.at(starts, after[before == FIRST], n[before == FIRST])
    np.add.at(ends, before[after == LAST], n[after == LAST])
    share = starts / max(starts.sum(), 1)
    out[:SYMBOLS] += ends[:, None] * share
    out[BEGIN] = starts
    return out


class Alphabet:
    """The network's symbols: the end, the most frequent subwords, and one for all others.

    ``symbol_of`` has the symbol of each id (the end's is the last id), ``within``
    the natural logarithm of the id's probability among the ids of its symbol.
    """

    def __init__(self, counts: np.ndarray):
        often = counts.astype(np.float64)
        often[-1] = np.inf  # the end always has a symbol of its own
        ranked = np.argsort(-often, kind="stable")
        self.symbol_of = np.full(len(counts), SYMBOLS - 1, np.int16)
        self.symbol_of[ranked[: SYMBOLS - 1]] = np.arange(min(SYMBOLS - 1, len(counts)))
        rest = ranked[SYMBOLS - 1 :]
        self.within = np.zeros(len(counts))
        self.within[rest] = np.log((counts[rest] + 1.0) / (counts[rest].sum() + len(rest)))


class Words:
    """Places of words in a table of their ids; the lexicon's words come first, others are dropped when there are many."""

    def __init__(self, path: str, alphabet: Alphabet, lexicon: dict[bytes, int]):
        self.alphabet = alphabet
        self.lexicon = [END, *[w for w in lexicon if w != END]]
        self.counts = np.array([lexicon.get(w, 0) for w in self.lexicon], np.int64)
        self.table = _subwords(path).table()
        self.table.add([END.decode()], np.array([len(alphabet.symbol_of) - 1], "<u4"), np.ones(1, np.int64))
        own = _subwords(path).table()
        places = own.places(np.array([w.decode() for w in self.lexicon[1:]], object))
        sizes = np.array(own.sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        self.table.add([w.decode() for w in self.lexicon[1:]], np.array(own.ids, "<u4")[runs_of(starts[places], sizes[places])], sizes[places])

    def trim(self) -> None:
        """Keep memory bounded; places are valid until this is called."""
        if len(self.table) - len(self.lexicon) > KNOWN_WORDS or len(self.table.ids) > 64 * (KNOWN_WORDS + len(self.lexicon)):
            self.table.keep(len(self.lexicon))

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all texts, each text's followed by its end's, and how many each text has."""
        lists = lower_words(texts)
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        codes, names = distinct(lists.flatten())
        at = self.table.places(names)[codes]
        kept = at > 0  # nothing stands before white space at a text's beginning or behind it at its end
        text = np.repeat(np.arange(len(sizes)), sizes)[kept]
        sizes = np.bincount(text, minlength=len(texts)) + 1
        out = np.zeros(int(sizes.sum()), np.int64)
        out[np.arange(len(text)) + text] = at[kept]
        return out, sizes

    def spelled(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``places``, one after the other, and how many each has."""
        ids, sizes = np.array(self.table.ids, "<u4"), np.array(self.table.sizes, np.int64)
        own = sizes[places]
        return ids[runs_of((np.cumsum(sizes) - sizes)[places], own)], own


def _words(model_of, key: str, path: str) -> Words:
    """The word tables of one model in a Python worker; another model's are dropped."""
    held = HELD.of("lm", "words", dict)
    if key not in held:
        held.clear()
        held[key] = Words(path, *model_of.value[:2])
    return held[key]


def windows(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows (inputs, targets, weights) of all symbols of texts, of which each has so many as its size."""
    ends = np.cumsum([0, *sizes])
    begins = np.cumsum([0, *-(-sizes // WINDOW) * WINDOW])
    x, y, weight = np.zeros(begins[-1], "<i2"), np.zeros(begins[-1], "<i2"), np.zeros(begins[-1], np.uint8)
    at = runs_of(begins[:-1], sizes)
    y[at], weight[at] = symbols, 1
    x[1:] = y[:-1]
    x[begins[:-1][sizes > 0]] = BEGIN
    x[weight == 0] = 0
    for at in range(0, len(y), ROW_WINDOWS * WINDOW):
        blobs = [v[at : at + ROW_WINDOWS * WINDOW].tobytes() for v in (x, y, weight)]
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["x", "y", "weight"])


def _runs(model_of, key: str, path: str, text_col: str):
    """Windows of all symbols of each training text, some rows for each slice; straight from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model_of, key, path)
        for whole in batches:
            for part in slices(whole, text_col):
                words.trim()
                places, sizes = words.places(part.column(text_col))
                ids, own = words.spelled(places)
                yield from windows(words.alphabet.symbol_of[ids], np.add.reduceat(own, np.cumsum(sizes) - sizes))

    return run


def blob_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binaries of consecutive values, so many in each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def blob_values(column: pa.Array, kind: str) -> np.ndarray:
    """All values of the binaries, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _spelled(model_of, key: str, path: str, id_col: str, text_col: str):
    """Each text once as words and ids, with what the lexicon's counts tell of it and its words beside the lexicon.

    ``words`` has a word's place in the lexicon, or for others a number of its
    own in the text, beyond the lexicon; ``sizes`` has how many of ``ids`` a word has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model_of, key, path)
        part, pos, n_lexicon = TaskContext.get().partitionId(), 0, len(words.lexicon)
        logs = np.log10(words.counts + 1.0)
        id_kind = "<u2" if len(words.alphabet.symbol_of) <= 1 << 16 else "<u4"
        for whole in batches:
            for rows in slices(whole, text_col):
                words.trim()
                flat, sizes = words.places(rows.column(text_col))
                n = len(sizes)
                text = np.repeat(np.arange(n), sizes)
                ids, own = words.spelled(flat)
                known = flat < n_lexicon
                counted = np.where(known, flat, 0)
                met = known & (words.counts[counted] > 0)
                rare = np.flatnonzero(~known)
                pairs, nth, times = np.unique(text[rare] << 32 | flat[rare], return_inverse=True, return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(n + 1))
                local = flat.astype("<i4")
                local[rare] = n_lexicon + nth - ends[text[rare]]
                names = list(words.table)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int64) * (1 << 40) + np.arange(pos, pos + n)),
                        rows.column(id_col),
                        rows.column("learn"),
                        pa.array(sizes),
                        pa.array(np.bincount(text, weights=met, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(text, weights=np.where(known, logs[counted], 0), minlength=n)),
                        lists(pa.array([word_key(names[k].encode()) for k in (pairs & 0xFFFFFFFF).tolist()], pa.binary())),
                        lists(pa.array(times, pa.int64())),
                        blob_array(local, sizes),
                        blob_array(own.astype("<u4"), sizes),
                        blob_array(ids.astype(id_kind), np.add.reduceat(own, np.cumsum(sizes) - sizes)),
                    ],
                    names=["row", "doc_id", "learn", "n_tokens", "known", "logs", "keys", "times", "words", "sizes", "ids"],
                )
                pos += n

    return run


def _windows(model_of):
    """Windows of all symbols of texts that are spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol_of = model_of.value[0].symbol_of
        kind = "<u2" if len(symbol_of) <= 1 << 16 else "<u4"
        for whole in batches:
            for part in slices(whole, "ids"):
                sizes = pc.binary_length(part.column("ids")).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
                yield from windows(symbol_of[blob_values(part.column("ids"), kind)], sizes)

    return run


def dealt(targets: np.ndarray, nth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a row that round ``nth`` takes, and the others. The order is the row's own, so over all rounds each window is taken once."""
    order = np.random.default_rng(zlib.crc32(np.ascontiguousarray(targets))).permutation(len(targets))
    own = order[nth % len(RATES) :: len(RATES)]
    return own, np.setdiff1d(order, own)


def _round(flat_of, model_of, nth: int, rate: float):
    """A task's parameters after its share of the windows, times their number, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        HELD.only("lm rounds")  # words and subwords are not needed until texts are scored
        rng, seen, steps = np.random.default_rng(nth), 0, 0
        kept: list[tuple] = []

        def steps_of(held: tuple[np.ndarray, ...], own: np.ndarray):
            for at in range(0, len(own), STEP_WINDOWS):
                yield tuple(m[own[at : at + STEP_WINDOWS]] for m in held)

        def all_steps():
            nonlocal seen, steps
            for b in batches:
                for row in range(len(b)):  # views of the batch, no copies
                    held = tuple(np.frombuffer(b.column(c)[row].as_buffer(), kind).reshape(-1, WINDOW) for c, kind in (("x", "<i2"), ("y", "<i2"), ("weight", np.uint8)))
                    own, others = dealt(held[1], nth)
                    if steps < LEAST_STEPS:
                        kept.append((held, others))
                    else:
                        kept.clear()
                    seen += len(held[0])
                    for step in steps_of(held, own):
                        steps += 1
                        yield step
            if steps < LEAST_STEPS:  # few windows: all of them in each round
                for held, others in kept:
                    yield from steps_of(held, rng.permutation(others))

        flat = attention.trained(flat_of.value, model_of.value[2], all_steps(), rate)
        if steps:
            n, part = seen, TaskContext.get().partitionId()
            pieces = [flat[at : at + PIECE].astype(np.float64) * n for at in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["part", "piece", "n", "total"],
            )

    return run


def _added(group: pa.Table) -> pa.Table:
    """The sum of a group's pieces, in the order of their parts."""
    group = group.sort_by("part")
    total = sum(np.frombuffer(x, np.float64) for x in group.column("total").to_pylist())
    return pa.table({"part": group.column("part")[:1], "piece": group.column("piece")[:1], "n": pa.array([sum(group.column("n").to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})


PIECES = "part long, piece int, n long, total binary"
#: Tasks whose parameters are added up together before all are.
FAN_IN = 64


#: What keeps few rows of windows in memory at once, in the reader and on the way to Python.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}


@contextlib.contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """FEW_ROWS hold in the session, which has its own settings again afterwards."""
    before = {k: spark.conf.get(k) for k in FEW_ROWS}
    try:
        for k, v in FEW_ROWS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def train(spark: SparkSession, runs: DataFrame, flat: np.ndarray, model_of) -> np.ndarray:
    """Parameters after all rounds: in each, every task trains on its own windows and the results are averaged.

    What travels is one set of parameters (150 kB) for each task and round.
    """
    for nth, rate in enumerate(RATES):
        flat_of = spark.sparkContext.broadcast(flat)
        found = runs.mapInArrow(_round(flat_of, model_of, nth, rate), PIECES)
        found = found.groupBy(F.floor(F.col("part") / FAN_IN), "piece").applyInArrow(_added, PIECES).groupBy("piece").applyInArrow(_added, PIECES)
        with few_rows(spark):
            rows = sorted(found.collect(), key=lambda r: r["piece"])
        if rows:
            flat = np.concatenate([np.frombuffer(bytes(r["total"]), np.float64) / r["n"] for r in rows]).astype(np.float32)
    return flat


def earlier(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How often each word stands before in its text."""
    key = text.astype(np.int64) << 32 | word
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def _scored(model_of, flat_of, total: int):
    """Rows of texts that are spelled, with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (alphabet, lexicon, prior), p = model_of.value, attention.named(flat_of.value)
        counts = np.array([lexicon.get(END, 0), *[n for w, n in lexicon.items() if w != END]], np.int64)
        shares = (1 - SHARE - RECENT) * counts / max(total, 1)
        kind = "<u2" if len(alphabet.symbol_of) <= 1 << 16 else "<u4"
        for whole in batches:
            for rows in slices(whole, "ids"):
                sizes, flat, own, ids = rows.column("n_tokens").to_numpy(), *(blob_values(rows.column(c), k) for c, k in (("words", "<i4"), ("sizes", "<u4"), ("ids", kind)))
                text, last = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(own, dtype=np.int64)
                found = attention.log_scores(p, prior, alphabet.symbol_of[ids], last[np.cumsum(sizes) - 1])
                by_word = np.add.reduceat(found + alphabet.within[ids], last - own)
                known = flat < len(counts)
                ahead = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rest = np.where(known, shares[np.where(known, flat, 0)], 0) + RECENT * earlier(text, flat) / np.maximum(ahead, 1)
                with np.errstate(divide="ignore"):
                    mixed = np.logaddexp(by_word + math.log(SHARE), np.log(rest)) / math.log(10)
                kept = ["row", "doc_id", "n_tokens", "known", "logs"]
                yield pa.RecordBatch.from_arrays([*map(rows.column, kept), pa.array(np.bincount(text, weights=mixed, minlength=len(sizes)))], names=[*kept, "score"])

    return run


def score_texts(spark: SparkSession, docs: DataFrame, *, tokenizer: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from the rows where ``learn`` holds.

    Words are lower-cased (A-Z) and counted with one end for each text over all
    training rows. ``base_score`` adds up log10((c+1)/(N+V+1)). ``score`` is the
    log10 probability of the words and the end: SHARE times what the attention
    gives a word's subwords one after the other, plus RECENT times the word's
    share of the words before it in the text, plus the rest times the word's
    share of the training tokens if it is in the lexicon.

    Words, subwords and which subword follows which are counted over all
    training texts; these counts are what the network's logits are added to. It is
    trained in the tasks on every symbol of every training text, each in one
    round at least, and its parameters are averaged after each round. Tasks know the counts of the lexicon (at most ``lexicon``
    words of at most 64 bytes); other words meet their counts in a join.

    Null and empty texts have the end alone. Repeated rows are texts of their
    own, null ids too; where ``learn`` is null the row is not learnt from. Other
    columns are ignored. No rows in, none out; without training rows all
    counts are 0 and the network is as it began.
    """
    scratch = Scratch(spark, "lm")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    training = texts.where("learn").select("doc_id", "text")
    counts = training.select("text").mapInArrow(_counted(tokenizer, "text"), "kind int, key binary, n long")
    counts = scratch.write(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 0").select("key", "n")

    pairs = counts.mapInArrow(_pair_counts(tokenizer), "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))
    pairs = scratch.write(pairs, "pairs")
    by_id = np.zeros(Subwords(tokenizer).size + 1, np.int64)
    for i, n in pairs.where("id >= 0").groupBy("id").agg(F.sum("n")).collect():  # the vocabulary's size at most
        by_id[i] = n
    alphabet = Alphabet(by_id)
    alphabet_of = spark.sparkContext.broadcast(alphabet)
    found = pairs.mapInArrow(_symbol_pairs(alphabet_of), "before long, id long, n long").groupBy("before", "id").agg(F.sum("n").alias("n"))
    prior = attention.Prior(followers(found.toArrow()))  # SYMBOLS squared rows at most

    step = F.floor(F.log2("n") * STEPS).cast("int")
    sized = words.withColumn("step", step)
    total, distinct, room, least = 0, 0, lexicon, None
    for at, size, n in sorted(sized.groupBy("step").agg(F.count("*"), F.sum("n")).collect(), reverse=True):  # at most 64 x STEPS rows
        total, distinct, room = total + n, distinct + size, room - size
        if room >= 0:
            least = at
    known = {} if least is None else {bytes(r["key"]): r["n"] for r in sized.where((F.col("step") >= least) & (F.hex(F.substring("key", 1, 1)) != "20")).select("key", "n").collect()}
    known |= {END: next((r["n"] for r in words.where(F.length("key") == 0).collect()), 0)}
    model_of = spark.sparkContext.broadcast((alphabet, dict(sorted(known.items())), prior))

    kinds = "row long, doc_id long, learn boolean, n_tokens long, known long, logs double, keys array<binary>, times array<long>, words binary, sizes binary, ids binary"
    spelled = scratch.write(texts.mapInArrow(_spelled(model_of, scratch.base, tokenizer, "doc_id", "text"), kinds), "spelled")
    runs = scratch.write(spelled.where("learn").select("ids").mapInArrow(_windows(model_of), "x binary, y binary, weight binary"), "runs")
    flat = train(spark, runs, attention.initial(), model_of)

    flat_of = spark.sparkContext.broadcast(flat)
    scored = spelled.select("row", "doc_id", "n_tokens", "known", "logs", "words", "sizes", "ids").mapInArrow(_scored(model_of, flat_of, total), "row long, doc_id long, n_tokens long, known long, logs double, score double")
    scored = scratch.write(scored, "scored")
    rare = spelled.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    rare = rare.join(words, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    rows = scored.join(rare, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return rows.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
