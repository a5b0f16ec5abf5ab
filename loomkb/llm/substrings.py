"""Removal of repeated word windows by suffix trees over parts of the suffixes.

A window of ``width`` words is the top of the suffix that starts there. Suffixes
that may share a window with another are found first: each window stands on an
anchor, the least hash of its ANCHOR_WORDS-word runs, and only windows on an anchor that
occurs twice go on. Their suffixes are written as symbols of a few words each,
split by prefixes of the symbol string (longer where many suffixes share one) into
groups that fit a task, and sorted there; internal nodes at least ``width`` words
deep are runs of neighbours with equal tops and equal 64-bit hashes of the whole window.
Words are compared by 64-bit hashes: windows that differ in one word have different hashes
if the word's have, others collide once in 2^64 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_values, gram_hashes, hashed_words, slices

ANCHOR_WORDS = 5
#: Symbols of a suffix's top, 32 bits each.
SYMBOLS = 4
#: Anchors or suffixes that one task groups, on average; prefixes are extended beyond twice as many.
GROUP = 300_000
#: Anchors or suffixes that a task holds before it passes them on.
CHUNK = 500_000

def _sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each run of ``size`` neighbours, by doubling."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = op(values[:-step], values[step:])
        done += step
    return values


class Windows:
    """The windows of ``width`` words of all rows of a text column, and their anchors."""

    def __init__(self, texts: pa.Array, width: int):
        self.words, ends = hashed_words(texts)
        self.begins = ends[:-1]
        self.row = np.repeat(np.arange(len(texts)), np.diff(ends))
        self.grams = gram_hashes(self.words, ANCHOR_WORDS)
        self.span = width - ANCHOR_WORDS + 1
        n = max(0, len(self.words) - width + 1)
        #: The least anchor hash of the window that begins at each word; 0 where it would leave its row.
        self.least = np.where(self.row[:n] == self.row[width - 1 :], _sliding(self.grams, self.span, np.minimum), np.uint64(0)) if n else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Words at which some window's least run begins."""
        if not len(self.least):
            return np.zeros(0, np.int64)
        pad = np.zeros(self.span - 1, np.uint64)
        highest = _sliding(np.concatenate([pad, self.least, pad]), self.span, np.maximum)
        return np.flatnonzero((self.grams == highest) & (highest > 0))

    def places(self, at: np.ndarray) -> np.ndarray:
        return (at - self.begins[self.row[at]]).astype(np.int32)

    def on(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Words at which windows on one of the anchors at ``places`` of ``rows`` begin."""
        at = self.begins[rows] + places
        hot = np.unique(self.grams[at[at < len(self.grams)]])
        return np.flatnonzero(np.isin(self.least, hot) & (self.least > 0))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values)]


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    ends = _runs(bucket)
    for s, e in zip(ends[:-1], ends[1:], strict=True):
        yield int(bucket[s]), *[c[s:e].tobytes() for c in columns]


def _anchors(width: int, buckets: int, text_col: str):
    """Rows (bucket, known, values, texts, places) of the anchors; an anchor that a chunk holds twice leaves its bucket a mark and travels apart."""

    def rows(values, texts, places, salt):
        order = np.lexsort((places, texts, values))
        values, texts, places = values[order], texts[order], places[order]
        # copies of a text in this chunk count once
        new = np.r_[True, (values[1:] != values[:-1]) | (texts[1:] != texts[:-1]) | (places[1:] != places[:-1])]
        values, texts, places = values[new], texts[new], places[new]
        ends = _runs(values)
        sizes = np.diff(ends)
        twice = np.repeat(sizes > 1, sizes)
        marks = values[ends[:-1][sizes > 1]]
        none = np.full(len(marks), -1, np.int32)
        plain = np.concatenate([values[~twice], marks]), np.concatenate([texts[~twice], np.zeros(len(marks), np.uint64)]), np.concatenate([places[~twice], none])
        for b, *x in _by_bucket((plain[0] % np.uint64(buckets)).astype(np.int64), *plain):
            yield b, False, *x
        known = texts[twice]
        for b, *x in _by_bucket(((known + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64), values[twice], known, places[twice]):
            yield b, True, *x

    def batch(found):
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "known", "values", "texts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, salt = [], 0, TaskContext.get().partitionId()
        for whole in batches:
            for part in slices(whole, text_col):
                keys, windows = part.column("_key").to_numpy().view(np.uint64), Windows(part.column(text_col), width)
                at = windows.anchors()
                if len(at):
                    held.append((windows.grams[at], keys[windows.row[at]], windows.places(at)))
                    size += len(at)
                if size >= CHUNK:
                    yield batch(rows(*map(np.concatenate, zip(*held, strict=True)), salt))
                    held, size, salt = [], 0, salt + 1
        if size:
            yield batch(rows(*map(np.concatenate, zip(*held, strict=True)), salt))

    return run


def _repeated_anchors(group: pa.Table) -> pa.Table:
    """(text, places) of one bucket's anchors that occur at two places or in two texts."""
    known = group.column("known").to_pylist()

    def joined(column, flag, kind):
        return np.frombuffer(b"".join(x for x, k in zip(group.column(column).to_pylist(), known, strict=True) if k == flag), kind)

    values, texts, places = joined("values", False, np.uint64), joined("texts", False, np.uint64), joined("places", False, np.int32)
    order = np.lexsort((places, texts, values))
    values, texts, places = values[order], texts[order], places[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (texts[1:] != texts[:-1]) | (places[1:] != places[:-1])]
        values, texts, places = values[new], texts[new], places[new]
        ends = _runs(values)
        sizes = np.diff(ends)
        marked = np.minimum.reduceat(places, ends[:-1]) < 0
        keep = np.repeat(marked | (sizes > 1), sizes) & (places >= 0)
        texts, places = texts[keep], places[keep]
    return _listed(np.concatenate([texts, joined("texts", True, np.uint64)]).view(np.int64), np.concatenate([places, joined("places", True, np.int32)]), "text")


def _listed(keys: np.ndarray, places: np.ndarray, name: str) -> pa.Table:
    """One row a key with its places."""
    found = list(_by_bucket(keys, places))
    return pa.table({name: pa.array([k for k, _ in found], pa.int64()), "places": pa.array([p for _, p in found], pa.binary())})


#: A suffix's columns: document, 64 bits of its text's digest (an id may have several texts), place.
LEAF = (("docs", np.int64), ("keys", np.int64), ("places", np.int32))
COLUMNS = ("cell", "tops", "wholes", *[c for c, _ in LEAF])


def _later(new: np.ndarray, *leaf: np.ndarray) -> np.ndarray:
    """Leaves in order but for each run's first one (``new``) and what is that same place in a repeated row."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    same = np.ones(len(new), bool)
    for column in leaf:
        same &= column == column[first]
    return np.flatnonzero(~same)


def _suffixes(width: int, bits: int, text_col: str):
    """Rows (cell, tops, wholes, docs, keys, places) of suffixes that start on a repeated anchor; cell -1: places whose window began earlier in this chunk.

    A top is the big-endian string of its symbols' hashes; a cell is its first ``bits`` bits; a whole is the hash of all words of the window.
    """
    span = -(-width // SYMBOLS)
    steps = [round(k * (width - span) / (SYMBOLS - 1)) for k in range(SYMBOLS)]

    def rows(tops, wholes, docs, keys, places):
        order = np.lexsort((places, keys, docs, wholes, tops[:, 1], tops[:, 0]))
        tops, wholes, docs, keys, places = tops[order], wholes[order], docs[order], keys[order], places[order]
        new = np.r_[True, (tops[1:] != tops[:-1]).any(axis=1) | (wholes[1:] != wholes[:-1])]
        again = _later(new, docs, keys, places)
        if len(again):
            again = again[np.argsort(docs[again], kind="stable")]
            for k in range(0, len(again), 50_000):
                own = again[k : k + 50_000]
                yield -1, None, None, docs[own].tobytes(), keys[own].tobytes(), places[own].tobytes()
        tops, wholes, docs, keys, places = tops[new], wholes[new], docs[new], keys[new], places[new]
        cells = (tops[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tops), np.int64)
        yield from _by_bucket(cells, tops.astype(">u8"), wholes, docs, keys, places)

    def batch(found):
        columns = list(zip(*found, strict=True)) or [()] * len(COLUMNS)
        kinds = (pa.int64(), *[pa.binary()] * (len(COLUMNS) - 1))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        high = np.uint64(0xFFFFFFFF00000000)
        for whole in batches:
            for part in slices(whole, text_col):
                windows = Windows(part.column(text_col), width)
                own = [np.frombuffer(b"".join(x), np.int32) for x in part.column("lists").to_pylist()]
                starts = windows.on(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own))
                if len(starts):
                    symbols = gram_hashes(windows.words, span) if span != ANCHOR_WORDS else windows.grams
                    a, b, c, d = (symbols[starts + s] & high for s in steps)
                    row = windows.row[starts]
                    docs, keys = part.column("_doc").to_numpy()[row], part.column("_key").to_numpy()[row]
                    held.append((np.stack([a | (b >> np.uint64(32)), c | (d >> np.uint64(32))], axis=1), gram_hashes(windows.words, width)[starts], docs, keys, windows.places(starts)))
                    size += len(starts)
                if size >= CHUNK:
                    yield batch(rows(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if size:
            yield batch(rows(*map(np.concatenate, zip(*held, strict=True))))

    return run


def _prefix_counts(bits: int, step: int, heavy: set):
    """Counts of the next ``step`` bits below each heavy prefix: rows (cell, prefix, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell, raw in zip(b.column("cell").to_pylist(), b.column("tops").to_pylist(), strict=True):
                tops = np.frombuffer(raw, "S16")
                keys, sizes = np.unique(_head(tops, bits + step), return_counts=True)
                parents = _head(keys, bits).tolist()
                out += [(cell, bytes(k).ljust(16, b"\0"), int(n)) for k, n, p in zip(keys, sizes, parents, strict=True) if (cell, None) in heavy or (cell, bytes(p).ljust(16, b"\0")) in heavy]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["cell", "prefix", "size"])

    return run


def _head(tops: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of 16-byte strings, the others zero."""
    raw = np.frombuffer(tops.tobytes(), ">u8").reshape(-1, 2).astype(np.uint64)
    masks = [(2**64 - 1) ^ (2 ** max(0, 64 - bits) - 1), (2**64 - 1) ^ (2 ** max(0, 128 - max(bits, 64)) - 1)]
    return np.frombuffer((raw & np.array(masks, np.uint64)).astype(">u8").tobytes(), "S16")


def prefix_plan(suffixes: DataFrame, bits: int, most: int) -> dict[int, list[bytes]]:
    """Lower bounds of the groups below each cell that holds more than ``most`` suffixes.

    The prefix of a heavy group is extended by 8 bits at a time until it holds
    few enough or is a whole top. Counts are taken by Spark; the driver gets one row
    for each heavy prefix and its children.
    """
    sizes = suffixes.where("cell >= 0").groupBy("cell").agg(F.sum(F.octet_length("places") / 4).alias("n")).where(F.col("n") > most)
    heavy, bounds, depth = {(r[0], None) for r in sizes.collect()}, {}, bits
    while heavy and depth < 32 * SYMBOLS:
        cells = sorted({c for c, _ in heavy})
        counts = suffixes.where(F.col("cell").isin(cells)).select("cell", "tops").mapInArrow(_prefix_counts(depth, 8, heavy), "cell long, prefix binary, size long")
        below = counts.groupBy("cell", "prefix").agg(F.sum("size").alias("n")).collect()
        parents, heavy_next = {p for _, p in heavy}, set()
        for cell, prefix, n in below:
            parent = bytes(_head(np.frombuffer(bytes(prefix), "S16"), depth)[0]).ljust(16, b"\0")
            if None in parents or parent in parents:
                bounds.setdefault(cell, set()).add(bytes(prefix))
                if n > most:
                    heavy_next.add((cell, bytes(prefix)))
        heavy, depth = heavy_next, depth + 8
    return {c: sorted(b) for c, b in bounds.items()}


def _regrouped(plan_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = {c: np.array(b, "S16") for c, b in plan_of.value.items()}
        names = ["cell", "branch", *COLUMNS[1:]]
        for b in batches:
            out = []
            for cell, *raw in zip(*[b.column(c).to_pylist() for c in COLUMNS], strict=True):
                if cell not in plan:
                    out.append((cell, 0, *raw))
                    continue
                group = np.searchsorted(plan[cell], np.frombuffer(raw[0], "S16"), side="right")
                columns = [np.frombuffer(x, t) for x, t in zip(raw, ("V16", np.uint64, *[t for _, t in LEAF]), strict=True)]
                out += [(cell, *x) for x in _by_bucket(group, *columns)]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _dealt(slots: int, *leaf: np.ndarray) -> pa.Table:
    """Leaves, one row for each slot that some of their documents fall in."""
    found = list(_by_bucket(leaf[0] % slots, *leaf))
    columns = list(zip(*found, strict=True)) or [()] * (1 + len(LEAF))
    kinds = (pa.int64(), *[pa.binary()] * len(LEAF))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("slot", *[c for c, _ in LEAF]), columns, kinds, strict=True)})


def _subtree(slots: int):
    """One subtree's leaves under deep internal nodes, but for each node's earliest leaf."""

    def run(group: pa.Table) -> pa.Table:
        kinds = ("tops", ">u8"), ("wholes", np.uint64), *LEAF
        tops, wholes, docs, keys, places = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in kinds)
        tops = tops.reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((places, keys, docs, wholes, tops[:, 1], tops[:, 0]))
        tops, wholes = tops[order], wholes[order]
        docs, keys, places = docs[order], keys[order], places[order]
        new = np.r_[True, (tops[1:] != tops[:-1]).any(axis=1) | (wholes[1:] != wholes[:-1])] if len(tops) else np.zeros(0, bool)
        again = _later(new, docs, keys, places)
        return _dealt(slots, docs[again], keys[again], places[again])

    return run


def _known(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = [np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in LEAF]
            if len(leaf[0]):
                yield from _dealt(slots, *leaf).to_batches()

    return run


def _by_document(group: pa.Table) -> pa.Table:
    """One row (doc, key, places) for each text of each document."""
    docs, keys, places = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in LEAF)
    order = np.lexsort((keys, docs))
    docs, keys, places = docs[order], keys[order], places[order]
    ends = np.r_[0, np.flatnonzero((docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])) + 1, len(docs)] if len(docs) else np.zeros(1, np.int64)
    return pa.table({"doc": pa.array(docs[ends[:-1]]), "key": pa.array(keys[ends[:-1]]), "places": pa.array([places[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _cut(width: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col):
                out = []
                for raw, again, places in zip(byte_values(part.column(text_col)), part.column("again").to_pylist(), part.column("places").to_pylist(), strict=True):
                    words = raw.split()
                    n, removed = len(words), 0
                    if again and n >= width:
                        words, removed = [], n
                    elif places:
                        starts = np.frombuffer(places, np.int32)
                        steps = np.zeros(n + 1, np.int32)
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + width, -1)
                        covered = np.cumsum(steps[:n]) > 0
                        removed = int(covered.sum())
                        words = [words[k] for k in np.flatnonzero(~covered).tolist()]
                    out.append((n, removed, b" ".join(words)))
                names = [c for c in whole.schema.names if c not in ("again", "places", text_col)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
                    names=[*names, "n_words", "n_removed", "kept_text"],
                )

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, *, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with (n_words, n_removed, kept_text); the text column goes.

    Words are runs of characters other than the ASCII white space. A window is
    ``width`` consecutive words of one document; words covered by a window that
    also starts earlier (smaller id, or same document and earlier start) go,
    judged on the input. Kept words are joined by one space.

    Of identical texts only the smallest id takes part in the search; all windows
    of the others began earlier. Equal tops are taken together in each task
    before they move, so a passage that a third of all rows share costs one
    suffix a task. Null and empty texts have no words. Rows with a null id take
    no part and keep their words; rows repeated with their id keep what that
    document keeps. An id with several texts is a document for each, in the order
    of their digests. Other columns pass through unless they clash with the new ones.
    """
    if width < ANCHOR_WORDS:
        raise ValueError(f"a window has {ANCHOR_WORDS} words at least")
    scratch = Scratch(spark, "substrings")
    doc, digest = F.col(id_col).cast("long"), F.unhex(F.substring(F.sha2(text_col, 256), 1, 32))
    head = F.conv(F.hex(F.substring("_digest", 1, 8)), 16, -10).cast("long").alias("_key")
    thin = docs.where(F.length(text_col) >= 2 * width - 1).where(doc.isNotNull()).select(doc.alias("_doc"), digest.alias("_digest"), text_col)
    ids = scratch.write(thin.select("_doc", "_digest", F.length(text_col).alias("_size")), "ids")
    firsts = scratch.write(ids.groupBy("_digest").agg(F.min("_doc").alias("_first")), "firsts")
    size = ids.agg(F.sum("_size")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(size / 40 / GROUP))  # about one anchor in 40 characters
    anchors = thin.select(head, text_col).mapInArrow(_anchors(width, buckets, text_col), "bucket long, known boolean, values binary, texts binary, places binary")
    repeated = scratch.write(anchors.groupBy("bucket").applyInArrow(_repeated_anchors, "text long, places binary"), "anchors")

    found = repeated.agg(F.sum(F.octet_length("places") / 4)).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, parts, 5 * found / GROUP))))
    lists = repeated.groupBy(F.col("text").alias("_key")).agg(F.collect_list("places").alias("lists"))
    wanted = firsts.select(F.col("_first").alias("_doc"), "_digest", head).join(lists, "_key")
    sources = thin.join(wanted, ["_doc", "_digest"]).select("_doc", "_key", "lists", text_col)
    suffixes = scratch.write(sources.mapInArrow(_suffixes(width, bits, text_col), "cell long, tops binary, wholes binary, docs binary, keys binary, places binary"), "suffixes")
    plan_of = spark.sparkContext.broadcast(prefix_plan(suffixes, bits, 2 * GROUP))
    grouped = suffixes.where("cell >= 0").mapInArrow(_regrouped(plan_of), "cell long, branch long, tops binary, wholes binary, docs binary, keys binary, places binary")
    slots, dealt = max(parts, math.ceil(5 * found / GROUP)), "slot long, docs binary, keys binary, places binary"
    deep = grouped.groupBy("cell", "branch").applyInArrow(_subtree(slots), dealt)
    here = suffixes.where("cell < 0").select("docs", "keys", "places").mapInArrow(_known(slots), dealt)
    covers = scratch.write(deep.union(here).groupBy("slot").applyInArrow(_by_document, "doc long, key long, places binary"), "covers")
    scratch.drop("anchors", "suffixes")

    copies = ids.join(firsts, "_digest").where("_doc <> _first").select(F.col("_doc").alias("doc"), head.alias("key")).distinct()
    facts = covers.join(copies.withColumn("again", F.lit(True)), ["doc", "key"], "full_outer").withColumnsRenamed({"doc": "_doc", "key": "_key"})
    facts = scratch.write(facts.withColumn("again", F.coalesce("again", F.lit(False))), "facts")
    clash = {"n_words", "n_removed", "kept_text", "again", "places", "_doc", "_digest", "_key"} - {id_col, text_col}
    rows = docs.select(*[c for c in docs.columns if c not in clash]).withColumn("_doc", doc).withColumn("_digest", digest).withColumn("_key", head)
    rows = rows.join(facts, ["_doc", "_key"], "left").drop("_doc", "_digest", "_key")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("again", "places", text_col)]
    return rows.mapInArrow(_cut(width, text_col), ", ".join([*kept, "n_words long", "n_removed long", "kept_text string"]))
