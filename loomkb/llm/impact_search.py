"""Ranked lexical search by exact integer impacts: postings in descending impact, score at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD, Scratch, slices

#: Documents and postings of a shard, at most (one long document more of the latter).
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: Terms that the index is confined to, if no more are asked for, and asked (item, term) pairs that are sent to tasks at once.
MOST_TERMS, MOST_PAIRS = 1 << 20, 1 << 18
#: Text bytes whose terms are held at once.
PIECE_BYTES = 4_000_000
#: Postings of a term are taken in levels, each down to this share of the level before.
FALL = 0.6
#: A search is completed by look-ups when so few documents can still be among the best.
FEW = 64
#: Stands for a null id within the index: after all ids.
NO_ID = np.iinfo(np.int64).max
#: Bytes to what they stand for in terms: a-z for A-Z, a blank for what no term holds.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """A text's terms (digits, ASCII letters, all beyond ASCII), in lists of bounded size."""
    plain, at = (text or b"").translate(TERM_BYTES), 0
    while len(plain) - at > PIECE_BYTES:
        end = plain.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def _lengths(text_col: str):
    """Documents with terms and all their terms: one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        HELD.only("impacts")
        n, total = 0, 0
        for whole in batches:
            for part in slices(whole, text_col):
                for text in part.column(text_col).cast(pa.binary()).to_pylist():
                    own = sum(map(len, terms_of(text)))
                    n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    return run


def _asked(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col):
                items, found = [], []
                for item, text in zip(part.column(id_col).to_pylist(), part.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
                    own = {t for ts in terms_of(text) for t in ts}
                    items += [item] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(items, part.schema.field(id_col).type), pa.array(found, pa.binary())], names=["item_id", "term"])

    return run


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What ``tf`` occurrences in a document with length factor ``m`` count before the term's weight, rounded down."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _indexed(n_docs: int, total: int, terms_sent, id_col: str, text_col: str):
    """(shard, term, size, levels, sizes, docs): a term's postings in a shard by falling impact; the empty term has the shard's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        HELD.only("impacts")
        wanted = terms_sent.value if terms_sent is not None else None
        shard, held = TaskContext.get().partitionId() << 24, 0
        ids: list[int] = []
        place: dict[bytes, int] = {}
        names: list[bytes] = []
        posted: list[tuple] = []  # for each document its terms' places, frequencies and length factor

        def flush():
            nonlocal shard, held
            terms = np.concatenate([np.fromiter(p, np.int64, len(p)) for p, _, _ in posted]) if posted else np.zeros(0, np.int64)
            tf = np.concatenate([np.fromiter(f, np.int64, len(f)) for _, f, _ in posted]) if posted else np.zeros(0, np.int64)
            each = np.array([len(p) for p, _, _ in posted], np.int64)
            docs, m = np.repeat(np.arange(len(each)), each), np.repeat(np.array([x for _, _, x in posted], np.int64), each)
            value = impact(tf, m)
            order = np.lexsort((docs, -value, terms))
            terms, value, docs = terms[order], value[order], docs[order].astype("<u4")
            level = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(value, prepend=-1))  # a term's postings of one impact
            term_at = np.searchsorted(terms[level], np.arange(len(names) + 1))
            sizes, begins = np.diff(np.append(level, len(docs))), np.searchsorted(terms, np.arange(len(names) + 1))
            blob = lambda x, kind: x.astype(kind).tobytes()
            rows = [(b"", len(ids), b"", b"", blob(np.array(ids, np.int64), "<i8"))]
            for k, name in enumerate(names):
                own = slice(term_at[k], term_at[k + 1])
                rows.append((name, int(begins[k + 1] - begins[k]), blob(value[level[own]], "<i4"), blob(sizes[own], "<i4"), docs[begins[k] : begins[k + 1]].tobytes()))
            for at in range(0, len(rows), 4096):
                columns = list(zip(*rows[at : at + 4096], strict=True))
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(columns[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["shard", "term", "size", "levels", "sizes", "docs"])
            shard, held = shard + 1, 0
            for x in (ids, place, names, posted):
                x.clear()

        for whole in batches:
            for part in slices(whole, text_col):
                for doc, text in zip(part.column(id_col).to_pylist(), part.column(text_col).cast(pa.binary()).to_pylist(), strict=True):
                    n, found = 0, Counter()
                    for ts in terms_of(text):
                        n += len(ts)
                        found.update(ts)
                    if not n:
                        continue
                    own = found.keys() if wanted is None else found.keys() & wanted
                    for t in own:
                        if t not in place:
                            place[t] = len(names)
                            names.append(t)
                    own = list(own)
                    ids.append(NO_ID if doc is None else doc)
                    posted.append(([place[t] for t in own], [found[t] for t in own], 10 + 90 * n * n_docs // total))
                    held += len(own)
                    if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                        yield from flush()
        if ids:
            yield from flush()

    return run


class Shard:
    """The postings of some documents: each term's by falling impact, and by document for look-ups."""

    def __init__(self, rows: dict[bytes, tuple[bytes, bytes, bytes]]):
        self.ids = np.frombuffer(rows.pop(b"")[2], "<i8")
        self.terms = {}
        for term, (levels, sizes, docs) in rows.items():
            docs = np.frombuffer(docs, "<u4").astype(np.int64)
            impacts = np.repeat(np.frombuffer(levels, "<i4").astype(np.int64), np.frombuffer(sizes, "<i4"))
            by_doc = np.argsort(docs)
            self.terms[term] = (impacts, docs, -impacts, docs[by_doc], impacts[by_doc])

    def best(self, asked: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) of terms with their weights, of a score above 0.

        All terms' postings are added up level by level, highest contributions
        first. What remains bounds what any document can still gain; once the
        k-th best so far is out of reach of all but a few, those few are
        completed by look-ups. Else all postings are added up.
        """
        lists = [(w, *self.terms[t]) for t, w in asked if w > 0 and t in self.terms]
        if not lists:
            return []
        score = np.zeros(len(self.ids), np.int64)
        done = [0] * len(lists)
        level = max(w * int(own[0]) for w, own, *_ in lists)
        while True:
            level, rest = int(level * FALL), 0
            for j, (w, own, docs, falling, _, _) in enumerate(lists):
                if done[j] < len(own):
                    # impacts above the level's share of this term; all of one impact are taken together
                    end = int(np.searchsorted(falling, -(level // w), side="left"))
                    if end > done[j]:
                        score[docs[done[j] : end]] += w * own[done[j] : end]
                        done[j] = end
                    if end < len(own):
                        rest += w * int(own[end])
            if not rest:
                chosen = np.flatnonzero(score)
                break
            if len(score) > k:
                kth = int(np.partition(score, len(score) - k)[len(score) - k])
                if kth > rest:  # no document that has gained nothing so far can be among the best
                    chosen = np.flatnonzero(score >= kth - rest)
                    if len(chosen) <= max(FEW, 4 * k):
                        for j, (w, own, _, _, sorted_docs, values) in enumerate(lists):
                            if done[j] < len(own):
                                at = np.minimum(np.searchsorted(sorted_docs, chosen), len(sorted_docs) - 1)
                                there = (sorted_docs[at] == chosen) & (values[at] <= own[done[j]])  # not yet added
                                score[chosen[there]] += w * values[at[there]]
                        break
        order = np.lexsort((self.ids[chosen], -score[chosen]))[:k]
        return [(int(score[c]), int(self.ids[c])) for c in chosen[order]]


def _searched(asked_of, k: int):
    """(item, doc_id, score) of a shard's best documents of each item."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        HELD.only("impacts")
        shard = Shard({t: (a, b, c) for t, a, b, c in zip(*[group.column(x).to_pylist() for x in ("term", "levels", "sizes", "docs")], strict=True)})
        found = [(item, doc, score) for item, asked in asked_of.value for score, doc in shard.best(asked, k)]
        items, docs, scores = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"item": pa.array(items, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


class ImpactIndex:
    """A stored index: ``postings`` (shard, term, size, levels, sizes, docs), documents with terms and all their terms."""

    def __init__(self, postings: DataFrame, n_docs: int, total: int):
        self.postings, self.n_docs, self.total = postings, n_docs, total


def build_index(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> ImpactIndex:
    """Index of all documents, of all terms or of those in ``terms`` (term) if there are at most MOST_TERMS.

    One pass counts lengths, on which impacts depend; a second one writes each
    task's documents as shards of bounded size. Nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_docs, total = texts.select("text").mapInArrow(_lengths("text"), "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    sent = None
    if terms is not None and terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        sent = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in terms.where(F.length("term") <= 256).collect()))  # MOST_TERMS of 256 bytes at most
        if terms.where(F.length("term") > 256).limit(1).count():
            sent = None
    kinds = "shard long, term binary, size long, levels binary, sizes binary, docs binary"
    return ImpactIndex(scratch.write(texts.mapInArrow(_indexed(n_docs, total, sent, "doc_id", "text"), kinds), "postings"), n_docs, total)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, *, k: int = 10, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with score above 0.

    A document's score adds up, over the item's distinct terms, the term's
    weight floor(1000 ln((2N+2)/(2df+1))) times its impact in the document (see
    ``impact``), all whole numbers. Equal scores rank by id, null ids last.

    Documents are indexed shard by shard, each term's postings in a shard by
    falling impact. Items go to the shards in blocks of at most MOST_PAIRS
    (item, term) pairs; every shard gives its own best, of which the best of
    all are kept. A hot term or source is spread over the shards.

    Null and empty texts have no terms: they count in nothing and are not found,
    and items without terms get no rows. Rows that share an item's id ask for
    all their terms as one item. Repeated documents are documents of their own.
    Other columns are ignored.
    """
    scratch = Scratch(spark, "impacts")
    kind = items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")).mapInArrow(_asked("item_id", "text"), f"item_id {kind}, term binary").distinct()
    asked = scratch.write(asked, "asked")
    index = build_index(spark, docs, scratch, terms=asked.select("term").distinct(), id_col=id_col, text_col=text_col)
    df = index.postings.where(F.length("term") > 0).groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    names = asked.select("item_id").distinct().select("item_id", F.xxhash64("item_id").alias("item"))
    weighed = asked.join(df.select("term", weight.alias("w")), "term").select(F.xxhash64("item_id").alias("item"), "term", "w")
    weighed = scratch.write(weighed, "weighed")
    blocks = max(1, -(-weighed.count() // MOST_PAIRS))
    best = None
    for b in range(blocks):  # a stated query set in blocks; one block for up to some thousand items
        by_item: dict[int, list] = {}
        for r in weighed.where(F.pmod("item", F.lit(blocks)) == b).collect():
            by_item.setdefault(r["item"], []).append((bytes(r["term"]), r["w"]))
        sent = spark.sparkContext.broadcast(sorted((i, sorted(ts)) for i, ts in by_item.items()))
        found = index.postings.select("shard", "term", "levels", "sizes", "docs").groupBy("shard").applyInArrow(_searched(sent, k), "item long, doc_id long, score long")
        best = found if best is None else best.union(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.join(names, "item")
    return best.select("item_id", "rank", F.when(F.col("doc_id") < int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")
