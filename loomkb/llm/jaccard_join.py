"""Similarity self-join on word shingles by token-combination prefixes.

Tokens (64-bit shingle hashes) have one global order: those that a sample of the
documents shows as common come last, the most common ones at the very end, each
kind by hash. Any order gives the same links; this one keeps common tokens out of
the prefixes. A document with n tokens
keeps its prefix of ``missing(n) + 1 + extra(n)`` tokens, where missing(n) is
how many of its tokens a similar document may lack. Of two similar documents,
the one whose prefix ends first shares at least ``shared(n)`` prefix tokens with
the other. Tokens in fewer than RARE documents are indexed alone; frequent ones
only in combinations of two, and only for documents whose prefix holds so many
of them that no rare token need be shared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, gram_hashes, hashed_words, slices
from .components import connected_components

#: From so many documents on, a token counts as frequent.
RARE = 48
#: Prefix tokens beyond the least number, at least.
EXTRA = 24
#: Classes of frequent tokens within which combinations are made; one for short documents.
CLASSES = 16
#: Postings that one task groups, on average.
BUCKET_POSTINGS = 400_000
#: Documents of a block that is compared as a whole.
BLOCK = 400


class Rule:
    """Similarity of at least ``percent`` hundredths, and the prefix sizes that follow."""

    def __init__(self, percent: int):
        self.percent = percent

    def missing(self, n):
        """Tokens of a document of n that a similar one may lack."""
        return n - (self.percent * n + 99) // 100

    def kept(self, n):
        m = self.missing(n)
        return np.minimum(n, m + 1 + np.maximum(EXTRA, (m + 1) // 2))

    def least(self, n):
        """Prefix tokens that a document of n shares with any similar one."""
        smaller = (self.percent * n + 99) // 100
        return self.kept(smaller) - self.missing(smaller)

    def similar(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words, A-Z lower-cased.

    A text with fewer words has one token, the whole sequence; one without
    words has none.
    """
    flat, ends = hashed_words(texts, lower=True)
    grams, out = gram_hashes(flat, size), []
    for at, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = end - at
        if n < size:
            out.append(gram_hashes(flat[at:end], n) ^ np.uint64(n) if n else np.zeros(0, np.uint64))
        else:
            own = np.sort(grams[at : end - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
    return out


#: One document of so many is counted for the order, and from so many of these on a token is of the next kind; three kinds at most.
ORDER_SAMPLE, ORDER_KINDS = 16, (3, 12, 48)
#: Highest places of a token's number in the order, which hold its kind.
KIND_BITS = 2


def _sampled_tokens(text_col: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = shingle_sets(part.column(text_col), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    return run


def common_tokens(narrow: DataFrame, scratch: Scratch, size: int, text_col: str) -> np.ndarray:
    """For each kind the bits of tokens (their highest binary places) that are so common in a sample of the distinct texts.

    This only orders tokens: a common one that is not found, or another one
    with its bit, costs time and changes no result. At most FILTERED tokens go
    in, the most common ones.
    """
    texts = narrow.where(F.pmod(F.xxhash64(text_col), F.lit(ORDER_SAMPLE)) == 0).where(F.col(text_col).isNotNull())
    tokens = texts.select(text_col).distinct().mapInArrow(_sampled_tokens(text_col, size), "token long")
    counted = scratch.write(tokens.groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") >= ORDER_KINDS[0]), "common")
    scale = 1
    while counted.where(F.col("times") >= scale * ORDER_KINDS[0]).count() > FILTERED:
        scale *= 2
    counted = counted.select("times", (F.shiftrightunsigned("token", TOKEN_SHIFT) + 1).alias("bit"))
    bits = np.stack([_filter_of(counted.where(F.col("times") >= scale * least)) for least in ORDER_KINDS])
    scratch.drop("common")
    return bits


def in_order(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sorted tokens as numbers in the global order, whose highest places are the kind; ``bits`` has a row for each kind but the first."""
    at = (tokens >> np.uint64(TOKEN_SHIFT)).astype(np.int64)
    kind, within = np.zeros(len(tokens), np.uint64), np.arange(len(tokens))
    for row in bits:
        within = within[(row[at[within] >> 3] >> (at[within] & 7).astype(np.uint8) & 1).astype(bool)]
        kind[within] += np.uint64(1)
    return np.sort(tokens >> np.uint64(KIND_BITS) | kind << np.uint64(64 - KIND_BITS))


def _scan(id_col: str, text_col: str, size: int, rule: Rule, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                sets = shingle_sets(part.column(text_col), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_col).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets], pa.binary()),
                        pa.array([in_order(s, common.value)[: int(rule.kept(len(s)))].tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "kept"],
                )

    return run


#: Bits of a filter (of documents whose whole sets are asked for, or of common tokens), and the most rows that go into it.
FILTER_BITS, FILTERED = 1 << 26, 1 << 24
BUCKET_BITS = 1 << 15
#: A token without its places beyond the highest ones is its bit.
TOKEN_SHIFT = 64 - (FILTER_BITS.bit_length() - 1)


def _bit() -> F.Column:
    return F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)) + 1


def _filter_of(rows: DataFrame) -> np.ndarray:
    """The bits of ``rows`` (bit, from 1), FILTER_BITS / 8 bytes whatever their number."""
    parts = rows.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((FILTER_BITS // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
    for k, bits in parts.collect():
        out[k - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _sets(size: int, text_col: str, bits_of=None):
    """Whole sets (doc, tokens); of rows whose bit is in the filter, where there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits_of is not None:
                at = batch.column("bit").to_numpy() - 1
                batch = batch.filter(pa.array((bits_of.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch, text_col):
                sets = shingle_sets(part.column(text_col), size)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "tokens"])

    return run


def whole_sets(narrow: DataFrame, needed: DataFrame, size: int, text_col: str) -> DataFrame:
    """(doc, tokens) of at least the documents ``needed`` (doc); ``narrow`` is (doc, text).

    The texts stay where they are read: a filter of fixed size tells which are
    asked for, with some that only share a bit. More than FILTERED documents,
    which would fill it, are joined to the texts instead.
    """
    narrow = narrow.where("doc IS NOT NULL")
    if needed.count() > FILTERED:
        return narrow.join(needed, "doc", "left_semi").mapInArrow(_sets(size, text_col), "doc long, tokens binary")
    bits_of = narrow.sparkSession.sparkContext.broadcast(_filter_of(needed.select(_bit().alias("bit"))))
    return narrow.withColumn("bit", _bit()).mapInArrow(_sets(size, text_col, bits_of), "doc long, tokens binary")


def _having(bits_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy() - 1
            yield batch.filter(pa.array((bits_of.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).select(["doc", "tokens"])

    return run


def only(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``sets`` (doc, tokens) of at least the documents ``docs`` (doc), so that a join does not move the others."""
    bits_of = sets.sparkSession.sparkContext.broadcast(_filter_of(docs.select(_bit().alias("bit"))))
    return sets.withColumn("bit", _bit()).mapInArrow(_having(bits_of), "doc long, tokens binary")


def _postings(buckets: int, rare: int, most: int = 400_000):
    """Rows (bucket, known, tokens, docs, sizes, places) of a task's prefix tokens, sorted by token within a bucket.

    A posting carries its document's number of tokens and the token's place
    among them. A token that is frequent in this chunk alone is known to be
    frequent: its documents travel apart, dealt over all buckets (known), and
    its own bucket gets only a mark, a posting of size 0.
    """

    def rows(tokens: np.ndarray, facts: np.ndarray, salt: int):
        order = np.argsort(tokens, kind="stable")
        tokens, facts = tokens[order], facts[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        sizes = np.diff(np.r_[first, len(tokens)])
        hot = np.repeat(sizes >= rare, sizes)
        marks = tokens[first[sizes >= rare]]
        mark = np.zeros(len(marks), FACTS)
        mark["doc"] = -1
        plain = np.concatenate([tokens[~hot], marks]), np.concatenate([facts[~hot], np.zeros(len(marks), FACTS)])
        for known, (t, f), by in ((False, plain, plain[0]), (True, (tokens[hot], facts[hot]), tokens[hot] + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))):
            bucket = (by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, f, bucket = t[order], f[order], bucket[order]
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for s, e in zip(starts, [*starts[1:], len(bucket)], strict=True):
                yield int(bucket[s]), known, t[s:e].tobytes(), f["doc"][s:e].tobytes(), *[None if known else f[c][s:e].tobytes() for c in ("size", "place")]

    def batch(found):
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.bool_(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "known", "tokens", "docs", "sizes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, facts, size, salt = [], [], 0, TaskContext.get().partitionId() * 1009
        for b in batches:
            for doc, n, raw in zip(b.column("doc").to_pylist(), b.column("n").to_pylist(), b.column("kept").to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                fact = np.empty(len(own), FACTS)
                fact["doc"], fact["size"], fact["place"] = doc, n, np.arange(len(own))
                tokens.append(own)
                facts.append(fact)
                size += len(own)
                if size >= most:
                    yield batch(rows(np.concatenate(tokens), np.concatenate(facts), salt))
                    tokens, facts, size, salt = [], [], 0, salt + 1
        if size:
            yield batch(rows(np.concatenate(tokens), np.concatenate(facts), salt))

    return run


#: A posting's document, its number of tokens and the token's place among them.
FACTS = np.dtype([("doc", np.int64), ("size", np.int32), ("place", np.int32)])
#: Pairs that a task holds at once before the filters.
PAIRS = 200_000


def _possible_pairs(facts: np.ndarray, first: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents within runs of postings of one token whose sizes and places of the token allow similarity.

    Of two documents' tokens, at most the lesser number before the token, and the
    lesser number from it on, can be common.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(sizes):
        i, j = np.triu_indices(int(m), 1)
        runs = first[sizes == m]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(runs), step):
            own = facts[runs[k : k + step][:, None] + np.arange(m)]
            a, b = own[:, i].ravel(), own[:, j].ravel()
            x, y = a["size"].astype(np.int64), b["size"].astype(np.int64)
            most = np.minimum(a["place"], b["place"]) + np.minimum(x - a["place"], y - b["place"])
            fit = (100 * np.minimum(x, y) >= rule.percent * np.maximum(x, y)) & rule.similar(most, x, y) & (a["doc"] != b["doc"])
            a, b = a["doc"][fit], b["doc"][fit]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
    return np.concatenate(left), np.concatenate(right)


def _group_postings(rare: int, rule: Rule):
    """One bucket: pairs of documents that share rare tokens and may be similar (kind 0: a, b, times), and who holds frequent ones (kind 1: token, doc)."""

    def run(group: pa.Table) -> pa.Table:
        known = group.column("known").to_pylist()

        def joined(column, flag, kind):
            return np.frombuffer(b"".join(x for x, k in zip(group.column(column).to_pylist(), known, strict=True) if k == flag), kind)

        tokens = joined("tokens", False, np.uint64)
        facts = np.empty(len(tokens), FACTS)
        for name, column in (("doc", "docs"), ("size", "sizes"), ("place", "places")):
            facts[name] = joined(column, False, FACTS[name])
        order = np.argsort(tokens, kind="stable")
        tokens, facts = tokens[order], facts[order]
        a = b = times = np.zeros(0, np.int64)
        ft, fd = [joined("tokens", True, np.uint64)], [joined("docs", True, np.int64)]
        if len(tokens):
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            sizes = np.diff(np.r_[first, len(tokens)])
            marked = np.minimum.reduceat(facts["size"], first) == 0
            hot = marked | (sizes >= rare)
            rows = np.repeat(hot, sizes) & (facts["size"] > 0)
            ft.append(tokens[rows])
            fd.append(facts["doc"][rows])
            some = ~hot & (sizes > 1)
            a, b = _possible_pairs(facts, first[some], sizes[some], rule)
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                times = np.diff(np.r_[new, len(a)])
                a, b = a[new], b[new]
        ft, fd = np.concatenate(ft).view(np.int64), np.concatenate(fd)
        return pa.table(
            {
                "kind": pa.array(np.r_[np.zeros(len(a), np.int32), np.ones(len(ft), np.int32)]),
                "a": pa.array(np.r_[a, ft]),
                "b": pa.array(np.r_[b, fd]),
                "times": pa.array(np.r_[times, np.zeros(len(ft), np.int64)]),
            }
        )

    return run


def _combinations(rule: Rule, short: int):
    """Rows (sig, doc): combinations of two frequent tokens of one class, over the least prefix that must hold one."""

    def combos(tokens: np.ndarray, n: int, classes: int) -> np.ndarray:
        need = int(rule.missing(n)) + classes + 1
        own = tokens[:need]
        cls = (own >> np.uint64(7)) % np.uint64(classes)
        out = []
        for c in np.unique(cls):
            t = own[cls == c]
            x, y = np.triu_indices(len(t), 1)
            out.append(gram_hashes_of(t[x], t[y]) + np.uint64(classes))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, n, held in zip(b.column("doc").to_pylist(), b.column("n").to_pylist(), b.column("held").to_pylist(), strict=True):
                tokens = np.sort(np.array(held, np.int64).view(np.uint64))
                parts = []
                if n >= short:
                    parts.append(combos(tokens, n, CLASSES))
                if rule.percent * n <= 100 * short:
                    parts.append(combos(tokens, n, 1))
                own = np.unique(np.concatenate(parts))
                sigs.append(own)
                docs.append(np.full(len(own), doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(docs))], names=["sig", "doc"])

    return run


def gram_hashes_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash for each pair of tokens."""
    from .common import mix

    return mix(mix(x) * np.uint64(0x9E3779B97F4A7C15) + y)


def _verified(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                keep.append(rule.similar(int((both[1:] == both[:-1]).sum()), len(s), len(t)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["u", "v"])

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every document of one block with every one of another, by a product of incidence matrices."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    common = np.zeros((len(left), len(right)), np.float32)

    def incidence(sets, tokens):
        m = np.zeros((len(sets), len(tokens)), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(tokens, s)
            at[at == len(tokens)] = 0
            m[k, at[tokens[at] == s]] = 1
        return m

    for k in range(0, len(shared), 8192):
        part = shared[k : k + 8192]
        common += incidence(left, part) @ incidence(right, part).T
    return common.astype(np.int64)


def _block_links(rule: Rule):
    """Links of one block pair that join different components, at most one fewer than there are documents."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sides = [frame[frame["side"] == s] for s in (0, 1)]
        if not len(sides[1]):  # a block with itself
            sides[1] = sides[0]
        out: list[tuple[int, int]] = []
        if len(sides[0]) and len(sides[1]):
            sets = [[np.frombuffer(x, np.uint64) for x in s["tokens"]] for s in sides]
            size = [np.array([len(x) for x in s]) for s in sets]
            common = _overlaps(*sets)
            hit = rule.similar(common, size[0][:, None], size[1][None, :])
            ids, comps = [s["doc"].to_numpy() for s in sides], [s["comp"].to_numpy() for s in sides]
            hit &= comps[0][:, None] != comps[1][None, :]
            for i, j in zip(*np.nonzero(hit), strict=True):
                x, y = find(comps[0][i]), find(comps[1][j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(ids[0][i]), int(ids[1][j])))
        return pd.DataFrame({"u": pd.Series([x for x, _ in out], dtype="int64"), "v": pd.Series([y for _, y in out], dtype="int64")})

    return run


def shingle_components(
    spark: SparkSession, docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when the Jaccard similarity of their sets of ``size``-word
    shingles is at least ``percent`` hundredths; a component is named by its
    smallest id. Documents with equal sets are one class, which its smallest id
    represents. Pairs that share enough rare prefix tokens are verified on whole
    sets. Documents dominated by frequent tokens meet in the buckets of their
    combinations, each with a pivot. Each document is verified against its most
    likely partner first; pairs and bucket members that this leaves in
    different components are compared too, the latter in blocks, so that a
    large group of copies costs in proportion to its size and no pair is lost.

    Null, empty and word-less texts have no shingles and are linked with
    nothing. A null id keeps its row and links with nothing. Rows repeated with
    their id fall in one class; an id with several texts links by
    each of them. Other columns are ignored. ``percent`` must be over 50: below, documents may
    be similar that share one shingle alone, and such have no combinations.
    """
    if not 50 < percent <= 100:
        raise ValueError("similar documents must share more than half of their shingles: percent from 51 to 100")
    rule, scratch = Rule(percent), Scratch(spark, "jaccard-join")
    short = 1
    while int(rule.least(short)) <= CLASSES:
        short += 1
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    common = spark.sparkContext.broadcast(common_tokens(narrow, scratch, size, text_col))
    scanned = scratch.write(narrow.mapInArrow(_scan(id_col, text_col, size, rule, common), "doc_id long, n long, digest binary, kept binary"), "scanned")
    total = scanned.agg(F.sum(F.octet_length("kept")) / 8).first()[0] or 0
    firsts = scanned.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "kept")).alias("s"))
    reps = scratch.write(firsts.select("digest", F.col("s.doc_id").alias("doc"), "s.n", "s.kept"), "reps")
    rows = scratch.write(scanned.select("doc_id", "n", "digest"), "rows")
    scratch.drop("scanned")

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_POSTINGS))
    # a document of one token is similar to its equals alone, which are one class
    posted = reps.where("n > 1").select("doc", "n", "kept").mapInArrow(_postings(buckets, rare), "bucket long, known boolean, tokens binary, docs binary, sizes binary, places binary")
    grouped = scratch.write(posted.groupBy("bucket").applyInArrow(_group_postings(rare, rule), "kind int, a long, b long, times long"), "grouped")
    classes = scratch.write(reps.select("digest", "doc", "n"), "classes")
    scratch.drop("reps")

    held = grouped.where("kind = 1").groupBy(F.col("b").alias("doc")).agg(F.collect_set("a").alias("held"))
    held = scratch.write(held.join(classes.select("doc", "n"), "doc"), "held")
    pairs = grouped.where("kind = 0").groupBy("a", "b").agg(F.sum("times").alias("times"))
    facts = classes.join(held.select("doc", F.size("held").alias("often")), "doc", "left").select("doc", "n", F.coalesce("often", F.lit(0)).alias("often"))
    least = _least_column(rule, F.least("na", "nb"))
    pairs = pairs.join(facts.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("often").alias("oa")), "a")
    pairs = pairs.join(facts.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("often").alias("ob")), "b")
    pairs = pairs.withColumn("common", F.col("times") + F.least("oa", "ob")).where(F.col("common") >= least)
    pairs = scratch.write(pairs.select("a", "b", "common"), "pairs")
    scratch.drop("grouped")

    heavy = held.where(F.size("held") >= _least_column(rule, F.col("n")))
    members = scratch.write(heavy.select("doc", "n", "held").mapInArrow(_combinations(rule, short), "sig long, doc long"), "members")
    weighed = members.join(heavy.select("doc", (F.col("n") - F.size("held")).alias("own")), "doc")
    pivots = weighed.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("own", "doc"))["doc"].alias("pivot")).where("m > 1")
    around = scratch.write(members.join(pivots, "sig").groupBy("pivot", "doc").agg(F.count("*").alias("common")), "around")
    scratch.drop("members", "held")

    # one likely partner for each document first; what that connects needs no further comparison
    nearest = pairs.union(around.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "common"))
    nearest = nearest.groupBy("b").agg(F.max(F.struct("common", "a"))["a"].alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nearest = scratch.write(nearest.distinct(), "nearest")
    needed = scratch.write(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(around.select("doc")).distinct(), "needed")
    sets = scratch.write(whole_sets(narrow.withColumnRenamed(id_col, "doc") if id_col != "doc" else narrow, needed, size, text_col), "sets")
    links = scratch.write(_verify(nearest, sets, rule), "links")
    first = scratch.write(connected_components(links, scratch, "cc"), "first")

    comp = lambda df, c, name: df.join(first.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    rest = comp(comp(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    rest = scratch.write(rest, "rest")
    asked = only(sets, rest.select(F.col("a").alias("doc")).union(rest.select("b")))
    more = scratch.write(_verify(rest, asked, rule), "more")
    scratch.drop("pairs", "nearest", "rest")
    placed = scratch.write(comp(comp(around.select("pivot", "doc"), "doc", "comp"), "pivot", "main"), "placed")
    open_groups = placed.groupBy("pivot").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("pivot")
    unlinked = scratch.write(placed.join(open_groups, "pivot"), "unlinked")
    across = scratch.write(_cross(unlinked, only(sets, unlinked.select("doc")), rule), "across")
    scratch.drop("around", "placed", "unlinked", "sets")
    final = connected_components(links.union(more).union(across), scratch, "cc2")

    named = classes.join(final, classes["doc"] == final["node"], "left").select("digest", F.coalesce("component", "doc").alias("component_id"))
    out = rows.join(named, "digest", "left")
    lone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _least_column(rule: Rule, n):
    """``Rule.least`` as a column expression."""
    smaller = F.ceil(rule.percent * n / 100)
    missing = smaller - F.ceil(rule.percent * smaller / 100)
    kept = F.least(smaller, missing + 1 + F.greatest(F.lit(EXTRA), F.floor((missing + 1) / 2)))
    return kept - missing


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    x = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(rule), "u long, v long")


def _cross(placed: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between documents that share a pivot and whose components differ.

    Buckets with one pivot are taken together, as copies of one text share many.
    Documents outside the pivot's component meet each block of the others;
    those within it are not compared with each other.
    """
    rows = placed.select("pivot", "doc", "comp", (F.col("comp") != F.col("main")).alias("outer"))
    sizes = rows.groupBy("pivot").agg(F.count_if("outer").alias("outers"), F.count_if(~F.col("outer")).alias("inners"))
    rows = rows.join(sizes, "pivot")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    rows = rows.withColumn("nb", blocks("outers")).withColumn("ni", blocks("inners"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.when(F.col("outer"), F.col("nb")).otherwise(F.col("ni"))).cast("int"))
    # (i, j): outer block i with outer block j for j < nb, with inner block j - nb from there on
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_left = F.transform(every(F.col("nb") + F.col("ni")), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_left = F.filter(as_left, lambda s: s["j"] >= F.col("own"))
    as_right = F.filter(F.transform(every(F.col("nb")), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))), lambda s: s["i"] < F.col("own"))
    inner = F.transform(every(F.col("nb")), lambda i: F.struct(i.alias("i"), (F.col("nb") + F.col("own")).alias("j"), F.lit(1).alias("side")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("outer"), F.concat(as_left, as_right)).otherwise(inner)))
    rows = rows.select("pivot", "doc", "comp", "at.i", "at.j", "at.side").join(sets, "doc")
    return rows.groupBy("pivot", "i", "j").applyInPandas(_block_links(rule), "u long, v long")
