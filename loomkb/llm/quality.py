"""Quality scores: random-indexing word vectors, pooled by document, and a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HELD, slices

#: Rows of the word table (words are hashed to them), components of a vector and non-zero ones of an index vector.
ROWS, DIM, NONZERO = 1 << 13, 64, 4
#: Neighbours on each side that make a word's context.
REACH = 2
#: Hidden units, passes over the sample, and most labelled rows that are fitted (the smallest by hash of the id).
HIDDEN, EPOCHS, SAMPLE = 32, 60, 20_000
SEED = 2
#: Words, numbers and runs of other characters are tokens of their own.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    """How a token is written: its case, or its first character and length."""
    if token[0].isalpha():
        return "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return f"{token[0]}{min(len(token), 3)}"


class TokenRows:
    """Table rows of a text's tokens and of their marks: how each is written, and whether it repeats one of the two before it.

    Tokens met lately are cached, at most ``most`` of them and of as many characters times 16.
    """

    def __init__(self, most: int = 300_000):
        self.cache: dict[str, int] = {}
        self.most, self.room = most, 16 * most

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens, cache = TOKEN.findall(text), self.cache
        if len(cache) > self.most or self.room < 0:
            cache.clear()
            self.room = 16 * self.most
        for t in set(tokens).difference(cache):
            cache[t] = zlib.crc32(t.encode()) % ROWS * ROWS + zlib.crc32(shape(t).encode()) % (ROWS // 2) * 2
            self.room -= len(t)
        both = np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
        rows, marks = both // ROWS, both % ROWS
        for step in (1, 2):
            marks[step:] |= rows[step:] == rows[:-step]
        return rows, marks


def _rows_of() -> TokenRows:
    """Token rows kept from task to task in a Python worker."""
    return HELD.of("quality", "rows", TokenRows)


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each table row's few non-zero components."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1], np.int64), (ROWS, NONZERO))


def _contexts(text_col: str):
    """Sums of the neighbours' index vectors by word, and word counts: one row for each part of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, counts = np.zeros((ROWS, DIM), np.float64), np.zeros(ROWS, np.int64)

        def add(rows: np.ndarray):
            nonlocal total, counts
            counts += np.bincount(rows[rows >= 0], minlength=ROWS)
            pairs = np.zeros(0, np.int64)
            for step in range(1, REACH + 1):
                a, b = rows[:-step], rows[step:]
                both = (a >= 0) & (b >= 0)
                pairs = np.concatenate([pairs, a[both] * ROWS + b[both], b[both] * ROWS + a[both]])
            pairs, times = np.unique(pairs, return_counts=True)
            word, other = pairs // ROWS, pairs % ROWS
            for k in range(NONZERO):
                total += np.bincount(word * DIM + places[other, k], weights=signs[other, k] * times, minlength=ROWS * DIM).reshape(ROWS, DIM)

        gap = np.full(REACH, -1, np.int64)
        held, size = [], 0
        for whole in batches:
            for part in slices(whole, text_col):
                for t in part.column(text_col).to_pylist():
                    if t:
                        own, _ = _rows_of()(t)
                        held += [own, gap]  # no context across texts
                        size += len(own)
                if size > 250_000:
                    add(np.concatenate(held))
                    held, size = [], 0
        if held:
            add(np.concatenate(held))
        step = 256
        parts = range(0, ROWS, step)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p // step for p in parts], pa.int32()), pa.array([total[p : p + step].astype(np.float32).tobytes() for p in parts], pa.binary()), pa.array([counts[p : p + step].tobytes() for p in parts], pa.binary())],
            names=["part", "sums", "counts"],
        )

    return run


def _summed(group: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group.column("sums").to_pylist())
    counts = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"part": group.column("part")[:1], "sums": pa.array([sums.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word table (ROWS x DIM, rows of unit length) over every text of ``docs``.

    Tasks add up their own contexts in a table of fixed size before they send it, so the shuffle is one table a task.
    A word's own index vector is added to its context, each scaled to the same length.
    """
    parts = docs.select(text_col).mapInArrow(_contexts(text_col), "part int, sums binary, counts binary")
    found = parts.groupBy("part").applyInArrow(_summed, "part int, sums binary, counts binary").collect()  # 4 MB, whatever the corpus
    table = np.zeros((ROWS, DIM))
    for part, sums, _ in found:
        own = np.frombuffer(bytes(sums), np.float64).reshape(-1, DIM)
        table[part * len(own) : (part + 1) * len(own)] = own
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return unit(unit(table) + unit(index_table())).astype(np.float32)


def index_table() -> np.ndarray:
    """The index vectors as rows of unit length."""
    places, signs = index_vectors()
    base = np.zeros((ROWS, DIM), np.float32)
    np.put_along_axis(base, places, signs.astype(np.float32) / np.sqrt(NONZERO), axis=1)
    return base


#: Components of a text's pooled vector: words, distinct words, marks, and the length of the first mean.
POOLED = 3 * DIM + 1


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Means of each text's word vectors over its words and over its distinct words, of its marks' index vectors, and the length of the first; zero for a text without tokens."""
    out, base = np.zeros((len(texts), POOLED), np.float32), HELD.of("quality", "index", index_table)
    for k, t in enumerate(texts):
        rows, marks = _rows_of()(t) if t else ((), ())
        if len(rows):
            met, times = np.unique(rows, return_counts=True)
            own = table[met]
            mean = times.astype(np.float32) @ own / len(rows)
            seen, often = np.unique(marks, return_counts=True)
            out[k] = np.concatenate([mean, own.mean(axis=0), often.astype(np.float32) @ base[seen] / len(rows), [np.linalg.norm(mean)]])
    return out


def _features(table_of, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text_col):
                x = pooled(part.column(text_col).to_pylist(), table_of.value)
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


class Network:
    """tanh hidden layer, one logit, divided by a temperature that is calibrated on rows held back from the fit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        self.shift, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(dim), np.ones(dim))
        self.w1, self.b1 = rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        self.temperature = 1.0
        if not len(y):
            self.w2[:] = 0
        elif y.min() == y.max():  # one label alone: its smoothed share
            self.w2[:] = 0
            self.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        else:
            order = rng.permutation(len(y))
            held = order[: len(y) // 5]
            self._fit(x[order[len(held) :]], y[order[len(held) :]], rng)
            self._calibrate(x[held], y[held])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def _fit(self, x: np.ndarray, y: np.ndarray, rng) -> None:
        """Adam on the cross-entropy; both labels weigh the same, weights decay a little."""
        x = (x - self.shift) / self.scale
        share = y.mean()
        weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 128):
                own = order[at : at + 128]
                h = np.tanh(x[own] @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
                d = (p - y[own]) * weight[own] / len(own)
                back = d[:, None] * params[2] * (1 - h * h)
                grads = [x[own].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    params[k] -= 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of a fixed grid with the least cross-entropy on held-back rows."""
        if not len(y):
            return
        z, grid = self.logits(x), np.exp(np.linspace(np.log(0.5), np.log(20), 121))
        loss = [np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def _scored(model_of, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = model_of.value
        for whole in batches:
            for part in slices(whole, text_col):
                score = network.scores(pooled(part.column(text_col).to_pylist(), table))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``sample`` labelled documents, the smallest by hash of the id; one label an id, the smallest."""
    known = labels.where(F.col(label_col).isin(0, 1)).where(F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    return known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word table over all of ``docs`` and a network fitted on a bounded sample of the labelled ones."""
    table = word_vectors(docs, text_col)
    rows = training_rows(docs, labels, id_col=id_col, label_col=label_col, sample=sample)
    rows = spark.createDataFrame(rows.toPandas().astype({"doc_id": "int64", "label": "int32"}), "doc_id long, label int")
    table_of = spark.sparkContext.broadcast(table)
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).withColumnRenamed(id_col, "doc_id")
    texts = texts.join(F.broadcast(rows), "doc_id")  # ``sample`` rows at most
    found = texts.mapInArrow(_features(table_of, "doc_id", text_col), "doc_id long, label int, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")  # of an id's texts one, whatever the tasks' order
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, POOLED).astype(np.float64) if len(found) else np.zeros((0, POOLED))
    return table, Network(x, found["label"].to_numpy(np.float64) if len(found) else np.zeros(0))


def score_quality(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, Network], *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Scores see the text alone: tokens hashed to the word table's rows, means of
    their vectors and of how they are written, the network's calibrated
    probability. Null, empty and token-less texts are scored from the zero
    vector. Other columns pass through unless they clash with the new ones;
    rows are never dropped.
    """
    model_of = spark.sparkContext.broadcast(model)
    rows = docs.select(*[c for c in docs.columns if c not in {"score", "predicted"} - {text_col}])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    out = rows.mapInArrow(_scored(model_of, text_col), ", ".join([*kept, "score double"]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

