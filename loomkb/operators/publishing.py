"""Articles published with their chunks in one commit, if no other article has their title or says the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.commits import Conflict, TableLog
from ..stored import Folder
from .sizes import broadcast_if_small
from .vectors import cosine

#: Asked vectors up to which they are sent to where the published ones are read, and scores that a task holds at once.
SENT_VECTORS, HELD_SCORES = 50_000, 4_000_000


def _near_in_task(asked_of, threshold: float):
    """(article_id, _score) of asked articles above ``threshold``: the greatest cosine of each slice of rows (kb_id, _v), by matrix products."""

    def units(column: pa.Array) -> np.ndarray:
        m = np.array(column.flatten(), np.float64).reshape(len(column), -1)
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {key: (np.array(ids, np.int64), units(pa.array(vectors, pa.list_(pa.float64())))) for key, (ids, vectors) in asked_of.value.items()}
        for b in batches:
            keys = list(zip(b.column("kb_id").to_pylist(), b.column("n").to_pylist(), strict=True))
            for key in dict.fromkeys(keys):
                if key not in asked:
                    continue
                ids, there = asked[key]
                own = b.column("_v").take(pa.array([i for i, k in enumerate(keys) if k == key]))
                step = max(1, HELD_SCORES // len(ids))
                for at in range(0, len(own), step):
                    here = units(own.slice(at, step))
                    scores = here @ there.T
                    for i, j in np.argwhere(np.abs(scores - threshold) < 1e-9):  # as one sum after the other has it
                        scores[i, j] = np.cumsum(here[i] * there[j])[-1]
                    best = np.max(scores, axis=0, initial=-2, where=~np.isnan(scores))
                    good = np.flatnonzero(best > threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(best[good])], names=["article_id", "_score"])

    return run


def nearest_published(published: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(article_id, _score) of the asked articles whose greatest cosine to a published one of their knowledge base is above ``threshold``.

    Articles without a vector, or with null components, are near nothing; vectors of different lengths do not meet.
    """
    whole = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    asked = asked.where(whole("embedding")).select("kb_id", "article_id", "embedding", F.size("embedding").alias("n"))
    published = published.where(whole("embedding")).select("kb_id", F.size("embedding").alias("n"), F.col("embedding").cast("array<double>").alias("_v"))
    if asked.limit(SENT_VECTORS + 1).count() > SENT_VECTORS:
        pairs = published.join(broadcast_if_small(asked), ["kb_id", "n"]).groupBy("article_id").agg(F.max(cosine(F.col("embedding"), F.col("_v"))).alias("_score"))
        return pairs.where(F.col("_score") > threshold)
    sent: dict = {}
    for r in asked.collect():  # SENT_VECTORS at most
        if r["kb_id"] is not None and r["n"]:
            ids, vectors = sent.setdefault((r["kb_id"], r["n"]), ([], []))
            ids.append(r["article_id"])
            vectors.append(r["embedding"])
    asked_of = published.sparkSession.sparkContext.broadcast(sent)
    near = published.where("n > 0").mapInArrow(_near_in_task(asked_of, threshold), "article_id long, _score double")
    return near.groupBy("article_id").agg(F.max("_score").alias("_score"))


def refusals(published: DataFrame, asked: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``asked`` (article_id, kb_id, title, embedding) with ``reason``: null, 'title' or 'meaning'.

    A title is taken if a published article of the knowledge base has it, or an
    asked one with a smaller id. A meaning is taken if the cosine to a published
    article of the knowledge base is above ``threshold``; each asked article
    meets its own knowledge base, and of the scores only the greatest travels.
    The scores are found once and kept; those of a cosine without a number are none.
    """
    titles = published.select("kb_id", "title", F.lit(None).cast("long").alias("article_id"), F.lit(0).alias("place")).distinct()
    titles = titles.union(asked.select("kb_id", "title", "article_id", F.lit(1))).where("title IS NOT NULL")
    first = Window.partitionBy("kb_id", "title").orderBy("place", "article_id")
    taken = titles.withColumn("n", F.row_number().over(first)).where("place = 1 AND n > 1").select("article_id", F.lit(True).alias("_title"))
    near = Folder(asked.sparkSession, "refusals").write(nearest_published(published, asked, threshold), "near")
    out = asked.join(taken, "article_id", "left").join(near, "article_id", "left")
    reason = F.when(F.col("_title"), "title").when(F.col("_score").isNotNull(), "meaning")
    return out.withColumn("reason", reason).drop("_title", "_score")


def create_and_publish(log: TableLog, asked: DataFrame, chunks: DataFrame, *, threshold: float = 0.92, tries: int = 3) -> DataFrame:
    """Publish ``asked`` (article_id, kb_id, title, embedding) with ``chunks`` (article_id, ...) in one commit; returns ``refusals``.

    Tables ``articles`` and ``chunks`` of the log. Refused articles leave nothing
    behind. If another writer publishes meanwhile, the checks run again on what
    it wrote, ``tries`` times in all; then Conflict is raised.
    """
    for left in range(tries - 1, -1, -1):
        change = log.begin()
        known = change.read("articles") if "articles" in change.before else asked.limit(0)
        change.watched.add("articles")
        judged = refusals(known, asked, threshold)
        fresh = judged.where("reason IS NULL")
        try:
            change.append("articles", fresh.select(*asked.columns))
            # the rows just written decide for the chunks and the answer, so nothing is judged twice
            written = log.spark.read.schema(asked.schema).parquet(f"{log.path}/{change.added['articles']}").select("article_id")
            change.append("chunks", chunks.join(written, "article_id", "left_semi").select(*chunks.columns))
            change.commit()
        except Conflict:
            if not left:
                raise
        except BaseException:
            change.rollback()
            raise
        else:
            return judged
    raise ValueError("tries must be positive")
