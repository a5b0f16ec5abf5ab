"""Words of texts written without spaces: the cheapest path through a dictionary's words, and tags of characters for what it lacks.

Costs are whole millionths of a natural logarithm, so that sums and ties are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import HAN, tokens

#: Most characters that a dictionary's words have together; it is sent to all executors.
DICTIONARY_CHARS = 2_000_000
UNIT = 1_000_000
#: Which tag may follow which: a word's begin, middle and end, and a word of one character.
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def _cost(part: Column, whole: Column) -> Column:
    return F.round(F.log(whole.cast("double") / part) * UNIT).cast("long")


def word_costs(words: DataFrame) -> DataFrame:
    """(word, cost) of a dictionary (word, count): -ln of a word's share; the empty word's cost is that of an unknown character.

    Counts of repeated words are added; null and empty words and counts that are
    not positive are left out. An unknown character counts as one occurrence.
    """
    known = words.where("word <> '' AND count > 0").groupBy("word").agg(F.sum("count").alias("count"))
    total = known.agg(F.sum("count").alias("total"))
    costs = known.crossJoin(F.broadcast(total)).select("word", _cost(F.col("count"), F.col("total")).alias("cost"))
    return costs.union(total.select(F.lit(""), F.coalesce(_cost(F.lit(1), F.col("total")), F.lit(0))))


def fit_tags(words: DataFrame) -> DataFrame:
    """(kind, tag, value, cost) of a tagger of characters, from a dictionary (word, count).

    Kinds: ``start`` (a text's first tag), ``move`` (from a tag to the tag in
    ``value``), ``emit`` (a tag's character) and ``other`` (its unseen
    characters). Within words, moves are counted; after a word the next one
    begins as words do on average. One is added to every count.
    """
    known = words.where("word <> '' AND count > 0").select("word", "count", F.char_length("word").alias("n"))
    of = lambda when, value=F.col("count"): F.coalesce(F.sum(F.when(when, value)), F.lit(0)) + 1
    n = F.col("n")
    sums = known.agg(
        of(n > 1).alias("many"),
        of(n == 1).alias("one"),
        of(n == 2).alias("BE"),
        of(n > 2).alias("BM"),
        of(n > 2).alias("ME"),
        of(n > 3, F.col("count") * (n - 3)).alias("MM"),
    )
    row = lambda kind, tag, value, part, other: F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), F.lit(value).alias("value"), _cost(F.col(part), F.col(part) + F.col(other)).alias("cost"))
    rows = [row("start", "B", "", "many", "one"), row("start", "S", "", "one", "many")]
    rows += [row("move", tag, to, part, other) for tag in "ES" for to, part, other in (("B", "many", "one"), ("S", "one", "many"))]
    rows += [row("move", "B", "E", "BE", "BM"), row("move", "B", "M", "BM", "BE"), row("move", "M", "E", "ME", "MM"), row("move", "M", "M", "MM", "ME")]
    shape = sums.select(F.inline(F.array(*rows)))

    placed = known.select("count", "n", F.posexplode(F.split("word", "(?!^)(?!$)")).alias("at", "value"))
    tag = F.when(n == 1, "S").when(F.col("at") == 0, "B").when(F.col("at") == n - 1, "E").otherwise("M")
    seen = placed.groupBy(tag.alias("tag"), "value").agg((F.sum("count") + 1).alias("c"))
    size = placed.agg(F.countDistinct("value").alias("size"))
    whole = seen.groupBy("tag").agg(F.sum(F.col("c") - 1).alias("sum")).crossJoin(F.broadcast(size)).select("tag", (F.col("sum") + F.col("size") + 1).alias("whole"))
    emit = seen.join(F.broadcast(whole), "tag").select(F.lit("emit"), "tag", "value", _cost(F.col("c"), F.col("whole")))
    return shape.union(emit).union(whole.select(F.lit("other"), "tag", F.lit(""), _cost(F.lit(1), F.col("whole"))))


class Lattice:
    """A dictionary's words and all their beginnings (cost None), and a tagger's costs; what a task segments with."""

    def __init__(self, words: list[tuple[str, int]], tags: list[tuple[str, str, str, int]]):
        self.words: dict[str, int | None] = {}
        for word, cost in words:
            for k in range(1, len(word)):
                self.words.setdefault(word[:k])
            self.words[word] = cost
        self.unknown = self.words.pop("", 0)
        self.tags = {(kind, tag, value): cost for kind, tag, value, cost in tags}

    def path(self, run: str) -> list[str]:
        """Dictionary words and unknown characters of least cost; of equally cheap paths, the longest first word."""
        n = len(run)
        best, ends = [0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            low, end = None, i + 1
            for j in range(i + 1, n + 1):
                piece = run[i:j]
                if piece not in self.words:
                    break
                cost = self.words[piece]
                if cost is not None and (low is None or cost + best[j] <= low):
                    low, end = cost + best[j], j
            if self.words.get(run[i]) is None and (low is None or self.unknown + best[i + 1] < low):
                low, end = self.unknown + best[i + 1], i + 1
            best[i], ends[i] = low, end
        out, at = [], 0
        while at < n:
            out.append(run[at : ends[at]])
            at = ends[at]
        return out

    def tagged(self, run: str) -> list[str]:
        """The words of the cheapest tags of all characters."""

        def emit(tag, char):
            return self.tags.get(("emit", tag, char), self.tags.get(("other", tag, ""), self.unknown))

        now = {t: self.tags["start", t, ""] + emit(t, run[0]) for t in "BS"}
        came: list[dict[str, str]] = []
        for char in run[1:]:
            ways: dict[str, tuple[int, str]] = {}
            for tag, cost in now.items():
                for to in FOLLOWS[tag]:
                    way = (cost + self.tags["move", tag, to], tag)
                    ways[to] = min(ways.get(to, way), way)
            came.append({to: tag for to, (_, tag) in ways.items()})
            now = {to: cost + emit(to, char) for to, (cost, _) in ways.items()}
        tag = min((now[t], t) for t in "ES" if t in now)[1]
        marks = [tag]
        for step in reversed(came):
            tag = step[tag]
            marks.append(tag)
        out, word = [], ""
        for char, mark in zip(run, reversed(marks), strict=True):
            word += char
            if mark in "ES":
                out.append(word)
                word = ""
        return out

    def segment(self, run: str) -> list[str]:
        """``path``, with characters in a row that are together no word of the dictionary taken by ``tagged``."""
        out: list[str] = []
        single: list[str] = []

        def close():
            whole = "".join(single)
            out.extend(self.tagged(whole) if len(single) > 1 and self.tags and self.words.get(whole) is None else single)
            single.clear()

        for word in self.path(run):
            if len(word) == 1:
                single.append(word)
            else:
                close()
                out.append(word)
        close()
        return out


def segmenter(dictionary: DataFrame, tags: DataFrame | None = None, *, letters: str = HAN, least_bytes: int = 2, most_chars: int = DICTIONARY_CHARS) -> Callable[[Column], Column]:
    """A tokenizer of text columns: runs of ``letters`` (a character class) by a dictionary (word, count), the rest as in ``tokens``.

    ``tags`` (as from ``fit_tags``) tells the words of what the dictionary lacks;
    without it such characters are words by themselves. Texts are lower-cased,
    words of fewer than ``least_bytes`` bytes are left out (of two in texts without
    ``letters``, which never reach Python). Null stays null, and an empty text has no words. The dictionary goes
    to all executors; more than ``most_chars`` characters are an error, as are more
    tagged characters. A run takes time in proportion to its length and the longest word.
    """
    chars = dictionary.agg(F.sum(F.char_length("word"))).first()[0] or 0
    rows = tags.count() if tags is not None else 0
    if chars > most_chars or rows > most_chars:
        raise ValueError(f"a dictionary of {chars} characters and {rows} tag rows, over {most_chars}")
    lattice = Lattice([tuple(r) for r in word_costs(dictionary).collect()], [tuple(r) for r in tags.collect()] if tags is not None else [])
    held = dictionary.sparkSession.sparkContext.broadcast(lattice)
    pieces = rf"(?<run>{letters}+)|(?:(?!{letters})[\p{{L}}\p{{N}}])+"

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find, segment = regex.compile(pieces).finditer, held.value.segment

        def words(text):
            if text is None:
                return None
            found = (w for m in find(text) for w in (segment(m[0]) if m["run"] else (m[0],)))
            return [w for w in found if len(w.encode()) >= least_bytes]

        for batch in batches:
            yield batch.map(words)

    def tokenizer(text: Column) -> Column:
        text = F.lower(text)
        has = text.rlike(letters)
        return F.when(has, cut(F.when(has, text))).otherwise(tokens(text))

    return tokenizer


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """(word, count) of the ``most`` most frequent of ``words`` (word), ties to the lesser word."""
    return words.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(most)
