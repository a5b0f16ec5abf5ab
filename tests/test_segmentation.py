"""Segmentation against all ways to cut and to tag short texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomkb.functions import segmentation as seg
from loomkb.operators import bm25

WORDS = [("账号", 40), ("冻结", 30), ("处理", 50), ("流程", 45), ("处", 9), ("理", 3), ("冻", 1), ("处理流程", 2), ("号", 5), ("研究", 20), ("研究生", 8), ("生命", 12), ("命", 2), ("生", 4)]


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([*WORDS, (None, 3), ("", 4), ("零", 0)], "word string, count long").cache()


@pytest.fixture(scope="module")
def lattice(dictionary):
    return seg.Lattice([tuple(r) for r in seg.word_costs(dictionary).collect()], [tuple(r) for r in seg.fit_tags(dictionary).collect()])


def cuts(text):
    for marks in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
        ends = [k + 1 for k, m in enumerate(marks) if m] + [len(text)]
        yield [text[a:b] for a, b in zip([0, *ends], ends)]


def texts(n, length, seed):
    rng = random.Random(seed)
    letters = "".join(w for w, _ in WORDS) + "新字眼"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, length))) for _ in range(n)]


def test_path_is_the_cheapest_of_all_cuts(lattice):
    known = {w: c for w, c in lattice.words.items() if c is not None}

    def cost(words):
        each = [known.get(w, lattice.unknown if len(w) == 1 else None) for w in words]
        return None if None in each else sum(each)

    for text in [*texts(150, 10, 1), "账号冻结处理流程", "研究生命"]:
        ways = [(cost(w), [-len(x) for x in w], w) for w in cuts(text) if cost(w) is not None]
        assert lattice.path(text) == min(ways)[2]


def test_tags_are_the_cheapest_of_all_tags(lattice):
    tags = lattice.tags

    def cost(words, text):
        marks = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
        total = tags["start", marks[0], ""] + sum(tags["move", a, b] for a, b in zip(marks, marks[1:]))
        return total + sum(tags.get(("emit", m, c), tags["other", m, ""]) for m, c in zip(marks, text))

    for text in texts(100, 8, 2):
        assert cost(lattice.tagged(text), text) == min(cost(w, text) for w in cuts(text))


def test_tag_shares_add_up(spark, dictionary):
    from math import exp

    rows = [tuple(r) for r in seg.fit_tags(dictionary).collect()]
    share = lambda kind, tag: sum(exp(-c / seg.UNIT) for k, t, _, c in rows if k == kind and t == tag)
    assert abs(share("start", "B") + share("start", "S") - 1) < 1e-5
    for tag in "BMES":
        assert abs(share("move", tag) - 1) < 1e-5
    size = len({c for w, _ in WORDS for c in w})
    for tag in "BES":  # unseen characters take what the seen ones leave
        unseen = size - sum(1 for k, t, *_ in rows if (k, t) == ("emit", tag))
        assert abs(share("emit", tag) + (unseen + 1) * share("other", tag) - 1) < 1e-4


def test_tokenizer_mixes_scripts_and_keeps_nulls(spark, dictionary):
    cut = seg.segmenter(dictionary, seg.fit_tags(dictionary))
    rows = ["账号冻结处理流程", "VPN 账号冻结 a b2 retry", "plain English only", None, "", "！？", "账号" * 20000]
    frame = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    found = {r["id"]: r["w"] for r in frame.select("id", cut(F.col("text")).alias("w")).collect()}
    assert found[0] == ["账号", "冻结", "处理", "流程"]
    assert found[1] == ["vpn", "账号", "冻结", "b2", "retry"]
    assert found[2] == ["plain", "english", "only"]
    assert found[3] is None and found[4] == [] and found[5] == [] and found[6] == ["账号"] * 20000


def test_no_dictionary_words_and_too_many(spark, dictionary):
    empty = dictionary.where("false")
    cut = seg.segmenter(empty)
    assert spark.range(1).select(cut(F.lit("账号")).alias("w")).first()["w"] == ["账", "号"]
    assert spark.range(1).select(seg.segmenter(empty, seg.fit_tags(empty))(F.lit("账号")).alias("w")).first()["w"]
    with pytest.raises(ValueError):
        seg.segmenter(dictionary, most_chars=10)


def test_keyword_search_by_words(spark, dictionary):
    cut = seg.segmenter(dictionary)
    chunks = spark.createDataFrame([(1, 1, "账号冻结处理流程"), (1, 2, "号账结冻"), (1, 3, "研究生命")], "kb_id long, chunk_id long, content string")
    queries = spark.createDataFrame([(1, 1, "冻结账号")], "query_id long, kb_id long, query string")
    hits = bm25.retrieve(bm25.build_index(chunks, cut), chunks, queries, tokenizer=cut).collect()
    assert [r["chunk_id"] for r in hits] == [1]
