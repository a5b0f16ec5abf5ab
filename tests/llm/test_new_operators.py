"""Ranked search, the filter audit and language-model scores against plain versions."""

import itertools
import math
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import edge_texts, prose

from loomkb.llm import attention, filter_audit, impact_search, lm_scoring, queries, url_filter
from loomkb.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def corpus():
    texts = [t for _, t in edge_texts()]
    texts += [prose(n, seed) for seed, n in enumerate((5, 40, 199, 200, 201, 450))]
    texts += [texts[-1], texts[-1], "Éa aÉ b\x00c one-two", "x" * 100_000 + " tail", "SHOUT " * 260, "a|b " * 300, None, "", " \t\n"]
    return list(enumerate(texts, 1000))


def plain_search(docs, items, k):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    own = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in own:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [1 << 16, 3])
def test_search_against_brute_force(spark, monkeypatch, shard):
    docs = [*corpus(), (None, "one tail"), (7, "one two"), (7, "one two"), (3, "one two")]
    items = [(1, "One two, three!"), (2, prose(60, 3)), (3, None), (4, ""), (5, "nowhereatall"), (1, "TAIL x"), (None, "one"), (6, prose(200, 5))]
    monkeypatch.setattr(impact_search, "SHARD_DOCS", shard)
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(2)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    for k in (1, 4, 10):
        found = impact_search.search(spark, table, asked, k=k)
        assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items, k)
    assert impact_search.search(spark, table.limit(0), asked).count() == 0
    assert impact_search.search(spark, table, asked.limit(0)).count() == 0


def test_searches_stop_early_and_stay_exact():
    rng = np.random.default_rng(4)
    n = 5000
    rows, plain = {b"": (b"", b"", np.arange(n).astype("<i8").tobytes())}, np.zeros((12, n), np.int64)
    for j in range(12):
        docs = np.sort(rng.choice(n, 2500, replace=False))
        value = np.minimum(999_999, (rng.pareto(1.2, 2500) * 3000).astype(np.int64) + 1)
        plain[j, docs] = value
        order = np.lexsort((docs, -value))
        levels, sizes = np.unique(-value, return_counts=True)
        rows[b"%d" % j] = ((-levels).astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), docs[order].astype("<u4").tobytes())
    shard = impact_search.Shard(rows)
    for width in (1, 2, 5, 12):
        asked = [(b"%d" % j, int(w)) for j, w in enumerate(rng.integers(1, 4000, width))]
        want = sum(w * plain[int(t)] for t, w in asked)
        order = np.lexsort((np.arange(n), -want))[:10]
        assert shard.best(asked, 10) == [(int(want[d]), int(d)) for d in order if want[d] > 0]


def test_whole_index_equals_the_confined_one(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = impact_search.build_index(spark, docs, Scratch(spark, "test"))
    some = impact_search.build_index(spark, docs, Scratch(spark, "test"), terms=spark.createDataFrame([(b"one",), (b"tail",)], "term binary"))
    for index in (whole, some):
        df = {bytes(r[0]): r[1] for r in index.postings.groupBy("term").agg(F.sum("size")).collect()}
        assert df[b"tail"] == 1 and df[b""] == index.n_docs
    assert len({r[0] for r in some.postings.select("term").distinct().collect()}) <= 3


def plain_audit(docs, labels):
    masks, least = [], {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, part, t in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        masks.append((part or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = []
    for part in {m[0] for m in masks}:
        own, first = [m[1:] for m in masks if m[0] == part], Counter()
        for f, _, _ in own:
            for order in itertools.permutations(range(5)):
                met = [x for x in order if f[x]]
                if met:
                    first[met[0]] += 1
        for order in itertools.permutations(range(5)):
            for step, x in enumerate(order, 1):
                alive = [m for m in own if not any(m[0][y] for y in order[: step - 1])]
                gone = [m for m in alive if m[0][x]]
                failing = [m for m in own if m[0][x]]
                out.append((part, "".join("ABCDE"[y] for y in order), step, len(alive) - len(gone), len(gone), len(failing) - len(gone), sum(sum(m[0]) == 1 for m in failing), sum(m[1] for m in gone), sum(m[2] for m in gone), first[x]))
    return sorted(out)


def test_audit_against_brute_force(spark):
    parts = ["a", "b", None, ""]
    docs = [(i, parts[k % 4] if k % 3 else "a", t) for k, (i, t) in enumerate(corpus())] + [(None, "b", "a null id"), (None, "b", None), (2000, "a", "a null id"), (1003, "a", corpus()[3][1])]
    labels = [(i, k % 2, int(k % 5 == 0)) for k, (i, _, _) in enumerate(docs) if k % 3] + [(1004, None, 1), (1004, 1, None), (None, 1, 1), (1, 1, 1)]
    table = spark.createDataFrame([(i, p, t, 1) for i, p, t in docs], "doc_id long, source string, text string, kept int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(spark, table, marks)
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(spark, table.limit(0), marks).count() == 0
    assert filter_audit.audit(spark, table, marks.limit(0)).where("good_lost > 0").count() == 0


def test_cells_come_back_from_parities(spark):
    rng = np.random.default_rng(8)
    masks = rng.integers(0, 32, 300).tolist()
    rows = spark.createDataFrame([(m,) for m in masks], "mask int").withColumn("part", F.lit("x"))
    cells = filter_audit.transformed(rows, 5, "part").select(filter_audit.inverted(F.col("w"), 5).alias("c")).first()["c"]
    assert cells == np.bincount(masks, minlength=32).tolist()


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, attention.SYMBOLS, n) for n in (1, 23, 24, 25, 44, 45, 200)]
    counts = np.zeros((attention.SYMBOLS + 1, attention.SYMBOLS))
    np.add.at(counts, (np.concatenate([[attention.BEGIN], seqs[-1][:-1]]), seqs[-1]), 1)
    prior, flat = attention.Prior(counts), attention.initial()
    both = np.exp(prior.group[:, prior.group_of] + prior.within)
    assert np.allclose(both.sum(axis=1), 1, atol=1e-3)  # every symbol, after any one
    flat = flat + rng.normal(0, 0.05, len(flat)).astype(np.float32)
    p = attention.named(flat)
    found = attention.log_scores(p, prior, np.concatenate(seqs), np.cumsum([len(s) for s in seqs]))
    at = 0
    for s in seqs:  # each symbol once, by a plain softmax over all symbols of a plain window
        shown = np.concatenate([[attention.BEGIN], s])
        for i in range(len(s)):
            nth = max(0, -(-(i + 1 - attention.WINDOW) // attention.STRIDE))
            begin = nth * attention.STRIDE
            x = shown[begin : i + 1]
            h = p["embed"][x] + p["place"][: len(x)]
            a = np.exp((h[-1] @ p["query"] * attention.SCALE) @ (h @ p["key"]).T)
            h = h[-1] + (a / a.sum()) @ (h @ p["value"]) @ p["mixed"]
            group = int(prior.group_of[s[i]])
            z = h @ p["group"] + p["group0"] + prior.group[x[-1]]
            want = z[group] - np.log(np.exp(z).sum()) + prior.within[x[-1], s[i]]
            assert abs(found[at] - want) < 1e-3
            at += 1
    x, y, weight = rng.integers(0, attention.SYMBOLS, (3, attention.WINDOW)), rng.integers(0, attention.SYMBOLS, (3, attention.WINDOW)), rng.integers(0, 2, (3, attention.WINDOW))
    _, g = attention.gradient(p, prior, x, y, weight)
    for k in [*np.argsort(-np.abs(g))[:20:4].tolist(), *rng.choice(len(g), 5).tolist()]:
        step = np.zeros(len(flat), np.float32)
        step[k] = 1e-2
        slope = [attention.gradient(attention.named(flat + side * step), prior, x, y, weight)[0] for side in (1, -1)]
        assert abs((slope[0] - slope[1]) / 2e-2 - g[k]) < 2e-3 + 0.05 * abs(g[k])


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(t)) if w] + [""]


def test_scores_against_brute_force(spark, monkeypatch):
    docs = [*corpus(), *[(i, prose(120, i)) for i in range(60)], (7, "one"), (7, "one"), (None, "a null id is learnt from"), (61, "y" * 300 + " " + "z" * 70), (62, "y" * 300)]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))
    want = sorted(((i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base(t), 6)) for i, t in docs), key=str)
    table = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    run = lambda rows, **more: lm_scoring.score_texts(spark, rows, tokenizer=queries.tokenizer_path("byte_bpe_50k.json"), learn=~queries.lm_held_out(), **more)
    for lexicon in (lm_scoring.LEXICON, 40):
        found = run(table, lexicon=lexicon).collect()
        assert sorted(((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in found), key=str) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert run(table.limit(0)).count() == 0
    untaught = lm_scoring.score_texts(spark, table, tokenizer=queries.tokenizer_path("byte_bpe_50k.json"), learn=F.lit(False)).collect()
    assert len(untaught) == len(docs) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-9 for r in untaught)
    for out in (True, False):  # what is learnt helps, also on texts held out
        taught = sum(r["score"] for r in found if r["doc_id"] is not None and held[r["doc_id"]] == out)
        assert taught > 0.9 * sum(r["score"] for r in untaught if r["doc_id"] is not None and held[r["doc_id"]] == out)


def test_words_of_the_table_are_spelled_as_by_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, subwords = Tokenizer.from_file(path), lm_scoring.Subwords(path)
    own = ["the", "qzxv", "don't", "über", "a1b2", "<|endoftext|>", "##", "日本", "e\u0301", "x" * 80]
    assert [subwords(w.encode()).tolist() for w in own] == [library.encode(" " + w, add_special_tokens=False).ids for w in own]


def test_earlier_words():
    assert lm_scoring.earlier(np.array([0, 0, 0, 1, 1, 1]), np.array([5, 7, 5, 5, 5, 7])).tolist() == [0, 0, 1, 0, 1, 0]


def test_long_texts_in_pieces(monkeypatch):
    text = (prose(300, 9) + " \t end").encode()
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 50)
    monkeypatch.setattr(impact_search, "PIECE_BYTES", 50)
    assert [w for ws in lm_scoring.words_of(text) for w in ws] == text.lower().split()
    assert [w for ws in impact_search.terms_of(text) for w in ws] == text.translate(impact_search.TERM_BYTES).split()


DECLARED = [
    ("<link rel='nofollow canonical' href='/de/1'>", ["http://q.net/de/1"]),
    ("<link title='a>b' rel=canonical href=\"/de/1\">", ["http://q.net/de/1"]),
    ("<!-- <link rel=canonical href='/de/1'> -->", []),
    ("<!-- open <link rel=canonical href='/de/1'>", []),
    ("<script>var a = \"<link rel=canonical href='/de/1'>\";</script><LINK REL=Canonical HREF=/fr/2>", ["http://q.net/fr/2"]),
    ("<title><link rel=canonical href=/de/1></title>", []),
    ("<link rel=canonical href='/fr/1' data-href='/de/9'>", ["http://q.net/fr/1"]),
    ("<link data-href='/de/9' rel=canonical href='/fr/1' href='/de/8'>", ["http://q.net/fr/1"]),
    ("<link rel=canonical-not href='/de/1'><link rel=icon href=/canonical>", []),
    ("<a title=\"<link rel=canonical href='/de/1'>\">x</a>", []),
    ("<meta content='3; URL=\"/a?b=1&amp;c=2\"' http-equiv=Refresh>", ["http://q.net/a?b=1&c=2"]),
    ("<base href='http://b.org/k/'><link rel=canonical href=l><base href='http://c.org/'>", ["http://b.org/k/l"]),
    ("<link rel=canonical href='/de/1", []),
    ("<link rel = \n canonical href\n=\n'/de/1'/>", ["http://q.net/de/1"]),
]


def test_declared_targets(spark):
    rows = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(DECLARED)], "k int, html string")
    found = rows.select("k", F.array_compact(url_filter.declared_targets(F.lit("http://q.net/x"), F.col("html"))).alias("t")).collect()
    for r in found:
        if "'/de/1" != DECLARED[r["k"]][0][-6:]:  # an open value: whatever is read, it ends
            assert r["t"] == DECLARED[r["k"]][1], DECLARED[r["k"]]


@pytest.mark.parametrize("soup", ["<link ", "<meta http-equiv=refresh content=url ", "<!-- canonical ", "<script ", "<link rel='", '<link rel="canonical\' href=', "<link = = ", "url=url ", "<link rel=canonical href=x "])
def test_tag_soup_takes_linear_time(spark, soup):
    def seconds(size):
        rows = spark.createDataFrame([(1, soup * (size // len(soup)))], "k int, html string").cache()
        rows.count()
        began = time.perf_counter()
        rows.select(F.size(url_filter.declared_targets(F.lit("http://q.net/x"), F.col("html")))).collect()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_000_000) < 4


def test_lm_scoring_trains_on_every_symbol(spark):
    """Each training text's symbols are the targets of its windows, all of them, once."""
    texts = [None, "", "One two", " ".join(f"w{k % 37} x{k % 11}" for k in range(3000))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    subwords = lm_scoring.Subwords(path)
    alphabet = lm_scoring.Alphabet(np.ones(subwords.size + 1, np.int64))
    model_of = spark.sparkContext.broadcast((alphabet, {}, None))
    windows = rows.mapInArrow(lm_scoring._runs(model_of, "every-symbol", path, "text"), "x binary, y binary, weight binary").collect()
    found = [s for r in windows for s in np.frombuffer(r["y"], "<i2")[np.frombuffer(r["weight"], np.uint8) == 1].tolist()]
    ids = [i for t in texts for w in (t or "").lower().split() + [None] for i in ([subwords.size] if w is None else subwords(w.encode()).tolist())]
    assert found == alphabet.symbol_of[ids].tolist()


def test_lm_scoring_rounds_take_each_window_once(monkeypatch):
    """Over all rounds a task trains on each of its windows, also where they are many; small rows hold a slice's windows."""
    values = np.arange(3 * 400 * attention.WINDOW, dtype="<i2").reshape(3, 400, -1)
    rows = [pa.array([v.tobytes() for v in values], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary()), pa.array([bytes(v.size) for v in values], pa.binary())]
    batch, taken = pa.RecordBatch.from_arrays(rows, names=["x", "y", "weight"]), []
    monkeypatch.setattr(lm_scoring, "LEAST_STEPS", 1)
    monkeypatch.setattr(lm_scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(attention, "trained", lambda flat, prior, steps, rate: taken.extend(w for x, _, _ in steps for w in x[:, 0].tolist()) or flat)
    model_of, flat_of = SimpleNamespace(value=(None, None, None)), SimpleNamespace(value=attention.initial())
    for nth, rate in enumerate(lm_scoring.RATES):
        list(lm_scoring._round(flat_of, model_of, nth, rate)(iter([batch])))
    assert sorted(taken) == sorted(values[:, :, 0].ravel().tolist())


def test_lm_scoring_reads_words_of_texts_once(spark, monkeypatch):
    """Texts are cut into words to count them and once to spell them; they are scored from what was spelled."""
    table = spark.createDataFrame([(k, prose(40, k)) for k in range(20)], "doc_id long, text string").coalesce(1)
    kept = []
    write = lm_scoring.Scratch.write
    monkeypatch.setattr(lm_scoring.Scratch, "write", lambda self, df, name: kept.append((name, df)) or write(self, df, name))
    lm_scoring.score_texts(spark, table, tokenizer=queries.tokenizer_path("byte_bpe_50k.json"), learn=F.lit(True))
    plans = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in kept}
    assert [name for name, plan in plans.items() if "ExistingRDD" in plan or "LogicalRDD" in plan] == ["counts", "spelled"]


def test_lm_scoring_words_are_cut_as_by_bytes():
    texts = [None, "", " ", "A b\tC\x0bd\x0ce\rf\ng ", "\x1c\x85x\xa0Y Ä ä　z", " " + "w" * 80]
    found = [[w.encode() for w in ws if w] for ws in lm_scoring.lower_words(pa.array(texts, pa.string())).to_pylist()]
    assert found == [[w for ws in lm_scoring.words_of((t or "").encode()) for w in ws] for t in texts]
