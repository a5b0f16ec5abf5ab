"""The operators of the training-data subpackage against brute force, round trips and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomkb.llm import bpe, queries, rans
from loomkb.llm.ann import CrossPolytope, hadamard, nearest_neighbours
from loomkb.llm.bpe import bpe_round_trip
from loomkb.llm.components import connected_components
from loomkb.llm.common import Scratch
from loomkb.llm.cutting_stock import plan, price
from loomkb.llm.exact_dedup import exact_dedup, perfect_hash
from loomkb.llm.html_text import extract_text, main_text
from loomkb.llm.jaccard_join import shingle_components
from loomkb.llm.lexicon import Lexicon, compile_lexicon
from loomkb.llm.packing import pack_documents
from loomkb.llm.quality import fit_quality, score_quality
from loomkb.llm.substrings import substring_dedup
from loomkb.llm.token_files import document_checksums, read_token_files, write_token_files
from loomkb.llm.url_filter import judge_urls

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(t, edits, seed):
    rng, words = random.Random(seed), t.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


def edge_texts():
    base, passage, rng = prose(200, 1), prose(60, 2), random.Random(8)
    texts = [None, "", " \n\t", "one", "one two", "ONE two", base, base, base.upper(), prose(3000, 3), "a " * 50, "é 中文 😀 <|endoftext|> x"]
    texts += [edited(base, k % 5, k) for k in range(30)]  # one group of near copies
    texts += [prose(25, 100 + k) + " " + passage + " " + prose(5, 200 + k) for k in range(20)]  # one shared passage
    texts += [prose(rng.randint(1, 120), 300 + k) for k in range(30)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7, 7, 7, 7, 7) for i, t in edge_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, digest long, sequence_id long, kept int, lists int")


def no_rows(docs):
    return docs.where("doc_id < 0")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def library_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.no_truncation()
    t.no_padding()
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs):
    _, ids = library_ids("word_bpe_49k.json", [t or "" for _, t in edge_texts()])
    want = {i: x + [2] for (i, _), x in zip(edge_texts(), ids, strict=True)}
    rows = pack_documents(spark, docs, tokenizer=path("word_bpe_49k.json"), capacity=256).collect()
    pieces, places = {}, {}
    for r in rows:
        assert bytes(r["ids"]) == np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in want.items():
        assert sum(n for _, n in pieces[i]) == len(x) and len({s for s, _ in pieces[i]}) == len(pieces[i])
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    assert len(places) <= 1.15 * sum(map(len, want.values())) / 256 + 1
    assert pack_documents(spark, no_rows(docs), tokenizer=path("word_bpe_49k.json")).count() == 0


def test_patterns_cover_all_lengths():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 100, 60))
    counts = rng.integers(1, 50, len(lengths))
    p = plan(lengths, counts, 100)
    room = {}
    for length, n, before in zip(lengths, counts, p["before"], strict=True):
        for rank in range(before, before + n):
            s = np.searchsorted(p["start"], rank, side="right") - 1
            r = rank - p["start"][s]
            key = (p["base"][s] + r // p["per"][s], p["slot"][s] + r % p["per"][s])
            assert key not in room
            room[key] = length
    total = {}
    for (seq, _), length in room.items():
        total[seq] = total.get(seq, 0) + length
    assert max(total.values()) <= 100 and len(room) == counts.sum()
    assert len(total) <= 1.1 * (lengths * counts).sum() / 100 + 2


def test_plan_does_not_depend_on_the_clock(monkeypatch):
    import itertools
    import time

    rng = np.random.default_rng(6)
    lengths = np.unique(rng.integers(1, 100, 60))
    counts = rng.integers(1, 50, len(lengths))
    want, ticks = plan(lengths, counts, 100), itertools.count(0, 100)
    monkeypatch.setattr(time, "monotonic", lambda: next(ticks))
    found = plan(lengths, counts, 100)
    assert all((found[k] == want[k]).all() for k in want)


def test_patterns_end_by_the_gap_with_little_padding():
    from loomkb.llm import cutting_stock

    rng = np.random.default_rng(11)
    every = np.clip(rng.lognormal(6, 1.2, 40_000).astype(np.int64), 1, 4095)
    lengths, counts = np.unique(every, return_counts=True)
    found = plan(lengths, counts, 4096, 64)
    assert every.sum() >= 0.97 * 4096 * found["sequences"][0]
    edges = cutting_stock.length_classes(lengths, counts, 64)
    demand = np.bincount(np.searchsorted(edges, lengths), weights=counts, minlength=len(edges))
    basis, used = cutting_stock.solve(edges, demand, 4096)
    assert (edges @ basis <= 4096).all() and np.allclose(basis @ used, demand, rtol=1e-3, atol=1)
    duals = np.linalg.solve(basis.T, np.ones(len(edges)))  # no pattern betters the solution by more than the gap
    assert max((cutting_stock.price(edges, np.maximum(duals, 0), 4096) @ duals)) <= 1 + 2 * cutting_stock.GAP


def test_prices_are_the_best_patterns():
    rng = np.random.default_rng(12)
    edges, values = np.array([3, 5, 7, 11]), rng.uniform(0.1, 1, 4)
    best = max(sum(n * v for n, v in zip(p, values, strict=True)) for p in np.ndindex(9, 6, 4, 3) if np.dot(p, edges) <= 25)
    found = price(edges, values, 25)
    assert np.isclose((found @ values).max(), best) and (found @ edges <= 25).all() and all((found[:, c] > 0).any() for c in range(4))


def test_quality_learns_held_out_labels(spark):
    good = [(k, prose(RNG.randint(20, 80), k)) for k in range(150)]
    bad = [(1000 + k, " ".join(w + RNG.choice(["###", "$$$", "!!"]) for w in prose(RNG.randint(20, 80), k).split())) for k in range(60)]
    rows = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 1000), None) for i, _ in good + bad if i % 2], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in score_quality(spark, rows, fit_quality(spark, rows, labels)).collect()}
    assert len(found) == 212 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    held = [i for i, _ in good + bad if not i % 2]
    assert sum(found[i]["predicted"] == int(i < 1000) for i in held) >= 0.97 * len(held)
    alone = score_quality(spark, rows, fit_quality(spark, rows, labels.where("doc_id < 0")))
    assert alone.count() == 212 and fit_quality(spark, no_rows(rows), labels) is not None


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies here</div>"
    "<article><h1>A &lt;b&gt;</h1><p>One&nbsp;two <b>three</b>\n four.<br><p>Short.<aside>see</aside><form><p>Name</p></form><script>var x='</p>'</script><!-- no --><div id=comments><p>Nice!</p></div></article>"
    "<div class=sidebar>Side</div><footer>c</footer></body></html>"
)


def test_html(spark):
    assert main_text(PAGE) == "A <b>\nOne two three four.\nShort."
    assert main_text("") == "" and main_text("plain & <") == ""
    long = "the quick one and the other of them are in this house and it is not so bad for all of us to be here " * 3
    loose = f"<body><div><a href=x>Menu</a></div><p>{long}</p><p>In between.</p><p>{long}</p><div><a href=y>More</a></div>"
    assert main_text(loose) == f"{long.strip()}\nIn between.\n{long.strip()}"
    rows = spark.createDataFrame([(1, PAGE, "u", 3), (2, None, None, 4), (3, "", "u", 5), (4, "<article>" + "x" * 100_000, "u", 6)], "page_id long, html string, url string, text int")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_text(rows).collect()}
    assert found == {1: (main_text(PAGE), 32), 2: ("", 0), 3: ("", 0), 4: ("x" * 100_000, 100_000)}


def test_html_takes_time_in_proportion_to_the_page():
    import time

    for soup in ("<a ", "<a href='", "<a href='>", "<svg>", "<div>x", "</x>", "<article>", "<b><a>", "<!-- ", "'<a \"", "<p>x"):
        began = time.process_time()
        main_text(soup * (300_000 // len(soup)))
        assert time.process_time() - began < 10, soup
    assert main_text("<article><p x='>'>the one and the other</p></article>") == "the one and the other"


def test_html_passes_run_beside_articles():
    long = ("the quick one and the other of them are in this house and it is not so bad for all of us to be here " * 3).strip()
    cards = "".join(f"<div class=post><a href=/{k}>Card number {k}</a></div>" for k in range(3))
    assert main_text(f"<body><h1>Title</h1><div>{long}</div><div>{long}</div>{cards}</body>") == f"Title\n{long}\n{long}"
    assert main_text(f"<body><div>{long}</div><article><p>In short.</p></article><div>{long}</div></body>") == f"{long}\nIn short.\n{long}"
    links = "<ul><li><a href=/a>Other things</a></li><li><a href=/b>More of them</a></li></ul>"
    assert main_text(f"<body><article><h1>Title</h1>{links}<p>{long}</p><p>By one.</p></article></body>") == f"Title\n{long}\nBy one."
    assert main_text(f"<article><p>{'Lorem ipsum dolor sit amet consectetur. ' * 6}</p></article>") == ("Lorem ipsum dolor sit amet consectetur. " * 6).strip()


def test_html_bad_names_are_whole_values_and_spare_wrappers():
    long = ("the quick one and the other of them are in this house and it is not so bad for all of us to be here " * 3).strip()
    for wrapper in ("div class='content has-sidebar'", "div id=page class=no-comments", "div class=layout--sidebar-right", "div class=widget", "div id='comments'", "form id=aspnetForm", "div class=pageHeader"):
        end = wrapper.split()[0]
        for inner in (f"<article><h1>Title</h1><p>{long}</p></article>", f"<main><h1>Title</h1><p>{long}</p></main>", f"<h1>Title</h1><p>{long}</p><p>{long}</p>"):
            page = f"<body><{wrapper}>{inner}</{end}><footer>Site</footer></body>"
            assert main_text(page).startswith(f"Title\n{long}") and "Site" not in main_text(page)
    for bad in ("class=comments", "id=comments-area", "class='x cookie-notice'", "class=sidebarLeft", "role=navigation"):
        assert main_text(f"<body><article><p>{long}</p><div {bad}><p>{long[:-5]}</p></div></article><div {bad}><p>{long}</p><p>{long}</p></div></body>") == long
    assert main_text(f"<article class='post has-sidebar'><p>{long}</p></article>") == long


def plain_components(rows, size, percent):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i, _ in rows if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i, _ in rows}


@pytest.mark.parametrize(("size", "percent", "rare"), [(3, 90, 48), (3, 90, 4), (5, 80, 5)])
def test_jaccard_components(spark, docs, size, percent, rare):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_components(spark, docs, size=size, percent=percent, rare=rare).collect()}
    assert found == plain_components(edge_texts(), size, percent)


def test_jaccard_sets_of_more_documents_than_the_filter_takes(spark, docs, monkeypatch):
    from loomkb.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FILTERED", 3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_components(spark, docs, size=3, percent=60).collect()}
    assert found == plain_components(edge_texts(), 3, 60)
    with pytest.raises(ValueError, match="more than half"):
        shingle_components(spark, docs, percent=50)


def test_jaccard_keeps_common_passages_out_of_the_prefixes(spark, monkeypatch):
    """Texts of which more than half is common to all are found by their own words, with no combinations of common shingles."""
    passage, rows = [f"passage{i}" for i in range(300)], []
    for k in range(80):
        own = [f"own{k}x{i}" for i in range(200)]
        rows += [(2 * k, " ".join([*passage, *own])), (2 * k + 1, " ".join([*own[:195], *(f"end{k}y{i}" for i in range(5)), *passage]))]
    rows += [(500 + k, " ".join([*passage, f"last{k}"])) for k in range(3)]  # hardly anything but common shingles
    counts, write = {}, Scratch.write

    def counted(self, df, name):
        counts[name] = (out := write(self, df, name)).count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_components(spark, docs, size=3, percent=90).collect()}
    assert found == plain_components(rows, 3, 90)
    assert found[159][1] == 158 and found[502][1] == 500
    assert counts["around"] <= 3


def test_jaccard_moves_only_the_sets_that_are_compared(spark):
    """Of many whole sets, a join reads those of the documents asked for and hardly any other."""
    from loomkb.llm.jaccard_join import only

    sets = spark.range(2000).select(F.col("id").alias("doc"), F.lit(b"12345678").alias("tokens"))
    found = {r["doc"] for r in only(sets, spark.range(0, 2000, 100).select(F.col("id").alias("doc"))).collect()}
    assert set(range(0, 2000, 100)) <= found and len(found) < 25
    assert only(sets, spark.range(0).select(F.col("id").alias("doc"))).count() == 0


def test_jaccard_without_rows(spark, docs):
    assert shingle_components(spark, no_rows(docs)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 51), (51, 50), (7, 7), (None, 1)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "test")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 50: 50, 51: 50}


def test_bpe_round_trip(spark, docs):
    t, ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in edge_texts()])
    found = {r["doc_id"]: r for r in bpe_round_trip(spark, docs, tokenizer=path("byte_bpe_50k.json"), lexicon_words=100).collect()}
    for (i, _), x in zip(edge_texts(), ids, strict=True):
        assert found[i]["ids"] == ",".join(map(str, x)) and bytes(found[i]["decoded"]) == t.decode(x, skip_special_tokens=False).encode()
    assert bpe_round_trip(spark, no_rows(docs), tokenizer=path("byte_bpe_50k.json")).count() == 0


def test_bpe_merges_a_word_once():
    """Words that new units share are not merged again; ids are those of merging one word by itself, also where slots of pairs collide."""
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encode = bpe.Encoder(f.read(), compile_lexicon({}))
    merged, many, rng = [], encode.merges.many, random.Random(1)
    encode.merges.many = lambda words: merged.extend(words) or many(words)
    for texts in (["one oferineati"], ["one oferineati, oferineati; oferineati.", "oferineati"], ["x" * 200 + " oferineati!"]):
        list(encode(texts))
    assert merged.count(b" oferineati") == 1
    words = ["".join(rng.choices("abdeinorst éñ北", k=rng.randint(1, 40))).encode() for _ in range(3000)]
    assert many(words) == [encode.merges.one(w) for w in words] and many([]) == []


def test_lexicon_shares_suffixes():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(sorted(set(WORDS)))}
    lexicon = Lexicon.mapped(compile_lexicon(words))
    numbers = lexicon.numbers([*words, b"nothing", b""])
    assert [lexicon.ids_of(n).tolist() for n in numbers[:-2]] == list(words.values()) and numbers[-2:].tolist() == [-1, -1]


def test_exact_dedup(spark, docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in edge_texts():
        groups.setdefault(lower(t), []).append(i)
    found = {r["doc_id"]: r for r in exact_dedup(spark, docs, bucket_keys=10).collect()}
    for i, t in edge_texts():
        own, r = groups[lower(t)], found[i]
        assert (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) == (max(own), len(own), i == max(own), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup(spark, no_rows(docs)).count() == 0


def test_perfect_hash_fills_its_slots():
    keys = np.random.default_rng(3).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    assert sorted(perfect_hash(keys)[1].tolist()) == list(range(5000))


def test_token_files(spark, docs, tmp_path):
    _, ids = library_ids("byte_bpe_50k.json", [t or "" for _, t in edge_texts()])
    write_token_files(spark, docs, str(tmp_path / "files"), tokenizer=path("byte_bpe_50k.json"), block_ids=500)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in document_checksums(read_token_files(spark, str(tmp_path / "files"))).collect()}
    at = 0
    for (i, _), x in zip(edge_texts(), ids, strict=True):
        assert found[i] == (at, len(x) + 1, crc([*x, 2]))
        at += len(x) + 1


def test_token_files_are_decoded_from_checkpoints(spark, tmp_path):
    docs = spark.createDataFrame([(1, prose(150_000, 1)), (5, "")], "doc_id long, text string").coalesce(1)
    where = str(tmp_path / "files")
    write_token_files(spark, docs, where, tokenizer=path("byte_bpe_50k.json"))
    want = sorted(map(tuple, document_checksums(read_token_files(spark, where)).collect()))
    runs = read_token_files(spark, where, segments=4)
    assert runs.where("NOT whole").count() > 2  # the long document is put together from several segments
    assert sorted(map(tuple, document_checksums(runs).collect())) == want


def test_rans_blocks():
    rng = np.random.default_rng(5)
    for n in (1, 63, 1000, 200_000):
        ids = rng.zipf(1.3, n).clip(1, 40_000).astype(np.uint32)
        symbols, counts = np.unique(ids, return_counts=True)
        table = rans.Table.unpack(rans.Table(symbols.astype(np.int64), counts).pack())
        raw = rans.encode_block(ids, table)
        assert (rans.decode_block(raw, table) == ids).all()
        broken = bytearray(raw)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block(bytes(broken), table)
    later = rans.decode_block(raw, table, checkpoint=1)
    assert (later == ids[-len(later) :]).all() and len(later) < len(ids)
    assert rans.crc32_join(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[100:200] = x[100]  # one hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, []), (None, x[0].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = {}
    for r in nearest_neighbours(spark, v, v.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    hit = 0
    for q, near in found.items():
        s = (x[q] * x).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        hit += len({i for i, _ in near} & set(want.tolist()))
        assert len(near) == 20 and near == sorted(near, key=lambda t: (-t[1], t[0]))
        assert all(abs(s[i] - score) < 1e-12 for i, score in near)
    assert hit >= 0.9 * 20 * len(found)
    assert nearest_neighbours(spark, v.where("vec_id < 0"), v.where("vec_id < 0")).count() == 0
    assert nearest_neighbours(spark, v.where("vec_id < 5"), v.where("vec_id = 0")).count() == 4


def test_nearest_gives_k_rows_or_all(spark):
    rng = np.random.default_rng(4)

    def check(rows, asked):
        v = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "vec_id long, embedding array<double>")
        vectors, found = dict(rows), {}
        for r in nearest_neighbours(spark, v, v.where(F.col("vec_id").isin(asked)), k=20).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in asked:
            order = sorted((i for i in vectors if i != q), key=lambda i: (-(vectors[q] * vectors[i]).sum(), i))
            yield found.get(q, []), order[:20]

    assert all(got == want for got, want in check(list(enumerate(rng.normal(size=(15, 64)))), [0, 5, 14]))  # fewer than 20 in all
    axis = np.eye(64)[0]
    tight = axis + 0.01 * rng.normal(size=(200, 64))
    away = rng.normal(size=(6, 64))
    away[:, 0] = 0
    away = 0.98 * away / np.linalg.norm(away, axis=1, keepdims=True) - 0.2 * axis
    both = np.concatenate([tight, away])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    assert all(len(got) == 20 for got, _ in check(list(enumerate(both)), list(range(200, 206))))
    same = [(0, axis)] * 30 + [(i, axis) for i in range(1, 26)]  # an id repeated more than k times
    assert all(got == want for got, want in check(same, [0, 25]))


def test_nearest_takes_most_vectors_length_and_any_numbers(spark):
    rows = [(i, [i % 3 + 1, i % 5, i % 7, 1]) for i in range(40)] + [(100, [1, 2, 3, 4, 5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<int>")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest_neighbours(spark, v, v.where("vec_id IN (0, 20, 100)"), k=5, probes=16).collect()}
    x = dict(rows[:40])
    for q in (0, 20):
        want = sorted((-float(np.dot(x[q], y)), i) for i, y in x.items() if i != q)[:5]
        assert [found[q, r] for r in range(1, 6)] == [(i, -s) for s, i in want]
    assert len(found) == 10


def test_nearest_recall_with_fitted_probes(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.where("embedding IS NOT NULL").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    found = {}
    for r in nearest_neighbours(spark, v, v.where("vec_id % 20 = 0"), k=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, near in found.items():
        order = np.lexsort((ids, -(x @ rows[q])))
        hits += len(near & set([i for i in ids[order].tolist() if i != q][:20]))
    assert hits >= 0.9 * 20 * len(found)


def test_ranks_count_the_probes_before():
    x = np.random.default_rng(3).normal(size=(30, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for functions in (1, 2):
        family = CrossPolytope(8, 2, functions)
        order, own = family.buckets(x[:5], 1, 16**functions), family.buckets(x, 1, 1)[:, 0]
        ranks = family.ranks(x[:5], np.tile(x, (5, 1, 1)), 1)
        assert all(order[q, ranks[q, k]] == own[k] for q in range(5) for k in range(30))


def test_rotations_keep_lengths():
    x = np.random.default_rng(2).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    family = CrossPolytope(60, 2, 2)
    codes = family.buckets(x[:, :60], 1, 9)
    assert codes.shape == (5, 9) and all(len(set(r)) == 9 for r in codes.tolist())
    assert (codes[:, 0] == family.buckets(x[:, :60], 1, 1)[:, 0]).all()


def plain_substrings(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        covered = [False] * len(words)
        for s in range(len(words) - width + 1):
            key = tuple(words[s : s + width])
            if key in seen:
                covered[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(words), sum(covered), b" ".join(w for w, c in zip(words, covered, strict=True) if not c).decode())
    return out


@pytest.mark.parametrize("width", [20, 7])
def test_substrings(spark, docs, width):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(spark, docs, width=width).collect()}
    assert found == plain_substrings(edge_texts(), width)


def test_substrings_tell_windows_with_equal_symbols_apart(spark):
    import pyarrow as pa

    from loomkb.llm.common import gram_hashes, hashed_words

    passage, own = [f"w{k}" for k in range(19)], [f"n{k}" for k in range(300_000)]
    hashes = lambda words: hashed_words(pa.array([" ".join(words)]))[0]
    head, last = hashes(passage), hashes(own)
    symbols = gram_hashes(np.column_stack([np.tile(head[15:], (len(own), 1)), last]).ravel(), 5)[::5]
    order = np.argsort(symbols, kind="stable")
    high = (symbols >> np.uint64(32))[order]
    pairs = [(order[k], order[k + 1]) for k in np.flatnonzero(high[1:] == high[:-1])]
    least = gram_hashes(head, 5).min()  # the anchor must lie in the shared words
    rows = [(10 * n + m, " ".join([*passage, own[k]])) for n, p in enumerate(pairs) if symbols[list(p)].min() > least for m, k in enumerate(p)]
    assert rows
    rows += [(1000, rows[0][1])]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), width=20).collect()}
    assert found == plain_substrings(rows, 20)


def test_substrings_extend_heavy_prefixes(spark, docs, monkeypatch):
    from loomkb.llm import substrings

    monkeypatch.setattr(substrings, "GROUP", 5)  # the plan is made by the driver
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(spark, docs, width=20).collect()}
    assert found == plain_substrings(edge_texts(), 20)
    assert substring_dedup(spark, no_rows(docs)).count() == 0


def test_prefix_counts_leave_light_prefixes_out():
    import pyarrow as pa

    from loomkb.llm.substrings import _prefix_counts

    tops = [bytes([a, b]) + bytes(14) for a in (1, 2) for b in (1, 2, 3)]
    batch = pa.RecordBatch.from_pydict({"cell": [0], "tops": [b"".join(tops)]})
    rows = [r for b in _prefix_counts(8, 8, {(0, tops[0][:1] + bytes(15))})(iter([batch])) for r in b.to_pylist()]
    assert sorted(r["prefix"] for r in rows) == tops[:3]


def test_urls(spark):
    link = "<link rel=canonical href='{0}'>"
    rows = [
        (1, "http://a.example.org/es/x", None),
        (2, "HTTP://A.Example.ORG/es/x?q#f", ""),
        (3, "http://b.net/1", link.format("http://b.net/2")),
        (4, "http://b.net/2", link.format("http://x.com/de/1")),
        (5, "http://x.com/de/1", ""),
        (6, "http://c.net/1", link.format("/2")),
        (7, "http://c.net/2", link.format("//x.com/de/9")),
        (8, "http://c.net/3", link.format("http://c.net/1") + "<meta http-equiv=refresh content='0;url=http://x.com/fr/1'>"),
        (9, None, None),
        (10, "no scheme", None),
        (11, "http://sub.example.org/en/12", None),
        (12, "http://notexample.org/es/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in judge_urls(spark, pages).collect()}
    assert found[1] == ("a.example.org", "example.org/es/", "block") and found[2][1:] == ("example.org/es/", "block")
    assert [found[k][2] for k in (3, 4, 5)] == ["block"] * 3  # blocked through aliases
    assert [found[k][2] for k in (6, 7, 8)] == ["allow"] * 3  # an allowed member comes first
    assert found[9] == ("", None, "allow") and found[10] == ("", None, "allow")
    assert found[11][1:] == ("example.org/en/1", "block") and found[12][1:] == ("org/", "allow")
    moved = judge_urls(spark, pages, redirects=spark.createDataFrame([("http://new.net/", "http://x.com/de/1")], "source string, target string"), html_col=None)
    assert moved.count() == 12


def test_urls_resolve_relative_targets(spark):
    from urllib.parse import urljoin

    from loomkb.llm.url_filter import declared_targets

    refs = ["page2.html", "?id=2", "../a", "./b/./c?x=../y", "../../../up", "..", ".", "d/..", "/e/../f/./g", "//x.com/de/1", "http://x.com/a", "a&amp;b", "\n h.html \n", "i#j"]
    none = ["", " ", "#top", "mailto:me@x.com"]
    urls = ["http://r.net/d/e/1?q=1#z", "http://r.net", "https://r.net/d/"]
    rows = [(u, r, f"<link rel='canonical' href='{r}'>") for u in urls for r in refs + none]
    rows += [("http://r.net/d/1", r, f"<base href='/k/l'><meta http-equiv=refresh content='0; url={r}'>") for r in ("m", "?n=1")]
    for r in spark.createDataFrame(rows, "url string, ref string, html string").select("*", F.array_compact(declared_targets(F.col("url"), F.col("html"))).alias("t")).collect():
        base = urljoin(r["url"], "/k/l") if "<base" in r["html"] else r["url"]
        assert r["t"] == ([] if r["ref"] in none else [urljoin(base, r["ref"].strip().replace("&amp;", "&"))]), r
    link = "<link rel=canonical href='{0}'>"
    pages = [(1, "http://r.net/d/1", link.format("page2.html")), (2, "http://r.net/d/page2.html", link.format("?id=2")), (3, "http://r.net/d/page2.html?id=2", link.format("../a"))]
    pages += [(4, "http://r.net/a", link.format("http://x.com/de/1")), (5, "http://r.net/b", link.format("#d"))]
    found = {r["page_id"]: r["verdict"] for r in judge_urls(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def plain_verdicts(pages):
    """Verdicts from urls and links found with Python's own parsers."""
    import html as h
    import re
    from urllib.parse import urljoin

    from loomkb.llm.url_filter import RULES

    def parts(url):
        if not url or "://" not in url:
            return "", "", ""
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path, query = re.match(r"([^?#]*)(\?[^#]*)?", rest[len(host) :]).groups()
        return host.lower(), path, query or ""

    def rule(url):
        host, path, _ = parts(url)
        fits = [(len(a + b), what) for what, a, b in RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
        return max(fits)[1] if fits else None

    key = lambda url: "".join(parts(url)) if parts(url)[0] else None
    parent, said, edges = {}, {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, url, page in pages:
        for link in re.findall(r"href='([^']*)'|url=([^'>]*)'", page or ""):
            target = h.unescape(link[0] or link[1]).strip()
            if target and not target.startswith("#"):
                edges.append((url, urljoin(url, target)))
    for url in [u for _, u, _ in pages] + [x for e in edges for x in e]:
        if key(url) and rule(url):
            said[key(url)] = min(said.get(key(url), "x"), rule(url))
    for u, v in edges:
        parent[find(key(u))] = find(key(v))
    of = {}
    for k, what in said.items():
        of[find(k)] = min(of.get(find(k), "x"), what)
    return {i: rule(u) or (of.get(find(key(u))) if key(u) else None) or "allow" for i, u, _ in pages}


def test_urls_against_brute_force(spark):
    rng = random.Random(21)
    hosts, folders = ["a.net", "b.net", "c.net", "x.com", "example.org"], ["", "de/", "fr/", "es/", "k/l/"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(folders)}{rng.randint(1, 6)}" for _ in range(120)]
    refs = lambda: rng.choice([rng.choice(urls), f"/{rng.choice(folders)}{rng.randint(1, 6)}", f"../{rng.randint(1, 6)}", str(rng.randint(1, 6)), "?a=1&amp;b=2", "?a=1&#38;b=2", "&#x2f;k&#47;l&#x2F;1", "#top", ""])
    kinds = ["<link rel='canonical' href='{0}'>", "<meta http-equiv='refresh' content='0; url={0}'>"]
    pages = [(i, u, "".join(rng.choice(kinds).format(refs()) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))) or None) for i, u in enumerate(urls)]
    pages += [(200, None, None), (201, "nothing", kinds[0].format("http://x.com/de/1")), (0, urls[0], pages[0][2])]
    found = {r["page_id"]: r["verdict"] for r in judge_urls(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == plain_verdicts(pages)


def test_join_links_negative_and_very_large_ids(spark):
    from loomkb.llm.jaccard_join import shingle_components

    base = [f"word{i}" for i in range(60)]
    ids = [-(2**63), -5, -1, 0, 3, 2**54 + 1, 2**63 - 1]
    rows = [(i, " ".join([*base, f"end{k}"])) for k, i in enumerate(ids)] + [(-7, "another text that nobody else has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rare in (2, 100):  # as frequent tokens and as rare ones
        found = {r["doc_id"]: r["component_id"] for r in shingle_components(spark, docs, rare=rare).collect()}
        assert found == {**dict.fromkeys(ids, -(2**63)), -7: -7}


def test_columns_of_texts_are_encoded_as_by_the_library(monkeypatch):
    """New pieces go to the library many at a time, in few calls; odd texts and a table that begins anew change no id."""
    from loomkb.llm import tokens

    path = queries.tokenizer_path("byte_bpe_50k.json")
    encode = tokens.UnitEncoder(path, tokens.spaced_units)
    odd = ["", None, " ", "  a", "a  ", "a\n b", "x  y", "x ", "<|endoftext|> a b", "a <|endoftext|>b c", "don't  's 's", "　 q", "日本 語 é x", "w" * 90 + " " + "v" * 90 + " u", "a\x1c b", "a b\n", "a\tb c", "end. end... end.& é. über, ab'. (a) a_b_"]
    many = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{'.' if k % 3 else ''}" for k in range(at, at + 500)) for at in range(0, 3000, 500)]
    table = tokens.SpacedTable(encode, most=300)
    for texts in (odd, odd[::-1], [None], many, many + odd):
        ids, ends = table(pa.array(texts, pa.string()), [2])
        want = [[*encode.library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    calls, one = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda unit: calls.append(unit) or one(unit))
    tokens.SpacedTable(encode)(pa.array(many, pa.string()), [2])
    assert len(calls) < 20
