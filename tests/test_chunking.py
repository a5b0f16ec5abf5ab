"""The chunker against a plain version that builds every list whole, and its table function."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomkb.functions import chunking

PIECES = ["# A\n", "## B\n", "### C\n", "  ## D  \n", "#no\n", "####### x\n", "```\n", "~~~\n", "word ", "word. ", "长句。", "！", "，", "\n", "\n\n\n", "\r\n", "x" * 13, "　", "a;b", "...", "# \n"]


def plain_split(text, size, overlap, seps):
    if seps[0] == "":
        out, k = [], 0
        while True:
            out.append(text[k : k + size])
            if k + size >= len(text):
                return out
            k += size - overlap
    parts = text.split(seps[0])
    if len(parts) == 1:
        return plain_split(text, size, overlap, seps[1:])
    out = []
    for p in (p.strip(chunking.WHITE) for p in parts):
        if len(p) > size:
            out += plain_split(p, size, overlap, seps[1:])
        elif p:
            out.append(p)
    return out


def plain_chunks(text, size, overlap):
    if not text:
        return []
    text = chunking.normalise(text)
    if len(text) <= size:
        return [text]
    found, headings, lines = [], [], []
    for line in text.split("\n") + [None]:
        t = (line or "").strip(chunking.WHITE)
        marks = len(t) - len(t.lstrip("#"))
        if line is None or (1 <= marks <= 6 and t[marks : marks + 1] == " "):
            if lines or not found:
                found.append((list(headings), "\n".join(lines).strip(chunking.WHITE)))
            lines = []
            if marks <= len(headings):
                headings = headings[: max(0, marks - 1)]
            headings.append("#" * marks + " " + t[marks:].strip(chunking.WHITE))
        else:
            lines.append(line)
    chunks = []
    for over, body in found:
        merged = [body]
        if len(body) > size:
            merged = []
            for p in plain_split(body, size, overlap, chunking.SEPARATORS):
                if merged and len(merged[-1]) + len(p) <= size:
                    merged[-1] += p
                else:
                    merged.append(p)
        chunks += ["\n".join([*over, m]) for m in merged]
    out = list(chunks)
    for k in range(len(chunks)):
        if overlap and k and len(chunks[k - 1]) > overlap:
            before = chunks[k - 1]
            start = len(before) - overlap
            ends = [j for j in range(start, start - overlap // 3, -1) if j > 0 and before[j] == "\n"]
            out[k] = before[ends[0] + 1 if ends else start :] + out[k]
        if overlap and k + 1 < len(chunks) and len(chunks[k + 1]) > overlap:
            after = chunks[k + 1]
            ends = [j for j in range(overlap, min(len(after), overlap + overlap // 3)) if after[j] == "\n"]
            out[k] += after[: ends[0] if ends else overlap]
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.integers(5, 40), st.integers(0, 12))
def test_against_the_plain_version(body, size, overlap):
    overlap = overlap if overlap < size else size // 2
    assert chunking.chunk(body, size, overlap) == plain_chunks(body, size, overlap)


def test_nested_headings():
    body = "intro " * 4 + "\n# A\n## B\nfirst text of it\n### C\n## D\nlast"
    assert chunking.chunk(body, 30, 0) == ["intro intro intro intro", "# A\n## B\nfirst text of it", "# A\n## D\nlast"]
    skipped = "# A\nx\n### B\ny\n### C\n" + "z" * 20
    assert chunking.chunk(skipped, 20, 0)[-1] == "# A\n### B\n### C\n" + "z" * 20
    assert chunking.chunk(skipped, 20, 0, "clean") == ["# A\nx", "# A\n### B\ny", "# A\n### C\n" + "z" * 20]
    fenced = "```\n# no heading\n```\n" + "q" * 20
    assert chunking.chunk(fenced, 30, 0)[1].startswith("# no heading\n```")
    assert chunking.chunk(fenced, 30, 0, "clean")[0].startswith("``` # no heading")


def test_overlap_crosses_sections_and_ends_at_lines():
    made = chunking.chunk("# A\n" + "a" * 12 + "\n# B\n" + "b" * 12, 20, 6)
    assert made[-1] == "aaaaaa# B\n" + "b" * 12
    assert list(chunking.overlapped(["0123\n56789", "x\nabcdefgh"], 5))[1] == "56789x\nabcdefgh"


@pytest.mark.parametrize("body", [None, "", "  \n ", "." * 60, "#", "# ", "#" * 600])
def test_odd_texts(body):
    made = chunking.chunk(body, 50, 10, "clean")
    assert all(made) and ("".join(made).strip() != "" or not (body or "").strip())


def test_table_function(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 200))) for _ in range(60)] + [None, "", "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "content_id")
    made = chunking.chunk_documents(docs, id_col="content_id", text_col="text", size=40, overlap=9)
    want = {(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.chunk(t, 40, 9))}
    assert {tuple(r) for r in made.collect()} == want
    chunking.register(spark)
    docs.createOrReplaceTempView("chunked_docs")
    assert {tuple(r) for r in spark.sql("SELECT content_id, chunk_index, content FROM chunked_docs, LATERAL markdown_chunks(text, 40, 9, 'compat')").collect()} == want
    assert chunking.chunk_documents(docs.limit(0), id_col="content_id", text_col="text").collect() == []
