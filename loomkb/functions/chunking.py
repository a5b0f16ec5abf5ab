"""Markdown-aware chunking of documents: a small per-text generator behind one table function."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: where text may be cut, the preferred place first.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ",", " ", ""]
#: Fixed value: characters trimmed at the ends (Unicode white space).
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
HEADING = re.compile(r"(#{1,6}) (.*)", re.DOTALL)
#: Full-width forms and the wide space, and their ASCII counterparts.
NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}


def is_fence(line: str) -> bool:
    return line.lstrip(WHITE).startswith(("```", "~~~"))


def normalise(text: str) -> str:
    """Line ends as LF, at most one empty line, full-width forms narrowed outside code fences, trimmed."""
    lines, fenced = [], False
    for line in re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n"):
        mark = is_fence(line)
        lines.append(line if fenced or mark else line.translate(NARROW))
        fenced ^= mark
    return "\n".join(lines).strip(WHITE)


def sections(text: str, mode: str = "compat") -> Iterator[tuple[str, str]]:
    """(headings over it, one a line; trimmed body) of each section.

    A heading with no line before the next one makes no section of its own.
    ``compat`` counts places in the path as levels, so headings of one level
    that was skipped pile up, and takes headings inside code fences too; the part before
    the first heading is a section even when empty. ``clean`` does none of the three.
    """
    path: list[tuple[int, str]] = []
    body: list[str] = []
    first, fenced = True, False
    for line in [*text.split("\n"), None]:
        found = HEADING.fullmatch(line.strip(WHITE)) if line is not None and not fenced else None
        if line is not None and not found:
            body.append(line)
            fenced ^= mode == "clean" and is_fence(line)
            continue
        if body or (first and mode == "compat"):
            yield "\n".join(t for _, t in path), "\n".join(body).strip(WHITE)
        first, body = False, []
        if found:
            level = len(found[1])
            above = [x for x in path if x[0] < level] if mode == "clean" else path[: level - 1]
            path = [*above, (level, f"{found[1]} {found[2].strip(WHITE)}")]


def windows(text: str, size: int, overlap: int) -> list[str]:
    step = max(1, size - overlap)
    out = []
    for at in range(0, len(text), step):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
    return out


def split(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Trimmed pieces of at most ``size`` characters, cut at the first separator that occurs, then at finer ones."""
    if len(text) <= size:
        return [text] if text else []
    for k, separator in enumerate(separators):
        if separator == "":
            break
        if separator in text:
            parts = [p.strip(WHITE) for p in text.split(separator)]
            return [x for p in parts if p for x in split(p, size, overlap, separators[k + 1 :])]
    return windows(text, size, overlap)


def merge(pieces: list[str], size: int, joint: str = "") -> list[str]:
    """Neighbours together while they fit."""
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(joint) + len(p) <= size:
            out[-1] += joint + p
        else:
            out.append(p)
    return out


def overlapped(chunks: Iterable[str], overlap: int) -> Iterator[str]:
    """Each chunk between the tail of the one before and the head of the one after, where those are longer than the overlap.

    Tail and head reach up to a third further, to a line end if one is there.
    """
    more = overlap // 3 if overlap > 0 else 0

    def tail(s: str) -> str:
        start = len(s) - overlap
        line = s.rfind("\n", max(1, start - more + 1), start + 1) if more else -1
        return s[line + 1 if line >= 0 else start :]

    def head(s: str) -> str:
        line = s.find("\n", overlap, overlap + more)
        return s[: line if line >= 0 else overlap]

    before, own = None, None
    for after in chain(chunks, [None]):
        if own is not None:
            left = tail(before) if before is not None and 0 < overlap < len(before) else ""
            right = head(after) if after is not None and 0 < overlap < len(after) else ""
            yield left + own + right
        before, own = own, after


def iter_chunks(text: str | None, size: int = 500, overlap: int = 100, mode: str = "compat") -> Iterator[str]:
    """Chunks of one text, one at a time.

    A null or empty text has none, one of at most ``size`` characters is one chunk.
    ``compat`` joins pieces without what separated them, keeps empty chunks and leaves a body of
    separators alone out. ``clean`` joins pieces with a space, cuts such a body by length, leaves empty chunks out
    and reads headings as ``sections`` says. A size below 1 means 500, an overlap not below the size half of it.
    """
    size = size if size > 0 else 500
    overlap = max(0, overlap) if overlap < size else size // 2
    if not text:
        return
    text = normalise(text)
    if len(text) <= size:
        if text or mode == "compat":
            yield text
        return

    def plain() -> Iterator[str]:
        for path, body in sections(text, mode):
            pieces = [body] if len(body) <= size else merge(split(body, size, overlap), size, "" if mode == "compat" else " ")
            if not pieces and mode == "clean":
                pieces = windows(body, size, overlap)
            for p in pieces:
                if p or mode == "compat":
                    yield f"{path}\n{p}" if path else p

    yield from overlapped(plain(), overlap)


def chunk(text: str | None, size: int = 500, overlap: int = 100, mode: str = "compat") -> list[str]:
    return list(iter_chunks(text, size, overlap, mode))


@F.udtf(returnType="chunk_index int, content string")
class MarkdownChunks:
    """Table function (text, size, overlap, mode) -> (chunk_index, content); rows leave the task one by one."""

    def eval(self, text: str, size: int, overlap: int, mode: str):
        yield from enumerate(iter_chunks(text, size, overlap, mode))


def register(spark: SparkSession, name: str = "markdown_chunks") -> None:
    """Makes ``SELECT ... FROM docs, LATERAL markdown_chunks(text, 500, 100, 'compat')`` known to SQL."""
    spark.udtf.register(name, MarkdownChunks)


def chunk_documents(docs: DataFrame, *, id_col: str, text_col: str, size: int = 500, overlap: int = 100, mode: str = "compat") -> DataFrame:
    """(id, chunk_index, content), one row a chunk; a text without chunks gives no row."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    made = MarkdownChunks(F.col("_text").outer(), F.lit(size), F.lit(overlap), F.lit(mode))
    return rows.lateralJoin(made).select(id_col, "chunk_index", "content")
