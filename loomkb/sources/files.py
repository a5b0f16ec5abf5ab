"""Sources of documents: text lines, directory trees, queues, corpora and office files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUEUE_SCHEMA = "article_id long, kb_id long, file_path string, action string, ts timestamp, status string, lease_at timestamp"
#: Fixed value: largest file that is parsed.
MOST_BYTES = 100 * 1024 * 1024


def grep_lines(files: DataFrame, pattern: str, *, id_col: str, text_col: str, ignore_case: bool = False) -> DataFrame:
    """(id, line_no from 1, line) of lines that a regular expression matches somewhere."""
    rows = files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("_pos", "line"))
    found = F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)
    return rows.where(found).select(id_col, (F.col("_pos") + 1).alias("line_no"), "line")


def read_lines(files: DataFrame, offset: int, limit: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of ``limit`` lines from number ``offset`` (1 is the first)."""
    start = max(1, offset)
    rows = files.select(id_col, F.posexplode(F.slice(F.split(text_col, "\n"), start, max(0, limit))).alias("_pos", "line"))
    return rows.select(id_col, (F.col("_pos") + start).alias("line_no"), "line")


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of files by name pattern, in order of the lower-cased path; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "modificationTime", "length").orderBy(F.lower("path"), "path")


def glob_regex(pattern: str) -> str:
    """A pattern of path segments as a regular expression: ``*``, ``?`` and ``[a-z]`` within one, ``**`` over any number, as the last over all beneath."""
    parts = [x for x in pattern.split("/") if x not in ("", ".")]
    out = []
    for k, part in enumerate(parts):
        if part == "**":
            out.append("(?:[^/]+/)*" if k + 1 < len(parts) else "(?:[^/]+/)*[^/]+")
            continue
        for piece in re.findall(r"\[[!^]?\]?[^\]]*\]|.", part, re.DOTALL):
            if piece in ("*", "?"):
                out.append("[^/]" + piece.replace("?", ""))
            elif len(piece) > 1:
                own = piece[1:-1]
                no, own = own[0] in "!^", own.lstrip("!^") if own[0] in "!^" else own
                out.append(("[^/" if no else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", own) + "]")
            else:
                out.append(re.escape(piece))
        out.append("/" if k + 1 < len(parts) else "")
    return "".join(out)


def glob_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, relative, length) of files under ``folder`` whose relative path fits a pattern with ``**``, in no order.

    Segments before the first ``**`` (or character class) go to the listing, which enters only folders that fit them and
    spreads over tasks beyond some folders; the rest is a filter on paths. As in all Spark sources, names that start with ``_`` or ``.`` don't count.
    """
    head = []
    for part in (x for x in pattern.split("/") if x not in ("", ".")):
        if part == "**" or set(part) & set("[]{}\\"):
            break
        head.append(part)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        found = reader.load("/".join([folder.rstrip("/"), *head]))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, relative string, length long")
    rows = found.select("path", F.substring("path", len(base) + 1, 2**31 - 1).alias("relative"), "length")
    return rows.where(F.col("relative").rlike(f"(?s)^{glob_regex(pattern)}$"))


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Queue items from JSON lines; lines that don't parse are skipped."""
    return spark.read.schema(QUEUE_SCHEMA).option("mode", "DROPMALFORMED").json(folder)


def append_queue(items: DataFrame, folder: str) -> None:
    """Add items; the time is now and the status pending where they have none."""
    rows = items.withColumn("ts", F.coalesce("ts", F.current_timestamp())).withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")))
    rows.write.mode("append").json(folder)


def read_ir_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus.jsonl and queries.jsonl with _id, title and text, qrels.tsv with query-id, corpus-id and score; queries with qrels only."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc_id"), "title", "text")
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    qrels = spark.read.option("sep", "\t").option("header", "true").csv(f"{folder}/qrels.tsv")
    qrels = qrels.toDF("query_id", "doc_id", "score").select("query_id", "doc_id", F.col("score").cast("int").alias("score"))
    return docs, asked.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def sniffed_type(content: Column, name: Column) -> Column:
    """File type by leading bytes and extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "25504446", "pdf")
        .when((head == "504B0304") & ext.isin("docx", "pptx", "xlsx"), ext)
        .when((head == "D0CF11E0") & ext.isin("doc", "xls", "ppt"), ext)
        .when(ext.isin("md", "markdown"), "md")
        .when(ext == "txt", "txt")
        .otherwise("unknown")
    )


def _paragraph(node) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] == "t")


def docx_text(raw: bytes) -> str:
    """Paragraphs in order, then each table's rows as cell | cell; runs of text by pattern where the XML doesn't parse."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml")
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        found = re.findall(rb"<(?:\w+:)?t(?:\s[^>]*)?>([^<]*)</(?:\w+:)?t>", xml)
        return "\n".join(x.decode("utf-8", "replace") for x in found)
    local = lambda n: n.tag.rpartition("}")[2]
    inside = {id(p) for t in root.iter() if local(t) == "tbl" for p in t.iter() if local(p) == "p"}
    out = [s for p in root.iter() if local(p) == "p" and id(p) not in inside and (s := _paragraph(p).strip())]
    for table in (t for t in root.iter() if local(t) == "tbl"):
        for row in (r for r in table.iter() if local(r) == "tr"):
            out.append(" | ".join(_paragraph(c).strip() for c in row if local(c) == "tc"))
    return "\n".join(out)


def pptx_text(raw: bytes) -> str:
    """Slides by number, divided by a rule."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = {int(m[1]): n for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        slides = []
        for k in sorted(names):
            root = ElementTree.fromstring(z.read(names[k]))
            lines = [_paragraph(p).strip() for p in root.iter() if p.tag.rpartition("}")[2] == "p"]
            slides.append("\n".join(x for x in lines if x))
    return "\n\n---\n\n".join(s for s in slides if s)


def xlsx_text(raw: bytes) -> str:
    """Each sheet as a Markdown table; blank rows are left out, the rule follows the first row if that isn't blank."""
    local = lambda n: n.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_paragraph(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"]
        sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        out = []
        for _, name in sheets:
            lines = []
            for k, row in enumerate(r for r in ElementTree.fromstring(z.read(name)).iter() if local(r) == "row"):
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c if local(v) == "v"), "") or (_paragraph(c) if c.get("t") == "inlineStr" else "")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(x.strip() for x in cells):
                    lines.append("| " + " | ".join(cells) + " |")
                    if k == 0:
                        lines.append("|" + " --- |" * len(cells))
            if lines:
                out.append("\n".join(lines))
    return "\n\n".join(out)


def images_of(raw: bytes, kind: str) -> dict[str, bytes]:
    """Pictures that an office file embeds, by name."""
    folder = {"docx": "word/media/", "pptx": "ppt/media/", "xlsx": "xl/media/"}[kind]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        return {n.removeprefix(folder): z.read(n) for n in z.namelist() if n.startswith(folder)}


PARSERS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace")}


def parse_files(files: DataFrame) -> DataFrame:
    """(path, kind, markdown, error) of binary files (path, content): a bad file is a row with its error, never a failed job.

    PDF and legacy office files need libraries that are not required here; their rows say so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                text = error = None
                try:
                    if kind not in PARSERS:
                        raise ValueError(f"no parser for {kind} files")
                    if len(content) > MOST_BYTES:
                        raise ValueError("the file is too large")
                    text = PARSERS[kind](bytes(content))
                except Exception as e:  # one bad file
                    error = f"{type(e).__name__}: {e}"
                out.append((path, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "kind", "markdown", "error"])

    kinds = files.select("path", sniffed_type(F.col("content"), F.col("path")).alias("kind"), "content")
    return kinds.mapInPandas(run, "path string, kind string, markdown string, error string")
