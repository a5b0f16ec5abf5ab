"""Labels, JSON answers, file names and references: small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of state codes, media types by extension, article types.
TICKET_STATES = {1: "待处理", 2: "处理中", 3: "需补充信息", 4: "已解决", 5: "已关闭", 6: "已撤回"}
MESSAGE_KINDS = {
    "ticket_supplement": "补充信息",
    "ticket_resolved": "已解决",
    "ticket_closed": "已关闭",
    "ticket_overdue": "处理超时",
    "knowledge_approved": "审核通过",
    "knowledge_rejected": "审核驳回",
    "system": "系统通知",
}
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp"}
ARTICLE_TYPES = ["guide", "reference", "procedure", "analysis", "note", "faq", "snippet"]


def label(code: Column, names: dict, default: str | None = "未知") -> Column:
    """The text of a state code or kind; the code itself where there is no default."""
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    key = code.cast("int") if all(isinstance(k, int) for k in names) else code
    return F.coalesce(F.try_element_at(pairs, key), code.cast("string") if default is None else F.lit(default))


def media_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for item in MEDIA_TYPES.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, ext), F.lit("application/octet-stream"))


def json_block(answer: Column) -> Column:
    """From the first brace to the last one, so that fences and talk around an object fall away."""
    return F.regexp_extract(answer, r"(?s)(\{.*\})", 1)


def verdict_of(answer: Column) -> Column:
    """level and reason of a model's JSON verdict; ambiguous if it isn't one."""
    parsed = F.from_json(json_block(answer), "level string, reason string")
    known = parsed["level"].isin("strong", "ambiguous", "weak")
    return F.struct(F.when(known, parsed["level"]).otherwise("ambiguous").alias("level"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"))


def completed_type(existing: Column, answer: Column) -> Column:
    """The article's type if allowed, else the one a model's JSON suggests, else guide."""
    suggested = F.from_json(json_block(answer), "type string, tags array<string>")["type"]
    return F.when(existing.isin(ARTICLE_TYPES), existing).when(suggested.isin(ARTICLE_TYPES), suggested).otherwise("guide")


def image_name(old: Column, content: Column) -> Column:
    """A picture's name by its content: 16 hex digits of its SHA-256 and the old extension."""
    return F.concat(F.left(F.sha2(content, 256), F.lit(16)), F.regexp_extract(old, r"(\.\w+)$", 1))


def rewritten_images(markdown: Column, names: Column) -> Column:
    """Markdown and img references to the keys of a map as image/value; external ones stay."""
    entries = F.map_entries(F.coalesce(names, F.create_map().cast("map<string,string>")))
    return F.aggregate(
        entries,
        markdown,
        lambda text, e: F.replace(
            F.replace(text, F.concat(F.lit("]("), e["key"], F.lit(")")), F.concat(F.lit("](image/"), e["value"], F.lit(")"))),
            F.concat(F.lit('src="'), e["key"], F.lit('"')),
            F.concat(F.lit('src="image/'), e["value"], F.lit('"')),
        ),
    )


def ticket_number(day: Column, number: Column) -> Column:
    """TK-yyyymmdd-nnnnnn from a day and a running number."""
    return F.concat(F.lit("TK-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(F.pmod(number, F.lit(1_000_000)).cast("string"), 6, "0"))


def external_source(src: Column) -> Column:
    return src.rlike("^(https?://|data:)")


def valid_phone(text: Column) -> Column:
    return text.rlike(r"^1[3-9]\d{9}$")


def masked(text: Column) -> Column:
    """The first and last four characters of a secret, all hidden in a short one."""
    return F.when(F.char_length(text) <= 8, F.lit("****")).otherwise(F.concat(F.left(text, F.lit(4)), F.lit("****"), F.right(text, F.lit(4))))
