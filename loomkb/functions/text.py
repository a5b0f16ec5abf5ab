"""Scalar text functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_ascii(text: Column) -> Column:
    """How many characters lie outside ASCII."""
    return F.char_length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def token_estimate(text: Column) -> Column:
    """Each non-ASCII character is a token, four other bytes are one (integer division)."""
    na = non_ascii(text)
    return (na + F.floor((F.octet_length(text) - na) / 4)).cast("long")


def chunk_hash(owner: Column, text: Column) -> Column:
    """Hex SHA-256 of owner:text, so that equal texts of two owners differ."""
    return F.sha2(F.concat(owner.cast("string"), F.lit(":"), text), 256)


def slugify(text: Column) -> Column:
    """Lower case, runs of other characters than a-z0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def truncate_text(text: Column, most: int, mark: str = "...") -> Column:
    """The first ``most`` characters and a mark, if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def rune_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters that start every size - overlap, up to the one that reaches the end."""
    step = size - overlap if overlap < size else size
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(size))))


def escape_like(keyword: str) -> str:
    """Backslash, percent and underscore escaped for LIKE."""
    return keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ilike(column: Column, keyword: str, escaped: bool = True) -> Column:
    """Case-insensitive LIKE %keyword%; unescaped keywords keep their wildcards."""
    return column.ilike(f"%{escape_like(keyword) if escaped else keyword}%")


def decode_entities(text: Column) -> Column:
    """The seven named references that search snippets use; the ampersand last, so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_html(page: Column) -> Column:
    """Text of a page: hidden elements and tags removed, references decoded, white space squeezed."""
    bare = F.regexp_replace(page, r"(?is)<(script|style|noscript|iframe)\b[^>]*>.*?</(script|style|noscript|iframe)>", "")
    bare = decode_entities(F.regexp_replace(bare, "<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


#: The blocks of Han characters.
HAN = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and each Han character by itself, as it is without a dictionary; one-byte ones are no tokens."""
    apart = F.when(text.rlike(HAN), F.regexp_replace(text, f"({HAN})", " $1 ")).otherwise(text)
    found = F.regexp_extract_all(F.lower(apart), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda t: F.octet_length(t) > 1)


def is_token(token: Column) -> Column:
    """Neither empty, blank, one ASCII byte nor punctuation and symbols alone."""
    return token.rlike(r"[^\p{P}\p{S}\s]") & (F.octet_length(token) > 1)


def front_matter(content: Column) -> tuple[Column, Column]:
    """Fields (a map, split at the first colon) and body of a text that opens with a --- block."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    shape = r"(?s)^---\n(.*?)\n?---(?:\n|$)"
    block = F.regexp_extract(text, shape, 1)
    has = text.rlike(shape)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    # a repeated key keeps its last value
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    fields = F.when(has, F.map_from_entries(last)).otherwise(F.map_from_entries(F.slice(pairs, 1, 0)))
    return fields, F.when(has, F.regexp_replace(text, shape, "")).otherwise(text)


def tag_list(value: Column) -> Column:
    """The items of [a, b]."""
    inner = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
    return F.filter(items, lambda x: x != "")


def normalised_tags(tags: Column, most: int = 10) -> Column:
    """Trimmed, without empty and repeated ones, in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")), 1, most)


def render_front_matter(fields: list[tuple[str, Column]], title: Column, body: Column) -> Column:
    """A text with its fields in the given order, then its title and body."""
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n# "), title, F.lit("\n\n"), body)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def has_permission(held: Column, required: Column) -> Column:
    """Any required permission is held: equal, by * or by a prefix*; nothing required means no."""
    return F.exists(required, lambda r: F.exists(held, lambda p: (r == p) | (p.endswith("*") & r.startswith(F.regexp_replace(p, r"\*$", "")))))


def valid_password(text: Column) -> Column:
    """8 to 32 characters with a lower-case and an upper-case letter and a digit."""
    return F.char_length(text).between(8, 32) & text.rlike(r"\p{Ll}") & text.rlike(r"\p{Lu}") & text.rlike(r"\p{Nd}")


def public_url(url: Column) -> Column:
    """http or https with a host that is not local, private or link-local."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    private = host.rlike(r"^(localhost|.*\.localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|0\..*|\[::1?\]|\[f[cde].*\])$")
    return url.rlike(r"(?i)^https?://") & (host != "") & ~private


def search_results(page: Column) -> Column:
    """Links of a result page: their target (from a redirect's uddg field where there is one) and title."""
    links = F.regexp_extract_all(page, F.lit(r"(?is)(<a\b[^>]*class=\"[^\"]*result__a[^\"]*\"[^>]*>.*?</a>)"), 1)

    def one(a: Column) -> Column:
        href = F.replace(F.regexp_extract(a, r"(?is)href=\"([^\"]*)\"", 1), F.lit("&amp;"), F.lit("&"))
        behind = F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1)
        url = F.when(behind != "", F.url_decode(behind)).otherwise(href)
        return F.struct(url.alias("url"), F.trim(decode_entities(F.regexp_replace(a, "<[^>]+>", ""))).alias("title"))

    return F.transform(links, one)
