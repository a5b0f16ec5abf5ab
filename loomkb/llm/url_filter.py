"""URL block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: (verdict, host, path prefix) of the production rules.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comments, elements whose contents are no markup, and tags with their quoted values, from left to right. No part of it
#: gives back what it has taken, so a page takes time in proportion to its length, whatever is left open in it.
PIECES = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)|</?[a-z](?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+>?"
#: The tags that declare something.
DECLARING = r"(?is)^<(?:link|meta|base)[\s/]"
#: A tag's attributes, one after the other, so that none is found within another's value.
ATTRIBUTE = r"(?is)[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?"
#: The target in a refresh's content.
REFRESH_URL = r"(?is)\burl\s*+=\s*+[\"']?([^\"'>\s]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its verdict, null where none fits.

    Ties in length go to allow, then to the longer host.
    """
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", len(r[1])))
    for what, h, p in ordered:  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def alias_key(url: Column) -> Column:
    """Host, path and query: what one resource's urls share whatever their scheme and fragment."""
    host = host_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1), F.lit(""))
    return F.when(host != "", F.concat(host, path_of(url), query))


def folded(path: Column) -> Column:
    """An absolute path without its . and .. segments."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


#: Named character references that can stand in a url.
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}


def unescaped(t: Column) -> Column:
    """``t`` with its numeric and NAMED character references decoded, once."""

    def one(part: Column) -> Column:
        name, rest = F.regexp_extract(part, r"(?s)^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-z]+);", 1), F.regexp_extract(part, r"(?s)^[^;]*;(.*)$", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.concat(letter, rest))
        for n, c in NAMED.items():
            out = out.when(name == n, F.concat(F.lit(c), rest))
        return out.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(t, "&")
    return F.when(t.contains("&"), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(t)


def resolved(t: Column, url: Column) -> Column:
    """The absolute form of a reference on the page ``url``; null for an empty or fragment-only one and for schemes without //."""
    t = F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url)))
    own, rest = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when((t == "") | t.startswith("#"), F.lit(None).cast("string"))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(root, folded(own), rest))
        .when(t.startswith("?"), F.concat(root, path_of(url), t))
        .otherwise(F.concat(root, folded(F.concat(folder, own)), rest))
    )


def _let(value: Column, body) -> Column:
    """``body`` of a lambda's variable, so that ``value`` stands in the plan once."""
    return F.transform(F.array(value), body)[0]


def attributes(tag: Column) -> Column:
    """A tag's attributes that matter here, in order, each as it is written."""
    inside = F.regexp_replace(tag, r"(?s)^</?[A-Za-z][^\s/>]*+", "")
    return F.filter(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 0), lambda a: a.rlike(r"(?i)^(?:rel|href|content|http-equiv)(?=[\s=]|$)"))


def value_of(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name, without its quotes; null if there is none."""
    first = F.get(F.filter(attrs, lambda a: a.rlike(rf"(?i)^{name}(?=[\s=]|$)")), F.lit(0))
    value = F.regexp_extract(first, r"(?s)^[^=]*+=\s*+(.*)$", 1)
    return _let(value, lambda v: F.when(v.rlike(r"(?s)^([\"']).*\1$"), F.regexp_extract(v, r"(?s)^.(.*).$", 1)).otherwise(v))


def declared_targets(url: Column, html: Column) -> Column:
    """Absolute targets of all canonical links and refresh redirects of a page, in page order (array, nulls possible).

    Tags in comments, scripts and other raw elements declare nothing; ``rel`` is
    read word by word and names of attributes whole.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(PIECES), 0), lambda t: t.rlike(DECLARING))

    def target(tag: Column) -> Column:
        def read(a: Column) -> Column:
            rel = F.array_contains(F.split(F.trim(_lower(value_of(a, "rel"))), r"\s+"), "canonical")
            refresh = F.trim(_lower(value_of(a, "http-equiv"))) == "refresh"
            moved = _let(_let(value_of(a, "content"), unescaped), lambda c: F.nullif(F.regexp_extract(c, REFRESH_URL, 1), F.lit("")))
            return F.when(tag.rlike(r"(?i)^<link") & rel, _let(value_of(a, "href"), unescaped)).when(tag.rlike(r"(?i)^<meta") & refresh, moved)

        return _let(attributes(tag), read)

    def found(tags: Column) -> Column:
        bases = F.filter(F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base")), lambda t: value_of(attributes(t), "href")), lambda x: x.isNotNull())
        base = F.coalesce(_let(_let(F.get(bases, F.lit(0)), unescaped), lambda t: resolved(t, url)), url)
        named = F.filter(F.transform(tags, target), lambda t: t.isNotNull())
        return _let(base, lambda b: F.transform(named, lambda t: resolved(t, b)))

    return _let(tags, found)


def judge_urls(spark: SparkSession, pages: DataFrame, *, redirects: DataFrame | None = None, rules=RULES, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict and how the verdict came about.

    A url's own longest rule decides. Urls without one take the decision of
    their alias component: edges are all canonical links and refresh redirects
    of the pages, resolved on the page's url or its base element, and the rows of
    ``redirects`` (source, target); scheme and fragment do not tell urls apart. A component with an explicitly allowed member is allowed,
    else one with a blocked member is blocked; without either, allow is the
    default. Targets take part with their own rules though they are no page.

    All steps are DataFrame expressions. Decisions combine before the shuffle
    and the component join can be split, so one hot host or target does not
    load one task. Null or malformed urls have empty host and path and, having
    no alias, are allowed; null html declares nothing; repeated rows are judged
    alike; other columns pass through unless they clash with the new ones.
    """
    scratch = Scratch(spark, "url-filter")
    url = F.col(url_col)
    key = alias_key(url)
    edges = redirects.select(F.col("source").alias("s"), F.col("target").alias("t")) if redirects is not None else None
    if html_col:
        own = pages.where(F.col(html_col).rlike(r"(?i)canonical|refresh")).select(url.alias("s"), F.explode(declared_targets(url, F.col(html_col))).alias("t"))
        edges = own if edges is None else edges.union(own)
    ends = edges.where("t IS NOT NULL AND s IS NOT NULL") if edges is not None else pages.select(url.alias("s"), url.alias("t")).limit(0)
    linked = scratch.write(
        ends.select("s", "t", alias_key(F.col("s")).alias("u"), alias_key(F.col("t")).alias("v")).distinct(), "edges"
    )
    groups = scratch.write(connected_components(linked.select("u", "v"), scratch), "groups")

    def verdicts(df, c):
        return df.select(alias_key(c).alias("key"), matched_rule(host_of(c), path_of(c), rules)[1].alias("own")).where("own IS NOT NULL AND key IS NOT NULL")

    known = verdicts(pages.select(url_col), url).union(verdicts(linked, F.col("s"))).union(verdicts(linked, F.col("t")))
    known = known.groupBy("key").agg(F.min("own").alias("own"))  # allow sorts before block
    named = known.join(groups, known["key"] == groups["node"])
    decided = named.groupBy("component").agg(F.min("own").alias("said"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    clash = {"host", "path", "rule", "verdict", "via", "node", "component", "said", "_key", "_own"} - {url_col}
    out = pages.select(*[c for c in pages.columns if c not in clash])
    out = out.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("_key", key)
    out = out.withColumn("rule", rule).withColumn("_own", verdict)
    out = out.join(groups, out["_key"] == groups["node"], "left").withColumnRenamed("component", "_at").drop("node")
    out = out.join(decided, out["_at"] == decided["component"], "left")
    return out.withColumn("verdict", F.coalesce("_own", "said", F.lit("allow"))).withColumn(
        "via", F.when(F.col("_own").isNotNull(), "rule").when(F.col("said").isNotNull(), "alias").otherwise("default")
    ).drop("_key", "_own", "_at", "said", "component")
