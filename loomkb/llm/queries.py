"""The registered queries of this subpackage: thin forms of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import bpe_round_trip
from .common import Scratch
from .exact_dedup import exact_dedup
from .filter_audit import audit
from .html_text import extract_text
from .impact_search import search
from .jaccard_join import shingle_components
from .lm_scoring import score_texts
from .packing import pack_documents
from .quality import fit_quality, score_quality
from .substrings import substring_dedup
from .token_files import document_checksums, read_token_files, write_token_files
from .url_filter import judge_urls


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    pieces = pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels must not be learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = score_quality(spark, docs.select("doc_id", "text"), fit_quality(spark, docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are 0.9 similar."""
    return shingle_components(spark, table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    coded = bpe_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    out = exact_dedup(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document places and checksums from token-id files written and read back."""
    files = Scratch(spark, "token-files")
    write_token_files(spark, table(spark, sf_dir, "documents"), files.base, tokenizer=tokenizer_path("byte_bpe_50k.json"))
    return document_checksums(read_token_files(spark, files.base))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(spark, vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when windows of 20 words that began earlier go."""
    out = substring_dedup(spark, table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by its url's rule or its aliases."""
    return judge_urls(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten highest-scoring documents."""
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of each order of the five filters keeps and removes, by source."""
    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_held_out(doc_id: str = "doc_id") -> Column:
    """Whether the language model must not learn from a document; a null id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the language model, beside that by smoothed word counts."""
    out = score_texts(spark, table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("byte_bpe_50k.json"), learn=~lm_held_out())
    return out.select("doc_id", lm_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_quality": op2_quality,
        "op3_html_text": op3_html_text,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_bpe": op5_bpe,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_token_files": op7_token_files,
        "op8_nearest": op8_nearest,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_ranked_search": op11_ranked_search,
        "op12_filter_audit": op12_filter_audit,
        "op13_lm_scoring": op13_lm_scoring,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(LOWER)} AS ws FROM documents),
tok AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(ws) - 1))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM tok a JOIN tok b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)"""

OP6_SQL = f"""WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

OP9_SQL = f"""WITH w AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i) WHERE len(ws) >= 20),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i, true AS gone FROM again, (SELECT unnest(range(0, 20)) AS k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS k FROM words LEFT JOIN covered USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: The tables' pages declare no canonical link and no redirect, so rules alone decide in SQL.
OP10_SQL = r"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(v, h, s) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, h || s AS rule, v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)"""

OP11_SQL = r"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT * FROM t WHERE len(ts) > 0), c AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * n) // l AS m FROM d, c),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY 1),
s AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY 1, 2, 3),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10"""

OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM w JOIN g USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, len(list_filter(f, lambda x: x)) AS k, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2, 3),
x(i) AS (SELECT unnest(range(1, 6))),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda q: chr((64 + q)::INTEGER)), '') AS filter_order, i AS step, p[i] AS fi, p[1 : i - 1] AS before FROM o, x),
r AS (SELECT part, filter_order, step, n, good, toxic, k, f[fi] AS fails, len(list_filter(before, lambda q: f[q])) > 0 AS gone FROM c, s)
SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(k, 1))) FILTER (fails), 0)::BIGINT AS shapley FROM r GROUP BY 1, 2, 3"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op9_substring_dedup": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_filter_audit": OP12_SQL}
