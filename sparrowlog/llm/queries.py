"""The queries of this package, for the entry module to add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written


def _rest(n: int) -> str:
    """The fold of a row: crc32 of its doc_id as text, modulo n (a null id counts as empty text)."""
    return f"crc32(coalesce(cast(doc_id as string), '')) % {n}"


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import learn, predict

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr(f"{_rest(3)} = 1"))
    model = learn(docs.where("not held_out"))
    return predict(docs, model, keep=("doc_id", "held_out"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr(f"{_rest(5)} = 0"))
    model = learn(docs, table(spark, sf_dir, "labels"), allowed=f"{_rest(5)} <> 0")
    return score(docs, model, keep=("doc_id", "held_out"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also near_docs: for every 50th document, how many others have a fingerprint within 3 bits; null for the rest."""
    from .simhash import edited, fingerprints, hex_of, likeness, text_key, with_next, within_radius

    rows = edited(with_next(table(spark, sf_dir, "documents")))
    prints = fingerprints(rows.select(F.explode(F.array("text", "edited")).alias("text")))
    keys = [k.alias(f"{c}{i}") for c, t in (("t", "text"), ("e", "edited"), ("n", "next_text")) for i, k in enumerate(text_key(t), 1)]
    out = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *keys)
    for c in "ten":
        out = out.join(prints.select(F.col("k1").alias(f"{c}1"), F.col("k2").alias(f"{c}2"), F.col("f1").alias(f"{c}f1"), F.col("f2").alias(f"{c}f2")), [f"{c}1", f"{c}2"])
    out = written(out.drop(*(f"{c}{i}" for c in "ten" for i in (1, 2))), "fingerprints")
    base = out.groupBy(F.col("tf1").alias("f1"), F.col("tf2").alias("f2")).agg(F.count("*").alias("n"))
    asks = out.where("doc_id % 50 = 0").select(F.col("tf1").alias("f1"), F.col("tf2").alias("f2"))
    near = within_radius(asks, base, radius=3).join(base, ["f1", "f2"]).groupBy(F.col("q1").alias("tf1"), F.col("q2").alias("tf2")).agg((F.sum("n") - 1).alias("near"))
    return out.join(near, ["tf1", "tf2"], "left").select(
        "doc_id", "n_chars", "edited_sha256", hex_of("tf1", "tf2").alias("fingerprint"), hex_of("ef1", "ef2").alias("edited_fingerprint"),
        likeness(("tf1", "tf2"), ("ef1", "ef2")).alias("near_edited"), likeness(("tf1", "tf2"), ("nf1", "nf2")).alias("near_next"), F.expr("if(doc_id % 50 = 0, near, null)").alias("near_docs"),
    )


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's number of pieces, a hash of their ids, and whether decoding gives the text again."""
    from .piece_codec import decode, encode, load_model

    model = load_model(tokenizer_path())
    ids = encode(table(spark, sf_dir, "documents"), model, keep=("doc_id", "text"))
    ids = ids.select("doc_id", "ids", F.xxhash64("ids").alias("ids_hash"), F.xxhash64(F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")).alias("text_hash"))
    back = decode(ids.withColumn("n_pieces", F.size("ids").cast("long")), model, keep=("doc_id", "n_pieces", "ids_hash", "text_hash"))
    return back.select("doc_id", "n_pieces", "ids_hash", (F.xxhash64("decoded") == F.col("text_hash")).alias("same_text"))


def tokenizer_path() -> str:
    """The vocabulary file: setting ``spark.sparrowlog.pieces``, or that of the public tokenizers' package."""
    session = SparkSession.getActiveSession()
    path = session.conf.get("spark.sparrowlog.pieces", None) if session else None
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def list_entries(pages: DataFrame) -> DataFrame:
    """Three dated lists made from the hosts of ``pages`` alone, as no table of lists is given; days count from 0."""
    from .url_filters import host_of

    hosts = pages.select(host_of().alias("host"), "page_id").where("host <> ''").groupBy("host").agg(F.min("page_id").alias("m"))
    entry = lambda name, kind, pattern, action, at, when="true": f"if({when}, named_struct('list', '{name}', 'kind', '{kind}', 'pattern', {pattern}, 'action', '{action}', 'at', cast({at} as int)), null)"
    each = [
        entry("abuse", "domain", "host", "add", "m % 200"), entry("abuse", "domain", "host", "remove", "m % 200 + 60 + m % 40"), entry("abuse", "domain", "host", "add", "m % 200 + 150", "m % 3 = 0"),
        entry("spam", "prefix", "concat(host, '/en/')", "add", "m % 100", "m % 2 = 0"), entry("spam", "prefix", "concat(host, '/en/')", "remove", "250", "m % 2 = 0"),
        entry("words", "word", "split(host, '[.]')[0]", "add", "m % 300", "m % 4 = 1"),
    ]
    return hosts.select(F.inline(F.expr(f"filter(array({', '.join(each)}), e -> e is not null)")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import evaluate

    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("cast(page_id % 365 as int)").alias("fetched"))
    return evaluate(captures, list_entries(pages))


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(page_id % 365 AS INT) AS fetched, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2) AS host,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT host, min(page_id) AS m FROM p WHERE host <> '' GROUP BY host),
spans AS (
  SELECT 'abuse' AS list, 'domain' AS kind, host AS pattern, m % 200 AS since, m % 200 + 60 + m % 40 AS until FROM h
  UNION ALL SELECT 'abuse', 'domain', host, m % 200 + 150, NULL FROM h WHERE m % 3 = 0
  UNION ALL SELECT 'spam', 'prefix', host || '/en/', m % 100, 250 FROM h WHERE m % 2 = 0
  UNION ALL SELECT 'words', 'word', w, min(s), NULL FROM (SELECT split_part(host, '.', 1) AS w, m % 300 AS s FROM h WHERE m % 4 = 1) GROUP BY w),
met AS (
  SELECT DISTINCT p.page_id, list, kind, pattern FROM p JOIN spans ON fetched >= since AND (until IS NULL OR fetched < until) AND CASE kind
    WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
    WHEN 'prefix' THEN starts_with(host || path, pattern)
    ELSE list_contains(regexp_split_to_array(host || path, '[^a-z0-9]+'), pattern) END),
agg AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met GROUP BY page_id)
SELECT p.page_id, host, fetched, coalesce(n, 0) AS n_rules, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked FROM p LEFT JOIN agg ON p.page_id = agg.page_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    return taken(mix(table(spark, sf_dir, "documents"))).drop("source")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derived records a page, by their identifiers, digests and lengths."""
    from .warc import derivatives, responses

    made = derivatives(responses(table(spark, sf_dir, "pages")))
    return made.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "content_length",
        F.sha2(F.col("header").cast("binary"), 256).alias("header_sha256"), F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"),
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


QUERIES = {
    "op1_piece_codec": op1_piece_codec, "op2_toxicity": op2_toxicity, "op3_url_filters": op3_url_filters, "op4_jaccard_join": op4_jaccard_join, "op5_mixing": op5_mixing,
    "op6_html_text": op6_html_text, "op7_simhash": op7_simhash, "op8_language_id": op8_language_id, "op9_warc": op9_warc, "op10_ann": op10_ann,
}
ORACLE_SQL: dict[str, str] = {"op3_url_filters": OP3_SQL}
