"""The queries over the driver's tables: one for each operator, in production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import crc_bucket, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docketry.llm.token_store import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.passages import shared_passages

    found = shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # each passage once for either of its documents
    sides = F.array(*(F.struct(F.col(f"doc_{a}").alias("doc_id"), F.col(f"doc_{b}").alias("other_id"), F.col(f"first_{a}").alias("first"), F.col(f"last_{a}").alias("last")) for a, b in ("ab", "ba")))
    return found.withColumn("side", F.explode(sides)).select("side.*", *found.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 4) == 2
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "toxic")
    held_out = crc_bucket("key", 5) == 0
    found = score(docs, learn(docs, labels, ~held_out))
    return found.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.simhash import components_within_two, fingerprint_text

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = components_within_two(docs)
    return found.select(F.col("id").alias("doc_id"), fingerprint_text("fp").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("print")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.licences import recognise

    found = recognise(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"), *(F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences", "unknown")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.mixing import mix_table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mix_table(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def page_records(pages: DataFrame) -> DataFrame:
    """Captures as WARC records: page_id is the date, every third page a 304 answer, the page's title its version."""
    title = F.md5(F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).cast("binary"))
    revisit = F.pmod("page_id", F.lit(3)) == 2
    tag = F.concat(F.when(F.pmod("page_id", F.lit(2)) == 0, "W/").otherwise(""), F.lit('"'), title, F.lit('"'))
    own = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=600"))
    new = F.create_map(F.lit("content-type"), F.lit("none"), F.lit("etag"), tag, F.lit("date"), F.col("page_id").cast("string"))
    body = [F.octet_length("html").cast("long").alias("body_bytes"), F.md5(F.col("html").cast("binary")).alias("body_md5")]
    return pages.select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("date"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, new).otherwise(own).alias("headers"), *body)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.warc import resolve

    found = resolve(page_records(table(spark, sf_dir, "pages")), ("body_bytes", "body_md5"))
    entries = F.array_sort(F.map_entries("headers"))
    line = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.select(F.col("id").alias("page_id"), F.col("base_id").alias("base_page_id"), "status", line.alias("headers"), "body_bytes", "body_md5")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, html, page_id % 3 = 2 AS revisit, '"' || md5(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) || '"' AS tag,
    regexp_replace(trim(url), '#.*$', '') AS bare
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest
  FROM p
), k AS (
  SELECT *, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|jsessionid|phpsessionid|sid)(=|$)'))) AS kept FROM q)
), b AS (
  SELECT r.page_id, r.tag, max(f.page_id) AS base FROM k r LEFT JOIN k f ON r.key = f.key AND NOT f.revisit AND f.page_id < r.page_id WHERE r.revisit GROUP BY 1, 2
)
SELECT b.page_id, b.base AS base_page_id,
  CASE WHEN f.page_id IS NULL THEN 'no_base' WHEN f.tag = b.tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN f.tag = b.tag THEN 'cache-control: max-age=600; content-type: text/html; date: ' || b.page_id || '; etag: ' || CASE WHEN b.page_id % 2 = 0 THEN 'W/' ELSE '' END || b.tag END AS headers,
  CASE WHEN f.tag = b.tag THEN octet_length(encode(f.html)) END AS body_bytes, CASE WHEN f.tag = b.tag THEN md5(f.html) END AS body_md5
FROM b LEFT JOIN k f ON b.base = f.page_id"""


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.multi_index import search

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.periodic import repeated, runs

    docs = table(spark, sf_dir, "documents")
    found = runs(docs.select("doc_id", repeated(F.col("doc_id"), F.col("text")).alias("text")))
    # of two runs the one with more length for its period (compared as products of whole numbers), the first of equal ones
    best = F.aggregate("runs", F.get("runs", 0), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    digest = [F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256) for c in (lines, F.col("collapsed"))]
    return found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), digest[0].alias("runs_sha256"), digest[1].alias("collapsed_sha256"))


def op12_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.migrate import migrate_clients

    return migrate_clients(table(spark, sf_dir, "clients"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docketry.llm.byte_bpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = decode(encode(table(spark, sf_dir, "documents"), *ranks), *ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_store, op2_passages, op3_language_id, op4_toxicity, op5_simhash_components, op6_decontamination, op7_licences, op8_mixing, op9_warc_revisits, op10_multi_index, op11_periodic_runs, op12_schema_rewrite, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    from docketry.llm import licences

    return {"op7_licences": licences.oracle(), "op9_warc_revisits": OP9_SQL}
