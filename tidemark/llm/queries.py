"""The numbered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dialogue, fill_middle, langid, licenses, line_dedup, main_text, mixing, neighbours, packing, simhash, token_counts, winnow
from tidemark.llm.shards import shard_by_ring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of documents by a bounded-load ring; law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_by_ring(docs, F.col("doc_id"), shards=16, vnodes=64, tie=[F.col("size"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "fit")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by its SimHash."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edit by the next."""
    return winnow.edit_likeness(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector with an id divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay; near-equal lines stay once in the table."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_kept")


def domain(source: Column) -> Column:
    """The domain of a source: by its number, 0 to 9 web, 10 to 14 reference, others forum."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "unknown").when(number.cast("int") < 10, "web").when(number.cast("int") < 15, "reference").otherwise("forum")


#: Target weights of siblings at each level of the tree.
WEIGHTS = {"domain": {"web": 50, "reference": 30, "forum": 15, "unknown": 5}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}
SHARE, EPOCHS, MIX_SEED = 0.8, 2, 1


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen to the weights of the domain, language and source tree, for each epoch."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain(F.col("source")))
    found = mixing.mix(docs, ["domain", "lang", "source"], WEIGHTS, share=SHARE, epochs=EPOCHS, seed=MIX_SEED, with_text=False)
    return found.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, and the paragraphs that name them."""
    return licenses.licences(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from that."""
    found = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits and the hash of the repaired rows."""
    return dialogue.repair(dialogue.damaged(_table(spark, sf_dir, "conversations")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_shard_ring": op1_shard_ring, "op2_language_id": op2_language_id, "op3_simhash": op3_simhash, "op4_winnowing": op4_winnowing, "op5_neighbours": op5_neighbours, "op6_line_dedup": op6_line_dedup, "op7_mixing": op7_mixing, "op8_main_text": op8_main_text, "op9_packing": op9_packing, "op10_licences": op10_licences, "op11_fill_middle": op11_fill_middle, "op12_dialogue_repair": op12_dialogue_repair, "op13_token_counts": op13_token_counts}


def _filled(table: str, parent: str, name: str) -> str:
    """SQL that gives each parent's budget to its children by weight, up to their cap."""
    ranked = f"PARTITION BY {parent} ORDER BY cap / weight, {name} NULLS FIRST"
    sums = f"SELECT *, coalesce(sum(cap) OVER ({ranked} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER ({ranked} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM {table} WHERE weight > 0"
    marks = f"SELECT *, cap * onward <= weight * (budget - before) AS filled FROM ({sums}) s"
    return f"SELECT *, CASE WHEN filled THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER (PARTITION BY {parent}), 0)) / sum(CASE WHEN NOT filled THEN weight END) OVER (PARTITION BY {parent}) END AS given FROM ({marks}) m"


def _weights(name: str) -> str:
    cases = " ".join(f"WHEN '{value}' THEN {weight}" for value, weight in WEIGHTS[name].items())
    return f"CAST(CASE {name} {cases} ELSE 1 END AS DOUBLE)"


MIXING_SQL = f"""
WITH docs AS (
  SELECT *, CASE WHEN number = '' THEN 'unknown' WHEN CAST(nullif(number, '') AS INTEGER) < 10 THEN 'web' WHEN CAST(nullif(number, '') AS INTEGER) < 15 THEN 'reference' ELSE 'forum' END AS domain
  FROM (SELECT doc_id, lang, source, coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS number, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS tokens FROM documents) d),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS have, CAST(sum(tokens) AS DOUBLE) * {EPOCHS} AS cap FROM docs GROUP BY domain, lang, source),
tops AS (SELECT domain, sum(cap) AS cap, (SELECT CAST(sum(have) AS DOUBLE) * {SHARE} FROM leaves) AS budget, {_weights("domain")} AS weight FROM leaves GROUP BY domain),
top AS ({_filled("tops", "1", "domain")}),
mids AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, max(t.given) AS budget, {_weights("lang").replace("CASE lang", "CASE l.lang")} AS weight FROM leaves l JOIN top t ON l.domain = t.domain GROUP BY l.domain, l.lang),
mid AS ({_filled("mids", "domain", "lang")}),
lows AS (SELECT l.*, m.given AS budget, CAST(1 AS DOUBLE) AS weight FROM leaves l JOIN mid m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang),
low AS ({_filled("lows", "domain, lang", "source")}),
plan AS (SELECT *, given - "full" * have AS rest FROM (SELECT domain, lang, source, have, given, CAST(least(CASE WHEN have > 0 THEN floor(given / have) ELSE 0 END, {EPOCHS}) AS INTEGER) AS "full" FROM low) p),
placed AS (SELECT d.*, p."full", p.rest, md5('{MIX_SEED}/' || p."full" || '/' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS place FROM docs d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed),
chosen AS (SELECT *, "full" + CASE WHEN "full" < {EPOCHS} AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INTEGER) AS epoch FROM (SELECT *, unnest(range(times)) AS epoch FROM chosen) c
"""


FILL_MIDDLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the other operators; they are tested against brute force."""
    return {"op7_mixing": MIXING_SQL, "op11_fill_middle": FILL_MIDDLE_SQL}
