"""Registered queries of the corpus operators and their DuckDB oracle text.

Every query applies its operator with production parameters to the whole
table and derives the contract's columns from the operator's own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import (
    chat, decontaminate, exact_dedup, hmm, importance, lexical, mixing, quality, sharding, simhash, token_counts, token_ids, toxicity,
)
from txlens.llm.common import bound_batches, read, text_or_empty, utf8
from txlens.llm.statistics import document_statistics
from txlens.session import checkpoint_dir, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_quality_classifier")
def op1(spark, sf_dir):
    bound_batches(spark)
    docs = read(spark, sf_dir, "documents")
    features = materialize(docs.select("doc_id", document_statistics(utf8()).alias("x")))
    held_out = F.pmod(quality.crc(F.col("doc_id")), F.lit(4)) == 2
    model = quality.fit(materialize(quality.training_rows(features.filter(~held_out), read(spark, sf_dir, "labels"))))
    scored = features.select("doc_id", held_out.alias("held_out"), quality.scorer(model)(F.col("x")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


@register("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op3_histogram_sharding")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", sharding.row_size().alias("size"), F.crc32(utf8()).alias("text_crc32"))
    placed = sharding.shard_documents(docs, 40, size=F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op4_edit_token_counts")
def op4(spark, sf_dir):
    """Three edits a document, placed by its id: an insertion, a deletion and a
    replacement by upper case; counts before and after, from the edited tree."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", text_or_empty().alias("text"))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length("text") + 1).cast("long")
    edit = lambda start, n, insert: F.struct(
        start.alias("start"), n.cast("long").alias("n_delete"), insert.alias("insert"))
    edits = F.array(
        edit(at(1), F.lit(0), F.concat(F.lit(" "), F.coalesce("source", F.lit("none")), F.lit(" inserted\n"))),
        edit(at(2), F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(200)), F.lit("")),
        edit(at(3), F.lit(40), F.upper(F.substring("text", 1, 40))))
    counted = token_counts.build_state(docs).withColumn("edits", edits)
    done = token_counts.apply_edits(counted)
    tokens = F.aggregate("state.tokens", F.lit(0).cast("long"), lambda a, b: a + b)
    return done.select("doc_id", F.length("text").cast("long").alias("n_chars"), tokens.alias("n_tokens"),
                       F.size("state.tokens").alias("n_leaves"), F.size("edits").alias("n_edits"),
                       F.length("edited.text").cast("long").alias("n_chars_edited"),
                       F.col("edited.n_tokens").alias("n_tokens_edited"), "edited.chars_encoded", "edited.nodes_updated",
                       F.crc32(F.col("edited.text").cast("binary")).alias("edited_crc32"))


@register("op5_hmm_language_model")
def op5(spark, sf_dir):
    held_out = F.pmod(quality.crc(F.col("doc_id")), F.lit(7)) == 2
    scored = hmm.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@register("op6_chat_rotation", sql="""
WITH said AS (
  SELECT conv_id, turn, coalesce(nullif(trim(translate(replace(replace(coalesce(role, ''), '<|', '< |'), '|>', '| >'),
           chr(10) || chr(13), '  ')), ''), 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|', '< |'), '|>', '| >') AS text FROM conversations),
placed AS (
  SELECT conv_id, speaker, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS pos FROM said),
views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
heads AS (
  SELECT m.conv_id, v.perspective, pos, pos // 256 AS part, m.speaker = v.perspective AS mine, text,
         CASE WHEN m.speaker = 'system' THEN '<|system|>' WHEN m.speaker = v.perspective THEN '<|assistant|>'
              ELSE '<|user:' || m.speaker || '|>' END || chr(10) AS head
  FROM placed m JOIN views v ON m.conv_id IS NOT DISTINCT FROM v.conv_id),
pieces AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM heads),
spans AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS s FROM pieces)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_messages,
       count(*) FILTER (WHERE mine) AS n_trained, string_agg(piece, '' ORDER BY pos) AS text,
       coalesce(string_agg(s || '-' || (s + length(piece) - length(head) - 1), ',' ORDER BY pos) FILTER (WHERE mine), '') AS mask
FROM spans GROUP BY conv_id, perspective, part
""")
def op6(spark, sf_dir):
    views = chat.rotate(read(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return views.withColumn("mask", F.array_join(spans, ","))


@register("op7_temperature_mixing", sql="""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, 'null') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS doc_key
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS n_docs FROM docs GROUP BY source),
shares AS (SELECT *, CASE WHEN tokens > 0 THEN tokens / (SELECT sum(tokens) FROM sources)::DOUBLE END AS p FROM sources),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(pow(p, (lo + hi) / 2 - 1)) * max(pow(p, 1 - (lo + hi) / 2)) FROM shares) <= 2.0 AS ok
        FROM bisect WHERE step < 30)),
exponent AS (
  SELECT CASE WHEN (SELECT max(pow(p, -1.0)) * max(p) FROM shares) <= 2.0 THEN 0.0 ELSE hi END AS a
  FROM bisect WHERE step = 30),
weighted AS (
  SELECT s.*, pow(p, a) AS power, (SELECT sum(pow(p, a)) FROM shares) AS z,
         (SELECT max(tokens / pow(p, a)) FROM shares) AS c
  FROM shares s, exponent),
budgets AS (
  SELECT source, tokens, n_docs, coalesce(power / z, 0.0) AS weight,
         CAST(floor(coalesce(c * power, 0.0) + 1e-6) AS BIGINT) AS budget FROM weighted),
parts AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole,
         CASE WHEN tokens > 0 THEN budget - (budget // tokens) * tokens ELSE 0 END AS rest,
         CAST(ceil(n_docs / 1024.0) AS BIGINT) AS n_blocks FROM budgets),
blocked AS (
  SELECT d.*, whole, rest, weight,
         CAST('0x' || substr(md5('7:block:' || doc_key), 1, 15) AS BIGINT) % n_blocks AS block
  FROM docs d JOIN parts USING (source)),
ordered AS (
  SELECT *, CAST('0x' || substr(md5('7:' || whole || ':' || source || ':' || block), 1, 15) AS BIGINT) AS border,
         CAST('0x' || substr(md5('7:doc:' || whole || ':' || doc_key), 1, 15) AS BIGINT) AS dorder FROM blocked),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY border, dorder
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered),
copies AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM placed),
epochs AS (SELECT *, unnest(range(0, n)) AS epoch FROM copies)
SELECT doc_id, source, tokens AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block,
       CAST('0x' || substr(md5('7:' || epoch || ':' || source || ':' || block), 1, 15) AS BIGINT) AS mix_order
FROM epochs
""")
def op7(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, max_repeats=2.0)
    return mixed.select("doc_id", F.coalesce("source", F.lit("null")).alias("source"),
                        mixing.n_tokens().alias("n_tokens"), "epoch", "block", "mix_order")


@register("op8_toxicity_chain")
def op8(spark, sf_dir):
    """Toxic at all, then toxic inside good prose and toxic inside junk; learned
    from ids whose crc32 mod 4 is not 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    toxic, quality_label = F.col("toxic"), F.col("quality")
    categories = {"toxic": toxic, "toxic_prose": toxic * quality_label, "toxic_junk": toxic * (1 - quality_label)}
    held_out = F.pmod(quality.crc(F.col("doc_id")), F.lit(4)) == 2
    model = toxicity.fit_documents(docs, read(spark, sf_dir, "labels"), categories, ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_udf(model)(utf8()).alias("p"))
    return scored.select("doc_id", "held_out", F.col("p")[0].alias("score"),
                         F.when(F.col("p")[0] >= 0.5, 1).otherwise(0).alias("predicted"),
                         F.col("p")[1].alias("p_toxic_prose"), F.col("p")[2].alias("p_toxic_junk"))


@register("op9_decontamination", sql="""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT g.doc_id, g.i, g.size, v.item_id FROM grams g JOIN windows v USING (size, gram)),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
""")
def op9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("leak.items", lambda x: x.cast("string")))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("leak.n_hit") > 0).alias("contaminated"))


@register("op10_exact_dedup", sql="""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM texts WINDOW w AS (PARTITION BY text_sha256)
""")
def op10(spark, sf_dir):
    found = exact_dedup.dedup_assignments(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@register("op11_token_ids")
def op11(spark, sf_dir):
    """Ids of all documents written as segment files and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-ids/{uuid.uuid4().hex}"
    token_ids.write_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_json(), end_id=2)
    return token_ids.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op12_lexical_search", sql="""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words),
queries AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
terms AS (SELECT DISTINCT term FROM queries),
postings AS (
  SELECT doc_id, term, n, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words) SEMI JOIN terms USING (term)
  GROUP BY doc_id, term, n),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN weights USING (term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * impact) AS BIGINT) AS score
  FROM queries JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 20
""")
def op12(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


@register("op13_importance_resampling")
def op13(spark, sf_dir):
    scored = importance.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "draw.n_features", "draw.weight", "draw.score", "draw.rank")
