"""The registered queries of the operators in this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import chat_format, decontamination, divergence, html_text, lm_scoring, packing, sharding, simhash, substring_dedup, token_files, topk, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id") -> F.Column:
    """Checksum of an id, as text, modulo 5: the fold of a document."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every document; those with remainder 1 (by checksum) are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, docs.where(remainder() != 1))
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of every fifth (by checksum) are never seen."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.sample(docs, _table(spark, sf_dir, "labels").where(remainder() != 0)))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay of every document once 13-word passages of documents with a smaller id are removed."""
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), width=13)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each conversation against its twin with another conversation's end."""
    pairs = chat_format.reply_pairs(chat_format.gather(_table(spark, sf_dir, "conversations"), "conv_id"))
    out = chat_format.format_pairs(pairs)
    mask = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"))), ",")
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links join fingerprints that differ in two bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 40 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    digest = ("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 40).select(*digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector."""
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with other numbers, names and units too."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 4096 tokens, with the checksum of its packed ids."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every document's token ids, as read back from files of independent frames."""
    return token_files.digest(spark, token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 first whitened components of every vector."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    parts = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set a source apart."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_toxicity": op2_toxicity,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_topk": op7_topk,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_token_files": op11_token_files,
    "op12_whitening": op12_whitening,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_format": """
        WITH t AS (
            SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS n
            FROM conversations WHERE conv_id IS NOT NULL
        ), l AS (
            SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY n) AS turns, max(n) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0
        ), k AS (
            SELECT conv_id, turns[1:last] AS c, CASE WHEN conv_id % 2 = 0 THEN last - 1 ELSE (last - 1) // 2 END AS kept, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM l
        ), p AS (
            SELECT k.conv_id AS pair_id, k.c, list_concat(k.c[1:k.kept], CASE WHEN k.conv_id % 2 = 0 OR len(o.c) <= k.kept THEN o.c[len(o.c):] ELSE o.c[k.kept + 1:] END) AS r
            FROM k JOIN k o ON o.conv_id = k.next_id WHERE k.conv_id <> k.next_id
        ), d AS (
            SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: i > len(r) OR c[i] <> r[i])) - 1, len(c)) AS n FROM p
        ), e AS (SELECT pair_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM d),
        s AS (
            SELECT *, list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS ps, list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS cs, list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)) AS rs FROM e
        ), m AS (
            SELECT *, list_transform(range(1, len(c) + 1), lambda i: length(array_to_string(cs[1:i], ''))) AS ce, list_transform(range(1, len(r) + 1), lambda i: length(array_to_string(rs[1:i], ''))) AS re FROM s
        )
        SELECT pair_id, CAST(n AS INTEGER) AS prompt_turns, array_to_string(ps, '') AS prompt, array_to_string(cs, '') AS chosen, array_to_string(rs, '') AS rejected,
            array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i: (ce[i] - length(c[i].text) - 8) || ':' || ce[i]), ',') AS chosen_mask,
            array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i: (re[i] - length(r[i].text) - 8) || ':' || re[i]), ',') AS rejected_mask
        FROM m
    """,
    "op7_topk": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term
            FROM documents
        ), kept AS (
            SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT id) >= 10
        ), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN kept USING (lang, term) GROUP BY ALL),
        full_c AS (
            SELECT grp.lang, grp.source, kept.term, coalesce(c.n, 0) AS n FROM grp JOIN kept ON grp.lang = kept.lang LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term
        ), own AS (
            SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_c JOIN size USING (lang)
        ), whole AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY lang, term) JOIN size USING (lang)
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}
