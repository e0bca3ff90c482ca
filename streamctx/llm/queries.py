"""The operators' queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, divergence, html, jaccard, knn, langid, lexical, licenses, mixing, packing, sharding, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return dedup.exact_dedup(docs, locator=dedup.place_in_file(docs)).drop("locator")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    out = chat.format_turns(chat.to_turns(rows.unionByName(two)))
    turns, masked = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, locator=dedup.place_in_file(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_read(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return jaccard.near_duplicates(docs, locator=dedup.place_in_file(docs)).drop("kept", "locator")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_read(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lexical.search(docs, lexical.build_index(docs), _read(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_packing, op4_exact_dedup, op5_license_scan, op6_chat_formatting, op7_mixing, op8_top_k, op9_sharding, op10_jaccard_join, op11_source_divergence, op12_lexical_search, op13_html_extraction)}

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents),
        g AS (SELECT whole, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY whole)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(whole) AS text_sha256 FROM t JOIN g USING (whole)""",
    "op6_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
        e AS (SELECT *, regexp_replace(replace(role, '\', '\\'), '(<)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>)', '\1\\!\2', 'g') AS er,
            regexp_replace(replace(text, '\', '\\'), '(<)(\|turn\|>|\|text\|>|\|end\|>|s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>)', '\1\\!\2', 'g') AS et FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|turn|>') + length('<|text|>') + length('<|end|>') + 1
                + length(regexp_replace(er, '(\[)(INST\]|/INST\])', '\1\\!\2', 'g')) + length(regexp_replace(et, '(\[)(INST\]|/INST\])', '\1\\!\2', 'g')))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_top_k": r"""
        WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM x AS q JOIN x ON x.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
        u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.x = b.x AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
        SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) USING (doc_id)""",
    "op11_source_divergence": r"""
        WITH t AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM t) GROUP BY lang, term HAVING count(*) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM t),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM t) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        gc AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.v
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
        gp AS (SELECT lang, source, term, n, 1 + ((1000000000::HUGEINT * (n + 1)) // (total + v)) AS p FROM gc),
        lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
        lq AS (SELECT lang, term, 1 + ((1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v)) AS q FROM lc JOIN v USING (lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp AS a JOIN gp AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
            FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM gp JOIN lq USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_lexical_search": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM t WHERE len(w) > 0),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total)))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    # the article element of these pages, which scoring has to find
    "op13_html_extraction": r"""
        WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
        b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')) AS parts FROM a),
        c AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')) AS parts FROM b),
        d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
        SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d""",
}
