"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_documents
from tessera.llm.chat import conversation_digests, format_conversations
from tessera.llm.hard_negatives import mine_hard_negatives
from tessera.llm.language_id import identify
from tessera.llm.line_dedup import remove_boilerplate
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.prefix_trie import placed_turns, prefix_trie, rebuilt
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_counts import section_tokens
from tessera.llm.top_k import scaled_vectors, top_k
from tessera.llm.vocabularies import vocabulary
from tessera.llm.warc import page_captures, resolve_revisits


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(_read(spark, sf_dir, "documents"), with_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages (text, markup, address) and all documents (text, source as host)."""
    documents = _read(spark, sf_dir, "documents")
    visible = F.regexp_replace("html", r"(?s)<(script|style|nav)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    pages = _read(spark, sf_dir, "pages").select(
        (2 * F.col("page_id")).alias("id"),
        visible.alias("text"),
        F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]+)"', 1).alias("declared"),
        F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1).alias("host"),
    )
    texts = documents.select((2 * F.col("doc_id") + 1).alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    found = identify(pages.unionByName(texts), documents)
    key = F.shiftright("id", 1)
    is_page = F.col("id") % 2 == 0
    return found.select(
        F.when(~is_page, key).alias("doc_id"), F.when(is_page, key).alias("page_id"), "language", "text_language", "posterior", "kept"
    )


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_vectors(_read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages; the merged headers as sorted text."""
    found = resolve_revisits(page_captures(_read(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(pairs, "\n"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), words=2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), with_ids=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each of which starts as the first one of its twenty does."""
    return prefix_trie(*rebuilt(placed_turns(_read(spark, sf_dir, "conversations"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh one takes the next label."""
    table = _read(spark, sf_dir, "embeddings").filter("label is not null")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = scaled_vectors(table.withColumn("label", label), scale=256, others=["label"])
    return mine_hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts spell out marks, as windows, read back."""
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return conversation_digests(format_conversations(table.unionByName(odd)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_bpe": op9_bpe,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_windows": op13_chat_windows,
}

SQL: dict[str, str] = {
    "op1_line_dedup": """
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents WHERE text IS NOT NULL
        ), b AS (
            SELECT trim(line) AS bare, min(doc_id) AS first FROM l WHERE trim(line) <> ''
            GROUP BY 1 HAVING count(DISTINCT source) >= 10
        ), k AS (
            SELECT doc_id, i, line, bare IS NOT NULL AND doc_id > first AS gone FROM l LEFT JOIN b ON trim(line) = bare
        )
        SELECT d.doc_id, count(k.i) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
    """,
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        ) WHERE rank <= 20
    """,
    "op6_warc_revisits": r"""
        WITH p AS (
            SELECT *, '"' || substr(sha256(html), 1, 16) || '"' AS etag,
                   TIMESTAMP '2024-01-01' + to_minutes(page_id) AS moment,
                   lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS start
            FROM pages
        ), c AS (
            SELECT *, regexp_replace(regexp_replace(regexp_replace(start, '^https://', 'http://'), '^(http://)www\.', '\1'), ':(80|443)$', '')
                   || '/part' || (page_id % 4) AS key
            FROM p
        ), r AS (
            SELECT key, moment, min(2 * page_id) AS response_id FROM c GROUP BY key, moment
        ), v AS (
            SELECT page_id, key, moment + to_minutes(CASE WHEN page_id % 11 = 0 THEN -30 ELSE 10 + page_id % 50 END) AS moment,
                   CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 5 = 0 THEN NULL ELSE etag END AS etag,
                   page_id % 28 AS day, page_id % 50 AS age
            FROM c
        ), j AS (
            SELECT v.*, r.response_id FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.moment > r.moment
        ), f AS (
            SELECT j.page_id, j.response_id, j.age,
                   CASE WHEN j.response_id IS NULL THEN 'missing'
                        WHEN coalesce(j.etag = s.etag, j.day = s.page_id % 28) THEN 'resolved' ELSE 'mismatch' END AS status,
                   s.etag AS r_etag, s.html
            FROM j LEFT JOIN c s ON j.response_id = 2 * s.page_id
        )
        SELECT 2 * page_id + 1 AS record_id, response_id, status,
               CASE WHEN status = 'resolved' THEN 'age: ' || age || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || r_etag
                    ELSE 'age: ' || age || chr(10) || 'content-length: 0' END AS headers,
               CASE WHEN status = 'resolved' THEN sha256(html) END AS payload_sha256
        FROM f
    """,
    "op11_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT DISTINCT c, c - c % 20 AS base, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))
            ), 4294967295::BIGINT) % 4 AS h
            FROM t
        ), s AS (
            SELECT ids.c, 0 AS own, i, role, text FROM ids JOIN t ON t.c = base WHERE i < h
            UNION ALL SELECT ids.c, 1, i, role, text FROM ids JOIN t ON t.c = ids.c WHERE i >= h
        ), n AS (
            SELECT c, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   md5(string_agg(md5(len(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)) AS path
            FROM s WINDOW w AS (PARTITION BY c ORDER BY own, i)
            UNION ALL SELECT c, 0, 0, '' FROM ids
        ), last AS (
            SELECT c, max(depth) AS depth FROM n GROUP BY c
        ), g AS (
            SELECT n.path, n.depth, any_value(words) AS words, min(n.c) AS first, count(*) AS n_convs,
                   sha256(coalesce(string_agg(n.c::VARCHAR, ',' ORDER BY n.c) FILTER (WHERE last.depth = n.depth), '')) AS ends
            FROM n JOIN last ON n.c = last.c GROUP BY n.path, n.depth
        ), up AS (
            SELECT g.path, a.path AS above, a.depth AS above_depth FROM g JOIN n a ON a.c = g.first AND a.depth <= g.depth
        ), kids AS (
            SELECT above AS path, count(*) AS n_children FROM up JOIN g ON up.path = g.path WHERE above_depth = g.depth - 1 GROUP BY above
        ), sums AS (
            SELECT above AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
            FROM up JOIN g ON up.path = g.path LEFT JOIN kids ON kids.path = g.path GROUP BY above
        )
        SELECT g.first AS conv_id, g.depth::BIGINT AS depth, p.first AS parent_conv_id, g.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
               leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
        FROM g JOIN sums ON sums.path = g.path LEFT JOIN kids ON kids.path = g.path
             LEFT JOIN up ON up.path = g.path AND up.above_depth = g.depth - 1 LEFT JOIN g p ON p.path = up.above
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, min({'x': list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT),
                                'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.r.label = c.r.label AS same,
                   list_sum(list_transform(list_zip(a.r.x, c.r.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, p.vec_id AS positive_id,
               row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n USING (anchor_id)
        WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        QUALIFY rank <= 10
    """,
    "op13_chat_windows": r"""
        WITH t AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)
        ), p AS (
            SELECT *, 4 + (strlen(role || text) + 3) // 4 AS tokens,
                   20 + len(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + len(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS chars,
                   row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY c) AS n
            FROM t WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text))
        ), k AS (
            SELECT *, coalesce(max(CASE WHEN place = 0 AND role = 'system' AND n > 1 THEN tokens END) OVER (PARTITION BY c), 0) AS kept,
                   sum(tokens) OVER (PARTITION BY c ORDER BY place) - tokens AS before
            FROM p
        ), b AS (
            SELECT c, place, tokens, chars, kept, before - kept AS before, (before - kept) // greatest(384 - kept, 1) AS low,
                   (before - kept + tokens - 1) // greatest(384 - kept, 1) AS high
            FROM k WHERE NOT (kept > 0 AND place = 0)
        ), s AS (
            SELECT *, 2 * high - (high > low AND tokens > 128)::INT AS w FROM b
        ), w AS (
            SELECT c, w, min(before) AS start, least(128, 512 - any_value(kept) - sum(tokens)) AS room FROM s GROUP BY c, w
        ), f AS (
            SELECT c, w, chars FROM s
            UNION ALL SELECT w.c, w.w, s.chars FROM w JOIN s ON s.c IS NOT DISTINCT FROM w.c WHERE before + tokens <= start AND before >= start - room
            UNION ALL SELECT w.c, w.w, k.chars FROM w JOIN k ON k.c IS NOT DISTINCT FROM w.c WHERE k.kept > 0 AND k.place = 0
        ), d AS (
            SELECT c, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss
            FROM p GROUP BY c
        )
        SELECT d.c AS conv_id, n_turns, turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, n_windows
        FROM d JOIN (SELECT c, sum(chars) AS chars, count(DISTINCT w) AS n_windows FROM f GROUP BY c) x ON d.c IS NOT DISTINCT FROM x.c
    """,
}
