"""The ten operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemicycle.llm import chat, mixing, ngram_lm, quality, sentencepiece_scan, simhash, token_bins, token_counts, topk, warc

def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable_vectors(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.piece_digest(sentencepiece_scan.encode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return ngram_lm.score(docs, ngram_lm.train(docs.where(~ngram_lm.held_out())))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_captures(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"), k=4, radius=4)


def op9_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_bins.read_token_files(token_bins.write_token_files(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = quality.judge(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {f.__name__: f for f in (op1_maxscore_topk, op2_entropy_mix, op3_sentencepiece_scan, op4_kneser_ney, op5_chat_format, op6_token_counts, op7_warc, op8_simhash, op9_token_bins, op10_quality)}

#: 20 bits (five hexadecimal digits) of a SHA-1 at a time as four base-32 digits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, {1 + 5 * i}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))

ORACLES = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS chosen, count(*) AS n FROM p GROUP BY h),
        d AS (SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS x, CASE WHEN n > 1 AND page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to FROM p JOIN g ON p.h = g.h)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM d""",
    "op1_maxscore_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
        )
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op5_chat_format": """
        WITH c AS (
          SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS t
          FROM conversations GROUP BY conv_id
        ), k AS (
          SELECT a.conv_id, a.t, count(*) FILTER (WHERE b.t = a.t) AS copies,
                 bool_or(len(b.t) > len(a.t) OR (len(b.t) = len(a.t) AND b.conv_id < a.conv_id)) AS gone
          FROM c a JOIN c b ON b.t[1] = a.t[1] AND b.t[1:len(a.t)] = a.t GROUP BY a.conv_id, a.t
        ), turns AS (
          SELECT conv_id, len(t) AS n_turns, copies, unnest(t) AS u, generate_subscripts(t, 1) AS place FROM k WHERE NOT gone
        )
        SELECT conv_id, CAST((place - 1) // 512 AS BIGINT) AS segment, any_value(n_turns) AS n_turns, any_value(copies) AS copies,
               string_agg('<|im_start|>' || coalesce(u.role, '') || chr(10) || coalesce(u.text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
        FROM turns GROUP BY conv_id, (place - 1) // 512""",
}
