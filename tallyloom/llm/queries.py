"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.suffix_tree import cut_repeated_words

    return cut_repeated_words(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.suffix_array import cut_repeated_bytes

    return cut_repeated_bytes(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.toxicity import score_documents

    return score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.licenses import scan_licenses

    return scan_licenses(_documents(spark, sf_dir)).drop("spans")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.topk import query_topk

    return query_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.bpe import bpe_digests

    return bpe_digests(_documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.lm import lm_scores

    scores = lm_scores(_documents(spark, sf_dir))
    return scores.select("doc_id", "n_words", "n_backoff", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op11_transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.undo_log import transaction_log

    return transaction_log(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.quality import quality_scores

    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.variants import spelling_variants

    return spelling_variants(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_suffix_array_dedup, op3_toxicity, op4_license_scan, op5_exact_topk, op6_bpe_round_trip, op7_ngram_jaccard, op8_best_fit_packing, op9_lm_scores, op10_exact_dedup, op11_transaction_log, op12_quality, op13_spelling_variants)}

#: What four zero bits do to the CRC-32 remainder (reflected polynomial), by the low four bits.
_CRC_STEPS = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def _crc32(string: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes, half a byte at a time, the low half first."""
    half = lambda c, x: f"xor(({c}) >> 4, ({_CRC_STEPS})[(xor({c}, {x}) & 15) + 1])"
    digit = lambda i: f"CAST(strpos('0123456789ABCDEF', x[{i}]) - 1 AS BIGINT)"
    numbers = f"list_transform(regexp_extract_all(hex(encode({string})), '..'), lambda x: 16 * {digit(1)} + {digit(2)})"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {numbers}), lambda c, x: {half(half('c', 'x'), 'x >> 4')}))"


ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_lm_scores": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
            FROM documents),
        p AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, ws FROM d),
        g AS (SELECT doc_id, n_words, i, w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM p),
        u AS (SELECT w, count(*) AS n FROM g GROUP BY w),
        ud AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY doc_id, w),
        b AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
        bd AS (SELECT doc_id, v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
        t AS (SELECT sum(n) AS n FROM u),
        s AS (
            SELECT g.doc_id, g.v IS NOT NULL AND b.n = bd.n AS backed,
                   CASE WHEN g.v IS NOT NULL AND b.n > bd.n THEN ln((b.n - bd.n) / (uv.n - udv.n))
                        ELSE ln(greatest(u.n - ud.n, 0.5) / greatest(t.n - g.n_words, 1)) + CASE WHEN g.v IS NULL THEN 0 ELSE ln(0.4) END END AS score
            FROM g JOIN u USING (w) JOIN ud USING (doc_id, w) CROSS JOIN t
            LEFT JOIN u uv ON uv.w = g.v LEFT JOIN ud udv ON udv.doc_id = g.doc_id AND udv.w = g.v
            LEFT JOIN b ON b.v = g.v AND b.w = g.w LEFT JOIN bd ON bd.doc_id = g.doc_id AND bd.v = g.v AND bd.w = g.w)
        SELECT d.doc_id, len(ws) AS n_words, count(*) FILTER (backed) AS n_backoff,
               round(coalesce(sum(score), 0.0), 4) AS log_score, round(sum(score) / nullif(len(ws), 0), 6) AS mean_log_score
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(ws)""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_transaction_log": f"""
        WITH h AS (SELECT doc_id, source, text, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
        r AS (SELECT doc_id, source, text, h // 100 % 30000 AS key, CASE WHEN h % 17 <= 1 THEN 'commit' WHEN h % 17 = 2 THEN 'abort' WHEN h % 17 <= 4 THEN 'savepoint' WHEN h % 17 <= 6 THEN 'rollback' ELSE 'change' END AS op FROM h),
        n AS (
            SELECT *, min(CASE WHEN op <> 'change' THEN doc_id END) OVER w AS next_id, min(CASE WHEN op IN ('commit', 'abort') THEN doc_id END) OVER w AS end_id
            FROM r WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
        c AS (
            SELECT n.doc_id, n.key, CASE WHEN x.op = 'rollback' THEN 'rollback' ELSE coalesce(e.op, 'abort') END AS fate, CASE WHEN x.op = 'rollback' THEN x.doc_id ELSE e.doc_id END AS by_id,
                   CASE WHEN n.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN n.text END AS text
            FROM n LEFT JOIN r x ON x.doc_id = n.next_id LEFT JOIN r e ON e.doc_id = n.end_id WHERE n.op = 'change'),
        k AS (SELECT doc_id AS by_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 + 1 AS epoch FROM r WHERE op = 'commit'),
        v AS (
            SELECT key, epoch, arg_max(row(doc_id, text), row(by_id, doc_id)) AS last FROM c JOIN k USING (by_id) WHERE fate = 'commit' GROUP BY key, epoch),
        s AS (SELECT key, epoch, CASE WHEN last[2] IS NOT NULL THEN {_crc32("CAST(key AS VARCHAR) || ':' || last[2]")} END AS crc FROM v),
        m AS (SELECT epoch, crc, lag(crc) OVER (PARTITION BY key ORDER BY epoch) AS old FROM s),
        d AS (SELECT epoch, count(crc) - count(old) AS n, coalesce(sum(crc), 0) - coalesce(sum(old), 0) AS value FROM m GROUP BY epoch),
        a AS (SELECT epoch, coalesce(n, 0) AS n, coalesce(value, 0) AS value FROM (SELECT DISTINCT epoch FROM k) LEFT JOIN d USING (epoch))
        SELECT 'state' AS kind, epoch AS id, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(value) OVER w AS BIGINT) AS value FROM a WINDOW w AS (ORDER BY epoch)
        UNION ALL SELECT fate, doc_id, by_id, key FROM c WHERE fate <> 'commit'""",
    "op13_spelling_variants": rf"""
        WITH o AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        r AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY doc_id, run),
        h AS (SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run")} AS h FROM r),
        t AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        p AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w),
        g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM p),
        l AS (
            SELECT a.word, b.word AS near FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word FROM g a JOIN w b ON a.rest = b.word
            UNION SELECT b.word, a.word FROM g a JOIN w b ON a.rest = b.word),
        b AS (SELECT l.word, count(*) AS n_near, arg_min(row(b.word, b.n), row(-b.n, encode(b.word))) AS best FROM l JOIN w b ON b.word = l.near GROUP BY l.word),
        f AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best[2] >= 5 * w.n THEN best[1] END AS form, CASE WHEN best[2] >= 5 * w.n THEN best[2] END AS form_n
            FROM w LEFT JOIN b USING (word)),
        e AS (
            WITH RECURSIVE up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
            SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)""",
}
