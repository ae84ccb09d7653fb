"""The thirteen registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import (divergence, fim, licenses, mixing, omh, outliers, packing, pieces, ppm, simhash, suffix,
                            token_files, warc)
from fleetspark.llm.common import documents


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_to_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), added=True)


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    return ppm.identify(documents(spark, sf_dir), held_out)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(packing.token_pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                                                    added=True))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.fingerprint_pairs(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mixing.mix_documents(documents(spark, sf_dir), labels).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.restore(fim.transform(documents(spark, sf_dir))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.decode(pieces.encode(documents(spark, sf_dir), model), model).select(
        "doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_ppm_language, op3_warc_revisits, op4_robust_outliers,
                                   op5_bit_sliced_simhash, op6_best_fit_packing, op7_order_minhash, op8_suffix_dedup,
                                   op9_license_scan, op10_source_mix, op11_fill_in_middle, op12_sentencepiece,
                                   op13_source_divergence)}

ORACLE = {
    "op3_warc_revisits": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, url, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM h),
        r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL AS again FROM w)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN original END AS refers_to
        FROM r""",
    "op10_source_mix": r"""
        WITH q AS (SELECT doc_id AS of_doc, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (SELECT doc_id, source, quality,
                     len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
              FROM documents LEFT JOIN q ON doc_id = of_doc),
        k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
                            / 4503599627370496.0)
                        / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
        t AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
                     coalesce(sum(3 * source_size) OVER capped_first, 0) AS caps_before,
                     coalesce(sum(weight) OVER capped_first, 0) AS weights_before
              FROM w WINDOW capped_first AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, 3 * source_size * (weights - weights_before) < weight * (total - caps_before) AS capped FROM t),
        l AS (SELECT *, (total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                        / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) AS share FROM c),
        g AS (SELECT source AS of_source, source_size,
                     CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE coalesce(weight * share, 0.0) END AS target FROM l),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
        m AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                     sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
              FROM k JOIN e ON source IS NOT DISTINCT FROM of_source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + CASE WHEN upto - size / 2.0 <= rest THEN size ELSE 0 END)::BIGINT AS taken
        FROM m""",
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                     ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                          THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, substr(t, 1, low) AS pre, substr(t, low + 1, high - low) AS mid, substr(t, high + 1) AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
        a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        b AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang) AS lang_total,
                     sum(n) OVER (PARTITION BY lang, term) AS lang_n FROM a JOIN v USING (lang)),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p,
                     1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q FROM b),
        s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
              FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
              GROUP BY x.lang, x.source, y.source),
        r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
              UNION ALL
              SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
        SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10""",
}
