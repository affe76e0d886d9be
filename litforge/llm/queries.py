"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=2, percent=80)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.html_template import main_texts

    return main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.token_files import token_table

    return token_table(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.warc import archived

    return archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.packing import packed

    return packed(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.line_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.quality import quality

    return quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.embed_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.infill import fill_in_middle, restored

    x = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.token_counts import prefix_counts, tokens_of

    x = prefix_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))
    return x.select("doc_id", "n_bytes", tokens_of("counts").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 512)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litforge.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_html_main_text": op2_html_main_text,
        "op3_token_files": op3_token_files,
        "op4_warc_revisits": op4_warc_revisits,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_media_columns": op6_media_columns,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_token_counts": op12_token_counts,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_revisits": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
            FROM m""",
        "op11_fill_in_middle": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
            r AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS r1, ('0x' || h[9:16])::BIGINT % (n + 1) AS r2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
            f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                         least(r1, r2) AS lo, greatest(r1, r2) AS hi FROM r),
            p AS (SELECT *, t[1:lo] AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM f)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
                   sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
                   sha256(t) AS restored_sha256
            FROM p""",
        "op13_source_divergence": r"""
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
            g AS (SELECT DISTINCT lang, source FROM d),
            v AS (SELECT g.lang, count(DISTINCT k.term)::HUGEINT AS v FROM g LEFT JOIN k USING (lang) GROUP BY ALL),
            c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
            gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
            ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY ALL),
            lc AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL),
            p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (gn.n + v.v) AS p
                  FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
            q AS (SELECT lc.lang, lc.term, 1 + (1000000000::HUGEINT * (lc.c + 1)) // (ln.n + v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
            pf AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pf.f, 0)::BIGINT AS value
                      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pf ON pf.lang = a.lang AND pf.source = a.source AND pf.item = b.source),
            terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
            u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
            n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
            SELECT * FROM n WHERE part = 'pair' OR rank <= 200""",
    }
