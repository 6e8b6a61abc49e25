"""The registered queries of the operators, each over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaven.llm import collocations, decontam, html, lm, neardup, packing, pii, quality, resample, tokens, toxicity, urls, warc
from lexhaven.llm.common import fold

VOCABULARY = "word_bpe_49k.json"
# Whoever knows the key can undo pseudonyms, so real data needs one of its own by this setting.
SECRET_SETTING = "spark.lexhaven.pseudonymKey"
SECRET = "lexhaven registered query"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def secret(spark: SparkSession) -> str:
    """The session's key for pseudonyms; without one, a known key that hides nothing."""
    return spark.conf.get(SECRET_SETTING, SECRET)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and greedy pieces of every document."""
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with benchmark passages, which ones, and how many words differ."""
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    judged = quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with pseudonyms, and the kinds of data found."""
    made = pii.pseudonymised(table(spark, folder, "documents"), secret(spark))
    return made.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_found"), F.array_join("pii_kinds", ",").alias("kinds"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Group of every document by shared shingles of four words."""
    found = neardup.near_duplicates(table(spark, folder, "documents"), width=4)
    return found.select("doc_id", "n_shingles", "component_id", neardup.kept().alias("kept"))


def pieces(df: DataFrame) -> DataFrame:
    """Packed pieces, their ids as a checksum."""
    packed = packing.pack(df, public_tokenizers.path(VOCABULARY))
    return packed.select(
        "doc_id", "start", packing.piece_length().alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    return pieces(table(spark, folder, "documents"))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it comes back from converted archives."""
    return warc.archived(table(spark, folder, "pages"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    held_out = fold(F.col("doc_id"), 5) == 0
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out, held_out)


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of every document."""
    held_out = fold(F.col("doc_id"), 7) == 2
    return lm.score(table(spark, folder, "documents"), ~held_out, held_out)


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's strongest phrases of two to five words."""
    return collocations.collocations(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's words."""
    return resample.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_token_counts, op2_decontamination, op3_quality_rules, op4_pii, op5_near_duplicates,
        op6_packing, op7_main_text, op8_warc, op9_toxicity, op10_lm_score, op11_url_filters,
        op12_collocations, op13_importance_resampling,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op5_near_duplicates": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), parts AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ')
                ELSE array_to_string(w[i:i + 3], ' ') END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM parts GROUP BY 1
        ), met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM parts a JOIN parts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT met.a, met.b FROM met JOIN sizes x ON x.doc_id = met.a JOIN sizes y ON y.doc_id = met.b
            WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)
        ), ways AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reached AS (
            SELECT a AS doc_id, b AS other FROM ways
            UNION
            SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other
        ), lowest AS (
            SELECT doc_id, min(other) AS other FROM reached GROUP BY 1
        )
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
            least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
            d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
        FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l USING (doc_id)
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), h AS (
            SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p
        ), m AS (
            SELECT payload_digest, max(page_id) AS top FROM h WHERE payload_bytes >= 1000 GROUP BY 1
        )
        SELECT h.page_id, h.payload_bytes, h.payload_digest,
            CASE WHEN m.top <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN m.top <> h.page_id THEN m.top END AS refers_to
        FROM h LEFT JOIN m ON m.payload_digest = h.payload_digest AND h.payload_bytes >= 1000
    """,
    "op11_url_filters": rf"""
        WITH parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UPPER}', '{_LOWER}') AS host,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), rules(h, p, v) AS (
            VALUES {", ".join(repr(r) for r in URL_RULES)}
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
        FROM parts LEFT JOIN LATERAL (
            SELECT h || p AS rule, v FROM rules
            WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1
        ) ON true
    """,
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1
        ), places AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
        ), runs AS (
            SELECT lang, w[i:i + size - 1] AS p FROM places, range(1, 6) AS s(size) WHERE i + size - 1 <= len(w)
        ), often AS (
            SELECT lang, p, len(p) AS size, count(*) AS f FROM runs GROUP BY 1, 2 HAVING count(*) >= 100
        ), cuts AS (
            SELECT lang, p, f AS a, unnest(range(1, size)) AS k FROM often WHERE size > 1
        ), scored AS (
            SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n,
                ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN totals t USING (lang)
            JOIN often x ON x.lang = c.lang AND x.p = c.p[1:c.k]
            JOIN often y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
        ), best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, p[i:j] AS p, max(f) AS longer
            FROM (SELECT lang, p, f, size, i, unnest(range(i + 1, size + 1)) AS j FROM (SELECT *, unnest(range(1, size)) AS i FROM often WHERE size > 2))
            WHERE j - i + 1 < size GROUP BY 1, 2
        ), named AS (
            SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score
            FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.p = b.p
            WHERE i.longer IS NULL OR i.longer < b.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM named QUALIFY rank <= 2000
    """,
}
