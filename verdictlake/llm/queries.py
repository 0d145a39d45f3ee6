"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import BpeConfig, encoding_digest
from .common import lasting, scratch, shared_folder
from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .language_id import fit_languages, held_out, identify_languages
from .lz_dedup import parse_documents
from .ngram_join import similarity_components
from .order_minhash import fingerprint_edits
from .packing import PackingConfig, pack_documents
from .resampling import resample
from .sharding import ShardConfig, ShardStore
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity

PACKING = PackingConfig(public_tokenizers.path("word_bpe_49k.json"))
BYTE_BPE = BpeConfig(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens by local search."""
    return pack_documents(_documents(spark, sf_dir).select("doc_id", "text"), PACKING)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by polynomial fingerprints."""
    return exact_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by compression, learned from those that are not held out."""
    docs = _documents(spark, sf_dir)
    model = fit_languages(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which arrive in eight lots by a hash of their id, appended as small shards, compacted after each fourth
    arrival; where each one is then."""
    docs = _documents(spark, sf_dir)
    store = ShardStore(spark, f"{shared_folder(spark)}/verdictlake-shards-{uuid.uuid4().hex}", ShardConfig())
    lot = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(8))
    for n in range(8):
        version = store.append(docs.where(lot == n))
        if n % 4 == 3:
            version = store.compact()
    return store.located(version).select("row.doc_id", F.lit(version).cast("long").alias("version"), F.concat_ws("/", "gen", "shard").alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"), F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that occur in a document with a smaller id, removed from all documents."""
    return remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))


def op6_lz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that occurred before, removed from all documents."""
    with scratch(spark):
        parsed = parse_documents(_documents(spark, sf_dir).select("doc_id", "text"))
        return lasting(parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels of those that are not held out."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 5-word shingles have a Jaccard similarity of 0.75 and more."""
    return similarity_components(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and what they decode to, as digests."""
    return encoding_digest(_documents(spark, sf_dir).select("doc_id", "text"), BYTE_BPE)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by how much more likely their words are in the benchmark's texts; a tenth of those with 20 words drawn."""
    return resample(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language of all documents diverge, and the terms that mark each source."""
    return source_divergence(_documents(spark, sf_dir).select("lang", "source", "text"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose SimHash fingerprints differ in 3 bits at most."""
    return simhash_components(_documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_exact_dedup, op3_language_id, op4_size_tiered_shards, op5_suffix_array_dedup, op6_lz_substring_dedup, op7_toxicity, op8_order_minhash, op9_ngram_join, op10_byte_bpe, op11_importance_resampling, op12_source_divergence, op13_simhash)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM d
        """,
        "op6_lz_substring_dedup": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            w AS (SELECT doc_id, i, words[i] AS word, CASE WHEN i + 19 <= len(words) THEN array_to_string(words[i:i + 19], ' ') END AS win
                  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d)),
            m AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
            c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) AS gone FROM m),
            r AS (SELECT doc_id, count(CASE WHEN gone THEN 1 END) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY i) AS kept FROM c GROUP BY doc_id)
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
            FROM d LEFT JOIN r USING (doc_id)
        """,
        "op9_ngram_join": r"""
            WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
            s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS g
                  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS i FROM d)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            rare AS (SELECT * FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
            able AS (SELECT doc_id FROM rare JOIN n USING (doc_id) GROUP BY doc_id, n HAVING 100 * count(*) >= 75 * n),
            u AS (SELECT * FROM rare WHERE doc_id IN (SELECT doc_id FROM able)),
            p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
            e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
            r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
            SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x) USING (doc_id)
        """,
        # crc32 by its rule, a bit at a time, over the bytes of the distinct words
        "op11_importance_resampling": r"""
            WITH texts AS (SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
            d AS (SELECT row_number() OVER () AS r, doc_id, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM texts),
            f AS (SELECT r, doc_id, own, unnest(words) AS word FROM d),
            v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f)),
            c AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, (length(h) // 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 10000 AS bucket FROM v),
            n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN c USING (word) GROUP BY bucket),
            a AS (SELECT coalesce(sum(s), 0)::DOUBLE + 10000 AS all_s, coalesce(sum(t), 0)::DOUBLE + 10000 AS all_t FROM n),
            g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * all_s / ((s + 1)::DOUBLE * all_t)))::BIGINT AS gain FROM n, a),
            w AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM f JOIN c USING (word) JOIN g USING (bucket) WHERE own GROUP BY r),
            x AS (SELECT doc_id, len(words) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r) WHERE own),
            y AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
            z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM y)
            SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM z
        """,
        "op12_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
            o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
            v AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
            langs AS (SELECT lang, count(*) AS terms, sum(n)::HUGEINT AS n FROM v GROUP BY lang),
            c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
            g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
            p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + langs.terms) AS p,
                    1 + (1000000000::HUGEINT * (v.n + 1)) // (langs.n + langs.terms) AS q
                  FROM g JOIN langs USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
            s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
            parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
                      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
                      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
            SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
        """,
    }
