"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavesift.llm import embeddings, katz, packing, quality_classifier, quality_rules, secrets, sentencepieces, simhash, substrings, token_files
from wavesift.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sentencepieces.encode_decode(docs, _vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_files(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _secrets_sql(reach: int = 200) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(k, secrets.ROLE[k], p, g, n) for k, (p, g, n) in secrets.BASE.items()] + [(k, r, p, g, n) for k, (r, p, g, n) in secrets.WEAK.items()]
    pats = ", ".join(f"({quote(k)}, {i}, {quote(r)}, {quote(p)}, {g}, {n})" for i, (k, r, p, g, n) in enumerate(rows))
    base = len(secrets.BASE)
    return f"""WITH pats(kind, rank, role, pat, grp, least) AS (VALUES {pats}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT rid, pats.*, regexp_extract_all(t, pat) AS f, regexp_split_to_array(t, pat) AS g FROM d, pats WHERE regexp_matches(t, pat)),
        e AS (SELECT rid, kind, rank, role, pat, grp, least, unnest(f) AS s, unnest(list_transform(g[1:len(f)], lambda x: length(x))) AS gap, unnest(range(1, len(f) + 1)) AS i FROM m),
        p AS (SELECT *, sum(gap + length(s)) OVER (PARTITION BY rid, rank ORDER BY i) AS stop FROM e),
        h AS (SELECT rid, kind, rank, role, CAST(stop - length(s) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p
            WHERE length(CASE grp WHEN 0 THEN s WHEN 1 THEN regexp_extract(s, pat, 1) ELSE regexp_extract(s, pat, 2) END) >= least),
        base AS (SELECT * FROM h WHERE rank < {base}),
        weak AS (SELECT * FROM h WHERE rank >= {base} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = h.rid AND b.start < h.stop AND h.start < b.stop)),
        parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
        found AS (SELECT rid, kind, rank, start, stop FROM base UNION ALL SELECT rid, kind, rank, start, stop FROM weak w WHERE EXISTS (
            SELECT 1 FROM parts b WHERE b.rid = w.rid AND b.role <> w.role AND b.start < w.stop + {reach} AND w.start < b.stop + {reach} AND (b.stop <= w.start OR w.stop <= b.start)))
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {base}), '')) AS base_sha256,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
        FROM d LEFT JOIN found USING (rid) GROUP BY d.rid, doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others learn, count hashes that DuckDB lacks, or call a library: tests compare them
    with brute force."""
    return {"op8_secrets": _secrets_sql()}
