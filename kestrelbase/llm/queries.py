"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrelbase.llm import decontaminate, ngram_join, packing, quality, rules, sharding, substring, tokencount, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_seed_align_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), 16)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), n=3, threshold=70)


def op4_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.seed_labels(pages), urlfilter.RULES)


def op5_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_variable_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer())


def op7_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_read(spark, sf_dir, "documents"), _tokenizer(), limit=1024)


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_read(spark, sf_dir, "documents"))


def op9_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_seed_align_decontamination": op1_seed_align_decontamination,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_boosted_url_filter": op4_boosted_url_filter,
    "op5_subword_quality": op5_subword_quality,
    "op6_variable_best_fit_packing": op6_variable_best_fit_packing,
    "op7_two_tier_token_counts": op7_two_tier_token_counts,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_factorization_toxicity": op9_factorization_toxicity,
    "op10_weak_supervision_rules": op10_weak_supervision_rules,
}



def _crc_table() -> str:
    """The 256 remainders of the byte-wise CRC-32, as a DuckDB list."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return str(out) + "::BIGINT[]"


ORACLE_SQL = {
    # binary search of the capacity, each step a greedy fill; then cuts from the left, each as near to its even share as the capacity permits
    "op2_minimax_shards": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents),
g AS (SELECT k, sum(strlen(t) + 1)::BIGINT AS size FROM d GROUP BY k),
o AS (SELECT k, size, (sum(size) OVER (ORDER BY k))::BIGINT AS p FROM g),
a AS (SELECT list_prepend(0, list(p ORDER BY p)) AS ps, max(p) AS total, max(size) AS most FROM o),
b AS (SELECT greatest(ceil(total / 16)::BIGINT, most) AS low, total AS high FROM a
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE middle + 1 END, CASE WHEN ok THEN middle ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS middle,
    list_reduce(range(16), lambda s, i: list_max(list_filter(ps, lambda x: x <= s + (low + high) // 2)), 0::BIGINT) = total AS ok FROM b, a WHERE low < high)),
c AS (SELECT min(high) AS cap FROM b),
e AS (SELECT 16 AS j, total AS v FROM a UNION ALL SELECT j - 1, list_min(list_filter(ps, lambda x: x >= v - cap)) FROM e, a, c WHERE j > 1),
f AS (SELECT 0 AS j, 0::BIGINT AS v UNION ALL
  SELECT f.j + 1, least(greatest(list_filter(ps, lambda x: abs(16 * x - total * (f.j + 1)) = list_min(list_transform(ps, lambda y: abs(16 * y - total * (f.j + 1)))))[1], e.v, f.v), list_max(list_filter(ps, lambda x: x <= f.v + cap)))
  FROM f JOIN e ON e.j = f.j + 1, a, c WHERE f.j < 15),
cuts AS (SELECT list(v) AS vs FROM f WHERE j > 0),
s AS (SELECT k, len(list_filter(vs, lambda v: v <= p - size))::INTEGER AS shard FROM o, cuts)
SELECT doc_id, (strlen(t) + 1)::BIGINT AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT), lambda x, y: xor(x >> 8, list_extract({_crc_table()}, (xor(x, y) & 255) + 1)), 4294967295::BIGINT), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, d.k) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN s ON s.k = d.k
""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 70 * (x.n + y.n - i)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT doc_id, min(other) AS o FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_similar FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.n_similar, 0)::BIGINT AS n_similar, least(d.doc_id, coalesce(m.o, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
""",
}
