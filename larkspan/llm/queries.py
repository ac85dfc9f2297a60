"""The operators of this package over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import decontamination, languages, mixing, neighbours, secret_scan, sharding, simhash, substrings, tokens, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_warc(_read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.removed_windows(_read(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_hilbert_shards, op5_token_counts, op6_substrings, op7_secrets, op8_languages, op9_contamination, op10_neighbours)}


def _hilbert(bits: int) -> str:
    """CTEs ``b0`` to ``b<bits>`` that walk down the curve from the highest bits of cells ``x, y, z`` of a table ``cells``."""
    steps = ["b0 AS (SELECT *, 0 AS h, 0 AS e, 0 AS d FROM cells)"]
    for k in range(bits):
        level = bits - 1 - k
        corner = f"(((x >> {level}) & 1) + 2 * ((y >> {level}) & 1) + 4 * ((z >> {level}) & 1))"
        steps.append(f"""t{k} AS (SELECT *, xor({corner}, e) AS c, (d + 1) % 3 AS n FROM b{k}),
g{k} AS (SELECT * EXCLUDE (c), ((c >> n) | (c << (3 - n))) & 7 AS g FROM t{k}),
p{k} AS (SELECT * EXCLUDE (g), xor(xor(g, g >> 1), g >> 2) AS p FROM g{k}),
b{k + 1} AS (SELECT * EXCLUDE (p, h, e, d, n), 8 * h + p AS h,
  xor(e, (({list(sharding.ENTRY)}[p + 1] << n) | ({list(sharding.ENTRY)}[p + 1] >> (3 - n))) & 7) AS e, (d + {list(sharding.AXIS)}[p + 1] + 1) % 3 AS d FROM p{k})""")
    return ",\n".join(steps)


def _depth_cells(column: str) -> str:
    return f"""(SELECT {column} AS v, floor(coalesce(sum(n) OVER (ORDER BY {column} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * {1 << sharding.BITS} / (SELECT count(*) FROM r))::INT AS cell
  FROM (SELECT {column}, count(*) AS n FROM r GROUP BY {column}))"""


#: A checksum by half bytes: the register's last four bits pick one of 16 remainders, which are worked out first.
_CRC32 = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(2 * octet_length(body)), lambda j: (instr('0123456789ABCDEF', hexes[xor(j, 1::BIGINT) + 1]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 4, rem[(xor(a, b) & 15) + 1]))"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""",
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0)::DOUBLE AS caps, coalesce(sum(weight) OVER b, 0)::DOUBLE AS weights FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - caps) / ((SELECT sum(weight) FROM w)::DOUBLE - weights)) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM w, l),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0
    ELSE (whole // source_size) * size + greatest(0, least(size, whole % source_size - start)) END)::BIGINT AS taken
FROM q
""",
    "op4_hilbert_shards": f"""
WITH RECURSIVE q AS (SELECT k, 0 AS step, k::BIGINT AS v FROM range(16) t(k)
  UNION ALL SELECT k, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM q WHERE step < 4),
remainders AS (SELECT list(v ORDER BY k) AS rem FROM q WHERE step = 4),
h AS (SELECT doc_id, source, lang, encode(coalesce(text, '')) AS body, string_split(hex(encode(coalesce(text, ''))), '') AS hexes FROM documents),
r AS (SELECT doc_id, source, lang, (octet_length(body) + 1)::BIGINT AS size, xor({_CRC32}, 4294967295::BIGINT) AS text_crc32 FROM h, remainders),
cells AS (SELECT r.*, s.cell AS x, l.cell AS y, least({(1 << sharding.BITS) - 1}, floor(ln(size) / ln(2) * 2))::INT AS z
  FROM r JOIN {_depth_cells("source")} s ON r.source IS NOT DISTINCT FROM s.v JOIN {_depth_cells("lang")} l ON r.lang IS NOT DISTINCT FROM l.v),
{_hilbert(sharding.BITS)},
o AS (SELECT *, row_number() OVER (ORDER BY h, source NULLS LAST, lang NULLS LAST, size, doc_id NULLS LAST, text_crc32) - 1 AS rank, count(*) OVER () AS total FROM b{sharding.BITS})
SELECT doc_id, size, text_crc32, 'rows' AS law, (rank * 16 // total)::INT AS shard, (rank - (rank * 16 // total * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, h::INT AS hilbert FROM o
""",
    "op6_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
f AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS k FROM g JOIN m USING (s) WHERE m.first < g.doc_id),
r AS (SELECT doc_id, list(k) AS ks FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN ws
    ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ks, x)), lambda x: ws[x]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""",
}
