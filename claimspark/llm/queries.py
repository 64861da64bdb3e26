"""Queries over the documents, embeddings, pages and conversations tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import alignment, ann, chat, decontaminate, jaccard_join, minhash, mixing, pii, quality, token_count, token_store, vector_codes, warc
from claimspark.llm.common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_sequences(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's counts are of base spans, as base_sha256 is; what the field adds is in ``spans`` and all_ counts."""
    found = pii.find(table(spark, sf_dir, "documents")).withColumnsRenamed({f"n_{kind}": f"all_{kind}" for kind in pii.KINDS})
    return found.select("doc_id", *(F.col(f"base_{kind}").alias(f"n_{kind}") for kind in pii.KINDS), "base_sha256", "spans", *(f"all_{kind}" for kind in pii.KINDS))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_source_mixing": op3_source_mixing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_token_counts": op6_token_counts,
    "op7_token_store": op7_token_store,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_token_alignment": op11_token_alignment,
    "op12_circulant_minhash": op12_circulant_minhash,
    "op13_vector_codes": op13_vector_codes,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"



def _mixing_sql() -> str:
    """The mix without bands: plain windows over each source."""
    steps = []
    for i in range(1, mixing.FILLS + 1):
        steps.append(f"""
        able_{i} AS (
            SELECT r.*, sum(size) OVER (PARTITION BY r.source ORDER BY r.key, r.tie RANGE UNBOUNDED PRECEDING) AS upto, p.rest
            FROM rows_{i - 1} r JOIN rest_{i - 1} p ON r.source IS NOT DISTINCT FROM p.source
            WHERE NOT r.chosen AND r.size > 0 AND r.size <= p.rest AND (p.key IS NULL OR (r.key, r.tie) > (p.key, p.tie))),
        fit_{i} AS (SELECT source, max(upto) AS used, max((key, tie)) AS last FROM able_{i} WHERE upto <= rest GROUP BY source),
        rows_{i} AS (
            SELECT r.* REPLACE (r.chosen OR coalesce((r.key, r.tie) <= f.last AND (p.key IS NULL OR (r.key, r.tie) > (p.key, p.tie)) AND r.size > 0 AND r.size <= p.rest, false) AS chosen)
            FROM rows_{i - 1} r JOIN rest_{i - 1} p ON r.source IS NOT DISTINCT FROM p.source LEFT JOIN fit_{i} f ON r.source IS NOT DISTINCT FROM f.source),
        rest_{i} AS (
            SELECT p.source, p.rest - coalesce(f.used, 0) AS rest, coalesce(f.last[1], p.key) AS key, coalesce(f.last[2], p.tie) AS tie
            FROM rest_{i - 1} p LEFT JOIN fit_{i} f ON p.source IS NOT DISTINCT FROM f.source)""")
    return rf"""
        WITH base AS (
            SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS tie
            FROM documents),
        keyed AS (
            SELECT doc_id, source, size, tie,
                round(-ln((('0x' || tie[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / greatest(0.1, 1.0 - 4.0 * (length(t) - length(translate(t, '{mixing.SIGNS}', ''))) / greatest(length(t), 1)), 9) AS key
            FROM base),
        sizes AS (SELECT source, sum(size)::DOUBLE AS s FROM keyed GROUP BY source),
        weighed AS (SELECT source, s, 3 * s AS cap, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM sizes),
        levels AS (
            SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM weighed),
        goals AS (SELECT source, s, least(cap, w * coalesce((SELECT max(level) FROM levels WHERE level * w <= cap), 'inf'::DOUBLE)) AS target FROM levels),
        plan AS (SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS epochs FROM goals),
        rest_0 AS (SELECT source, target - epochs * s AS rest, NULL::DOUBLE AS key, NULL::VARCHAR AS tie FROM plan),
        rows_0 AS (SELECT *, false AS chosen FROM keyed),{','.join(steps)}
        SELECT r.doc_id, r.size::BIGINT AS size, p.s::BIGINT AS source_size, p.target, ((p.epochs + r.chosen::INT) * r.size)::BIGINT AS taken
        FROM rows_{mixing.FILLS} r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source"""


def _components_sql(k: int, percent: int, more: str = "") -> str:
    """All pairs that share a shingle, and what they reach."""
    return rf"""
        WITH RECURSIVE tokens AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: concat_ws(' ', w[i], {', '.join(f'w[i + {j}]' for j in range(1, k))})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
            FROM tokens),
        copies AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets GROUP BY s),
        items AS (SELECT rep, n, unnest(s) AS t FROM copies),
        common AS (
            SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS c
            FROM items a JOIN items b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            GROUP BY ALL),
        links AS (SELECT x, y FROM common WHERE 100 * c >= {percent} * (nx + ny - c)),
        edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT x, x FROM links UNION SELECT y, y FROM links),
        reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
        least_id AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
        SELECT d.doc_id, c.n::BIGINT AS n_shingles, CASE WHEN c.n = 0 THEN d.doc_id ELSE coalesce(l.low, c.rep) END AS component_id{more}
        FROM sets d JOIN copies c ON d.s = c.s LEFT JOIN least_id l ON c.rep = l.x"""


_BASE32 = "list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || sha1(h)[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], 'string_agg', '')"



def _codes_sql() -> str:
    """Every round spelled out: distances entry by entry, means position by position."""
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
        far_{k} AS (SELECT vec_id, y.p, e, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM y JOIN book_{k} b ON y.p = b.p),
        near_{k} AS (SELECT vec_id, p, any_value(x) AS x, min((d, e)) AS best FROM far_{k} GROUP BY vec_id, p)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""
        flat_{k} AS (SELECT p, best[2] AS e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near_{k}),
        mean_{k} AS (SELECT p, e, i, floor(sum(v) / count(*))::BIGINT AS v FROM flat_{k} GROUP BY p, e, i),
        new_{k} AS (SELECT p, e, list(v ORDER BY i) AS c FROM mean_{k} GROUP BY p, e),
        book_{k + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book_{k} b LEFT JOIN new_{k} n ON b.p = n.p AND b.e = n.e)""")
    last = vector_codes.ROUNDS
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda c: floor({vector_codes.SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = len(embedding)),
        y AS MATERIALIZED (SELECT vec_id, p::INT AS p, v[p * len(v) // {vector_codes.PARTS} + 1 : (p + 1) * len(v) // {vector_codes.PARTS}] AS x FROM kept, range({vector_codes.PARTS}) r(p)),
        seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {vector_codes.ENTRIES}),
        book_0 AS (SELECT p, e, x AS c FROM y JOIN seeds USING (vec_id)),{','.join(s.replace(' AS (', ' AS MATERIALIZED (') for s in steps)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near_{last} GROUP BY vec_id),
        hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book_{last})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), hash"""


ORACLES: dict[str, str] = {
    "op10_warc_round_trip": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, {_BASE32.replace('sha1(h)', 'sha1(p.h)')} AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f ON p.h = f.h""",
    "op3_source_mixing": _mixing_sql(),
    "op13_vector_codes": _codes_sql(),
    "op4_ngram_jaccard_join": _components_sql(3, 90),
    "op12_circulant_minhash": _components_sql(5, 85, ", d.doc_id = component_id AS kept"),
}
