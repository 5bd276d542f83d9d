"""Queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, debruijn, decontaminate, filters, html, langid, packing, pii, simhash, tensored, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, taken as a response."""
    return warc.derivatives(warc.responses_of_pages(_read(spark, sf_dir, "pages")), keep=("page_id",))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the fold that isn't held out. Nothing is learned from a null id, held_out is false there."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_fold(4) != 2).select("doc_id", "text", "lang"))
    marked = docs.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "text")
    return langid.identify(marked, model, keep=("doc_id", "held_out"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labelled rows of the fold that isn't held out. Nothing is learned from a null id, held_out is false there."""
    docs = _read(spark, sf_dir, "documents")
    labels = toxicity.sample_labels(_read(spark, sf_dir, "labels").where(_fold(5) != 0))
    model = toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))
    marked = docs.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(marked, model, keep=("doc_id", "held_out"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without passages of 20 words that occur earlier."""
    kept = debruijn.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that reveal it."""
    found = pii.all_spans(_read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    everything = F.concat("spans", "terms")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("spans").cast("binary"), 256).alias("base_sha256"), joined(everything).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the group of near-duplicates that it belongs to."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 512 to 4096 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain passages of the benchmark, with the best overlap for each of its items."""
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by the similarity of their shingles, and which document of each group stays."""
    return tensored.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five quality filters remove from each source in all 120 orders."""
    return filters.audit(filters.measured(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    whole = _read(spark, sf_dir, "conversations")
    reports, repaired = conversations.repair(conversations.damage(whole))
    names = whole.select("conv_id").distinct().withColumn("key", conversations.key_of(F.col("conv_id")))
    found = names.join(reports, "key", "left").join(conversations.hashes(repaired), "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_pii": op5_pii,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_main_text": op9_main_text,
    "op10_decontamination": op10_decontamination,
    "op11_minhash": op11_minhash,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB SQL for the operators that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20
        ), windows AS (
            SELECT doc_id, s, w[s:s + 19] AS seq FROM starts
        ), repeated AS (
            SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT doc_id, s + k AS i FROM repeated, (SELECT unnest(range(0, 20)) AS k)
        ), by_doc AS (
            SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, w, coalesce(len(gone), 0) AS n_removed,
                   CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k
            FROM words LEFT JOIN by_doc USING (doc_id)
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS s FROM words
        ), nodes AS (
            SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s
        ), held AS (
            SELECT node, n, unnest(s) AS shingle FROM nodes
        ), links AS (
            SELECT a.node AS a, b.node AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.node < b.node
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), both_ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT node, node AS other FROM nodes
            UNION
            SELECT r.node, e.b FROM reached r JOIN both_ways e ON e.a = r.other
        ), named AS (
            SELECT node, min(other) AS component_id FROM reached GROUP BY node
        )
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN nodes USING (s) LEFT JOIN named USING (node)
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), l AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
                'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
            FROM d LEFT JOIN l USING (doc_id)
        ), patterns AS (
            SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [fails.A, fails.B, fails.C, fails.D, fails.E]) AS fails, count(*) AS n FROM f GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, step::INTEGER AS step, filter_order[step] AS x, [filter_order[k] FOR k IN range(1, step)] AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), outcomes AS (
            SELECT part, filter_order, step, x, n, good, toxic, fails[x] AS fails, len(list_filter(earlier, lambda y: fails[y])) > 0 AS gone,
                len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) AS many FROM steps, patterns
        ), counted AS (
            SELECT part, filter_order, step, x, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM outcomes GROUP BY ALL
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM counted
    """,
    # an inserted row costs more than to delete the one beside it, so one before a row and one at the end are more than any cheapest repair has
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT [list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) FOR n IN range(256)] AS t
        ), whole AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
        ), fated AS (
            SELECT *, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(k, '')], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS fate FROM whole, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0
        ), placed AS (
            SELECT conv_id, turn, role, text, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
        ), marked AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id
        ), next(q, x, goes, role) AS (
            VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')
        ), inserts AS (
            SELECT q AS p, q, 0 AS price, '' AS letter, []::VARCHAR[] AS lines FROM (SELECT unnest(range(4))::INTEGER AS q)
            UNION ALL SELECT q, goes, 5, 'I', [role || ':'] FROM next WHERE role IS NOT NULL
        ), best AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS s FROM counts
            UNION ALL
            SELECT conv_id, i, q, min(s) FROM (
                SELECT b.conv_id, b.i + 1 AS i, o.goes AS q, {'cost': (b.s.cost + n.price + o.price + CASE WHEN m.fault = 'truncated' AND o.letter <> 'D' THEN 5 ELSE 0 END)::BIGINT,
                    'audit': b.s.audit || n.letter || o.letter, 'lines': b.s.lines || n.lines || CASE o.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [o.role || ':' || m.text] END} AS s
                FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.i = b.i + 1 JOIN inserts n ON n.p = b.q
                JOIN (SELECT q, NULL AS x, q AS goes, NULL AS role, 2 AS price, 'D' AS letter FROM (SELECT unnest(range(4))::INTEGER AS q)
                    UNION ALL SELECT q, x, goes, NULL, 0, 'K' FROM next UNION ALL SELECT q, NULL, goes, role, 1, 'R' FROM next WHERE role IS NOT NULL) o
                ON o.q = n.q AND (o.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate') AND (o.letter = 'R' OR o.x = m.x))
            ) GROUP BY ALL
        ), ended AS (
            SELECT b.conv_id, min({'cost': b.s.cost + n.price, 'audit': b.s.audit || n.letter, 'lines': b.s.lines || n.lines}) AS s
            FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i JOIN inserts n ON n.p = b.q WHERE n.q IN (0, 3) GROUP BY b.conv_id
        )
        SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM w.conv_id
    """,
}
