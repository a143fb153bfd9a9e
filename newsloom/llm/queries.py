"""The registered queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from newsloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    from newsloom.llm.simhash import hex_print, simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"), radius=2, size=3)
    return groups.select("doc_id", hex_print().alias("fingerprint"), "component_id")


@query(
    """
    WITH sized AS (
        SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
               CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
    firsts AS (
        SELECT payload_digest, max(page_id) AS first FROM sized WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id < first THEN first END AS refers_to
    FROM sized LEFT JOIN firsts USING (payload_digest)"""
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, deduplicated, and read back."""
    from newsloom.llm.warc import archive_table, deduplicated_archive

    _, lean = deduplicated_archive(table(spark, sf_dir, "pages"))
    return archive_table(spark, lean)


@query()
def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard once there is one more."""
    from newsloom.llm.shards import shard

    return shard(table(spark, sf_dir, "documents"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    from newsloom.llm.token_counts import default_tokenizer, token_counts

    return token_counts(table(spark, sf_dir, "documents"), default_tokenizer())


@query()
def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every vector."""
    from newsloom.llm.vector_dedup import vector_groups

    return vector_groups(table(spark, sf_dir, "embeddings"), least=0.93)


@query()
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    from newsloom.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query()
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    from newsloom.llm.pieces import default_model, encode

    return encode(table(spark, sf_dir, "documents"), default_model())


@query()
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines of every document that repeat an earlier line, nearly or exactly."""
    from newsloom.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), whole=False)


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    from newsloom.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from newsloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    """
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        -- crc32 of the decimal id, bit by bit: -1 stands for a shift, other items are bytes.
        SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(list_reduce([4294967295] || flatten(list_transform(range(1, len(name) + 1),
                                   lambda i: [ord(name[i]), -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda v, x: CASE WHEN x < 0 THEN xor(v >> 1, 3988292384 * (v & 1)) ELSE xor(v, x) END), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM turns)),
    rebuilt AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, role, text
        FROM (SELECT c.conv_id, 0 AS own, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
              UNION ALL
              SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h)),
    prefixes AS (
        SELECT conv_id, depth, length(text) AS size,
               string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key
        FROM rebuilt UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY 1),
    nodes AS (
        SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
               sha256(coalesce(string_agg(CASE WHEN l.depth IS NOT NULL THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM prefixes LEFT JOIN lengths l USING (conv_id, depth) GROUP BY 1, 2),
    parents AS (
        SELECT n.key, n.depth, p.key AS parent_key, m.conv_id AS parent
        FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes m ON m.key = p.key AND m.depth = p.depth),
    children AS (SELECT parent_key AS key, depth - 1 AS depth, count(*) AS n FROM parents GROUP BY 1, 2),
    subtrees AS (
        SELECT above.key, above.depth, count(*) FILTER (c.n IS NULL) AS leaves, sum(n.saved) AS saved
        FROM nodes n LEFT JOIN children c USING (key, depth) JOIN prefixes above ON above.conv_id = n.conv_id AND above.depth <= n.depth
        GROUP BY 1, 2)
    SELECT n.conv_id, n.depth, p.parent AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
           CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN subtrees s USING (key, depth) LEFT JOIN parents p USING (key, depth) LEFT JOIN children c USING (key, depth)"""
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each of which starts with turns of the first of its hundred."""
    from newsloom.llm.trie import prefix_trie

    shared = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6
    return prefix_trie(table(spark, sf_dir, "conversations"), period=100, shares=shared)


@query(
    """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
        FROM rows a JOIN rows r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row has the label after its own."""
    from newsloom.llm.negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)
