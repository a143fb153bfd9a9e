"""Logical tables built from the driver's parquet tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = ("left", "center-left", "center", "center-right", "right")
VOTE_WORDS = ("left", "center left", "center", "center right", "right")


class DriverViews:
    """Logical tables over one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def articles(self, clusters: bool = False, categories: bool = False) -> DataFrame:
        """Documents with the time of their event; cluster and categories are joined when asked for."""
        events = self.table("events").select(
            F.expr("event_id div 5").alias("doc_id"),
            F.col("ts").cast("timestamp").alias("published_at"),
            F.col("event_id").alias("_event"),
            "event_type",
        )
        # Titles are cut before the join, so texts are shuffled only where they are asked for.
        documents = self.table("documents").select(
            "doc_id",
            F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            "lang",
            F.col("source").alias("news_provider_key"),
        )
        rows = documents.join(events.where("_event % 5 = 0"), "doc_id")
        columns = [F.col("doc_id").alias("id"), *map(F.col, ("url", "title", "published_at", "content", "lang", "news_provider_key"))]
        if clusters:
            labels = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"))
            rows = rows.join(labels, "doc_id", "left")
            columns.append(F.col("cluster_id"))
        if categories:
            rows = rows.join(self.table("labels").select("doc_id", "quality"), "doc_id", "left")
            named = F.array_compact(F.array("lang", "event_type", F.col("quality").cast("string")))
            columns.append(named.alias("categories"))
        return rows.select(*columns)

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
        )

    def articles_with_vectors(self) -> DataFrame:
        return self.articles().join(self.vectors(), "id")

    def providers(self) -> DataFrame:
        number = F.regexp_extract("key", r"(\d+)", 1).cast("int")
        keys = self.table("documents").select(F.col("source").alias("key")).distinct()
        ratings = F.array(*[F.lit(r) for r in RATINGS])
        return keys.select(
            "key",
            F.concat(F.lit("Outlet "), number.cast("string")).alias("name"),
            F.concat(F.lit("https://"), "key", F.lit(".example")).alias("url"),
            (number % 5).cast("int").alias("rank"),
            F.get(ratings, number % 5).alias("bias_rating"),
            F.when(number % 10 == 0, F.expr("INTERVAL '5' DAY"))
            .otherwise(F.expr("INTERVAL '2' DAY"))
            .cast("interval day to second")
            .alias("time_window"),
            F.lit("%a, %d %b %Y %H:%M:%S %z").alias("date_format"),
        )

    def now(self) -> Column:
        """Newest published time of the scale in use, as a scalar subquery."""
        return self.articles().agg(F.max("published_at")).scalar()

    def story_now(self) -> Column:
        """Newest published time among the articles that have a vector."""
        return self.stories().agg(F.max("published_at")).scalar()

    def entries(self) -> DataFrame:
        """Documents that link to pages; links repeat on purpose."""
        pages = self.table("pages").select("page_id", "url")
        total = pages.agg(F.count("*")).scalar()
        return (
            self.articles()
            .withColumn("page_id", F.col("id") % total)
            .join(pages.withColumnRenamed("url", "link"), "page_id")
            .select(
                "link",
                F.col("news_provider_key").alias("provider_key"),
                "title",
                "published_at",
                F.nullif(F.get(F.split("content", "\n"), F.lit(1)), F.lit("")).alias("summary"),
                F.array().cast("array<string>").alias("image_urls"),
                "id",
            )
        )

    def stories(self) -> DataFrame:
        """Articles keyed by (label, day): the cluster input of the ranked feed."""
        day = F.date_format("published_at", "yyyy-MM-dd")
        articles = self.articles(clusters=True).where("cluster_id IS NOT NULL")
        return articles.withColumn("cluster_id", F.concat(F.col("cluster_id").cast("string"), F.lit("/"), day))

    def members(self) -> DataFrame:
        """Story membership in the column names of the cluster operators."""
        return self.stories().select(
            "cluster_id", F.col("id").alias("article_id"), F.col("title").alias("article_title"), "published_at"
        )

    def legacy_clusters(self) -> DataFrame:
        """Ten labelled legacy clusters and as many empty ones."""
        labels = self.table("embeddings").select("label").distinct()
        full = labels.select(
            F.col("label").cast("bigint").alias("id"),
            F.concat(F.lit("Story "), F.col("label").cast("string")).alias("title"),
            F.concat(F.lit("story-"), F.col("label").cast("string")).alias("slug"),
        )
        empty = full.select(
            (F.col("id") + 1000).alias("id"), F.concat("title", F.lit(" (empty)")).alias("title"),
            F.concat("slug", F.lit("-empty")).alias("slug"),
        )
        return full.unionByName(empty)

    def votes(self) -> DataFrame:
        words = F.array(*[F.lit(w) for w in VOTE_WORDS])
        return self.table("events").select(
            F.col("user_id").cast("string").alias("user_id"),
            F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("provider_id"),
            F.get(words, (F.col("event_id") % 5).cast("int")).alias("value"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def responses(self) -> DataFrame:
        """Analysis answers as JSON text; every seventh one is cut off."""
        payload = F.to_json(
            F.struct(
                F.col("content").alias("summary"),
                (F.col("id") % 10 + 1).cast("int").alias("rank"),
                F.array("lang", "news_provider_key").alias("categories"),
                F.lit("city street").alias("stock_image_search"),
                (F.col("id") % 3 == 0).alias("is_paywalled"),
            )
        )
        return self.articles().select(
            "url",
            F.when(F.col("id") % 7 == 0, F.left(payload, F.lit(30))).otherwise(payload).alias("payload"),
        )

    def log(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.lit("ingest").alias("service"),
            F.when(F.col("event_type") == "click", F.lit("tick done: 3 articles stored"))
            .otherwise(F.col("event_type"))
            .alias("message"),
        )

    def checks(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("probe-"), (F.col("user_id") % 3).cast("string")).alias("service"),
            (F.col("event_type") != "error").alias("ok"),
        )


# The same tables as SQL; a check prefixes the ones it names.
SQL_VIEWS = {
    "articles": """
        SELECT d.doc_id AS id, concat('https://', d.source, '.example/', d.doc_id) AS url,
               split_part(d.text, chr(10), 1) AS title, CAST(e.ts AS TIMESTAMP) AS published_at,
               d.text AS content, d.lang, concat(d.source, '') AS news_provider_key, m.label AS cluster_id,
               [x FOR x IN [d.lang, e.event_type, CAST(l.quality AS VARCHAR)] IF x IS NOT NULL] AS categories
        FROM documents d JOIN events e ON e.event_id = d.doc_id * 5
        LEFT JOIN embeddings m ON m.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "clock": "SELECT max(published_at) AS now FROM articles",
    "providers": """
        SELECT key, 'Outlet ' || num AS name, 'https://' || key || '.example' AS url, num % 5 AS rank,
               ['left', 'center-left', 'center', 'center-right', 'right'][num % 5 + 1] AS bias_rating,
               CASE WHEN num % 10 = 0 THEN 5 ELSE 2 END AS window_days
        FROM (SELECT DISTINCT source AS key, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS num
              FROM documents)""",
    "entries": """
        SELECT concat(p.url, '') AS link, concat(a.news_provider_key, '') AS provider_key, a.title, a.published_at,
               nullif(string_split(a.content, chr(10))[2], '') AS summary, a.id
        FROM articles a JOIN pages p ON p.page_id = a.id % (SELECT count(*) FROM pages)""",
    "stories": """
        SELECT * REPLACE (CAST(cluster_id AS VARCHAR) || '/' || strftime(published_at, '%Y-%m-%d') AS cluster_id)
        FROM articles WHERE cluster_id IS NOT NULL""",
    "story_clock": "SELECT max(published_at) AS now FROM stories",
    "legacy_clusters": """
        SELECT CAST(label AS BIGINT) AS id, 'Story ' || label AS title, 'story-' || label AS slug
        FROM (SELECT DISTINCT label FROM embeddings)
        UNION ALL
        SELECT label + 1000, 'Story ' || label || ' (empty)', 'story-' || label || '-empty'
        FROM (SELECT DISTINCT label FROM embeddings)""",
    "votes": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, 'src' || (event_id % 20) AS provider_id,
               ['left', 'center left', 'center', 'center right', 'right'][event_id % 5 + 1] AS value,
               CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
    "log": """
        SELECT CAST(ts AS TIMESTAMP) AS ts, 'ingest' AS service, event_type FROM events""",
    "checks": """
        SELECT CAST(ts AS TIMESTAMP) AS ts, 'probe-' || (user_id % 3) AS service, event_type <> 'error' AS ok
        FROM events""",
}


def with_views(names: str, body: str) -> str:
    """SQL statement with the named views (in dependency order) as common table expressions."""
    ctes = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n].strip()})" for n in names.split()]
    return (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + body.strip()
