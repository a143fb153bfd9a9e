"""Checks: cluster runs, identity, numbering, ranking, alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from newsloom.operators import clusters as C
from newsloom.operators import monitor as M
from newsloom.operators import ranking as R
from newsloom.plans.registry import as_text, check, text_sql

PUBLISHED = text_sql("published_at")


def run_tables(v):
    """One run whose clusters are the embedding labels, plus a cluster without members."""
    members = v.table("embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("label").cast("bigint").alias("cluster_id"), F.lit(1).alias("run_id")
    )
    heads = v.table("embeddings").select(F.col("label").cast("bigint").alias("id")).distinct()
    heads = heads.select(
        "id", F.concat(F.lit("Story "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("story-"), F.col("id").cast("string")).alias("slug"), F.lit(1).alias("run_id"),
    )
    # The empty cluster derives from the same table: one row, the number after the largest label.
    empty = v.table("embeddings").agg(F.max("label").cast("bigint").alias("m")).select(
        (F.col("m") + 1).alias("id"), F.lit("Empty").alias("title"), F.lit("empty").alias("slug"), F.lit(1).alias("run_id")
    )
    return heads.unionByName(empty), members


RUN_SQL = """
, heads AS (
  SELECT label AS cluster_id, 'Story ' || label AS cluster_title FROM (SELECT DISTINCT label FROM embeddings)
  UNION ALL SELECT max(label) + 1, 'Empty' FROM embeddings),
linked AS (SELECT e.label AS cluster_id, a.id AS article_id, a.title AS article_title, a.published_at
           FROM embeddings e JOIN articles a ON a.id = e.vec_id)
"""


@check("run_members", "articles", RUN_SQL + f"""
SELECT h.cluster_id, cluster_title, article_id, {PUBLISHED} AS published_at FROM heads h LEFT JOIN linked l ON l.cluster_id = h.cluster_id""")
def run_members(v):
    heads, links = run_tables(v)
    out = C.run_members(1, heads, links, v.articles())
    return out.select("cluster_id", "cluster_title", "article_id", as_text("published_at").alias("published_at"))


@check("load_run", "articles", RUN_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, article_id) - 1 AS pos FROM linked)
SELECT h.cluster_id, cluster_title, coalesce(pos // 20, 0) AS page,
       coalesce(string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos), '') AS ids
FROM heads h LEFT JOIN placed p ON p.cluster_id = h.cluster_id GROUP BY 1, 2, 3""")
def load_run(v):
    heads, links = run_tables(v)
    pages = C.load_run(1, heads, links, v.articles(), page_size=20)
    ids = F.array_join(F.transform("articles", lambda a: a["article_id"].cast("string")), " ")
    return pages.select("cluster_id", "cluster_title", "page", F.coalesce(ids, F.lit("")).alias("ids"))


@check("cluster_by_id", "articles", RUN_SQL + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, article_id) - 1 AS pos FROM linked)
SELECT h.cluster_id, cluster_title, coalesce(pos // 20, 0) AS page,
       coalesce(string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos), '') AS ids
FROM heads h LEFT JOIN placed p ON p.cluster_id = h.cluster_id WHERE h.cluster_id = (SELECT min(cluster_id) FROM heads) GROUP BY 1, 2, 3""")
def cluster_by_id(v):
    """The run's first cluster, named by a scalar subquery."""
    heads, links = run_tables(v)
    first = heads.where("run_id = 1").agg(F.min("id")).scalar()
    pages = C.cluster_by_id(1, first, heads, links, v.articles(), page_size=20)
    ids = F.array_join(F.transform("articles", lambda a: a["article_id"].cast("string")), " ")
    return pages.select("cluster_id", "cluster_title", "page", F.coalesce(ids, F.lit("")).alias("ids"))


@check("latest_run", "", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def latest_run(v):
    runs = v.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("is_production"),
    )
    return C.latest_run(runs).select("id", as_text("created_at").alias("created_at"))


@check("nonempty_clusters", "articles legacy_clusters", """
SELECT id, title FROM legacy_clusters c WHERE EXISTS (SELECT 1 FROM articles a WHERE a.cluster_id = c.id)""")
def nonempty_clusters(v):
    return C.nonempty_clusters(v.legacy_clusters(), v.articles(clusters=True)).select("id", "title")


@check("cluster_newest", "articles stories", f"SELECT cluster_id, {text_sql('max(published_at)')} AS newest FROM stories GROUP BY 1")
def cluster_newest(v):
    return C.cluster_newest(v.members()).select("cluster_id", as_text("newest").alias("newest"))


@check("drop_stale_clusters", "articles stories story_clock", """
SELECT cluster_id, id AS article_id FROM stories WHERE cluster_id IN
 (SELECT cluster_id FROM stories, story_clock GROUP BY cluster_id, now HAVING max(published_at) > now - INTERVAL 36 HOUR)""")
def drop_stale_clusters(v):
    return C.drop_stale_clusters(v.members(), v.story_now(), timedelta(hours=36)).select("cluster_id", "article_id")


@check("high_water_mark", "articles clock stories", f"""
SELECT 'members' AS kind, {text_sql('max(published_at)')} AS mark FROM stories
UNION ALL SELECT 'none', {text_sql("now - INTERVAL 3 DAY")} FROM clock""")
def high_water_mark(v):
    some = C.high_water_mark(v.members(), v.now())
    none = C.high_water_mark(v.members().where("cluster_id IS NULL"), v.now())
    return some.select(F.lit("members").alias("kind"), as_text("mark").alias("mark")).unionByName(
        none.select(F.lit("none").alias("kind"), as_text("mark").alias("mark"))
    )


@check("cluster_signature", "articles stories", """
SELECT cluster_id, count(*) AS members,
       CAST(sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT)) AS VARCHAR) AS signature
FROM stories GROUP BY 1""")
def cluster_signature(v):
    return C.cluster_signature(v.members())


@check("carry_titles", "articles stories", """
, cur AS (SELECT cluster_id, id, CASE WHEN hash_group = 0 THEN cluster_id || '/even' ELSE cluster_id END AS label
          FROM (SELECT cluster_id, id, CASE WHEN ascii(cluster_id) % 2 = 0 AND id % 2 = 0 THEN 0 ELSE 1 END AS hash_group FROM stories)),
old AS (SELECT cluster_id, list_sort(list(id)) AS ids FROM stories GROUP BY 1),
new AS (SELECT label, list_sort(list(id)) AS ids FROM cur GROUP BY 1)
SELECT label, 'Title of ' || cluster_id AS title FROM new JOIN old ON old.ids = new.ids""")
def carry_titles(v):
    """Clusters with an even first digit split by id parity; the rest keep their member set."""
    members = v.members()
    split = (F.ascii("cluster_id") % 2 == 0) & (F.col("article_id") % 2 == 0)
    current = members.select(
        F.when(split, F.concat("cluster_id", F.lit("/even"))).otherwise(F.col("cluster_id")).alias("label"), "article_id"
    )
    titles = members.select(F.col("cluster_id").alias("id")).distinct().withColumn("title", F.concat(F.lit("Title of "), "id"))
    return C.carry_titles(members, titles, current)


def labelled(v):
    """Story labels as numbers, every third article as noise."""
    return v.articles(clusters=True).where("cluster_id IS NOT NULL").select(
        "id", "published_at", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("cluster_id")).cast("bigint").alias("label")
    )


LABELLED_SQL = """
, labelled AS (SELECT id, published_at, CASE WHEN id % 3 = 0 THEN -1 ELSE cluster_id END AS label
               FROM articles WHERE cluster_id IS NOT NULL)
"""


@check("next_label", "articles", LABELLED_SQL + "SELECT CAST(max(label) + 1 AS BIGINT) AS next_label FROM labelled")
def next_label(v):
    return C.next_label(labelled(v))


@check("assign_singletons", "articles", LABELLED_SQL + """
SELECT id, label FROM labelled WHERE label <> -1
UNION ALL
SELECT id, (SELECT max(label) FROM labelled) + row_number() OVER (ORDER BY published_at DESC, id) FROM labelled WHERE label = -1""")
def assign_singletons(v):
    return C.assign_singletons(labelled(v)).select("id", "label")


@check("group_members", "articles", LABELLED_SQL + """
SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY published_at DESC, id) AS position FROM labelled""")
def group_members(v):
    return C.group_members(labelled(v)).select("label", "id", "position")


@check("first_title", "articles stories", """
SELECT cluster_id, arg_max(title, {'t': published_at, 'i': -id}) AS title FROM stories GROUP BY 1""")
def first_title(v):
    return C.first_title(v.members())


TOP_TITLES_SQL = """
SELECT cluster_id, string_agg(title, chr(10) ORDER BY place) AS titles FROM
 (SELECT cluster_id, title, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, id) AS place FROM stories)
WHERE place <= 5 GROUP BY 1"""


@check("top_titles", "articles stories", TOP_TITLES_SQL)
def top_titles(v):
    return C.top_titles(v.members())


@check("title_prompt", "articles stories", f"SELECT cluster_id, 'Name it:' || chr(10) || chr(10) || titles AS prompt FROM ({TOP_TITLES_SQL})")
def title_prompt(v):
    return C.render_title_prompt(v.members(), head="Name it:")


@check("resolve_titles", "articles stories", """
SELECT cluster_id, CASE WHEN starts_with(cluster_id, '1') THEN 'Made ' || cluster_id
                        ELSE arg_max(title, {'t': published_at, 'i': -id}) END AS title FROM stories GROUP BY 1""")
def resolve_titles(v):
    made = v.members().select("cluster_id").distinct().where(F.startswith("cluster_id", F.lit("1")))
    return C.resolve_titles(v.members(), made.withColumn("title", F.concat(F.lit("Made "), "cluster_id")))


def titled(v):
    """Carried-over titles (labels starting with an even digit) and new ones."""
    first = C.first_title(v.members(), "cluster_id").withColumnRenamed("cluster_id", "label")
    even = F.ascii("label") % 2 == 0
    return C.reused_then_new(first.where(even), first.where(~even))


TITLED_SQL = """
, titled AS (SELECT cluster_id AS label, arg_max(title, {'t': published_at, 'i': -id}) AS title,
                    ascii(cluster_id) % 2 <> 0 AS is_new FROM stories GROUP BY 1)
"""


@check("reused_then_new", "articles stories", TITLED_SQL + "SELECT * FROM titled")
def reused_then_new(v):
    return titled(v)


@check("cluster_slugs", "articles clock stories", TITLED_SQL + r"""
, indexed AS (SELECT *, row_number() OVER (ORDER BY is_new, label) - 1 AS cluster_no FROM titled)
SELECT label, cluster_no,
       lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))
       || '-' || strftime(now, '%Y-%m-%d-%H-%M') || '-' || cluster_no AS slug
FROM indexed, clock""")
def cluster_slugs(v):
    rows = C.cluster_index(titled(v))
    return rows.select("label", "cluster_no", C.cluster_slug(F.col("title"), v.now(), F.col("cluster_no")).alias("slug"))


@check("run_metrics", "articles stories", TITLED_SQL + "SELECT count(*) FILTER (is_new) AS created, count(*) FILTER (NOT is_new) AS kept FROM titled")
def run_metrics(v):
    return C.run_metrics(titled(v))


@check("fetched_per_provider", "articles entries", "SELECT provider_key, count(*) AS fetched FROM entries GROUP BY 1")
def fetched_per_provider(v):
    return C.fetched_per_provider(v.entries())


# -- ranking -------------------------------------------------------------------------------------

SCORE_SQL = """
, facts AS (
  SELECT cluster_id, count(*) AS size, avg(epoch_us(published_at) / 1e6) AS avg_published, max(published_at) AS most_recent,
         avg(p.rank) AS avg_rank
  FROM stories s JOIN providers p ON p.key = s.news_provider_key GROUP BY 1),
scored AS (
  SELECT f.*, round(0.4 * least(size / (SELECT max(size) FROM facts), 1.0)
                  + 0.3 * exp(-(epoch_us(now) / 1e6 - avg_published) / 3600)
                  + 0.3 * (1 - least(avg_rank / (SELECT max(rank) FROM providers), 1.0)), 4) AS score
  FROM facts f, clock)
"""


@check("providers_ranked", "articles providers stories", """
SELECT s.id, s.cluster_id, p.rank FROM stories s JOIN providers p ON p.key = s.news_provider_key""")
def providers_ranked(v):
    return R.providers_ranked(v.stories(), v.providers()).select("id", "cluster_id", "rank")


@check("cluster_with_articles", "articles legacy_clusters", """
SELECT c.id AS cluster_id, c.title AS cluster_title, a.id FROM legacy_clusters c JOIN articles a ON a.cluster_id = c.id""")
def cluster_with_articles(v):
    return R.cluster_with_articles(v.legacy_clusters(), v.articles(clusters=True)).select("cluster_id", "cluster_title", "id")


@check("avg_published", "articles stories", """
SELECT cluster_id, round(avg(epoch_us(published_at) / 1e6), 3) AS avg_published FROM stories GROUP BY 1""")
def avg_published(v):
    return R.avg_published(v.stories()).select("cluster_id", F.round("avg_published", 3).alias("avg_published"))


@check("feed_globals", "articles providers stories", """
SELECT max(rank) AS max_rank, (SELECT max(n) FROM (SELECT count(*) AS n FROM stories GROUP BY cluster_id)) AS max_size FROM providers""")
def feed_globals(v):
    return R.feed_globals(v.stories(), v.providers())


@check("cluster_score", "articles clock providers stories", SCORE_SQL + """
SELECT cluster_id, size, round(avg_rank, 6) AS avg_rank, score FROM scored""")
def cluster_score(v):
    out = R.cluster_score(v.stories(), v.providers(), v.now())
    return out.select("cluster_id", "size", F.round("avg_rank", 6).alias("avg_rank"), "score")


@check("top_feed", "articles clock providers stories", SCORE_SQL + f"""
SELECT cluster_id, size, {text_sql("most_recent")} AS most_recent, score FROM scored ORDER BY score DESC, cluster_id LIMIT 20""")
def top_feed(v):
    out = R.top_feed(R.cluster_score(v.stories(), v.providers(), v.now()))
    return out.select("cluster_id", "size", as_text("most_recent").alias("most_recent"), "score")


@check("feed_card", "articles clock providers stories", SCORE_SQL + f"""
SELECT c.cluster_id, c.score, round(c.avg_rank, 6) AS avg_rank, s.id AS article_id, s.title, s.url, {text_sql("s.published_at")} AS published_at
FROM (SELECT * FROM scored ORDER BY score DESC, cluster_id LIMIT 20) c JOIN stories s ON s.cluster_id = c.cluster_id""")
def feed_card(v):
    out = R.feed_card(v.stories(), v.providers(), v.now())
    return out.select("cluster_id", "score", F.round("avg_rank", 6).alias("avg_rank"), "article_id", "title", "url",
                      as_text("published_at").alias("published_at"))


# -- alerts --------------------------------------------------------------------------------------

PATTERN = "tick done: .* articles stored"
BREACH_SQL = """
, grid AS (SELECT unnest(generate_series(CAST(floor(epoch(min(ts)) / 60) * 60 AS BIGINT), CAST(ceil(epoch(max(ts)) / 60) * 60 AS BIGINT), 60)) AS tick FROM log),
hits AS (SELECT epoch_us(ts) AS us FROM log WHERE event_type = 'click'),
cum AS (SELECT us, row_number() OVER (ORDER BY us) AS k FROM hits),
upto AS (SELECT g.tick, coalesce(c.k, 0) AS hi FROM grid g ASOF LEFT JOIN cum c ON c.us <= g.tick * 1000000),
since AS (SELECT g.tick, coalesce(c.k, 0) AS lo FROM grid g ASOF LEFT JOIN cum c ON c.us <= (g.tick - 1200) * 1000000),
states AS (SELECT u.tick, hi - lo AS n, hi - lo < 1 AS breached FROM upto u JOIN since s ON s.tick = u.tick)
"""


@check("liveness_breaches", "log", BREACH_SQL + "SELECT 'ingest' AS service, tick, n, breached FROM states")
def liveness_breaches(v):
    return M.breaches(v.log(), PATTERN)


@check("liveness_alert", "log", BREACH_SQL + """
SELECT 'ingest' AS service, tick, n FROM
 (SELECT *, count(*) FILTER (breached) OVER (ORDER BY tick ROWS 5 PRECEDING) AS held FROM states) WHERE held = 6""")
def liveness_alert(v):
    return M.liveness_alert(v.log(), PATTERN)


@check("breach_periods", "log", BREACH_SQL + """
SELECT 'ingest' AS service, min(tick) AS since, max(tick) AS until, CASE WHEN max(tick) - min(tick) >= 300 THEN min(tick) + 300 END AS fires_at
FROM (SELECT tick, tick - 60 * row_number() OVER (ORDER BY tick) AS island FROM states WHERE breached) GROUP BY island""")
def breach_periods(v):
    return M.breach_periods(M.breaches(v.log(), PATTERN))


@check("failure_alert", "checks", """
SELECT service, tick, count(*) AS n FROM
 (SELECT service, CAST(ceil(epoch_us(ts) / 60e6) * 60 AS BIGINT) + 60 * unnest(range(15)) AS tick FROM checks WHERE NOT ok)
GROUP BY 1, 2 HAVING count(*) >= 2""")
def failure_alert(v):
    return M.failure_alert(v.checks())
