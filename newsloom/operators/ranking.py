"""Ranked feeds: score events by size, recency and outlet importance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Clock = datetime | Column

# Weights of the size, recency and outlet parts of the score.
SIZE_WEIGHT, RECENCY_WEIGHT, RANK_WEIGHT = 0.4, 0.3, 0.3


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def providers_ranked(members: DataFrame, providers: DataFrame) -> DataFrame:
    """Members with the rank of their outlet."""
    ranks = providers.where("rank IS NOT NULL").select(F.col("key").alias("news_provider_key"), "rank")
    return members.join(ranks, "news_provider_key")


def cluster_with_articles(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per (cluster, article); clusters without articles drop out."""
    return clusters.select(F.col("id").alias("cluster_id"), F.col("title").alias("cluster_title")).join(
        articles, "cluster_id"
    )


def avg_published(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.avg(epoch_seconds(F.col("published_at"))).alias("avg_published"))


def cluster_facts(members: DataFrame, providers: DataFrame) -> DataFrame:
    """Size, mean time, newest time and mean outlet rank per cluster; partial sums map-side."""
    return (
        providers_ranked(members, providers)
        .groupBy("cluster_id")
        .agg(
            F.count("*").alias("size"),
            F.avg(epoch_seconds(F.col("published_at"))).alias("avg_published"),
            F.max("published_at").alias("most_recent"),
            F.avg("rank").alias("avg_rank"),
        )
    )


def feed_globals(members: DataFrame, providers: DataFrame) -> DataFrame:
    """One row: highest outlet rank and largest cluster."""
    largest = members.groupBy("cluster_id").count().agg(F.max("count")).scalar()
    return providers.agg(F.max("rank").alias("max_rank"), largest.alias("max_size"))


def cluster_score(members: DataFrame, providers: DataFrame, now: Clock) -> DataFrame:
    """Score per cluster. The two global maxima are scalar subqueries, not a cross join.

    A catalogue whose highest rank is 0 gives every cluster the full outlet part.
    """
    facts = cluster_facts(members, providers)
    max_size = facts.agg(F.max("size")).scalar()
    max_rank = providers.agg(F.max("rank")).scalar()
    age_hours = (epoch_seconds(now if isinstance(now, Column) else F.lit(now)) - F.col("avg_published")) / 3600
    size_part = F.least(F.col("size") / max_size, F.lit(1.0))
    rank_part = 1 - F.least(F.coalesce(F.col("avg_rank") / F.nullif(max_rank, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    score = SIZE_WEIGHT * size_part + RECENCY_WEIGHT * F.exp(-age_hours) + RANK_WEIGHT * rank_part
    return facts.withColumn("score", F.round(score, 4))


def top_feed(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("cluster_id")).limit(n)


def feed_card(members: DataFrame, providers: DataFrame, now: Clock, n: int = 20) -> DataFrame:
    """Cards of the top ``n`` clusters with their articles, one row per (card, article).

    The relation replaces a nested list: a card may hold any number of articles.
    """
    cards = top_feed(cluster_score(members, providers, now), n).select(
        "cluster_id", "score", "most_recent", "avg_rank"
    )
    articles = members.select(
        "cluster_id",
        F.col("id").alias("article_id"),
        "title",
        "published_at",
        "news_provider_key",
        "url",
    )
    return cards.join(articles, "cluster_id")
