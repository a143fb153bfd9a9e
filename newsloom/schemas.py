"""Explicit schemas of the logical tables."""

from __future__ import annotations

ANALYSIS = (
    "summary string, rank int, categories array<string>, stock_image_search string, "
    "is_paywalled boolean"
)
PROVIDER = (
    "key string, name string, url string, rank int, bias_rating string, "
    "time_window interval day to second, date_format string, feeds array<string>"
)
CLUSTER_RUN = (
    "id bigint, algo_version string, params string, is_production boolean, created_at timestamp"
)
CLUSTER = "id bigint, title string, slug string, run_id bigint, created_at timestamp"
# Keyed by its ids; a surrogate id would need a global numbering on every write. The article's time
# is kept with it, so that the next run knows which part of the article table it needs.
MEMBERSHIP = "article_id bigint, cluster_id bigint, published_at timestamp, run_id bigint"
LOG_EVENT = "ts timestamp, service string, message string"
RAW_FEED = "provider_key string, feed_url string, fetched_at timestamp, body string"
EXCLUSION_RULE = "provider_key string, field string, prefix string"
IMAGE_RULE = (
    "provider_key string, source string, selector string, find string, repl string, "
    "first_only boolean, prefix string, order int"
)

# Ratings a provider or a vote may carry.
BIAS_RATINGS = ("left", "center-left", "center", "center-right", "right")
