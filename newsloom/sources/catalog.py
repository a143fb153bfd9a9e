"""Fixed catalogue values and the DataFrames built from them.

Every operator takes the catalogue and the rules as inputs; these are the defaults.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.session import as_dimension, local_table

RFC822_OFFSET = "%a, %d %b %Y %H:%M:%S %z"
RFC822_ZONE_NAME = "%a, %d %b %Y %H:%M:%S %Z"
DEFAULT_WINDOW = timedelta(minutes=30)

# --- fixed values: outlets (key, name, url, feeds, bias) ------------------------------------
OUTLETS = [
    ("24ur", "24ur", "https://www.24ur.com", ["https://www.24ur.com/rss"], "center-left"),
    ("rtv", "RTV", "https://www.rtvslo.si", ["https://img.rtvslo.si/feeds/00.xml"], "center-left"),
    ("delo", "Delo", "https://www.delo.si", ["https://www.delo.si/rss"], "left"),
    ("siol", "Siol", "https://siol.net", ["https://siol.net/feeds/latest"], "center"),
    ("nova24tv", "Nova24TV", "https://nova24tv.si", ["https://nova24tv.si/feed"], "right"),
    ("necenzurirano", "Necenzurirano", "https://necenzurirano.si", ["https://necenzurirano.si/rss/site.xml"], "left"),
    ("dnevnik", "Dnevnik", "https://www.dnevnik.si", ["https://www.dnevnik.si/rss.xml"], "left"),
    ("svet24", "Svet24", "https://www.svet24.si", ["https://svet24.si/rss/site.xml"], "left"),
    ("vecer", "Večer", "https://vecer.com", ["https://feeds.feedburner.com/vecer"], "left"),
    ("mladina", "Mladina", "https://www.mladina.si", ["https://www.mladina.si/media/rss/rss-fb-mladina.xml"], "left"),
    ("primorskenovice", "Primorske Novice", "https://primorske.svet24.si", ["https://primorske.svet24.si/rss.xml"], "center-left"),
    ("ljubljanskenovice", "Ljubljanske novice", "https://ljnovice.si/", ["https://ljnovice.si/feed/"], None),
    ("maribor24", "Maribor24", "https://maribor24.si", ["https://maribor24.si/feed"], "center-right"),
    ("slotech", "Slo-Tech", "https://slo-tech.com", ["http://feeds.st.si/ST-novice"], None),
    ("reporter", "Reporter", "https://reporter.si", ["https://reporter.si/rss/site.xml"], "right"),
    ("n1info", "N1 Info", "https://n1info.si", ["https://n1info.si/feed"], "center"),
    ("zurnal24", "Žurnal24", "https://www.zurnal24.si", ["https://www.zurnal24.si/feeds/latest"], "center-right"),
    ("slovenskenovice", "Slovenske Novice", "https://www.slovenskenovice.si", ["https://www.slovenskenovice.si/rss"], "center-left"),
    ("sta", "Slovenska tiskovna agencija", "https://www.sta.si", ["https://www.sta.si/rss-0"], "center"),
    ("cekin", "Cekin", "https://cekin.si", ["https://cekin.si/rss"], "center-left"),
    ("demokracija", "Demokracija", "https://demokracija.si/", ["https://demokracija.si/feed/"], "right"),
    (
        "bloombergadria",
        "Bloomberg Adria",
        "https://si.bloombergadria.com/",
        [
            "https://si.bloombergadria.com/rss/ekonomija",
            "https://si.bloombergadria.com/rss/posel",
            "https://si.bloombergadria.com/rss/politika",
            "https://si.bloombergadria.com/rss/financni-trgi",
            "https://si.bloombergadria.com/rss/analiza",
        ],
        "center-right",
    ),
    ("info360", "Info360", "https://info360.si/", ["https://info360.si/rss.xml"], "center-right"),
    ("lokalec", "Lokalec", "https://www.lokalec.si", ["https://www.lokalec.si/feed/"], "center"),
    ("domovina", "Domovina", "https://www.domovina.je", ["https://www.domovina.je/feed"], "right"),
    ("zanimame", "Zanima.me", "https://www.zanima.me", ["https://www.zanima.me/feed/"], "right"),
    ("finance", "Finance.si", "https://www.finance.si", ["https://feeds.feedburner.com/financesi"], "center-right"),
]

# --- fixed values: importance ranks (lower is more important) -------------------------------
RANKS = {
    0: ["24ur", "siol", "zurnal24", "svet24", "rtv", "slovenskenovice"],
    1: ["delo", "dnevnik", "n1info", "vecer", "maribor24"],
    2: ["lokalec", "reporter", "sta", "necenzurirano", "nova24tv", "demokracija", "domovina", "cekin", "info360"],
    3: ["bloombergadria", "finance", "zanimame", "ljubljanskenovice", "primorskenovice"],
    4: ["mladina", "slotech"],
}

# --- fixed values: outlets with their own look-back window or date format --------------------
WINDOWS = {"mladina": timedelta(hours=20)}
DATE_FORMATS = {"mladina": RFC822_ZONE_NAME}

# --- fixed values: entries that are dropped (provider, field, prefix) -------------------------
EXCLUSIONS = [
    ("sta", "title", "Razmere na slovenskih cestah ob"),
    ("sta", "title", "Pregled - "),
    ("sta", "title", "Kronika v zadnjih 24 urah"),
    ("sta", "title", "Napoved - "),
    ("sta", "title", "Tedenska napoved - "),
    ("zurnal24", "title", "Dnevni horoskop"),
    ("siol", "link", "https://siol.net/trendi/horoskop/"),
    ("svet24", "link", "https://svet24.si/horoskop/"),
]

# --- fixed values: categories (key, name) -----------------------------------------------------
CATEGORIES = [
    ("politika", "POLITIKA"),
    ("gospodarstvo", "GOSPODARSTVO"),
    ("kriminal", "KRIMINAL"),
    ("sport", "ŠPORT"),
    ("kultura", "KULTURA"),
    ("zdravje", "ZDRAVJE"),
    ("okolje", "OKOLJE"),
    ("lokalno", "LOKALNO"),
    ("tehnologija-znanost", "TEHNOLOGIJA & ZNANOST"),
]

# --- fixed values: image rules; columns as in schemas.IMAGE_RULE ------------------------------
IMAGE_RULES = [
    ("24ur", "summary_all", None, "/213xX/", "/884xX/", False, None, 1),
    ("24ur", "enclosures", None, None, None, False, None, 2),
    ("sta", "summary_first", None, None, None, False, None, 1),
    ("demokracija", "summary_first", None, None, None, False, None, 1),
    ("zanimame", "summary_first", None, None, None, False, None, 1),
    ("zanimame", "page", "div.featured-image >> img@src", None, None, False, None, 1),
    ("mladina", "summary_first", None, "__190", "__1600", False, None, 1),
    ("ljubljanskenovice", "content_first", None, None, None, False, None, 1),
    ("slovenskenovice", "enclosures", None, "width-660", "width-932", True, None, 1),
    ("domovina", "enclosures", None, "medium", "large", True, None, 1),
    ("n1info", "media_images", None, None, None, False, None, 1),
    ("n1info", "enclosures", None, None, None, False, None, 2),
    ("slotech", "media", None, None, None, False, None, 1),
    ("nova24tv", "page", "img.entry-thumb@srcset:first", None, None, False, None, 1),
    ("maribor24", "page", "picture.article-main-img >> img@src", None, None, False, None, 1),
    ("lokalec", "page", "figure.wp-caption >> img@src", None, None, False, None, 1),
    (
        "siol",
        "page",
        ".article_main_media__main_image_figure >> .article_main_media__main_image_lightbox_trigger@data-href"
        " | .article_main_media__main_image_figure >> picture >> source@srcset"
        " | .article_main_media__main_image_figure >> picture >> img@src",
        None,
        None,
        False,
        "https://siol.net",
        1,
    ),
]


def provider_catalog(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    """Catalogue table; default rows are the fixed outlets with ranks, windows and date formats."""
    if rows is not None:
        return local_table(spark, rows, schemas.PROVIDER)
    base = [
        (key, name, url, None, bias, WINDOWS.get(key), DATE_FORMATS.get(key, RFC822_OFFSET), feeds)
        for key, name, url, feeds, bias in OUTLETS
    ]
    return as_dimension(assign_ranks(local_table(spark, base, schemas.PROVIDER), RANKS))


def assign_ranks(providers: DataFrame, rank_lists: Mapping[int, Sequence[str]]) -> DataFrame:
    """Attach ranks by key; a key ranked twice, or a provider without a rank, is an error."""
    pairs = [(key, rank) for rank, keys in rank_lists.items() for key in keys]
    ranked = (
        local_table(providers.sparkSession, pairs, "key string, _rank int")
        .groupBy("key")
        .agg(F.max("_rank").alias("_rank"), F.count("*").alias("_times"))
    )
    checked = (
        F.when(F.col("_times") > 1, F.raise_error(F.concat(F.lit("ranked twice: "), F.col("key"))))
        .when(F.col("_rank").isNull(), F.raise_error(F.concat(F.lit("no rank: "), F.col("key"))))
        .otherwise(F.col("_rank"))
        .cast("int")
    )
    columns = [c for c in providers.columns if c != "rank"]
    out = providers.select(*columns).join(ranked, "key", "left").withColumn("rank", checked)
    order = providers.columns if "rank" in providers.columns else [*columns, "rank"]
    return out.select(*order)


def exclusion_rules(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    return local_table(spark, EXCLUSIONS if rows is None else rows, schemas.EXCLUSION_RULE)


def image_rules(spark: SparkSession, rows: Iterable[Sequence] | None = None) -> DataFrame:
    return local_table(spark, IMAGE_RULES if rows is None else rows, schemas.IMAGE_RULE)


def categories(spark: SparkSession) -> DataFrame:
    return local_table(spark, CATEGORIES, "key string, name string")
