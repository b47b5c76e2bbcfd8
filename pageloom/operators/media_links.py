"""M1, M2: linked images of an article and where a link leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import href_keys, upgrade_image_url

DEFAULT_ALT = "图像"  # fixed value


def media_inventory(articles: DataFrame, blocks: DataFrame) -> DataFrame:
    """M1: every linked image in reading order: cover, images, galleries, post and quoted photos.

    articles: page_id, base_url, cover (image struct). blocks: page_id, block_pos and block columns.
    """
    picture = lambda i: F.struct(i["href"].alias("href"), i["src"].alias("src"), i["alt"].alias("alt"))
    photos = lambda items: F.flatten(F.transform(items, lambda i: F.coalesce(i["photos"], F.slice(i["photos"], 1, 0))))
    none = F.expr("cast(array() as array<struct<href:string,src:string,alt:string>>)")
    tweet_items = F.col("tweet.items")
    # an item is a photo, a photo group or a quoted post: flatten them in item order
    per_item = F.flatten(F.transform(tweet_items, lambda i: F.concat(
        F.coalesce(F.transform(i["photos"], picture), none),
        F.coalesce(F.transform(photos(i["quoted"]["items"]), picture), none),
    )))
    found = (
        F.when(F.col("type") == "image", F.array(picture(F.col("image"))))
        .when(F.col("type") == "image-gallery", F.transform("gallery.items", picture))
        .when(F.col("type") == "simple-tweet", per_item)
    )
    of_blocks = blocks.select("page_id", "block_pos", F.posexplode(found).alias("item_pos", "m"))
    covers = articles.filter("cover.href is not null").select(
        "page_id", F.lit(-1).alias("block_pos"), F.lit(0).alias("item_pos"), picture(F.col("cover")).alias("m")
    )
    media = of_blocks.unionByName(covers).filter("coalesce(m.href, '') <> ''")
    return media.select(
        "page_id", "block_pos", "item_pos", F.col("m.href").alias("href"), upgrade_image_url(F.col("m.src")).alias("src"),
        F.coalesce("m.alt", F.lit(DEFAULT_ALT)).alias("alt"),
    )


def media_list(inventory: DataFrame, bases: DataFrame) -> DataFrame:
    """M1: the media to page through; one whose key an earlier one already had is left out."""
    order = F.struct("block_pos", "item_pos")
    keyed = inventory.join(bases.select("page_id", "base_url"), "page_id").withColumn(
        "key", F.explode(href_keys(F.col("href"), F.col("base_url")))
    )
    first = keyed.groupBy("page_id", "key").agg(F.min(order).alias("first"))
    fresh = keyed.join(first, ["page_id", "key"]).groupBy("page_id", "block_pos", "item_pos").agg(
        F.bool_and(F.col("first") == order).alias("fresh"), F.first("href").alias("href"), F.first("src").alias("src"),
        F.first("alt").alias("alt"),
    )
    return fresh.filter("fresh").drop("fresh")


def media_keys(inventory: DataFrame, bases: DataFrame) -> DataFrame:
    """Lookup table: one row per (page, href key); the last medium with a key wins."""
    keyed = inventory.join(bases.select("page_id", "base_url"), "page_id")
    keys = keyed.select("page_id", F.explode(href_keys(F.col("href"), F.col("base_url"))).alias("key"), "block_pos", "item_pos", "href", "src", "alt")
    return keys.groupBy("page_id", "key").agg(
        F.max_by(F.struct("href", "src", "alt"), F.struct("block_pos", "item_pos")).alias("m")
    ).select("page_id", "key", "m.*")


def lookup_media(links: DataFrame, keys: DataFrame) -> DataFrame:
    """M2: links (page_id, link_id, href, base_url, image_src, image_alt) to media: by any key, else the inline image."""
    probes = links.select(
        "page_id", "link_id", F.posexplode_outer(href_keys(F.col("href"), F.col("base_url"))).alias("key_pos", "key")
    )
    hits = probes.join(keys, ["page_id", "key"]).groupBy("page_id", "link_id").agg(
        F.min_by(F.struct("href", "src", "alt"), "key_pos").alias("m")
    )
    inline = F.when((F.coalesce("image_src", F.lit("")) != "") & (F.coalesce("href", F.lit("")) != ""), F.struct(
        F.col("href").alias("href"), upgrade_image_url(F.col("image_src")).alias("src"),
        F.coalesce(F.nullif(F.col("image_alt"), F.lit("")), F.lit(DEFAULT_ALT)).alias("alt"),
    ))
    return links.join(hits, ["page_id", "link_id"], "left").select(
        "page_id", "link_id", F.coalesce("m", inline).alias("found")
    ).select("page_id", "link_id", "found.*")
