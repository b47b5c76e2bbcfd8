"""Articles from block rows, text lengths, validation, old record shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..schema import ITEM
from ..sources.adapters import Adapter
from .tree import make_struct

# Fixed values.
MIN_BLOCKS = 3
MIN_TEXT = 200
TEXT_TYPES = ["paragraph", "heading", "quote", "list", "link", "code", "table"]
MEDIA_TYPES = ["image", "image-gallery", "gif", "video", "embed", "simple-tweet"]
DEFAULT_MEDIA_TYPES = [*MEDIA_TYPES, "link", "code", "table"]


def _length(*cols: Column) -> Column:
    return F.length(normalize_text(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])))


def block_text_length(b: Column, strict: bool = False) -> Column:
    """A2: characters a block adds. `strict` counts code language and post items too."""
    total = lambda items, text: F.aggregate(items, F.lit(0), lambda acc, i: acc + F.length(normalize_text(text(i))))
    cells = F.flatten(b["table"]["rows"])
    tweet = b["tweet"]
    item_text = F.array_join(F.transform(tweet["items"], lambda i: F.coalesce(
        i["text"],
        F.concat_ws(" ", i["quoted"]["title"], i["quoted"]["excerpt"]),
    )), " ")
    tweet_length = _length(F.lit("X Tweet"), tweet["title"], tweet["excerpt"], item_text) if strict else _length(tweet["title"], tweet["excerpt"])
    code_length = _length(b["code"]["language"], b["text"]) if strict else _length(b["text"])
    kind = b["type"]
    return (
        F.when(kind.isin("paragraph", "heading", "quote", "link"), F.length(normalize_text(b["text"])))
        .when(kind == "list", total(b["items"], lambda i: i["text"]))
        .when(kind == "table", total(cells, lambda c: c["text"]))
        .when(kind == "code", code_length)
        .when(kind == "embed", _length(b["embed"]["label"], b["embed"]["text"]))
        .when(kind == "simple-tweet", tweet_length)
        .otherwise(F.lit(0))
    )


def article_facts(rows: DataFrame) -> DataFrame:
    """One row per page: page facts plus what its blocks add up to.

    Rows come hashed by page_id, so this aggregation needs no further exchange.
    """
    is_block = F.col("block_pos") >= 0
    b = F.col("block")
    sized = rows.withColumns({
        "length": F.when(is_block, block_text_length(b)), "strict_length": F.when(is_block, block_text_length(b, strict=True)),
    })
    kind = F.col("block.type")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    facts = sized.groupBy("page_id").agg(
        F.first("page", ignorenulls=True).alias("page"),
        F.first("adapter_id").alias("adapter_id"),
        count(is_block).alias("n_blocks"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("article_text_length"),
        F.coalesce(F.sum("strict_length"), F.lit(0)).cast("bigint").alias("strict_text_length"),
        (count(kind.isin(*TEXT_TYPES)) > 0).alias("has_text"),
        (count(kind.isin(*MEDIA_TYPES)) > 0).alias("has_media"),
        (count(kind.isin(*DEFAULT_MEDIA_TYPES)) > 0).alias("has_rich"),
    )
    return facts.select("page_id", "adapter_id", "page.*", *[c for c in facts.columns if c not in ("page_id", "adapter_id", "page")])


def default_reason(a: DataFrame) -> Column:
    """A3: first failing check, null when the article is fine."""
    blank = lambda c: F.coalesce(normalize_text(F.col(c)), F.lit("")) == ""
    return (
        F.when(blank("article_id"), "missing_id")
        .when(blank("title"), "missing_title")
        .when(blank("source_url"), "missing_source_url")
        .when(blank("canonical_url"), "missing_canonical_url")
        .when(F.col("n_blocks") < MIN_BLOCKS, "insufficient_blocks")
        .when((F.col("strict_text_length") <= MIN_TEXT) & ~(F.col("has_text") & F.col("has_rich")), "insufficient_content")
    )


def validate_default(articles: DataFrame) -> DataFrame:
    """A3."""
    return articles.withColumn("invalid", default_reason(articles))


def validate_adapter(articles: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """A4: the site's own minima; sites without any use A3."""
    reason = default_reason(articles)
    for a in adapters:
        v = a.validation
        if v is None:
            continue
        blank = lambda c: F.coalesce(normalize_text(F.col(c)), F.lit("")) == ""
        own = F.when(blank("article_id"), "missing_id")
        if v.get("title") != "optional":
            own = own.when(blank("title"), "missing_title")
        if v.get("min_blocks"):
            own = own.when(F.col("n_blocks") < v["min_blocks"], "insufficient_blocks")
        if v.get("min_text"):
            short = F.col("article_text_length") <= v["min_text"]
            if v.get("empty") == "allow-media-only":
                short = short & ~F.col("has_media")
            own = own.when(short, "insufficient_content")
        reason = F.when(F.col("adapter_id") == a.id, own).otherwise(reason)
    return articles.withColumn("invalid", reason)


HEAD_FIELDS = ["author_name", "author_handle", "author_avatar_url", "author_verified", "published_at", "published_at_text", "metrics",
               "cover_src", "cover_alt", "cover_href"]


def with_head(articles: DataFrame) -> DataFrame:
    """Author, date, metrics and cover as columns of the article: of a post's head, else of the site's header."""
    kinds = {f: dict(articles.select(f"{f}.*").dtypes) for f in ("post", "header") if f in articles.columns}
    pick = lambda name: [F.col(f"{f}.{name}") for f, fields in kinds.items() if name in fields]
    return articles.withColumns({name: F.coalesce(*pick(name)) for name in HEAD_FIELDS if pick(name)})


def assemble_articles(rows: DataFrame, adapters: list[Adapter], extracted_at: int, with_blocks: bool = False) -> DataFrame:
    """A1+A4: one row per page; `rejected` names the first reason against it, null for good articles.

    `extracted_at` (epoch ms) is injected, so a rerun gives the same rows.
    """
    facts = article_facts(rows)
    lookup = lambda f: F.create_map(*[F.lit(v) for a in adapters for v in (a.id, f(a))])[F.col("adapter_id")]
    articles = facts.withColumns({
        "article_id": F.concat(F.col("adapter_id"), F.lit(":"), F.col("url")),
        "source": lookup(lambda a: a.source),
        "source_kind": F.when(F.col("adapter_id") == "fixture.article", "fixture").otherwise("platform"),
        "platform": lookup(lambda a: a.platform),
        "source_url": F.col("url"),
        "canonical_url": F.col("url"),
        "extracted_at": F.lit(extracted_at).cast("bigint"),
    })
    articles = with_head(articles)
    checked = validate_adapter(articles, adapters)
    done = checked.withColumn("rejected", F.coalesce("not_ready", "invalid")).drop("invalid")
    if not with_blocks:
        return done
    kept = rows.filter("block_pos >= 0").groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "block"))).alias("blocks")
    )
    return done.join(kept, "page_id", "left")


def extraction_diagnostics(merge_stats: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Merge counts next to site and platform."""
    platforms = F.create_map(*[F.lit(v) for a in adapters for v in (a.id, a.platform)])
    return merge_stats.withColumn("platform", platforms[F.col("adapter_id")])


def upgrade_posts(posts: DataFrame) -> DataFrame:
    """Old post records without `items` get them from excerpt, video, photos or cover."""
    text = F.when(F.col("excerpt") != "", make_struct(ITEM, type=F.lit("text"), text=F.col("excerpt")))
    n_photos = F.coalesce(F.size("photos"), F.lit(0))
    media = (
        F.when(F.col("video").isNotNull(), make_struct(ITEM, type=F.lit("video"), video=F.col("video")))
        .when(n_photos == 1, make_struct(ITEM, type=F.lit("photo"), photos=F.col("photos")))
        .when(n_photos > 1, make_struct(ITEM, type=F.lit("photo-group"), photos=F.col("photos")))
        .when(F.col("cover_url").isNotNull() & (F.col("cover_url") != ""), make_struct(
            ITEM, type=F.lit("article-cover"), cover=make_struct(
                "struct<cover_url:string,cover_alt:string,aspect_ratio:double,source_label:string,title:string,excerpt:string,href:string,"
                "author_name:string,author_handle:string,author_verified:boolean,published_at_text:string>",
                cover_url=F.col("cover_url"), title=F.col("title"), excerpt=F.col("excerpt"), href=F.col("href"),
            )))
    )
    made = F.array_compact(F.array(text, media))
    return posts.withColumn("items", F.coalesce("items", made))


def canonical_header(articles: DataFrame) -> DataFrame:
    """One header from nested or flat fields; null when there is nothing to show."""
    pick = lambda nested, flat: F.coalesce(F.col(f"author.{nested}"), F.col(flat))
    name, handle, avatar = pick("name", "author_name"), pick("handle", "author_handle"), pick("avatar_url", "author_avatar_url")
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    shown = some(name) | some(handle) | some(avatar) | some(F.col("published_at_text"))
    metrics = F.coalesce("engagement", "metrics")
    header = F.struct(
        name.alias("name"), handle.alias("handle"), avatar.alias("avatar_url"),
        F.coalesce(F.col("author.profile_url"), F.col("canonical_url")).alias("href"),
        F.coalesce(F.col("author.verified"), F.col("author_verified")).alias("verified"),
        F.col("published_at_text").alias("published_at_text"),
    )
    has_metrics = F.exists(F.map_values(metrics), some)
    return articles.withColumns({
        "header": F.when(shown, header), "header_metrics": F.when(F.coalesce(has_metrics, F.lit(False)), metrics),
    })
