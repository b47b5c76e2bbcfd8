"""Roots, readiness, title and header of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import trimmed
from ..functions.numbers import article_metric_label
from ..functions.text import normalize_text
from ..functions.urls import resolve_url
from ..sources.adapters import Adapter
from .selectors import needs_scope
from .tree import Tree, attr, first_of, known_hits, let, per_adapter

# Where a title may stand when the site rule finds none.
HEADER_TITLE_SELECTORS = [
    "header h1",
    "header [data-title]",
    "[data-article-header] h1",
    "[data-post-header] h1",
    ".post-header h1",
    ".post-title",
    ".post-title a[href]",
    ':scope > div:first-child a[href*="/p/"]',
]
OG_TITLE_SELECTOR = 'meta[property="og:title"], meta[name="og:title"]'
VERIFIED_SELECTOR = '[data-testid="icon-verified"], [aria-label="认证账号"], [aria-label="Verified account"]'
# Fixed values that cleaning asks for.
RETAINING_COMPONENTS = '[data-component-name="SubscribeWidget"], [data-component-name="Paywall"], [data-testid="paywall"]'
CODE_AROUND = '[data-testid="markdown-code-block"], pre, code'
TABLE_AROUND = 'table, [role="table"], [role="grid"], [data-testid="markdown-table"]'
MEDIA_INSIDE = '[data-testid="tweetPhoto"], [data-testid="videoPlayer"], [data-testid="previewInterstitial"]'
CARD = '[data-testid="simpleTweet"], [data-testid="tweet"]'
LAID_OUT = '[class*="r-18u37iz"], [class*="r-eqz5dr"]'
LAYOUT_PARTS = 'a, div, [role="group"], [role="link"]'
FOLDED_TEXT, PLAYER = '[data-testid="tweetText"]', '[data-testid="videoPlayer"]'
HEADER_ONE, HEADER_TWO = ".longform-header-one", ".longform-header-two"
ORDERED_ITEM, UNORDERED_ITEM = ".public-DraftStyleDefault-orderedListItem", ".public-DraftStyleDefault-unorderedListItem"
CAPTION_ROOT, DATA_BLOCK = '.twitter-article-media-caption-id, [id^="caption-"]', '[data-block="true"]'
FIX_SELECTORS = [
    MEDIA_INSIDE, CARD, LAID_OUT, LAYOUT_PARTS, FOLDED_TEXT, PLAYER, HEADER_ONE, HEADER_TWO, ORDERED_ITEM, UNORDERED_ITEM, CAPTION_ROOT, DATA_BLOCK,
]
VIEW_HINT = "(?i)(?:查看|观看|view)"
NODE_KEEP = ("node_id", "end_id", "path", "tag", "attrs", "text_from", "text_to")


#: Asked of pages while their attributes are as written, besides the rules of the sites.
RAW_SELECTORS = [
    *(s for s in HEADER_TITLE_SELECTORS if not needs_scope(s)), OG_TITLE_SELECTOR, "title", "h1", "a[href]", RETAINING_COMPONENTS, CODE_AROUND, TABLE_AROUND,
]


def page_selectors(adapters: list[Adapter]) -> list[str]:
    """All that finding roots, titles, readiness, headers and noise of these sites asks of a page, for the parser to match at
    once. Marks that fixes add later (`data-pl-`) are not on the page yet."""
    asked = list(RAW_SELECTORS)
    for a in adapters:
        asked += [a.root_selector, a.title_selector, a.content_selector, block_selector(a), *a.required, *a.header.values(), *a.remove, *a.unwrap]
        asked += FIX_SELECTORS if a.enabled_fixes else []
        asked += [*POST_HEAD.values(), POST_PHOTO, VERIFIED_SELECTOR] if a.platform == "x" else []
    return list(dict.fromkeys(s for s in asked if s and not needs_scope(s) and "data-pl-" not in s))


def block_selector(a: Adapter) -> str:
    return a.semantic.get("block") or '[data-block="true"]'


def _page_tree(parsed: DataFrame | None = None, adapters: list[Adapter] | None = None) -> Tree:
    hits = known_hits(parsed, page_selectors(adapters)) if parsed is not None else None
    return Tree(F.col("nodes"), F.col("texts"), hits=hits)


def title_text(tree: Tree, n: Column) -> Column:
    """content attribute if there is one, else the element's text; normalized."""
    return normalize_text(F.coalesce(attr(n, "content"), tree.text(n), F.lit("")))


def first_in_page(tree: Tree, selector: str) -> Column:
    return first_of(F.filter(tree.nodes, lambda n: tree.matches(n, selector)))


def locate_roots(parsed: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H3: article root, title element and content root as structs, null where missing."""
    tree = _page_tree(parsed, adapters)
    rooted = parsed.withColumn("article_root", per_adapter(adapters, lambda a: first_in_page(tree, a.root_selector)))
    root = F.col("article_root")

    def title(a: Adapter) -> Column:
        if not a.title_selector:
            return F.when(F.lit(False), root)
        inside = tree.first(root, a.title_selector)
        return F.when(root.isNotNull(), F.coalesce(inside, first_in_page(tree, a.title_selector)))

    def content(a: Adapter) -> Column:
        return tree.first(root, a.content_selector) if a.content_selector else root

    return rooted.withColumns({"title_node": per_adapter(adapters, title), "content_root": per_adapter(adapters, content)})


def resolve_title(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Adds `title`, '' when the page has none."""
    tree, root = _page_tree(located, adapters), F.col("article_root")

    def chain(a: Adapter) -> Column:
        def text_at(n: Column) -> Column:
            return F.nullif(let(n, lambda x: title_text(tree, x)), F.lit(""))

        steps = [text_at(F.col("title_node"))]
        steps += [text_at(tree.first(root, s)) for s in HEADER_TITLE_SELECTORS]
        if (a.validation or {}).get("title") == "fallback-from-h1":
            steps.append(F.coalesce(normalize_text(tree.text(tree.first(root, "h1"))), F.lit("")))
        else:
            steps += [text_at(first_in_page(tree, s)) for s in ("title", OG_TITLE_SELECTOR)]
        return F.coalesce(*steps, F.lit(""))

    return located.withColumn("title", per_adapter(adapters, chain))


def readiness(titled: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """H4: adds `block_count`, `text_length`, `not_ready` (first failing reason, null when ready), `root_found`, `body_found`."""
    tree, content = _page_tree(titled, adapters), F.col("content_root")

    def missing_required(a: Adapter) -> Column:
        missing = F.lit(False)
        for selector in a.required:
            missing = missing | ~F.exists(tree.nodes, tree.matching(selector))
        return missing

    def limits(a: Adapter) -> Column:
        few = (F.col("block_count") < a.min_blocks) if a.min_blocks else F.lit(False)
        short = (F.col("text_length") < a.min_text) if a.min_text else F.lit(False)
        return few | short

    if_content = lambda c: F.when(content.isNotNull(), c)
    counted = titled.withColumns({
        "block_count": if_content(per_adapter(adapters, lambda a: F.size(tree.all(content, block_selector(a))))),
        "text_length": if_content(F.length(normalize_text(tree.text(content)))),
    })
    reason = (
        F.when(F.size("nodes") == 0, "missing_document")
        .when(F.col("article_root").isNull(), "missing_article_root")
        .when(F.col("title") == "", "missing_title")
        .when(content.isNull(), "missing_content_root")
        .when(per_adapter(adapters, missing_required), "missing_required_selector")
        .when(per_adapter(adapters, limits), "content_not_stable")
    )
    return counted.withColumns({
        "not_ready": reason, "root_found": F.col("article_root").isNotNull(), "body_found": content.isNotNull(),
    })


def detect_post_article(parsed: DataFrame, adapter: Adapter, rich_view: str, block: str = '[data-block="true"]') -> DataFrame:
    """H4, the site's own detector: (page_id, not_ready)."""
    tree = _page_tree()
    view = first_in_page(tree, adapter.root_selector)
    staged = parsed.withColumn("view", view)
    view = F.col("view")
    staged = staged.withColumn("body", tree.first(view, adapter.content_selector))
    body = F.col("body")
    title = normalize_text(tree.text(tree.first(view, adapter.title_selector)))
    reason = (
        F.when(view.isNull(), "missing_article_root")
        .when(F.coalesce(title, F.lit("")) == "", "missing_title")
        .when(~tree.has(view, rich_view), "missing_rich_text_view")
        .when(body.isNull(), "missing_longform_content")
        .when(
            (F.size(tree.all(body, block)) < 3) | (F.length(normalize_text(tree.text(body))) < 200),
            "content_not_stable",
        )
    )
    return staged.select("page_id", reason.alias("not_ready"))


def header_meta(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Adds `header`: source, title link, subtitle, author and date found in the page head."""
    tree, root, base = _page_tree(located, adapters), F.col("article_root"), F.col("url")
    none = F.lit(None).cast("string")

    def found(a: Adapter, key: str) -> Column | None:
        return tree.first(root, a.header[key]) if a.header.get(key) else None

    def text_of(n: Column | None) -> Column:
        return none if n is None else F.nullif(let(n, lambda x: title_text(tree, x)), F.lit(""))

    def href_of(n: Column | None) -> Column:
        if n is None:
            return none
        return let(n, lambda x: resolve_url(F.coalesce(attr(x, "href"), attr(tree.closest(x, "a[href]"), "href")), base))

    def build(a: Adapter) -> Column:
        link = found(a, "title_link")
        link = F.col("title_node") if link is None else F.coalesce(link, F.col("title_node"))
        avatar = found(a, "author_avatar")
        avatar_url = none if avatar is None else let(
            avatar, lambda x: resolve_url(F.coalesce(attr(x, "src"), attr(x, "data-src")), base)
        )
        return F.struct(
            text_of(found(a, "source_label")).alias("source_label"),
            href_of(found(a, "source_label")).alias("source_href"),
            (href_of(link) if a.header else none).alias("title_href"),
            text_of(found(a, "subtitle")).alias("subtitle"),
            text_of(found(a, "author_name")).alias("author_name"),
            href_of(found(a, "author_name")).alias("author_profile_url"),
            avatar_url.alias("author_avatar_url"),
            text_of(found(a, "published_at")).alias("published_at_text"),
        )

    return located.withColumn("header", per_adapter(adapters, build))


POST_PHOTO = '[data-testid="tweetPhoto"] img'
# Where a post's head keeps author, counts and date.
POST_HEAD = {
    "author": '[itemprop="author"]', "group": '[role="group"][aria-label]', "name": 'meta[itemprop="name"]', "image": 'meta[itemprop="image"]',
    "handle": 'meta[itemprop="additionalName"]', "views": 'a[href*="/analytics"]', "time": "time", "img": "img",
    **{test_id: f'[data-testid="{test_id}"]' for test_id in ("reply", "retweet", "like", "bookmark")},
}


def with_post_parts(located: DataFrame, tree: Tree) -> DataFrame:
    """Adds the author's element, the group of counts and the cover's image of a page, null where it has none."""
    root, body, title = F.col("article_root"), F.col("content_root"), F.col("title_node")

    def after_title(selector: str) -> Column:
        def ok(n: Column) -> Column:
            outside = ~((n["node_id"] > body["node_id"]) & (n["node_id"] <= body["end_id"]))
            return outside & (title.isNull() | (n["node_id"] > title["node_id"]))

        return first_of(F.filter(tree.all(root, selector), ok))

    return located.withColumns({
        "author_root": after_title(POST_HEAD["author"]), "metric_group": after_title(POST_HEAD["group"]),
        "cover_node": first_of(F.filter(tree.all(root, POST_PHOTO), lambda n: n["node_id"] < title["node_id"])),
    })


def _post_columns(tree: Tree) -> dict[str, Column]:
    author, group = F.col("author_root"), F.col("metric_group")

    def meta(part: str) -> Column:
        return F.nullif(normalize_text(attr(tree.first(author, POST_HEAD[part]), "content")), F.lit(""))

    def metric(test_id: str) -> Column:
        return let(tree.first(group, POST_HEAD[test_id]), lambda x: F.coalesce(
            F.nullif(normalize_text(tree.text(x)), F.lit("")),
            F.nullif(article_metric_label(attr(x, "aria-label")), F.lit("")),
        ))

    label = attr(group, "aria-label")
    views = F.coalesce(
        F.nullif(normalize_text(tree.text(tree.first(group, POST_HEAD["views"]))), F.lit("")),
        F.when(F.regexp_like(label, F.lit(VIEW_HINT)), F.nullif(article_metric_label(label), F.lit(""))),
    )
    handle = meta("handle")
    moment = lambda build: let(tree.first(tree.at(author["parent_id"]), POST_HEAD["time"]), build)
    return {
        "author_name": meta("name"),
        "author_handle": let(handle, lambda h: F.when(h.isNotNull(), F.concat(F.lit("@"), F.regexp_replace(h, "^@", "")))),
        "author_avatar_url": F.coalesce(trimmed(attr(tree.first(author, POST_HEAD["img"]), "src")), meta("image")),
        "author_verified": tree.has(author, VERIFIED_SELECTOR),
        "published_at": moment(lambda t: attr(t, "datetime")),
        "published_at_text": moment(lambda t: F.nullif(normalize_text(tree.text(t)), F.lit(""))),
        "metrics": F.struct(
            metric("reply").alias("replies"), metric("retweet").alias("reposts"), metric("like").alias("likes"),
            views.alias("views"), metric("bookmark").alias("bookmarks"),
        ),
    }


def _cover_columns(tree: Tree) -> dict[str, Column]:
    cover = F.col("cover_node")
    return {
        "cover_src": attr(cover, "src"), "cover_alt": F.nullif(attr(cover, "alt"), F.lit("")),
        "cover_href": resolve_url(attr(tree.closest(cover, "a[href]"), "href"), F.lit("https://x.com/")),
    }


def post_metadata(located: DataFrame) -> DataFrame:
    """B22, marked-up form: author, date and metrics that follow the title outside the body."""
    tree = _page_tree()
    return with_post_parts(located, tree).select("page_id", *[c.alias(k) for k, c in _post_columns(tree).items()])


def cover_image(located: DataFrame) -> DataFrame:
    """The first photo that stands before the title."""
    tree = _page_tree()
    return with_post_parts(located, tree).select("page_id", *[c.alias(k) for k, c in _cover_columns(tree).items()])


def post_head(located: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Adds `post` (author, date, metrics, cover) to pages of post sites, null elsewhere; no column without such a site."""
    ids = [a.id for a in adapters if a.platform == "x"]
    if not ids:
        return located
    tree = _page_tree(located, adapters)
    parts = with_post_parts(located, tree)
    post = F.struct(*[c.alias(k) for k, c in {**_post_columns(tree), **_cover_columns(tree)}.items()])
    return parts.withColumn("post", F.when(F.col("adapter_id").isin(*ids), post)).drop("author_root", "metric_group", "cover_node")
