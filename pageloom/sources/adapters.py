"""Per-site rules. A rule set is a short Python list; `adapters_df` shows it as a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Default selectors of every block family.
DEFAULT_SELECTORS = {
    "block": '[data-block], p, hr, [role="separator"], [data-kind="divider"], h1, h2, h3, h4, h5, h6, blockquote, li, figure, img, pre, code, table',
    "paragraph": '[data-pl-block-role="paragraph"], [data-kind="paragraph"], p',
    "divider": '[data-pl-block-role="divider"], [data-kind="divider"], hr, [role="separator"]',
    "heading": '[data-pl-block-role="heading"], [data-kind="heading"], h1, h2, h3, h4, h5, h6',
    "quote": '[data-pl-block-role="quote"], [data-kind="quote"], blockquote',
    "ordered": '[data-pl-list-kind="ordered"], [data-kind="ordered-list"], ol > li',
    "unordered": '[data-pl-list-kind="unordered"], [data-kind="unordered-list"], ul > li',
    "image": '[data-pl-block-role="image"] img, [data-kind="image"] img, figure img, picture img, img',
    "gallery": '[data-pl-block-role="image-gallery"], [data-kind="image-gallery"], figure',
    "code": '[data-pl-block-role="code"], [data-kind="code"], pre, code',
    "table": 'table, [role="table"], [role="grid"]',
}
FIX_ORDER = [
    "expand-folded-tweet-text",
    "normalize-handwritten-ordered-list",
    "preserve-svg-emoji",
    "capture-x-video-hls",
    "preserve-x-media-caption",
    "preserve-x-media-layout",
]
MATCH_REASON = "platform_adapter_match"


@dataclass(frozen=True)
class Adapter:
    """Rules of one site."""

    id: str
    platform: str
    hosts: list[str]
    root_selector: str
    content_type: str = "article"
    article_source: str | None = None
    url_patterns: list[str] = field(default_factory=list)
    enabled: bool = True
    confidence: float = 0.8
    title_selector: str | None = None
    content_selector: str | None = None
    header: dict[str, str] = field(default_factory=dict)
    semantic: dict[str, str] = field(default_factory=dict)
    remove: list[str] = field(default_factory=list)
    unwrap: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=list)
    min_blocks: int | None = None
    min_text: int | None = None
    required: list[str] = field(default_factory=list)
    stable_ms: int | None = None
    # None: the default article check applies
    validation: dict | None = None
    fixes: list[str] = field(default_factory=list)
    enabled_fixes: list[str] = field(default_factory=list)
    style: dict = field(default_factory=dict)
    special: list[dict] = field(default_factory=list)

    def selector(self, family: str) -> str:
        return (self.semantic.get(family) or "").strip() or DEFAULT_SELECTORS[family]

    @property
    def source(self) -> str:
        if self.article_source:
            return self.article_source
        if self.id == "fixture.article":
            return "fixture"
        return "x-article" if self.platform == "x" else self.id


# The built-in sites.
X_ARTICLE = Adapter(
    id="x.article",
    platform="x",
    hosts=["x.com", "twitter.com"],
    url_patterns=["^/[^/]+/(?:article|status)/[^/]+$"],
    # the site's own extractor claims its pages with full confidence
    confidence=1.0,
    root_selector='[data-testid="twitterArticleReadView"]',
    title_selector='[data-testid="twitter-article-title"]',
    content_selector='[data-testid="longformRichTextComponent"]',
    semantic={
        "block": '[data-block="true"]',
        "paragraph": '[data-block="true"]',
        "divider": '[data-block="true"] > [role="separator"], [data-pl-block-role="divider"], [data-kind="divider"]',
        "heading": '.longform-header-one, .longform-header-two, [data-pl-block-role="heading"], h1, h2, h3, h4, h5, h6',
        "quote": 'blockquote.longform-blockquote[data-block="true"], blockquote',
        "ordered": '.public-DraftStyleDefault-orderedListItem, .longform-ordered-list-item, [data-pl-list-kind="ordered"]',
        "unordered": '.public-DraftStyleDefault-unorderedListItem, .longform-unordered-list-item, [data-pl-list-kind="unordered"]',
        "image": '[data-testid="tweetPhoto"], img',
        "gallery": '[data-testid="tweetPhoto"]',
        "code": '[data-testid="markdown-code-block"], pre, code',
        "table": 'table, [role="table"], [role="grid"]',
    },
    remove=[
        "script", "style", "noscript", "button", "input", "textarea", "select", "option", "svg", '[role="button"]',
        '[data-testid="bookmark"]', '[data-testid="like"]', '[data-testid="reply"]', '[data-testid="retweet"]',
        '[data-testid="unlike"]',
    ],
    preserve=[
        "alt", "aria-label", "contenteditable", "datetime", "dir", "href", "lang", "rel", "role", "src", "style",
        "target", "title",
    ],
    min_text=200,
    min_blocks=3,
    required=[
        '[data-testid="twitterArticleReadView"]', '[data-testid="twitter-article-title"]',
        '[data-testid="longformRichTextComponent"]',
    ],
    validation={"min_blocks": 3, "min_text": 200, "title": "required", "empty": "reject"},
    fixes=FIX_ORDER,
    enabled_fixes=FIX_ORDER,
    style={"preserve_props": ["font-weight"], "preserve_color_for": ["link"], "preserve_white_space": ["pre", "pre-wrap"]},
    special=[{
        "id": "x.simple-tweet", "type": "social-card", "root": '[data-testid="simpleTweet"]', "handler": "x.simple-tweet",
    }],
)

_SUBSTACK_ROOT = "article.newsletter-post.post-viewer-post, article.podcast-post.post-viewer-post"
_SUBSTACK_TITLE = (
    'article.newsletter-post.post-viewer-post > div:first-child a[href*="/p/"], '
    'article.podcast-post.post-viewer-post > div:first-child a[href*="/p/"], '
    'article.podcast-post.post-viewer-post > div:nth-child(2) a[href*="/p/"]'
)
_SUBSTACK_BODY = ".available-content .body.markup"
_SUBSTACK_COMPONENTS = (
    '.body.markup [data-component-name="Image2ToDOM"], .body.markup > [data-component-name="Youtube2ToDOM"], '
    '.body.markup > [data-component-name="VideoEmbedPlayer"], audio[src], '
    '.body.markup > [data-component-name="FootnoteToDOM"], [data-component-name="Paywall"], '
    '[data-testid="paywall"], [data-component-name="SubscribeWidget"]'
)
SUBSTACK_ARTICLE = Adapter(
    id="substack.article",
    platform="substack",
    article_source="substack-article",
    hosts=["substack.com"],
    url_patterns=["^/inbox/post/[^/]+$", "^/home/post/[^/]+$"],
    root_selector=_SUBSTACK_ROOT,
    title_selector=_SUBSTACK_TITLE,
    header={
        "source_label": ':scope > div:first-child a[data-native="true"][href]',
        "title_link": _SUBSTACK_TITLE,
        "subtitle": ':scope > div:first-child a[href*="/p/"] + div',
        "author_name": '.byline-wrapper a[href*="substack.com/@"]',
        "author_avatar": '.byline-wrapper img[alt*="avatar"]',
        "published_at": ".byline-wrapper > div:last-child > div:last-child",
    },
    semantic={
        "block": (
            ".body.markup > p, .body.markup > hr, .body.markup > div > hr, "
            ".body.markup > h1, .body.markup > h2, .body.markup > h3, .body.markup > h4, .body.markup > h5, .body.markup > h6, "
            ".body.markup > ul > li, .body.markup > ol > li, .body.markup > blockquote, "
            ".body.markup > .captioned-image-container img, " + _SUBSTACK_COMPONENTS + ", .body.markup > a[data-component-name]"
        ),
        "paragraph": ".body.markup > p",
        "divider": ".body.markup > hr, .body.markup > div > hr",
        "heading": ".body.markup > h1, .body.markup > h2, .body.markup > h3, .body.markup > h4, .body.markup > h5, .body.markup > h6",
        "quote": ".body.markup > blockquote",
        "ordered": ".body.markup > ol > li",
        "unordered": ".body.markup > ul > li",
        "image": ".body.markup > .captioned-image-container img",
        "gallery": ".body.markup > .captioned-image-container",
        "code": ".body.markup > pre",
        "table": ".body.markup > table",
    },
    remove=["script", "style", "noscript", "button", '[role="button"]'],
    preserve=[
        "allow", "allowautoplay", "allowfullscreen", "aria-label", "controls", "controlslist", "crossorigin", "data-href",
        "data-native", "data-testid", "href", "frameborder", "src", "srcset", "sizes", "alt", "title", "class", "id",
        "loading", "poster", "preload", "style", "data-component-name", "data-attrs", "data-video-id", "gesture",
        "width", "height",
    ],
    min_blocks=10,
    min_text=500,
    required=[_SUBSTACK_ROOT, _SUBSTACK_BODY],
    validation={"min_blocks": 10, "min_text": 500, "title": "required", "empty": "reject"},
    style={
        "preserve_props": ["font-weight", "font-style", "text-decoration"], "preserve_color_for": ["link"],
        "preserve_white_space": ["pre", "pre-wrap"],
    },
    special=[
        {"id": "substack.twitter-embed", "type": "embed", "root": '.body.markup > a[data-component-name="Twitter2ToDOM"]', "handler": "substack.twitter-embed"},
        {"id": "substack.youtube-embed", "type": "embed", "root": '.body.markup > [data-component-name="Youtube2ToDOM"]', "handler": "substack.youtube-embed"},
        {"id": "substack.video-embed", "type": "video", "root": '.body.markup > [data-component-name="VideoEmbedPlayer"]', "handler": "substack.video-embed"},
        {"id": "substack.audio-embed", "type": "embed", "root": "audio[src]", "handler": "substack.audio-embed"},
        {"id": "substack.footnote", "type": "custom-card", "root": '.body.markup > [data-component-name="FootnoteToDOM"]', "handler": "substack.footnote"},
        {"id": "substack.paywall", "type": "embed", "root": '[data-component-name="Paywall"], [data-testid="paywall"]', "handler": "substack.paywall"},
        {"id": "substack.subscribe-widget", "type": "embed", "root": '[data-component-name="SubscribeWidget"]', "handler": "substack.subscribe-widget"},
    ],
)

FIXTURE_ARTICLE = Adapter(
    id="fixture.article",
    platform="fixture",
    hosts=["fixture.local"],
    url_patterns=["^/article/.+$"],
    root_selector="[data-article-root]",
    title_selector="[data-article-title]",
    content_selector="[data-article-content]",
    semantic={
        "block": "[data-block]",
        "paragraph": '[data-kind="paragraph"]',
        "heading": '[data-kind="heading"]',
        "quote": '[data-kind="quote"]',
        "ordered": '[data-kind="ordered-list"]',
        "unordered": '[data-kind="unordered-list"]',
        "image": '[data-kind="image"] img',
        "gallery": '[data-kind="image-gallery"]',
        "code": '[data-kind="code"]',
        "table": '[data-kind="table"]',
    },
    remove=[".ad", ".recommendation", ".comments", "button", '[role="button"]'],
    unwrap=[".content-wrapper"],
    preserve=["href", "src", "alt", "role", "data-kind", "data-block", "data-text", "data-pl-heading-level"],
    min_blocks=7,
    min_text=80,
    required=["[data-article-root]", "[data-article-title]", "[data-article-content]"],
    validation={"min_blocks": 7, "min_text": 80, "title": "required", "empty": "reject"},
    style={"preserve_props": ["font-weight", "font-style"], "preserve_color_for": ["link"], "preserve_white_space": ["pre", "pre-wrap"]},
)

BUILT_IN = [X_ARTICLE, SUBSTACK_ARTICLE, FIXTURE_ARTICLE]

# Our own site rules for the crawled example pages.
EXAMPLE_ARTICLE = Adapter(
    id="example.article",
    platform="example",
    hosts=["example.com", "example.net", "example.org"],
    url_patterns=["^/[a-z]{2}/[0-9]+"],
    root_selector="article",
    title_selector="h1",
    semantic={"block": DEFAULT_SELECTORS["block"]},
    remove=["script", "style", "nav", "footer", ".ad"],
    min_blocks=3,
    min_text=200,
    required=["article", "h1"],
    validation={"min_blocks": 3, "min_text": 200, "title": "required", "empty": "reject"},
)

CORPUS = [*BUILT_IN, EXAMPLE_ARTICLE]

# Hosts media may be requested from.
MEDIA_HOSTS = ["video.twimg.com", "pbs.twimg.com"]

_RULE = (
    "adapter_pos int, adapter_id string, platform string, content_type string, article_source string, "
    "hosts array<string>, url_patterns array<string>, enabled boolean, confidence double, root_selector string, "
    "title_selector string, content_selector string, semantic_map map<string,string>, "
    "remove_selectors array<string>, unwrap_selectors array<string>, preserve_attrs array<string>, "
    "readiness struct<min_text:int,min_blocks:int,required:array<string>,stable_ms:int>, "
    "validation struct<min_blocks:int,min_text:int,title_strategy:string,empty_strategy:string>, "
    "fixes array<string>, enabled_fixes array<string>, "
    "special array<struct<id:string,type:string,root_selector:string,handler_id:string>>"
)


def adapters_df(spark: SparkSession, adapters: list[Adapter]) -> DataFrame:
    """The rule registry in priority order."""
    rows = []
    for pos, a in enumerate(adapters):
        v = a.validation
        rows.append((
            pos, a.id, a.platform, a.content_type, a.source, a.hosts, a.url_patterns, a.enabled, a.confidence,
            a.root_selector, a.title_selector, a.content_selector, a.semantic, a.remove, a.unwrap, a.preserve,
            (a.min_text, a.min_blocks, a.required, a.stable_ms),
            (v.get("min_blocks"), v.get("min_text"), v.get("title"), v.get("empty")) if v is not None else None,
            a.fixes, a.enabled_fixes, [(s["id"], s["type"], s["root"], s["handler"]) for s in a.special],
        ))
    return spark.createDataFrame(rows, _RULE)
