"""URL columns (U3-U9): parts, resolution against a base, providers, lookup keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let
from .text import WS

# Fixed values.
CANONICAL_POST_ORIGIN = "https://x.com"
POST_HOSTS = ("x.com", "twitter.com")
POST_PATH = "^/([^/]+)/(?:article|status)/([0-9]+)/?$"
PROVIDER_LABELS = {"youtube": "YouTube", "x": "X", "substack": "Substack", "generic": "Embed"}

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_WEB = "^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]*))?"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def is_web(c: Column) -> Column:
    return F.regexp_like(c, F.lit(_WEB))


def url_host(c: Column) -> Column:
    """Lower-case host of a web URL, null otherwise."""
    return F.nullif(F.lower(_part(c, _WEB, 2)), F.lit(""))


def url_origin(c: Column) -> Column:
    scheme = F.lower(_part(c, _WEB, 1))
    port = _part(c, _WEB, 3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(
        is_web(c),
        F.concat(scheme, F.lit("://"), url_host(c), F.when(default, "").otherwise(F.concat(F.lit(":"), port))),
    )


def _after_authority(c: Column) -> Column:
    return F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")


def url_path(c: Column) -> Column:
    path = _part(_after_authority(c), "^([^?#]*)")
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_query(c: Column) -> Column:
    """Query including `?`; a lone `?` counts as none."""
    query = _part(c, "^[^?#]*(\\?[^#]*)")
    return F.when(query == "?", F.lit("")).otherwise(query)


def url_fragment(c: Column) -> Column:
    return _part(c, "^[^#]*(#.*)$")


def url_file(c: Column) -> Column:
    """Path plus query, the part URL patterns are tested on."""
    return F.concat(url_path(c), url_query(c))


def _escape(c: Column, also: str = "") -> Column:
    """Percent-encode what a browser encodes; untouched text takes the cheap branch."""
    unsafe = f"[^\\x21-\\x7e]|[\"<>{also}]"

    def one(ch: Column) -> Column:
        code = F.when(ch == " ", F.lit("%20")).otherwise(F.url_encode(ch))
        return F.when(F.regexp_like(ch, F.lit(unsafe)), code).otherwise(ch)

    spelled = F.array_join(F.transform(F.split(c, ""), one), "")
    return F.when(F.regexp_like(c, F.lit(unsafe)), spelled).otherwise(c)


def _squeeze_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    parents = ("..", "%2e%2e")

    def step(acc: Column, seg: Column) -> Column:
        low = F.lower(seg)
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(low.isin(*parents), up).when(low.isin(".", "%2e"), acc).otherwise(F.concat(acc, F.array(seg)))

    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    trailing = F.when(F.regexp_like(path, F.lit("/(?:\\.|\\.\\.)$")), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    closed = F.when((joined == "/") & (trailing == "/"), joined).otherwise(F.concat(joined, trailing))
    return F.when(F.regexp_like(path, F.lit("/(?:\\.|%2[eE])")), closed).otherwise(path)


def _normal(url: Column) -> Column:
    """A web URL the way a browser spells it."""
    path = let(url_path(url), lambda p: let(_squeeze_dots(p), lambda q: _escape(q, "`{}")))
    query = let(url_query(url), lambda q: _escape(q, "'"))
    fragment = let(F.regexp_replace(url_fragment(url), "^#$", ""), lambda f: _escape(f, "`"))
    return F.concat(url_origin(url), path, query, fragment)


def resolve_url(href: Column, base: Column) -> Column:
    """U4: absolute URL of `href` seen from `base`, null when there is none."""
    parts = F.struct(
        F.regexp_replace(F.btrim(href, F.lit(WS)), "[\t\r\n]", "").alias("h"),
        url_origin(base).alias("origin"),
        url_path(base).alias("path"),
        url_query(base).alias("query"),
        is_web(base).alias("web"),
    )

    def join(p: Column) -> Column:
        h = p["h"]
        web_base = (
            F.when(F.startswith(h, F.lit("//")), F.concat(_part(p["origin"], "^([a-z]+:)"), h))
            .when(F.startswith(h, F.lit("/")), F.concat(p["origin"], h))
            .when(F.startswith(h, F.lit("?")), F.concat(p["origin"], p["path"], h))
            .when(F.startswith(h, F.lit("#")), F.concat(p["origin"], p["path"], p["query"], h))
            .otherwise(F.concat(p["origin"], _part(p["path"], "^(.*/)"), h))
        )
        return (
            F.when(h == "", None)
            .when(F.regexp_like(h, F.lit("^(?i)https?:")), F.regexp_replace(h, "^(?i)(https?):/*", "$1://"))
            .when(F.regexp_like(h, F.lit(_SCHEME)), h)
            .when(p["web"], web_base)
        )

    def spell(u: Column) -> Column:
        web = is_web(u)
        broken = F.regexp_like(u, F.lit("^(?i)https?:"))
        return F.when(web, _normal(u)).when(~broken, u)

    return let(let(parts, join), spell)


def safe_url(href: Column, base: Column) -> Column:
    """Resolved URL when it is plain http(s)."""
    return let(resolve_url(href, base), lambda url: F.when(F.regexp_like(url, F.lit("^https?:")), url))


def post_id(c: Column) -> Column:
    """Digits of a post URL on the exact post hosts, else null."""
    return F.when(url_host(c).isin(*POST_HOSTS), F.nullif(_part(url_path(c), POST_PATH, 2), F.lit("")))


def post_handle(c: Column) -> Column:
    return F.when(url_host(c).isin(*POST_HOSTS), F.nullif(_part(url_path(c), POST_PATH, 1), F.lit("")))


def post_canonical(c: Column) -> Column:
    handle = F.coalesce(post_handle(c), F.lit("i"))
    return F.when(
        post_id(c).isNotNull(), F.concat(F.lit(CANONICAL_POST_ORIGIN + "/"), handle, F.lit("/article/"), post_id(c))
    )


def embed_provider(href: Column) -> Column:
    """U6."""
    return let(url_host(href), lambda host: (
        F.when(host.contains("youtube.com") | host.contains("youtu.be"), F.lit("youtube"))
        .when((host == "x.com") | host.endswith(".x.com") | host.contains("twitter.com"), F.lit("x"))
        .when(host.contains("substack.com"), F.lit("substack"))
        .otherwise(F.lit("generic"))
    ))


def provider_name(provider: Column) -> Column:
    named = F.create_map(*[F.lit(v) for pair in PROVIDER_LABELS.items() for v in pair])
    return F.coalesce(F.element_at(named, provider), F.lit(PROVIDER_LABELS["generic"]))


def href_keys(href: Column, base: Column) -> Column:
    """Raw, absolute, and absolute without fragment; distinct, in that order."""
    keys = let(resolve_url(href, base), lambda absolute: F.array_distinct(F.array_compact(
        F.array(href, absolute, F.regexp_replace(absolute, "#.*$", ""))
    )))
    empty = F.expr("cast(array() as array<string>)")
    return F.when(href.isNull() | (href == ""), empty).otherwise(keys)


def upgrade_image_url(src: Column) -> Column:
    """U8: ask the image host for the original size."""
    wanted = src.contains("pbs.twimg.com/media/")
    named = F.regexp_like(src, F.lit("[?&]name="))
    replaced = F.regexp_replace(src, "([?&]name=)[^&#]*", "$1orig")
    base = F.regexp_replace(src, "#.*$", "")
    glue = F.when(F.regexp_like(base, F.lit("\\?")), F.lit("&")).otherwise(F.lit("?"))
    appended = F.concat(base, glue, F.lit("name=orig"), url_fragment(src))
    return F.when(wanted & named, replaced).when(wanted, appended).otherwise(src)


def absolute_post_url(href: Column) -> Column:
    return resolve_url(href, F.lit(CANONICAL_POST_ORIGIN + "/"))


def dot_suffixes(host: Column) -> Column:
    """`a.b.c` -> [`a.b.c`, `b.c`, `c`]: the keys a host rule can match on."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."),
    )
