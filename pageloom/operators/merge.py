"""Merge two extractions of an article in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.text import comparable_code_language, normalize_for_compare
from ..schema import BLOCK

# Fixed values.
REPLACEABLE = [
    "paragraph", "divider", "heading", "quote", "list", "image", "code", "table", "simple-tweet", "image-gallery", "embed",
]
HIGH_RISK = ["video", "gif"]
KEPT_FROM_PRIMARY = ["link"]


def block_equivalence_key(b: Column) -> Column:
    """Equal for blocks that say the same. JSON keeps nulls and borders apart."""
    same = lambda c: normalize_for_compare(F.coalesce(c, F.lit("")))
    joined = F.array_join(F.transform(b["items"], lambda i: i["text"]), "\n")
    cells = F.transform(b["table"]["rows"], lambda row: F.transform(row, lambda c: same(c["text"])))
    tweet, embed = b["tweet"], b["embed"]
    items = F.transform(tweet["items"], lambda i: F.struct(
        i["type"].alias("t"), same(i["text"]).alias("x"), F.transform(i["photos"], lambda p: p["src"]).alias("p"),
        i["video"]["src"].alias("v"), i["preview"]["src"].alias("s"), i["cover"]["cover_url"].alias("c"),
        same(i["quoted"]["title"]).alias("qt"), same(i["quoted"]["excerpt"]).alias("qe"), F.size(i["quoted"]["items"]).alias("qn"),
    ))
    t = b["type"]
    body = (
        F.when(t == "heading", F.to_json(F.struct(same(b["text"]).alias("x"), b["level"].alias("l"))))
        .when(t.isin("paragraph", "quote"), F.to_json(F.struct(same(b["text"]).alias("x"))))
        .when(t == "divider", F.lit(""))
        .when(t == "list", F.to_json(F.struct(b["kind"].alias("k"), same(joined).alias("x"))))
        .when(t == "image", F.to_json(F.struct(b["image"]["src"].alias("s"))))
        .when(t == "code", F.to_json(F.struct(same(b["text"]).alias("x"), comparable_code_language(b["code"]["language"]).alias("l"))))
        .when(t == "table", F.to_json(F.struct(cells.alias("c"))))
        .when(t == "image-gallery", F.to_json(F.struct(F.transform(b["gallery"]["items"], lambda i: i["src"]).alias("s"))))
        .when(t == "embed", F.to_json(F.struct(same(embed["label"]).alias("l"), same(embed["text"]).alias("x"), same(embed["href"]).alias("h"))))
        .when(t == "simple-tweet", F.to_json(F.struct(
            same(tweet["title"]).alias("t"), same(tweet["excerpt"]).alias("e"), same(tweet["href"]).alias("h"), items.alias("i"))))
    )
    return F.when(body.isNotNull(), F.sha2(F.concat(t, F.lit("|"), body), 256))


SEARCH_STEPS = 24  # halvings of a binary search: articles of up to sixteen million blocks
ROW = f"struct<order:struct<p:int,s:int,c:int>,block_id:string,block:{BLOCK}>"


def steps_for(items: Column) -> Column:
    """Widths of a binary search over these items, the widest first."""
    return F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(SEARCH_STEPS))]), lambda width: width <= F.size(items))


def lower_bound(items: Column, less: Callable[[Column], Column], steps: Column) -> Column:
    """How many items from the front are `less`; they all stand before those that are not. `steps`: of `steps_for`."""
    def step(at: Column, width: Column) -> Column:
        ahead = (at + width <= F.size(items)) & less(F.get(items, at + width - 1))
        return F.when(F.coalesce(ahead, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _side(df: DataFrame, key: str, name: str, eq: Column) -> DataFrame:
    """One row per article: its blocks in order."""
    by_place = lambda a, b: (a["block_pos"] - b["block_pos"]).cast("int")
    entry = F.struct("block_pos", "block_id", F.col("block").cast(BLOCK).alias("block"), eq.alias("eq"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(entry), by_place).alias(name))


def matched_articles(primary: DataFrame, clean: DataFrame, key: str = "article_id") -> DataFrame:
    """One row per article: both sides in order, and for each primary block the place of the clean block it takes (-1: none).

    A fold over the primary blocks keeps a cursor into the clean ones. What a block may take lies next to (its key, cursor)
    in the sorted list of (key, place), found by halving, so an article costs its blocks times the logarithm of their
    number. Each side moves once.
    """
    replaceable = F.col("block.type").isin(*REPLACEABLE)
    own = _side(primary, key, "own", F.when(replaceable, block_equivalence_key(F.col("block"))))
    sides = own.join(_side(clean, key, "new", block_equivalence_key(F.col("block"))), key, "full_outer")
    places = F.transform("new", lambda b, i: F.struct(b["eq"].alias("eq"), i.alias("at")))
    sides = sides.withColumn("finder", F.array_sort(F.coalesce(F.filter(places, lambda x: x["eq"].isNotNull()), F.expr("cast(array() as array<struct<eq:string,at:int>>)"))))
    sides = sides.withColumn("steps", steps_for(F.col("finder")))
    finder = F.col("finder")

    def take(state: Column, block: Column) -> Column:
        wanted = F.struct(block["eq"].alias("eq"), state["cursor"].alias("at"))
        found = let(lower_bound(finder, lambda x: x < wanted, F.col("steps")), lambda i: F.get(finder, i))
        hit = let(found, lambda x: F.when(x["eq"] == block["eq"], x["at"]).otherwise(-1))
        return let(F.coalesce(hit, F.lit(-1)), lambda at: F.struct(
            F.when(at >= 0, at + 1).otherwise(state["cursor"]).alias("cursor"), F.concat(state["taken"], F.array(at)).alias("taken")))

    start = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<int>)").alias("taken"))
    return sides.withColumn("taken", F.aggregate("own", start, take, lambda s: s["taken"])).drop("finder", "steps")


def _merged(own: Column, new: Column) -> Column:
    """A replaced block has the clean one's content; captions keep their role and both styles."""
    no_style = F.expr("cast(map() as map<string,string>)")
    caption = (F.coalesce(own["role"], F.lit("")) == "caption") | (F.coalesce(new["role"], F.lit("")) == "caption")
    old_style = F.coalesce(own["text_style"], no_style)
    new_style = F.map_filter(F.coalesce(new["text_style"], no_style), lambda k, v: ~F.map_contains_key(old_style, k))
    restyled = new.withField("role", F.lit("caption")).withField("text_style", F.map_concat(new_style, old_style)).cast(BLOCK)
    return F.when(new.isNull(), own).when((own["type"] == "paragraph") & caption, restyled).otherwise(new)


def merge_extractions(primary: DataFrame, clean: DataFrame, key: str = "article_id") -> tuple[DataFrame, DataFrame]:
    """A5: (merged blocks, stats). Inputs: key, block_pos, block_id, block.

    Column expressions over one row per article (`matched_articles`). An article without primary blocks keeps its clean ones
    as they are, with a stats row of zeros.
    """
    matched = matched_articles(primary, clean, key)
    place = lambda p, s, c: F.struct(p.cast("int").alias("p"), F.lit(s).alias("s"), c.cast("int").alias("c"))
    row = lambda order, block_id, block: F.struct(order.alias("order"), block_id.alias("block_id"), block.alias("block")).cast(ROW)
    kept = F.transform("own", lambda b, i: row(
        place(b["block_pos"], 1, F.lit(0)), b["block_id"],
        let(F.get("new", F.nullif(F.get("taken", i), F.lit(-1))), lambda c: _merged(b["block"], c["block"]))))
    passed = F.transform("new", lambda b: row(place(b["block_pos"], 1, F.lit(0)), b["block_id"], b["block"]))
    # clean-only dividers stand before the primary block whose match follows them
    hits = F.filter(F.transform("own", lambda b, i: F.struct(F.get("taken", i).alias("at"), b["block_pos"].alias("block_pos"))), lambda h: h["at"] >= 0)
    dividers = F.filter(F.transform("new", lambda b, i: F.when(b["block"]["type"] == "divider", i)), lambda i: i.isNotNull())
    staged = matched.withColumns({"hits": hits, "dividers": dividers}).withColumn("steps", steps_for(F.col("hits")))
    loose = F.filter(F.transform("dividers", lambda i: F.struct(
        F.get("new", i).alias("b"), F.get("hits", lower_bound(F.col("hits"), lambda h: h["at"] < i, F.col("steps"))).alias("next"), i.alias("at"))),
        lambda x: ~F.coalesce(x["next"]["at"] == x["at"], F.lit(False)))
    extra = F.transform(loose, lambda x: row(
        place(F.coalesce(x["next"]["block_pos"], F.lit((1 << 31) - 1)), 0, x["b"]["block_pos"]), x["b"]["block_id"], x["b"]["block"]))
    rows = F.when(F.col("own").isNull(), passed).otherwise(F.concat(kept, F.coalesce(extra, F.expr(f"cast(array() as array<{ROW}>)"))))
    merged = staged.withColumn("rows", rows).select(key, F.inline_outer("rows"))

    def count(test: Callable[[Column, Column], Column]) -> Column:
        return F.coalesce(F.size(F.filter("own", lambda b, i: test(b["block"]["type"], F.get("taken", i)))), F.lit(0)).cast("bigint")

    none = F.col("own").isNull()
    stats = matched.select(key, *[F.when(none, 0).otherwise(c).cast("bigint").alias(name) for name, c in {
        "replaced": count(lambda t, at: at >= 0), "fallback": count(lambda t, at: t.isin(*REPLACEABLE) & (at < 0)),
        "high_risk": count(lambda t, at: t.isin(*HIGH_RISK)), "primary_only": count(lambda t, at: t.isin(*KEPT_FROM_PRIMARY)),
    }.items()])
    return merged, stats
