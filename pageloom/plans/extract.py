"""Pages to blocks and articles in one pass.

route -> one exchange on page_id
      -> parse -> locate -> ready? -> fix -> clean -> convert    (narrow, per page row)
      -> suppress, group, number -> articles                     (windows and groups, same partitioning)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import (
    finish_blocks,
    group_lists,
    number_blocks,
    outermost,
    suppress_consumed,
    with_facts,
    with_family,
    with_parts,
)
from ..operators.clean import platform_fixes, remove_noise, sanitize, strip_attrs, with_snapshot
from ..operators.handlers import HANDLERS
from ..operators.marks import explode_candidates, is_, mark_nodes
from ..operators.locate import header_meta, locate_roots, page_selectors, post_head, readiness, resolve_title
from ..operators.routing import route
from ..operators.merge import merge_extractions
from ..operators.second import second_blocks, second_extraction, with_second
from ..session import dealt, written
from ..sources.adapters import CORPUS, Adapter
from ..sources.html import parse_nodes

UNCLEANED_ATTRS = ["class", "poster", "preload", "width", "height"]


def parsed_pages(pages: DataFrame, adapters: list[Adapter]) -> DataFrame:
    return parse_nodes(dealt(route(pages, adapters), "page_id"), page_selectors(adapters))


def ready_pages(parsed: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """Roots, title and readiness of every routed page."""
    return readiness(resolve_title(locate_roots(parsed, adapters), adapters), adapters)


def heads(ready: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """What stands above the article, of either kind of site."""
    return post_head(header_meta(ready, adapters), adapters)


def clean_pages(pages: DataFrame, adapters: list[Adapter]) -> DataFrame:
    ready = ready_pages(parsed_pages(pages, adapters), adapters)
    return sanitize(platform_fixes(heads(ready, adapters), adapters), adapters)


def extract(pages: DataFrame, adapters: list[Adapter] | None = None, handlers: dict | None = None, nested: str = "keep") -> DataFrame:
    """Block rows and one head row (block_pos -1) per routed page, hashed by page_id.

    `nested='keep'` keeps a paragraph inside a quote next to the quote;
    `'outermost'` keeps only the outer one.
    """
    adapters = CORPUS if adapters is None else adapters
    clean = clean_pages(pages, adapters)
    typed = with_family(with_facts(explode_candidates(mark_nodes(clean, adapters))))
    parts = with_parts(typed, HANDLERS if handlers is None else handlers, adapters)
    rows = group_lists(suppress_consumed(finish_blocks(parts)))
    return number_blocks(outermost(rows) if nested == "outermost" else rows)


def extract_twice(pages: DataFrame, adapters: list[Adapter], handlers: dict | None = None) -> DataFrame:
    """Blocks of the second extraction, the primary side of a merge.

    It reads the page as it is, so the attributes it needs survive cleaning.
    """
    adapters = [replace(a, preserve=[*a.preserve, *UNCLEANED_ATTRS]) for a in adapters]
    clean = clean_pages(pages, adapters)
    typed = with_family(with_facts(explode_candidates(mark_nodes(clean, adapters))))
    parts = with_parts(typed, HANDLERS if handlers is None else handlers, adapters)
    return second_extraction(second_blocks(parts))


SECOND = "#second"


@dataclass
class Merged:
    """Block and head rows of the first extraction, blocks of the second, and both merged, with the counts of the merge."""

    rows: DataFrame
    second: DataFrame
    blocks: DataFrame
    stats: DataFrame


def extract_merged(pages: DataFrame, adapters: list[Adapter], handlers: dict | None = None) -> Merged:
    """Both extractions and their merge from one parse of each page.

    A page is located, fixed and freed of noise once and then stripped in two ways, the second keeping the attributes that
    the second extraction reads. A candidate is converted for its own extraction only, and the second one has no others than
    marked elements. The candidates of both are written once; what follows reads that table.
    """
    is_second = F.endswith("adapter_id", F.lit(SECOND))
    rules = [*adapters, *[replace(a, id=a.id + SECOND, preserve=[*a.preserve, *UNCLEANED_ATTRS]) for a in adapters]]
    fixed = platform_fixes(heads(ready_pages(parsed_pages(pages, adapters), adapters), adapters), adapters)
    twice = remove_noise(fixed, adapters).withColumn("adapter_id", F.explode_outer(F.array("adapter_id", F.concat("adapter_id", F.lit(SECOND)))))
    clean = with_snapshot(strip_attrs(twice, rules), rules)
    read = explode_candidates(mark_nodes(clean, rules)).filter(~is_second | is_(F.col("n"), "data_block"))
    typed = with_family(with_facts(read)).withColumn("family", F.when(~is_second, F.col("family")))
    parts = with_second(with_parts(typed, HANDLERS if handlers is None else handlers, rules), is_second)
    both = written(finish_blocks(parts, carry=("second",)), "candidates")
    rows = number_blocks(group_lists(suppress_consumed(both.filter(~is_second).drop("second"))))
    second = second_extraction(both.filter(is_second & (F.col("node_id") >= 0)).select("page_id", "node_id", "second.*"))
    clean_side = rows.filter("block_pos >= 0").select("page_id", "block_pos", "block_id", "block")
    blocks, stats = merge_extractions(second, clean_side, "page_id")
    routed = rows.filter("block_pos < 0").select("page_id", "adapter_id")
    return Merged(rows, second, blocks, routed.join(stats, "page_id", "left").na.fill(0))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The `blocks` table."""
    return rows.filter("block_pos >= 0").select("page_id", "adapter_id", "block_pos", "block_id", "node_id", "block.*")


def pages_of(rows: DataFrame) -> DataFrame:
    """Page facts: url, title, readiness, cleaning counts."""
    return rows.filter("block_pos < 0").select(F.col("page.*"))
