"""H2: selectors and tree walks as columns over a page's node array.

`Tree` holds the columns of one page row. All walks use the interval encoding:
descendants are a slice of the array and ancestors are looked up by position
through `path`, so a page costs its node count times its depth, never its
square, and no walk needs a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import let  # noqa: F401
from ..sources.adapters import Adapter
from .selectors import alternatives_of, hit_places, parse_selector  # noqa: F401

def attr(n: Column, name: str) -> Column:
    return F.element_at(n["attrs"], F.lit(name))


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


@lru_cache(maxsize=64)
def _fields_of(ddl: str) -> tuple[tuple[str, str], ...]:
    return tuple((f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(ddl).fields)


def make_struct(ddl: str, **values: Column) -> Column:
    """Struct of the given DDL; fields without a value are null."""
    return F.struct(*[
        (values[name] if name in values else F.lit(None)).cast(kind).alias(name) for name, kind in _fields_of(ddl)
    ])


def per_adapter(adapters: list[Adapter], build: Callable[[Adapter], Column], key: str = "adapter_id") -> Column:
    """One expression for pages of many sites: only the page's own branch is evaluated."""
    chosen = None
    for a in adapters:
        is_site = F.col(key) == a.id
        chosen = F.when(is_site, build(a)) if chosen is None else chosen.when(is_site, build(a))
    return chosen if chosen is not None else F.lit(None)


class Tree:
    """Column expressions over one page's `nodes` and `texts`."""

    def __init__(
        self, nodes: Column, texts: Column, root_id: Column | None = None, cleaned: bool = False, hits: dict[str, tuple[str, int]] | None = None,
    ):
        """`hits`: bits that the parser left on the nodes for selectors it was given (`selectors.hit_places`)."""
        self.hits = hits or {}
        self.nodes = nodes
        self.texts = texts
        self.root_id = F.lit(0) if root_id is None else root_id
        self.cleaned = cleaned

    def at(self, node_id: Column) -> Column:
        return F.get(self.nodes, node_id)

    # ---- selectors -------------------------------------------------------
    def _test(self, n: Column, test: tuple, scope: Column | None) -> Column:
        kind = test[0]
        if kind == "tag":
            return F.lit(True) if test[1] == "*" else n["tag"] == test[1]
        if kind == "class":
            return F.array_contains(n["classes"], test[1])
        if kind == "scope":
            return n["node_id"] == scope if scope is not None else n["parent_id"] < 0
        if kind == "first-child":
            return n["sib_pos"] == 1
        if kind == "last-child":
            return n["sib_last"]
        if kind == "nth-child":
            return n["sib_pos"] == int(test[1])
        value = attr(n, test[1])
        if kind == "has":
            return value.isNotNull()
        if kind == "=":
            return value == test[2]
        matcher = {"*=": value.contains, "^=": value.startswith, "$=": value.endswith}[kind]
        return matcher(test[2]) if test[2] else F.lit(False)

    def _chain(self, n: Column, chain: tuple, scope: Column | None) -> Column:
        comb, tests = chain[-1]
        here = reduce(lambda a, b: a & b, [self._test(n, t, scope) for t in tests])
        if len(chain) == 1:
            return here
        rest = chain[:-1]
        if comb == ">":
            outer = self._chain(self.at(n["parent_id"]), rest, scope)
        elif comb == "+":
            outer = self._chain(self.at(n["prev_id"]), rest, scope)
        else:
            outer = F.exists(n["path"], lambda i: F.coalesce(self._chain(self.at(i), rest, scope), F.lit(False)))
        return here & outer

    def matches(self, n: Column, selector: str | None, scope: Column | None = None) -> Column:
        """Element.matches; an unknown selector matches nothing."""
        if selector in self.hits:
            field, bit = self.hits[selector]
            return F.coalesce(n[field].bitwiseAND(F.lit(1 << bit)) != 0, F.lit(False))
        alternatives = alternatives_of(selector)
        tags = [a[0][1][0][1] for a in alternatives if len(a) == 1 and len(a[0][1]) == 1 and a[0][1][0][0] == "tag" and a[0][1][0][1] != "*"]
        found = [n["tag"].isin(*tags)] if tags else []
        for chain in alternatives:
            if len(chain) == 1 and len(chain[0][1]) == 1 and chain[0][1][0][0] == "tag" and chain[0][1][0][1] != "*":
                continue
            found.append(self._chain(n, chain, scope))
        return F.coalesce(any_of(found), F.lit(False))

    def matching(self, selector: str) -> Callable[[Column], Column]:
        return lambda n: self.matches(n, selector)

    # ---- walks -----------------------------------------------------------
    def _live(self, n: Column) -> Column:
        return n["live"] if self.cleaned else F.lit(True)

    def slice_of(self, n: Column) -> Column:
        """Everything below `n`, removed elements included."""
        return F.slice(self.nodes, n["node_id"] + 2, n["end_id"] - n["node_id"])

    def all(self, n: Column, selector: str | None = None) -> Column:
        """querySelectorAll below `n`, in document order."""
        scope = n["node_id"]
        if selector is None:
            return F.filter(self.slice_of(n), self._live)
        return F.filter(self.slice_of(n), lambda m: self._live(m) & self.matches(m, selector, scope))

    def first(self, n: Column, selector: str) -> Column:
        return first_of(self.all(n, selector))

    def has(self, n: Column, selector: str) -> Column:
        """Is there such an element below `n`?"""
        found = F.exists(self.slice_of(n), lambda m: self._live(m) & self.matches(m, selector, n["node_id"]))
        return F.coalesce(found, F.lit(False))

    def self_or_first(self, n: Column, selector: str) -> Column:
        return F.when(self.matches(n, selector), n).otherwise(self.first(n, selector))

    def children(self, n: Column) -> Column:
        return F.filter(self.slice_of(n), lambda m: self._live(m) & (m["parent_id"] == n["node_id"]))

    def line(self, n: Column) -> Column:
        """Ids from the root down to `n` itself."""
        return F.filter(F.concat(n["path"], F.array(n["node_id"])), lambda i: i >= self.root_id)

    def has_closest(self, n: Column, selector: str) -> Column:
        return F.coalesce(F.exists(self.line(n), lambda i: self.matches(self.at(i), selector)), F.lit(False))

    def closest(self, n: Column, selector: str) -> Column:
        hit = last_of(F.filter(self.line(n), lambda i: self.matches(self.at(i), selector)))
        return self.at(hit)

    def text(self, n: Column) -> Column:
        """textContent."""
        return F.array_join(F.slice(self.texts, n["text_from"] + 1, n["text_to"] - n["text_from"]), "")


def known_hits(df: DataFrame, selectors: list[str]) -> dict[str, tuple[str, int]]:
    """Bits of these very selectors, if the nodes of `df` carry them."""
    places = hit_places(selectors)
    carried = df.schema["nodes"].dataType.elementType.names
    return places if all(field in carried for field, _ in places.values()) else {}


def select(parsed, selector: str):
    """H2: rows of the elements that match `selector` anywhere in the page."""
    tree = Tree(F.col("nodes"), F.col("texts"))
    found = F.filter("nodes", lambda n: tree.matches(n, selector))
    return parsed.select("page_id", F.inline(found))
