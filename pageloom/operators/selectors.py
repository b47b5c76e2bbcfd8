"""H2, many selectors at once: compiled into one matcher over a batch of pages.

Selectors fall into compounds and compounds into single tests; every distinct test is one comparison over the flat nodes of
the batch, every distinct step of a selector one bit per node. A step holds where its compound does and the step before it
holds at the parent (`>`), the sibling before (`+`) or some ancestor. Elements are intervals in document order, so "some
ancestor" is a running count of open intervals, whatever the depth. The same count carries bits from ancestors down.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..kernels import ship_by_value

ship_by_value(__name__)

WORD_BITS = 62

_PIECE = re.compile(
    r"""(?P<comb>\s*[>+]\s*)|(?P<comma>\s*,\s*)|(?P<space>\s+)|(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+)))?\s*\]"""
    r"""|:(?P<pseudo>scope|first-child|last-child|nth-child)(?:\((?P<n>\d+)\))?"""
)


def parse_selector(selector: str) -> tuple:
    """((combinator, tests), ...) per alternative; raises ValueError when unknown."""
    alternatives, chain, tests, comb, pos = [], [], [], " ", 0
    source = selector.strip()

    def end_compound() -> None:
        if not tests:
            raise ValueError(f"unsupported selector: {selector}")
        chain.append((comb, tuple(tests)))
        tests.clear()

    while pos < len(source):
        m = _PIECE.match(source, pos)
        if m is None:
            raise ValueError(f"unsupported selector: {selector}")
        pos = m.end()
        if m["comma"]:
            end_compound()
            alternatives.append(tuple(chain))
            chain.clear()
            comb = " "
        elif m["comb"] or m["space"]:
            end_compound()
            comb = (m["comb"] or " ").strip() or " "
        elif m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["cls"]:
            tests.append(("class", m["cls"]))
        elif m["id"]:
            tests.append(("=", "id", m["id"]))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            tests.append((m["op"] or "has", m["attr"].lower(), value))
        else:
            tests.append((m["pseudo"], m["n"]))
    end_compound()
    alternatives.append(tuple(chain))
    return tuple(alternatives)


def alternatives_of(selector: str | None) -> tuple:
    """Parsed alternatives; an unknown selector has none and so matches nothing."""
    try:
        return parse_selector(selector) if selector and selector.strip() else ()
    except ValueError:
        return ()


def needs_scope(selector: str) -> bool:
    return any(test[0] == "scope" for chain in alternatives_of(selector) for _, tests in chain for test in tests)


class Nodes:
    """The nodes of a batch of pages as flat arrays; positions count through the batch."""

    def __init__(self, pages: pa.ListArray):
        flat = pages.flatten()
        fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
        self.n = len(flat)
        offsets = pages.offsets.to_numpy().astype(np.int64)
        self.offsets = offsets - offsets[0]
        sizes = np.diff(self.offsets)
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.base = np.repeat(self.offsets[:-1], sizes)
        self.fields = fields
        self.end = self.whole("end_id") + self.base
        self.parent = self.position("parent_id")
        self._masks: dict[tuple, np.ndarray] = {}

    def whole(self, name: str) -> np.ndarray:
        return self.fields[name].fill_null(-1).to_numpy().astype(np.int64)

    def flag(self, name: str) -> np.ndarray:
        return self.fields[name].fill_null(False).to_numpy(zero_copy_only=False)

    def position(self, name: str) -> np.ndarray:
        """Positions that a field points to; n where it points nowhere."""
        own = self.whole(name)
        return np.where(own < 0, self.n, own + self.base)

    def owners(self, lists) -> tuple[np.ndarray, np.ndarray]:
        ends = lists.offsets.to_numpy().astype(np.int64)
        return np.repeat(np.arange(len(lists)), np.diff(ends)), ends

    def test(self, test: tuple) -> np.ndarray:
        """Where one test holds."""
        if test not in self._masks:
            self._masks[test] = self._test(test)
        return self._masks[test]

    def _test(self, test: tuple) -> np.ndarray:
        kind, name = test[0], test[1]
        if kind == "tag":
            return np.ones(self.n, bool) if name == "*" else pc.equal(self.fields["tag"], name).fill_null(False).to_numpy(zero_copy_only=False)
        if kind == "first-child":
            return self.whole("sib_pos") == 1
        if kind == "nth-child":
            return self.whole("sib_pos") == int(name)
        if kind == "last-child":
            return self.flag("sib_last")
        mask = np.zeros(self.n, bool)
        if kind == "class":
            lists = self.fields["classes"]
            owner, ends = self.owners(lists)
            values = lists.values.slice(ends[0], ends[-1] - ends[0])
            mask[owner[pc.equal(values, name).fill_null(False).to_numpy(zero_copy_only=False)]] = True
            return mask
        maps = self.fields["attrs"]
        owner, ends = self.owners(maps)
        own = pc.equal(maps.keys.slice(ends[0], ends[-1] - ends[0]), name).to_numpy(zero_copy_only=False)
        owner = owner[own]
        if kind != "has":
            if kind != "=" and not test[2]:
                return mask
            values = maps.items.slice(ends[0], ends[-1] - ends[0]).filter(pa.array(own))
            compare = {"=": pc.equal, "*=": pc.match_substring, "^=": pc.starts_with, "$=": pc.ends_with}[kind]
            owner = owner[compare(values, test[2]).fill_null(False).to_numpy(zero_copy_only=False)]
        mask[owner] = True
        return mask

    def below(self, mask: np.ndarray) -> np.ndarray:
        """Nodes with an ancestor in the mask."""
        change = np.zeros(self.n + 2, np.int32)
        at = np.flatnonzero(mask)
        np.add.at(change, at + 1, 1)
        np.add.at(change, self.end[at] + 1, -1)
        return np.cumsum(change[:self.n]) > 0

    def nearest(self, mask: np.ndarray) -> np.ndarray:
        """The innermost of a node and its ancestors in the mask; n where there is none."""
        near = np.append(np.where(mask, np.arange(self.n), self.parent), self.n)
        while True:
            further = near[near]
            if (further == near).all():
                return near[:-1]
            near = further

    def outermost_above(self, mask: np.ndarray) -> np.ndarray:
        """The outermost proper ancestor in the mask; n where there is none."""
        near = np.append(self.nearest(mask), self.n)
        above = near[np.append(self.parent, self.n)]
        top = np.where(above < self.n, above, np.arange(self.n + 1))
        while True:
            further = top[top]
            if (further == top).all():
                break
            top = further
        return top[above][:-1]


class Matcher:
    """Selectors without `:scope`, matched together."""

    def __init__(self, selectors: list[str]):
        self.chains = {s: alternatives_of(s) for s in selectors}

    def __call__(self, nodes: Nodes, usable: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Per selector the nodes it matches. Nodes that are not usable match nothing and are nobody's ancestors."""
        steps: dict[tuple, np.ndarray] = {}

        def step(chain: tuple) -> np.ndarray:
            if chain in steps:
                return steps[chain]
            comb, tests = chain[-1]
            mask = np.ones(nodes.n, bool) if usable is None else usable
            for test in tests:
                mask = mask & nodes.test(test)
            if len(chain) > 1:
                before = step(chain[:-1])
                if comb == " ":
                    mask = mask & nodes.below(before)
                else:
                    held = np.append(before, False)
                    mask = mask & held[nodes.parent if comb == ">" else nodes.position("prev_id")]
            steps[chain] = mask
            return mask

        none = np.zeros(nodes.n, bool)
        return {s: np.logical_or.reduce([step(c) for c in chains]) if chains else none for s, chains in self.chains.items()}


def hit_places(selectors: list[str]) -> dict[str, tuple[str, int]]:
    """Field and bit that tell whether a selector matches a node. Field names go with the list of selectors, so bits of one
    list are never read as those of another."""
    name = f"h{zlib.crc32(chr(10).join(selectors).encode()):08x}"
    return {s: (f"{name}_{i // WORD_BITS}", i % WORD_BITS) for i, s in enumerate(selectors)}


def with_hits(pages: pa.ListArray, selectors: list[str], matcher: Matcher) -> pa.ListArray:
    """The nodes of pages with the bits of `hit_places`."""
    nodes = Nodes(pages)
    words: dict[str, np.ndarray] = {}
    found = matcher(nodes)
    for selector, (field, bit) in hit_places(selectors).items():
        word = words.setdefault(field, np.zeros(nodes.n, np.int64))
        word |= found[selector].astype(np.int64) << bit
    fields = nodes.fields | {f: pa.array(w) for f, w in words.items()}
    flat = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(nodes.offsets.astype(np.int32)), flat)
