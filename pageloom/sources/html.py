"""H1: HTML pages to interval-encoded nodes.

One Arrow kernel turns the html column into two arrays per page. Everything
after it is column work on those arrays or on the rows they explode into.

`nodes[i]` is element number i in document order; `end_id` is the number of
its last descendant, so containment is `BETWEEN node_id AND end_id`. `texts[k]`
is text node k and belongs to element `owners[k]`; the text of an element is
`texts[text_from .. text_to)`.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import ship_by_value
from ..operators.selectors import Matcher, hit_places, needs_scope, with_hits

ship_by_value(__name__)

# Fixed values of HTML.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW_TEXT = frozenset("title textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li "
    "listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# Elements that formatting does not reach into from outside.
WALLS = frozenset("td th caption applet marquee object template".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
# Start tags before which open formatting is not taken up again.
PLAIN_START = CLOSES_P | HEAD_ONLY | frozenset(
    "html head body frame frameset caption col colgroup tbody td tfoot th thead tr param source track textarea iframe noembed".split()
)
SPECIAL = CLOSES_P - frozenset({"dialog"}) | HEAD_ONLY | VOID | frozenset(
    "applet body button caption colgroup frameset head html iframe marquee noembed object select tbody td textarea tfoot th thead tr".split()
)
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object select template svg math".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset("html table template".split())
# Parts of a table that hold other parts only, and what each is put into when that is not open.
TABLE_FRAME = frozenset("table tbody tfoot thead tr colgroup".split())
FOSTERING = TABLE_FRAME - {"colgroup"}
ROW_GROUPS = frozenset("tbody tfoot thead".split())
CELLS = frozenset("td th".split())
TABLE_PARTS = ROW_GROUPS | CELLS | frozenset("caption col colgroup tr".split())
HOLDER = {"caption": {"table"}, "colgroup": {"table"}, "col": {"colgroup"}, "tr": ROW_GROUPS, "td": {"tr"}, "th": {"tr"}} | dict.fromkeys(ROW_GROUPS, {"table"})
IMPLIED_HOLDER = {"col": "colgroup", "tr": "tbody", "td": "tr", "th": "tr"}
MAX_ALIKE = 3  # equal formatting elements that are taken up again
MAX_ADOPTIONS, MAX_CLONES = 8, 3  # limits of the adoption agency algorithm
PARSED_TOGETHER = 64  # pages whose elements a worker holds as Python objects at a time
MAX_DEPTH = 512  # deeper elements become siblings at the limit, as in browsers

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WHITE = " \t\n\r\f"

NODE_FIELDS = [
    ("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("prev_id", pa.int32()),
    ("depth", pa.int32()), ("sib_pos", pa.int32()), ("sib_last", pa.bool_()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("path", pa.list_(pa.int32())),
    ("text_from", pa.int32()), ("text_to", pa.int32()),
]
NODE_TYPE = (
    "struct<node_id:int,end_id:int,parent_id:int,prev_id:int,depth:int,sib_pos:int,sib_last:boolean,tag:string,"
    "attrs:map<string,string>,classes:array<string>,path:array<int>,text_from:int,text_to:int>"
)
ARROW_NODE = pa.struct(NODE_FIELDS)


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        value = double or single or bare
        found.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return found


class Element:
    """An element while the tree is being built; kids are elements and strings."""

    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, None, []

    def put(self, kid: Element | str, before: Element | None = None) -> None:
        if not isinstance(kid, str):
            if kid.parent is not None:
                kid.parent.kids.remove(kid)
            kid.parent = self
        if before is None:
            self.kids.append(kid)
        else:
            at = len(self.kids) - 1
            while self.kids[at] is not before:
                at -= 1
            self.kids.insert(at, kid)


def within(items: list, wanted: Element) -> int:
    """Where an element itself, not one like it, stands in a list, from the end; -1 if nowhere."""
    for i in range(len(items) - 1, -1, -1):
        if items[i] is wanted:
            return i
    return -1


class Builder:
    """The open elements and active formatting of one page, and the tree built so far."""

    def __init__(self):
        self.root: Element | None = None
        self.head: Element | None = None
        self.body: Element | None = None
        self.stack: list[Element] = []
        self.active: list[Element | None] = []  # formatting elements; None is a wall
        self.tables = 0  # open tables
        self.foster = False  # does content of a table's frame go before the table?

    # ---- the stack of open elements --------------------------------------
    def close_to(self, level: int) -> None:
        while len(self.stack) > level:
            tag = self.stack.pop().tag
            if tag == "table":
                self.tables -= 1
            if tag in WALLS and None in self.active:
                while self.active.pop() is not None:
                    pass

    def find(self, wanted, stops) -> int:
        """Level of the innermost open element of these tags, unless an element of `stops` comes first."""
        for level in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[level].tag
            if tag in wanted:
                return level
            if tag in stops:
                return -1
        return -1

    def imply_ends(self, but: str = "") -> None:
        while self.stack and self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != but:
            self.close_to(len(self.stack) - 1)

    def table_mode(self) -> str | None:
        """The innermost open part of a table's frame, unless a cell or caption is open in it."""
        if not self.tables:
            return None
        for node in reversed(self.stack):
            if node.tag in TABLE_FRAME:
                return node.tag
            if node.tag in WALLS:
                return None
        return None

    # ---- putting things into the tree ------------------------------------
    def place(self, kid: Element | str, target: Element | None = None) -> None:
        target = self.stack[-1] if target is None else target
        if self.foster and target.tag in FOSTERING:
            level = self.find(("table",), ())
            table = self.stack[level]
            if table.parent is not None:
                table.parent.put(kid, before=table)
                return
            target = self.stack[level - 1]
        target.put(kid)

    def open(self, tag: str, attrs: dict[str, str]) -> Element:
        if len(self.stack) >= MAX_DEPTH:
            self.close_to(MAX_DEPTH - 1)
        node = Element(tag, attrs)
        if self.stack:
            self.place(node)
        else:
            self.root = node
        self.stack.append(node)
        if tag == "table":
            self.tables += 1
        elif tag == "head":
            self.head = self.head or node
        elif tag == "body":
            self.body = self.body or node
        if tag in WALLS:
            self.active.append(None)
        return node

    def imply(self, tag: str | None) -> None:
        """Opens html, head and body where a start tag (None: text) needs them."""
        if tag == "html":
            return
        if not self.stack:
            self.open("html", {})
        if self.body is not None or tag in ("head", "frameset"):
            return
        if tag in HEAD_ONLY:
            if self.head is None:
                self.open("head", {})
            return
        if self.head is None:
            self.open("head", {})
        if self.stack[-1].tag in ("head", "html") or tag == "body":
            self.close_to(1)
            if tag != "body":
                self.open("body", {})

    def text(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        blank = not raw.strip(WHITE)
        if decode and not (self.stack and self.stack[-1].tag in ESCAPABLE_RAW_TEXT):
            if self.body is None and blank:
                if len(self.stack) < 2:
                    return  # white space before head and body is nobody's
            else:
                self.imply(None)
                mode = self.table_mode()
                if mode == "colgroup" and not blank:
                    self.close_to(self.find(("colgroup",), ()))
                framed = self.stack[-1].tag in TABLE_FRAME
                self.foster = mode is not None and not (blank and framed)
                if self.foster or not framed:
                    self.take_up()
        self.place(_html.unescape(raw) if decode and "&" in raw else raw)
        self.foster = False

    # ---- formatting ------------------------------------------------------
    def take_up(self) -> None:
        """Opens formatting again that is active but no longer open."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and within(self.stack, self.active[at - 1]) < 0:
            at -= 1
        for i in range(at, len(self.active)):
            self.active[i] = self.open(self.active[i].tag, self.active[i].attrs)

    def start_formatting(self, tag: str, attrs: dict[str, str]) -> None:
        alike = []
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                break
            if self.active[i].tag == tag and self.active[i].attrs == attrs:
                alike.append(i)
        if len(alike) >= MAX_ALIKE:
            del self.active[alike[-1]]
        self.active.append(self.open(tag, attrs))

    def last_active(self, tag: str) -> int:
        for i in range(len(self.active) - 1, -1, -1):
            if self.active[i] is None:
                return -1
            if self.active[i].tag == tag:
                return i
        return -1

    def end_formatting(self, tag: str) -> None:
        """The adoption agency: a block that an end tag of formatting cuts through keeps the formatting inside, for what it
        has so far, and goes out of the formatting itself."""
        stack, active = self.stack, self.active
        if stack and stack[-1].tag == tag and within(active, stack[-1]) < 0:
            self.close_to(len(stack) - 1)
            return
        for _ in range(MAX_ADOPTIONS):
            at = self.last_active(tag)
            if at < 0:
                self.end_other(tag)
                return
            subject = active[at]
            level = within(stack, subject)
            if level < 0:
                del active[at]
                return
            if any(n.tag in SCOPE for n in stack[level + 1:]):
                return
            cut = next((k for k in range(level + 1, len(stack)) if stack[k].tag in SPECIAL), -1)
            if cut < 0:
                self.close_to(level)
                del active[at]
                return
            block = inner = stack[cut]
            mark, clones, k = at, 0, cut
            while True:
                k -= 1
                node = stack[k]
                if node is subject:
                    break
                clones += 1
                own = within(active, node)
                if clones > MAX_CLONES and own >= 0:
                    del active[own]
                    mark -= own < mark
                    own = -1
                if own < 0:
                    del stack[k]
                    continue
                copy = Element(node.tag, node.attrs)
                active[own] = stack[k] = copy
                if inner is block:
                    mark = own + 1
                copy.put(inner)
                inner = copy
            if inner.parent is not None:
                inner.parent.kids.remove(inner)
                inner.parent = None
            foster, self.foster = self.foster, True
            self.place(inner, stack[level - 1])
            self.foster = foster
            copy = Element(tag, subject.attrs)
            for kid in block.kids:
                if not isinstance(kid, str):
                    kid.parent = copy
            copy.kids, block.kids = block.kids, []
            block.put(copy)
            at = within(active, subject)
            del active[at]
            active.insert(mark - (at < mark), copy)
            del stack[level]
            stack.insert(within(stack, block) + 1, copy)

    # ---- tags ------------------------------------------------------------
    def end_other(self, tag: str) -> None:
        for level in range(len(self.stack) - 1, -1, -1):
            if self.stack[level].tag == tag:
                self.close_to(level)
                return
            if self.stack[level].tag in SPECIAL:
                return

    def close_p(self) -> None:
        level = self.find(("p",), BUTTON_SCOPE)
        if level >= 0:
            self.close_to(level)

    def close_item(self, alike) -> None:
        """An li, dt or dd ends the open one, unless it stands in a block of its own."""
        for level in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[level].tag
            if tag in alike:
                self.close_to(level)
                return
            if tag in SPECIAL and tag not in ("address", "div", "p"):
                return

    def table_start(self, tag: str) -> bool:
        """Makes way for a part of a table; False where there is no table for it."""
        if self.find(("table",), ("template",)) < 0:
            return False
        holder = HOLDER[tag]
        while True:
            level = self.find(holder, ("table",)) if "table" not in holder else self.find(holder, ())
            if level >= 0:
                self.close_to(level + 1)
                return True
            self.close_to(self.find(HOLDER[IMPLIED_HOLDER[tag]], ("table",)) + 1 or self.find(("table",), ()) + 1)
            if self.stack[-1].tag not in HOLDER[IMPLIED_HOLDER[tag]]:
                self.table_start(IMPLIED_HOLDER[tag])
            self.open(IMPLIED_HOLDER[tag], {})

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        """Opens an element; is it to be read on as raw text?"""
        if tag == "html" and self.stack or tag == "head" and self.head is not None or tag == "body" and self.body is not None:
            return False
        tag = "img" if tag == "image" else tag
        self.imply(tag)
        foreign = any(n.tag in ("svg", "math") for n in self.stack)
        if foreign or tag in ("svg", "math"):
            if not foreign:
                self.foster = self.table_mode() is not None
                self.take_up()
            self.open(tag, attrs)
            self.foster = False
            if closed or tag in VOID:
                self.close_to(len(self.stack) - 1)
            return tag in RAW_TEXT
        late = tag in HEAD_ONLY and self.body is None and self.head is not None and self.stack[-1] is self.root
        if late:
            self.stack.append(self.head)
        if tag in TABLE_PARTS:
            if not self.table_start(tag):
                return False
        else:
            mode = self.table_mode()
            if mode == "colgroup" and tag != "template":
                self.close_to(self.find(("colgroup",), ()))
            if mode is not None and tag == "table":
                self.close_to(self.find(("table",), ()))
            elif mode is not None:
                hidden = tag == "input" and attrs.get("type", "").lower() == "hidden"
                self.foster = not (hidden or tag in ("script", "style", "template"))
            self.make_way(tag)
            if tag not in PLAIN_START:
                self.take_up()
        if tag in FORMATTING:
            self.start_formatting(tag, attrs)
        else:
            self.open(tag, attrs)
        self.foster = False
        if tag in VOID:
            self.close_to(len(self.stack) - 1)
        if late:
            del self.stack[within(self.stack, self.head)]
        return tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT

    def make_way(self, tag: str) -> None:
        """Ends the elements that cannot hold the one to come."""
        if tag == "li":
            self.close_item(("li",))
        elif tag in ("dt", "dd"):
            self.close_item(("dt", "dd"))
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS:
            if self.stack[-1].tag in HEADINGS:
                self.close_to(len(self.stack) - 1)
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.close_to(len(self.stack) - 1)
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.close_to(len(self.stack) - 1)
        elif tag == "button":
            level = self.find(("button",), SCOPE)
            if level >= 0:
                self.close_to(level)
        elif tag in ("rb", "rtc", "rp", "rt") and self.find(("ruby",), SCOPE) >= 0:
            self.imply_ends("rtc" if tag in ("rp", "rt") else "")
        elif tag == "a":
            at = self.last_active("a")
            if at >= 0:
                old = self.active[at]
                self.end_formatting("a")
                for items in (self.active, self.stack):
                    if within(items, old) >= 0:
                        del items[within(items, old)]
        elif tag == "nobr":
            self.take_up()
            if self.find(("nobr",), SCOPE) >= 0:
                self.end_formatting("nobr")

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return  # what follows still belongs to body
        if tag == "br":
            self.start("br", {}, False)
        elif tag in FORMATTING:
            self.foster = self.table_mode() is not None
            self.end_formatting(tag)
            self.foster = False
        elif tag in TABLE_PARTS or tag == "table":
            level = self.find((tag,), TABLE_SCOPE)
            if level >= 0 and not (tag == "col"):
                self.close_to(level)
        elif tag == "p":
            if self.find(("p",), BUTTON_SCOPE) < 0:
                self.start("p", {}, False)
            self.close_p()
        elif tag in HEADINGS:
            level = self.find(HEADINGS, SCOPE)
            if level >= 0:
                self.close_to(level)
        elif tag in CLOSES_P or tag in WALLS or tag in ("button", "select"):
            level = self.find((tag,), LIST_SCOPE if tag == "li" else SCOPE - {tag})
            if level >= 0:
                self.close_to(level)
        elif tag not in VOID:
            self.end_other(tag)


def read_tags(source: str) -> Element | None:
    """The tree of one page."""
    page = Builder()
    pos, size = 0, len(source)
    while pos < size:
        m = TOKEN.search(source, pos)
        if m is None:
            page.text(source[pos:])
            break
        if m.start() > pos:
            page.text(source[pos:m.start()])
        pos = m.end()
        end_tag, start_tag, attr_source = m.group(1), m.group(2), m.group(3)
        if start_tag:
            tag = start_tag.lower()
            attrs = _attributes(attr_source) if attr_source and attr_source.strip(" /\n\t\r") else {}
            if page.start(tag, attrs, attr_source.endswith("/")):
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, pos)
                until = stop.start() if stop else size
                page.text(source[pos + (tag == "textarea" and source[pos:pos + 1] == "\n"):until], tag in ESCAPABLE_RAW_TEXT)
                pos = until
                if page.stack[-1].tag == tag:
                    page.close_to(len(page.stack) - 1)
            elif tag in ("pre", "listing") and source[pos:pos + 1] == "\n":
                pos += 1  # the first line break in them is nobody's
        elif end_tag:
            page.end(end_tag.lower())
    return page.root


def parse_page(source: str) -> tuple[list[dict], list[str], list[int]]:
    """Nodes, texts and text owners of one page, as a browser's tree has them.

    html, head and body are there even if the page does not write them, and tbody and tr in tables. Formatting that its block
    cut off goes on in the next one (`<p><b>x<p>y` has two b elements), a block that an end tag of formatting cuts through
    leaves the formatting (`<b><p>x</b>y` has y outside b), and content that stands in a table but in no cell goes before it.
    """
    root = read_tags(source)
    nodes: list[dict] = []
    texts: list[str] = []
    owners: list[int] = []
    if root is None:
        return nodes, texts, owners
    path: list[int] = []
    # one entry per open element: its node, its kids still to come, its last child element
    todo: list[list] = [[None, iter([root]), None, 0]]
    while todo:
        top = todo[-1]
        parent, kids, previous, count = top
        for kid in kids:
            if isinstance(kid, str):
                texts.append(kid)
                owners.append(parent["node_id"])
                continue
            node_id = len(nodes)
            node = {
                "node_id": node_id, "end_id": node_id, "parent_id": parent["node_id"] if parent else -1,
                "prev_id": previous["node_id"] if previous else -1, "depth": len(path), "sib_pos": count + 1, "sib_last": False,
                "tag": kid.tag, "attrs": list(kid.attrs.items()), "classes": kid.attrs["class"].split() if "class" in kid.attrs else [],
                "path": path.copy(), "text_from": len(texts), "text_to": len(texts),
            }
            nodes.append(node)
            top[2], top[3] = node, count + 1
            path.append(node_id)
            todo.append([node, iter(kid.kids), None, 0])
            break
        else:
            todo.pop()
            if previous:
                previous["sib_last"] = True
            if parent:
                path.pop()
                parent["end_id"] = len(nodes) - 1
                parent["text_to"] = len(texts)
    return nodes, texts, owners


def _parse_batches(batches: Iterator[pa.RecordBatch], selectors: list[str]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(selectors)
    for batch in (whole.slice(at, PARSED_TOGETHER) for whole in batches for at in range(0, whole.num_rows, PARSED_TOGETHER)):
        where = batch.schema.get_field_index("html")
        parsed = [parse_page(h or "") for h in batch.column(where).to_pylist()]
        kept = [i for i in range(batch.num_columns) if i != where]
        columns = [batch.column(i) for i in kept]
        nodes = pa.array([p[0] for p in parsed], pa.list_(ARROW_NODE))
        columns.append(with_hits(nodes, selectors, matcher) if selectors else nodes)
        columns.append(pa.array([p[1] for p in parsed], pa.list_(pa.string())))
        columns.append(pa.array([p[2] for p in parsed], pa.list_(pa.int32())))
        names = [batch.schema.names[i] for i in kept] + ["nodes", "texts", "owners"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def parse_nodes(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """H1: replaces `html` by `nodes`, `texts`, `owners`. Narrow, no shuffle.

    With `selectors`, every node also carries a bit for each of them (`selectors.hit_places`).
    """
    asked = list(dict.fromkeys(s for s in selectors or [] if not needs_scope(s)))
    kept = [f for f in pages.schema.fields if f.name != "html"]
    words = "".join(f",{field}:bigint" for field in dict.fromkeys(f for f, _ in hit_places(asked).values()))
    extra = T._parse_datatype_string(f"nodes array<{NODE_TYPE.removesuffix('>')}{words}>>, texts array<string>, owners array<int>")
    return pages.mapInArrow(lambda batches: _parse_batches(batches, asked), T.StructType(kept + extra.fields))


def node_rows(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    return parsed.select("page_id", F.inline("nodes"))


def text_rows(parsed: DataFrame) -> DataFrame:
    """One row per text node."""
    pairs = F.arrays_zip("texts", "owners")
    return parsed.select("page_id", F.posexplode(pairs).alias("text_seq", "t")).select(
        "page_id", "text_seq", F.col("t.owners").alias("owner_node_id"), F.col("t.texts").alias("text")
    )


def raw_tokens(pages: DataFrame) -> DataFrame:
    """Tags and text runs without a tree, JVM side only."""
    found = F.regexp_extract_all("html", F.lit("<[^>]*>|[^<]+"), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("token_pos", "token"))
