"""HTML extraction by layout-aware rendering.

A tree builder reads the markup, opens and closes elements by HTML's rules for
implied tags (a paragraph ends where a block begins, a list item where the next one
begins, table parts where their siblings begin, void elements at once; an end tag
without an open element is dropped), and hands a renderer each element's entry and
exit. The renderer emits all visible text: scripts, styles, heads, templates, closed
dialogs and elements hidden by attribute or inline style are left out (what is invisible by
visibility may hold what is visible again); white space is
collapsed except in preformatted text; blocks begin on new lines, and paragraphs and
the like are set apart by an empty line; list items carry bullets or numbers and are
indented by depth, up to ``DEEPEST_INDENT`` spaces; table cells are aligned in columns, with spans.

Style sheets and scripts are not evaluated. Nesting of any depth is handled without
recursion and without a limit: open elements are found by their names' own places.

Defined results: null or empty HTML gives an empty text; a null id is kept as it is;
repeated rows are each rendered; text without markup is rendered as one block; an
empty table gives an empty result; very long pages are rendered whole, one at a time;
other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import slices

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z/][^>]*+\Z""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_STYLE = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
NOT_SHOWN = frozenset("head title script style template iframe noembed noframes object canvas audio video datalist rp param".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption xmp listing".split())
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing".split())
ENDS_PARAGRAPH = (BLOCK - frozenset("body html option optgroup tbody tfoot thead tr caption".split())) | {"table"}
#: An element that begins ends these, as far up as the ones that bound the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()), "h1": ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article", "td", "th", "li", "table"}),
}
SIBLINGS |= {f"h{k}": SIBLINGS["h1"] for k in range(2, 7)}
_HEAD_PARTS = frozenset("base link meta title style script template noscript head html".split())


#: Spaces that a line is indented by at most, however deep its element lies.
DEEPEST_INDENT = 240


class Output:
    """Lines being written: collapsed white space, pending breaks, and the marks that begin the next line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent = 0
        self.mark = ""

    def text(self, data: str) -> None:
        if data[:1] in " \t\n\r\f":
            self.space = True
        words = _SPACES.sub(" ", data).strip(" ")
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(words)
        self.space = data[-1] in " \t\n\r\f"

    def kept(self, data: str) -> None:
        parts = data.replace("\r\n", "\n").split("\n")
        for i, part in enumerate(parts):
            if i:
                self.new_line(True)
            if part:
                self.line.append(part)

    def new_line(self, always: bool = False) -> None:
        if self.line or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((" " * min(self.indent, DEEPEST_INDENT) + self.mark + "".join(self.line)).rstrip())
            self.mark = " " * len(self.mark)
        self.line, self.space = [], False

    def apart(self) -> None:
        self.new_line()
        self.gap = True

    def result(self) -> list[str]:
        self.new_line()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        self.spans: dict[int, int] = {}
        self.column = 0

    def row(self) -> None:
        self.spans = {c: n - 1 for c, n in self.spans.items() if n > 1}
        self.rows.append({})
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.spans:
            self.column += 1
        self.rows[-1][self.column] = (lines, across)
        if down > 1:
            for c in range(self.column, self.column + across):
                self.spans[c] = down
        self.column += across

    def layout(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, (lines, across) in row.items():
                if across == 1:
                    widths[c] = max(widths.get(c, 0), max(map(len, lines), default=0))
        columns = sorted({c for row in self.rows for c in row})
        at, x = {}, 0
        for c in range(columns[-1] + 1 if columns else 0):
            at[c] = x
            x += widths[c] + 2 if widths.get(c) else 0
        out = []
        for row in self.rows:
            parts: list[list[str]] = [[] for _ in range(max((len(lines) for lines, _ in row.values()), default=0))]
            used = [0] * len(parts)
            for c in sorted(row):
                for k, text in enumerate(row[c][0]):
                    if text:
                        blank = max(at[c] - used[k], 2 if used[k] else 0)
                        parts[k] += (" " * blank, text)
                        used[k] += blank + len(text)
            out += ("".join(p).rstrip() for p in parts)
        return out


class Renderer:
    """Turns entries, exits and text of elements into lines."""

    def __init__(self):
        self.out = Output()
        self.outer: list[tuple[Output, Table]] = []
        self.tables: list[Table] = []
        self.cells: list[tuple[Output, int, int]] = []
        self.lists: list[list] = []
        self.kept = 0
        self.hidden = 0
        self.unseen = False
        self.began = False

    def enter(self, name: str, attributes: dict[str, str]) -> dict:
        """Begin an element; returns what its exit needs."""
        state: dict = {"name": name}
        self.began = False
        style = {k.lower(): v.lower() for k, v in _STYLE.findall(attributes["style"])} if "style" in attributes else {}
        if self.hidden or name in NOT_SHOWN or "hidden" in attributes or style.get("display") == "none" or name == "dialog" and "open" not in attributes:
            state["hidden"] = True
            self.hidden += 1
            return state
        if (seen := style.get("visibility")) in ("visible", "hidden", "collapse"):  # inherited, and what lies inside may turn it back
            state["unseen"], self.unseen = self.unseen, seen != "visible"
        out = self.out
        if name in APART and not (name in ("ul", "ol", "menu") and self.lists):
            out.apart()
        elif name in BLOCK:
            out.new_line()
        if name in ("ul", "ol", "menu", "dir"):
            start = attributes.get("start", "1")
            self.lists.append([name, int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])
        elif name == "li":
            value = attributes.get("value", "")
            numbered = bool(self.lists) and self.lists[-1][0] == "ol"
            if numbered and value.lstrip("-").isdigit() and len(value) < 10:
                self.lists[-1][1] = int(value)
            state["indent"], state["mark"] = out.indent, out.mark
            out.indent += len(out.mark)
            out.mark = f"{self.lists[-1][1]}. " if numbered else "- "
            if numbered:
                self.lists[-1][1] += 1
        elif name in ("dd", "blockquote"):
            state["indent"], state["mark"] = out.indent, out.mark
            out.indent += len(out.mark) + 2
            out.mark = ""
        elif name in ("pre", "textarea", "xmp", "listing"):
            self.kept += 1
            self.began = True  # a line break that follows at once is dropped
        elif name == "table":
            self.tables.append(Table())
            state["lists"], self.lists = self.lists, []
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name in ("td", "th") and self.tables:
            span = lambda k, most: max(1, min(most, int(v[:9]))) if (v := attributes.get(k, "1").strip()).isascii() and v.isdigit() else 1
            self.cells.append((self.out, span("colspan", 1000), span("rowspan", 65534)))  # HTML's own limits
            self.out = Output()
        elif name == "br":
            if not self.unseen:
                out.new_line(True)
        elif name == "hr":
            if not self.unseen:
                out.line.append("---")
            out.apart()
        return state

    def leave(self, state: dict) -> None:
        name = state["name"]
        if "hidden" in state:
            self.hidden -= 1
            return
        self.unseen = state.get("unseen", self.unseen)
        if name in ("td", "th") and self.cells:
            lines = self.out.result()
            self.out, across, down = self.cells.pop()
            if self.tables:
                self.tables[-1].cell(lines, across, down)
            return
        out = self.out
        if name in APART and not (name in ("ul", "ol", "menu") and len(self.lists) > 1):
            out.apart()
        elif name in BLOCK:
            out.new_line()
        if name in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif "indent" in state:
            out.indent, out.mark = state["indent"], " " * len(state["mark"])
        elif name in ("pre", "textarea", "xmp", "listing"):
            self.kept -= 1
        elif name == "table" and self.tables:
            lines = self.tables.pop().layout()
            self.lists = state["lists"]
            for line in lines:
                out.line.append(line)
                out.new_line(True)
            out.gap = True

    def text(self, data: str) -> None:
        if not self.hidden and not self.unseen:
            if self.kept:
                if self.began:
                    data = data.removeprefix("\r").removeprefix("\n")
                self.out.kept(data)
            else:
                self.out.text(data)
        self.began = False


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


class TreeBuilder:
    """Opens and closes elements by the rules for implied tags.

    Open elements have rising numbers; ``places`` has those of each name, so that a
    search costs by the names it asks for and not by the depth.
    """

    def __init__(self, renderer: Renderer):
        self.renderer = renderer
        self.open: list[dict | None] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, attributes: dict[str, str]) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(self.renderer.enter(name, attributes))

    def pop(self) -> None:
        state = self.open.pop()
        if state is not None:
            self.places[state["name"]].pop()
            if state["name"] in BLOCK:
                self.blocks.pop()
            self.renderer.leave(state)

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name; -1 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else -1

    def close(self, names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """End every open element down to the outermost of ``names`` that is above any of ``bounds``."""
        bound = max((self.last(n) for n in bounds - names), default=-1)
        found = [p[bisect_right(p, bound)] for n in names if (p := self.places.get(n)) and p[-1] > bound]
        if found:
            while len(self.open) > min(found):
                self.pop()

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if self.places.get("head") and name not in _HEAD_PARTS:
            self.close({"head"}, frozenset())
        if name in SIBLINGS:
            self.close(*SIBLINGS[name])
        if name in ENDS_PARAGRAPH and self.places.get("p"):
            self.close({"p"}, {"td", "th", "table", "button", "caption"})
        if name in VOID:
            self.renderer.leave(self.renderer.enter(name, attributes))
            return
        self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name == "p" and not self.places.get("p"):
            self.start("p", {})
            self.pop()
        elif self.places.get(name):
            bounds = frozenset() if name in ("table", "body", "html") else {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"td", "th", "caption", "table"}
            place = self.last(name)
            if any(self.last(n) > place for n in bounds):
                return
            if name not in BLOCK and "hidden" not in self.open[place] and self.blocks and self.blocks[-1] > place:
                # An inline element that ends inside a block it began before: the block goes on.
                self.places[name].pop()
                self.renderer.leave(self.open[place])
                self.open[place] = None
                return
            while len(self.open) > place:
                self.pop()

    def text(self, data: str) -> None:
        if self.places.get("head") and data.strip(" \t\n\r\f"):
            while self.open[-1] is None:
                self.open.pop()
            if self.open[-1]["name"] == "head":  # text directly in a head ends it
                self.pop()
        self.renderer.text(data)

    def finish(self) -> None:
        while self.open:
            self.pop()


def render(page: str | None) -> str:
    """The visible text of a page, laid out in lines."""
    if not page:
        return ""
    renderer = Renderer()
    builder = TreeBuilder(renderer)
    at, size = 0, len(page)
    lower = None
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            data = page[at:stop]
            builder.text(html.unescape(data) if "&" in data else data)
        if not m:
            break
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            builder.end(name)
            continue
        rest = m["rest"] or m["rest2"] or ""
        builder.start(name, _attributes(rest) if rest.strip(" /\n\t\r\f") else {})
        if name in RAW or name in ("title", "textarea"):
            if lower is None:
                lower = page.lower() if len(page.lower()) == size else "".join(c.lower() if c.isascii() else c for c in page)
            close = lower.find(f"</{name}", at)
            close = size if close < 0 else close
            if name in ("textarea", "xmp"):
                renderer.text(html.unescape(page[at:close]) if name == "textarea" else page[at:close])
            at = close
    builder.finish()
    lines = renderer.out.result()
    return "\n".join(lines).strip("\n")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id, the rendered ``text``, and its ``n_chars`` and ``n_lines``."""
    kept = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [render(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array((t.count("\n") + 1 if t else 0 for t in texts), pa.int64())], names=["id", "text", "n_chars", "n_lines"])

    shape = f"id {kept.schema['id'].dataType.simpleString()}, text string, n_chars long, n_lines long"
    return kept.mapInArrow(run, shape).withColumnRenamed("id", id_col)
