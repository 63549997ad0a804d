"""The main part of a release's page: text and tables in document order.

A page becomes a small tree, one at a time within Arrow batches. Noise goes, the publisher's container is chosen, and what
it holds is given as blocks: text, one line for each run of characters, up to the next table; tables as rows of cells.
Titles, classes, numbering and Markdown are column expressions over the blocks, in `content`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.patterns import CONTAINERS, PAGE_NOISE

BLOCK = pa.struct([("kind", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
BLOCKS = "array<struct<kind: string, text: string, rows: array<array<string>>>>"
#: Columns that a cell may span at most, as browsers have it.
WIDEST = 1000
#: A container with fewer characters is passed over.
LEAST = 500
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element of the value ends where one of the key starts, unless one of the third kind stands between.
_ENDS = {"p": ({"p"}, {"td", "table"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}


class _Node:
    __slots__ = ("tag", "classes", "hidden", "spans", "inside")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):
        own = dict(attrs)
        self.tag, self.classes, self.hidden = tag, set((own.get("class") or "").split()), own.get("aria-hidden") == "true"
        self.spans = own.get("rowspan"), own.get("colspan")
        self.inside: list[_Node | str] = []

    def walk(self, enter: Callable[["_Node"], bool] = lambda x: True) -> Iterator["_Node | str"]:
        """All that is inside, in order; what `enter` refuses is given, but not entered."""
        open_ = [iter(self.inside)]
        while open_:
            x = next(open_[-1], None)
            if x is None:
                open_.pop()
                continue
            yield x
            if isinstance(x, _Node) and enter(x):
                open_.append(iter(x.inside))


class _Tree(HTMLParser):
    """Elements by name are counted, so that a tag which can end nothing costs nothing, however deep the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def _end(self, k: int) -> None:
        for x in self.open[k:]:
            self.count[x.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        ended, barrier = _ENDS.get(tag, ({"p"}, {"td", "table"}) if tag in _CLOSES_P else (set(), set()))
        if any(self.count[t] for t in ended):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in barrier:
                    break
                if self.open[k].tag in ended:
                    self._end(k)
        node = _Node(tag, attrs)
        self.open[-1].inside.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._end(k)
                return
            if self.open[k].tag == "table":
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _clear(node: _Node) -> None:
    todo = [node]
    while todo:
        x = todo.pop()
        x.inside = [y for y in x.inside if isinstance(y, str) or not (y.tag in PAGE_NOISE or y.hidden)]
        todo += [y for y in x.inside if isinstance(y, _Node)]


def _span(text: str | None, most: int) -> int:
    return min(max(int(text), 1), most) if text and text.strip().isdigit() else 1


def _grid(table: _Node) -> list[list[str]]:
    """A table's own cells by row and column. A cell that spans rows or columns stands in each place it covers; a place that
    no cell covers is empty; rows and columns without any text go. Cells of inner tables belong to those."""
    trs = [x for x in table.walk(lambda x: x.tag != "table") if isinstance(x, _Node) and x.tag == "tr"]
    taken: dict[int, tuple[int, str]] = {}  # by column: rows that a cell above still covers, and its text
    rows: list[dict[int, str]] = []
    for left, tr in zip(range(len(trs), 0, -1), trs, strict=True):
        row: dict[int, str] = {}
        covered, taken, column = taken, {}, 0
        for x in tr.walk(lambda x: x.tag not in ("td", "th", "table")):
            if isinstance(x, _Node) and x.tag in ("td", "th"):
                while column in covered:
                    column += 1
                text = _squeeze(" ".join(t for t in x.walk() if isinstance(t, str)))
                deep, wide = _span(x.spans[0], left), _span(x.spans[1], WIDEST)
                for _ in range(wide):
                    if column not in covered:  # where spans meet, the one from above stays
                        row[column] = text
                        if deep > 1:
                            taken[column] = deep - 1, text
                    column += 1
        for c, (more, text) in covered.items():
            row[c] = text
            if more > 1:
                taken[c] = more - 1, text
        rows.append(row)
    used = sorted({c for r in rows for c, t in r.items() if t})
    return [[r.get(c, "") for c in used] for r in rows if any(r.values())]


def table_grids(table: _Node) -> list[list[list[str]]]:
    """Grids of a table and those inside it, in order. A table gives way to the largest, by places, of those inside it, which
    then stands there: pages lay out their contents by tables. None comes twice."""
    every = [table, *[x for x in table.walk() if isinstance(x, _Node) and x.tag == "table"]]
    grids = [_grid(t) for t in every]
    size = [len(g) * len(g[0]) if g else 0 for g in grids]
    inside = [sum(isinstance(x, _Node) and x.tag == "table" for x in t.walk()) for t in every]
    chosen = [max(range(k, k + n + 1), key=lambda m: size[m]) for k, n in enumerate(inside)]
    return [grids[k] for k in dict.fromkeys(chosen)]


def release_blocks(page: str, url: str) -> list[dict]:
    """Blocks of one page."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    _clear(tree.root)
    domain = re.sub(r"^[a-z]+://", "", url.lower()).split("/")[0]
    elements = [x for x in tree.root.walk() if isinstance(x, _Node)]
    chosen = None
    for selector in next(v for k, v in CONTAINERS.items() if k in domain):
        tag, _, name = selector.partition(".")
        found = next((x for x in elements if x.tag == tag and (not name or name in x.classes)), None)
        if found and len(" ".join(t for x in found.walk() if isinstance(x, str) and (t := x.strip()))) > LEAST:
            chosen = found
            break
    chosen = chosen or next((x for x in elements if x.tag == "body"), tree.root)
    blocks: list[dict] = []
    lines: list[str] = []

    def flush() -> None:
        if lines:
            blocks.append({"kind": "text", "text": "\n".join(lines), "rows": None})
            lines.clear()

    for x in chosen.walk(lambda x: x.tag != "table"):
        if isinstance(x, str):
            if line := _squeeze(x):
                lines.append(line)
        elif x.tag == "table":
            flush()
            blocks += [{"kind": "table", "text": None, "rows": g} for g in table_grids(x)]
    flush()
    return blocks


def with_blocks(pages: DataFrame, keys: list[str], html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(keys, blocks, page_error) for every page: blocks are null where it is null or cannot be read. Of the page only keys,
    address and HTML go to Python, and not the HTML comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                few = batch.slice(at, 100)
                blocks, errors = [], []
                for page, url in zip(few.column(len(keys)), few.column(len(keys) + 1), strict=True):
                    try:
                        blocks.append(release_blocks(page.as_py(), url.as_py() or "") if page.is_valid else None)
                        errors.append(None)
                    except (AssertionError, ValueError, NotImplementedError) as e:
                        blocks.append(None)
                        errors.append(str(e) or type(e).__name__)
                yield pa.record_batch([*few.columns[: len(keys)], pa.array(blocks, pa.list_(BLOCK)), pa.array(errors, pa.string())], [*keys, "blocks", "page_error"])

    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html_col, url_col).mapInArrow(run, f"{kept}, blocks {BLOCKS}, page_error string")
