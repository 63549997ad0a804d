"""Sections of HTML pages: headings, paragraphs, list items and tables, in document order.

The tokeniser of the standard library runs over Arrow batches, one page at a time; pages need no shuffle. All that
follows (titles, classes, rows, Markdown) is column expressions on the array of sections that a page yields.

A page that is null or empty has no sections. One that cannot be read has a null array and an error text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES

# Tags whose content is left out, and tags that open a section.
UNSEEN = {"script", "style", "noscript", "head"}
BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "paragraph", "div": "paragraph", "li": "list_item"}

SECTION = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
#: Tags that begin and end a line of the plain text.
LINE_STARTS, LINE_ENDS = {"p", "div", "tr", "table", "br"}, {"p", "div", "li", "tr", "table", "h1", "h2", "h3", "h4"}
#: Plain tags: an end tag, or a start tag with quoted attributes.
PLAIN = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)(?:[ \n]+[a-zA-Z][a-zA-Z-]*="[^"<>&]*")*)>')
#: Elements in which the tokeniser may read tags as text.
RAW = {"script", "style", "title", "noscript", "textarea", "iframe", "xmp", "noembed", "noframes", "plaintext", "svg", "math"}
SCHEMA = "sections array<struct<pos: int, kind: string, tag: string, text: string, rows: array<array<string>>>>, error string"


def _tidy(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts).replace("​", "")).strip()


class _Sections(HTMLParser):
    """Collects sections. The block opened first holds the text until the first end tag of its name; an inner table is
    a section of its own before the outer one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.text: list[str] = []
        self.unseen = 0
        self.block: tuple[str, list[str]] | None = None
        self.tables: list[list[list[list[str]]]] = []  # open tables, of rows, of cells, of texts
        self.in_row: list[bool] = []
        self.in_cell: list[bool] = []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif not self.unseen:
            if tag in LINE_STARTS:
                self.text.append("\n")
            if tag in BLOCKS and self.block is None:
                self.block = (tag, [])
            if tag == "table":
                self.tables.append([]), self.in_row.append(False), self.in_cell.append(False)
            elif self.tables and tag == "tr":
                self.tables[-1].append([])
                self.in_row[-1], self.in_cell[-1] = True, False
            elif self.tables and tag in ("td", "th") and self.in_row[-1]:
                self.tables[-1][-1].append([])
                self.in_cell[-1] = True

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif not self.unseen:
            if self.tables and tag in ("td", "th"):
                self.in_cell[-1] = False
            elif self.tables and tag == "tr":
                self.in_row[-1] = self.in_cell[-1] = False
            elif self.tables and tag == "table":
                rows = [[_tidy(cell) for cell in row] for row in self.tables.pop()]
                self.in_row.pop(), self.in_cell.pop()
                if rows := [row for row in rows if any(row)]:
                    self._add("table", "table", None, rows)
            if self.block and self.block[0] == tag:
                text = _tidy(self.block[1])
                self.block = None
                if text and not (self.found and self.found[-1]["text"] == text):
                    self._add(BLOCKS[tag], tag, text, None)
            if tag in LINE_ENDS:
                self.text.append("\n")

    def handle_data(self, data):
        if not self.unseen:
            self.text.append(data)
            if self.block:
                self.block[1].append(data)
            if self.tables and self.in_cell[-1]:
                self.tables[-1][-1][-1].append(data)

    def _add(self, kind, tag, text, rows):
        self.found.append({"pos": len(self.found), "kind": kind, "tag": tag, "text": text, "rows": rows})


def _plain(page: str) -> list[str | None] | None:
    """Text, end tag, start tag, text and so on to the last text, for a page of plain tags alone; null for any other."""
    parts = PLAIN.split(page)
    if any("<" in x for x in parts[::3]) or "&" in parts[-1]:
        return None
    for k in range(2, len(parts), 3):
        if parts[k] and parts[k].lower() in RAW and (parts[k + 2 : k + 3] != [parts[k]] or "&" in parts[k + 1]):
            return None
    return parts


def _feed(reader: _Sections, page: str) -> None:
    """What the tokeniser would hand to `reader`; pages of plain tags, which need none of its care, are split at once."""
    parts = _plain(page)
    if parts is None:
        reader.feed(page)
        return
    for k in range(0, len(parts) - 1, 3):
        if text := parts[k]:
            reader.handle_data(unescape(text) if "&" in text else text)
        if end := parts[k + 1]:
            reader.handle_endtag(end.lower())
        else:
            reader.handle_starttag(parts[k + 2].lower(), [])
    if parts[-1]:
        reader.handle_data(parts[-1])


def _read(page: str | None) -> tuple[list[dict] | None, str | None, str | None]:
    reader = _Sections()
    try:
        _feed(reader, page or "")
    except (AssertionError, ValueError, NotImplementedError) as e:
        return None, str(e) or type(e).__name__, None
    return reader.found, None, "".join(reader.text)


#: What a plain tag does to text and tables: nothing, a new line, and so on; less than nothing for a tag that is not plain.
NOTHING, LINE, CELL, CELL_END, ROW, ROW_END, TABLE, TABLE_END, HIDE, SHOW, RAW_START, RAW_HIDE = range(12)
_STARTS = {"td": CELL, "th": CELL, "tr": ROW, "table": TABLE}
_ENDS = {"td": CELL_END, "th": CELL_END, "tr": ROW_END, "table": TABLE_END}


@lru_cache(4096)
def _effect(tag: str) -> int:
    """What a tag, given without its brackets, does."""
    found = PLAIN.fullmatch(f"<{tag}>")
    if not found:
        return -1
    if found[1]:
        name = found[1].lower()
        return SHOW if name in UNSEEN else _ENDS.get(name, LINE if name in LINE_ENDS else NOTHING)
    name = found[2].lower()
    if name in RAW:
        return RAW_HIDE if name in UNSEEN else RAW_START
    return HIDE if name in UNSEEN else _STARTS.get(name, LINE if name in LINE_STARTS else NOTHING)


#: Effects of what lies from one `<` to the next, where that is a tag without attributes and nothing behind it.
BARE = {f"{end}{name}>": _effect(f"{end}{name}") for name in sorted(LINE_STARTS | LINE_ENDS | {"td", "th", "tbody", "thead", "b", "i", "span", "ul", "ol", "a", "body", "html"}) for end in ("", "/")}


def _plain_text(page: str) -> tuple[str, int] | None:
    """The text of a page of plain tags alone and how many of its tables are closed and hold a word; null for any other page.
    What `_Sections` finds in what `_plain` splits, without its sections: a few steps for a tag."""
    pieces = page.split("<")
    marked = "&" in page
    if marked and "&" in (pieces[-1].partition(">")[2] if len(pieces) > 1 else page):
        return None
    rest = iter(pieces)
    text = next(rest)
    out, bare, unseen, n_tables = [unescape(text) if marked else text], BARE.get, 0, 0
    outer: list[tuple[bool, bool, bool]] = []  # of open tables but the innermost
    in_row = in_cell = filled = False  # of the innermost
    for piece in rest:
        effect = bare(piece)
        if effect is None:
            tag, closed, text = piece.partition(">")
            effect = _effect(tag) if len(tag) < 200 else _effect.__wrapped__(tag)
            if effect < 0 or not closed:
                return None
            if effect >= RAW_START:
                end = "/" + PLAIN.fullmatch(f"<{tag}>")[2] + ">"
                after = next(rest, "")
                if "&" in text or not after.startswith(end):
                    return None
                text = (text if effect == RAW_START else "") + after[len(end) :]
        else:
            text = ""
        if unseen:
            unseen += (effect == HIDE) - (effect == SHOW)
            if unseen:
                continue
        elif effect:
            if effect == CELL_END:
                in_cell = False
            elif effect == CELL:
                in_cell = in_row
            elif effect <= TABLE_END:
                out.append("\n")
                if effect == ROW:
                    in_row, in_cell = bool(outer), False
                elif effect == ROW_END:
                    in_row = in_cell = False
                elif effect == TABLE:
                    outer.append((in_row, in_cell, filled))
                    in_row = in_cell = filled = False
                elif effect == TABLE_END and outer:
                    n_tables += filled
                    in_row, in_cell, filled = outer.pop()
            elif effect == HIDE:
                unseen = 1
                continue
        if text:
            if marked and "&" in text:
                text = unescape(text)
            out.append(text)
            if in_cell and not filled and text.replace("​", "").strip():
                filled = True
    return "".join(out), n_tables


def _tidy_lines(text: str) -> str:
    """As `functions.text.filing_text` does."""
    text = text.replace("\xa0", " ")
    if "  " in text or "\t" in text or "\r" in text or "\f" in text or "\v" in text:
        text = re.sub(r"[ \t\r\f\v]+", " ", text)
    if " \n" in text or "\n " in text:
        text = "\n".join([line.strip(" ") for line in text.split("\n")])
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip(SPACES)


def _text(page: str | None) -> tuple[str, int]:
    """Text of a filing's page and the number of its tables; none of a page that cannot be read."""
    found = _plain_text(page or "")
    if found is None:
        sections, _, text = _read(page)
        found = (text or "", sum(x["kind"] == "table" for x in sections or ()))
    return _tidy_lines(found[0]), found[1]


def page_texts(pages: DataFrame, keys: list[str], terms: str, words: dict[str, list[str]], html_col: str = "html") -> DataFrame:
    """(keys, text, n_tables, n_terms, a flag for each of `words`), a row for each page: of `parse_pages` only the number of tables
    and the plain text, as `filing_text` tidies it; how often it holds one of `terms`, a pattern; and whether it holds one of
    some words. Both are in lower case and found in texts whose letters A to Z are lowered."""
    held = {name: "|".join(map(re.escape, some)) for name, some in words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some megabytes at a time: patterns are compiled for each.
            step = max(1, min(1000, 8_000_000 * batch.num_rows // max(1, batch.column(len(keys)).nbytes)))
            for at in range(0, batch.num_rows, step):
                few = batch.slice(at, step)
                texts, tables = zip(*map(_text, few.column(len(keys)).to_pylist()), strict=True)
                texts = pa.array(texts, pa.string())
                low = pc.ascii_lower(texts)
                counts = pc.count_substring_regex(low, pattern=terms).cast(pa.int32())
                flags = [pc.match_substring_regex(low, pattern=pattern) for pattern in held.values()]
                yield pa.record_batch([*few.columns[: len(keys)], texts, pa.array(tables, pa.int32()), counts, *flags], [*keys, "text", "n_tables", "n_terms", *held])

    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys)
    flags = "".join(f", `{name}` boolean" for name in held)
    return pages.select(*keys, F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"{kinds}text string, n_tables int, n_terms int{flags}")


def parse_pages(pages: DataFrame, key: str | list[str] = "page_id", html_col: str = "html", with_text: bool = False) -> DataFrame:
    """(key, sections, error), a row for each page; `with_text` adds its plain text, as it stands in the page."""
    keys = [key] if isinstance(key, str) else key
    names = [*keys, "sections", "error", *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                few = batch.slice(at, 100)
                sections, errors, texts = zip(*[_read(page.as_py()) for page in few.column(len(keys))], strict=True)
                columns = [*few.columns[: len(keys)], pa.array(sections, pa.list_(SECTION)), pa.array(errors, pa.string()), *([pa.array(texts, pa.string())] if with_text else [])]
                yield pa.record_batch(columns, names)

    rows = pages.select(*keys, F.col(html_col).cast("string").alias("h"))
    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{kinds}{SCHEMA}{', text string' if with_text else ''}")


def html_sections(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, tag, text, rows), a row for each section."""
    return parsed.select(key, F.inline("sections"))
