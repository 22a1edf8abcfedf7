"""Sections and paragraphs of marked-up documents (HTML, or XML with nested sections), also where the mark-up is broken."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a section of character data, a declaration or instruction, or a tag; nothing is tried twice.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<attributes>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LINK = re.compile(r"(?:xlink:)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: A reference to a character; one without its semicolon is text, as of a title that was cut inside one.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
#: Elements that have no end tag, and those whose inside is no mark-up.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
#: HTML's white space; a no-break space is none. At its ends a text loses spaces of all kinds.
BLANKS_OF_HTML = r"[ \t\n\f\r]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")
_SECTION = "struct<number: int, title: string, paragraphs: array<string>>"
_RECORD = f"title string, year int, licence string, summary string, sections array<{_SECTION}>"


def _unescaped(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


@dataclass(frozen=True)
class Roles:
    """What elements stand for, by their names in lower case, and titles of sections that end the text or are the summary."""

    paragraphs: frozenset[str] = frozenset(("p",))
    items: frozenset[str] = frozenset(("li", "list-item"))
    lists: frozenset[str] = frozenset(("ul", "ol", "list"))
    sections: frozenset[str] = frozenset(("sec", "section"))
    titles: frozenset[str] = frozenset(("title",))
    headings: frozenset[str] = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
    skipped: frozenset[str] = frozenset("script style nav footer aside fig fig-group figure table table-wrap table-wrap-group".split())
    heads: frozenset[str] = frozenset("head front book-part-meta".split())
    breaks: frozenset[str] = frozenset(("br", "hr"))
    years: frozenset[str] = frozenset(("year",))
    licences: frozenset[str] = frozenset(("license",))
    last: tuple[str, ...] = field(default=("references",))
    summary: tuple[str, ...] = ()
    blanks: str = r"\s"  # a pattern of one character of white space, as BLANKS_OF_HTML
    named_by_text: bool = True  # whether a document whose head has no title has that of its text


class _Reader:
    """One document, read from its first mark to its last with the names of the elements that are open."""

    def __init__(self, roles: Roles):
        self.roles = roles
        self.open: list[str] = []
        self.skipping = self.depth = 0  # open elements that are skipped, and open sections
        self.block: list[str] | None = None  # text of the paragraph or item that is open
        self.level = 0  # open elements when it began
        self.caught: dict[str, list[str]] = {}  # texts of a title, a year or a licence that is open
        self.sections: list[tuple[str, list[str]]] = [("", [])]
        self.titles: dict[str, str] = {}  # the first title of the head, and of the text
        self.year, self.licence, self.done = None, "", False
        self.blanks = re.compile(f"(?:{roles.blanks})+")

    def said(self, texts: list[str]) -> str:
        return self.blanks.sub(" ", "".join(texts)).strip(_SPACES)

    def text(self, text: str) -> None:
        if self.skipping or not text:
            return
        for caught in self.caught.values():
            caught.append(text)
        if self.block is not None and "title" not in self.caught:
            self.block.append(text)

    def start(self, name: str, attributes: str) -> None:
        r = self.roles
        if name in r.breaks:
            self.text(" ")
        if name in VOID or attributes.endswith("/"):
            return
        self.implied_ends(name)
        self.open.append(name)
        if name in r.skipped:
            self.skipping += 1
        elif self.skipping:
            return
        elif name in r.licences and not self.licence:
            link = _LINK.search(attributes)
            self.licence = _unescaped(link[1] or link[2] or "") if link else ""
            self.caught["licence"] = []
        elif name in r.years and self.in_head():
            self.caught["year"] = []
        elif name in r.sections:
            self.close_block()
            self.depth += 1
            if self.depth == 1:
                self.sections.append(("", []))
        elif name in r.titles or name in r.headings:
            if name in r.headings:
                self.close_block()
            self.caught["title"] = []
        elif name in r.paragraphs or name in r.items:
            if self.block is None and not self.in_head():
                self.block, self.level = [], len(self.open)
            else:
                self.text(" ")

    def implied_ends(self, name: str) -> None:
        """A paragraph ends where another begins, and an item where the next one does, unless a list between them is open; a heading ends with either."""
        r = self.roles
        if name in r.paragraphs | r.items | r.headings | r.sections and "title" in self.caught:
            heads = [i for i, n in enumerate(self.open) if n in r.headings]
            if heads:
                self.close_to(heads[0])
        for kind in (r.paragraphs, r.items):
            if name in kind or kind is r.paragraphs and name in r.headings | r.sections:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i] in kind:
                        self.close_to(i)
                        break
                    if self.open[i] in r.lists | r.sections | r.skipped | (r.items if kind is r.paragraphs else frozenset()):
                        break

    def end(self, name: str) -> None:
        if name in self.open:
            self.close_to(len(self.open) - 1 - self.open[::-1].index(name))

    def close_to(self, place: int) -> None:
        while len(self.open) > place and not self.done:
            self.closed(self.open.pop())

    def closed(self, name: str) -> None:
        r = self.roles
        if name in r.skipped:
            self.skipping -= 1
            return
        if self.skipping:
            return
        if name in r.years and "year" in self.caught:
            year = "".join(self.caught.pop("year")).strip()
            self.year = max(self.year or 0, int(year)) if re.fullmatch(r"[0-9]{1,4}", year) else self.year
        elif name in r.licences and "licence" in self.caught:
            said = "".join(self.caught.pop("licence"))
            address = re.search(r"https?://creativecommons\.org/[\w./-]+", said)
            self.licence = self.licence or (address[0].rstrip(".") if address else "")
        elif (name in r.titles or name in r.headings) and "title" in self.caught:
            self.titled(self.said(self.caught.pop("title")), name)
        elif name in r.sections:
            self.close_block()
            self.depth = max(0, self.depth - 1)
            if not self.depth:
                self.sections.append(("", []))
        elif self.block is not None and len(self.open) < self.level:
            self.close_block()
        elif name in r.paragraphs or name in r.items:
            self.text(" ")

    def in_head(self) -> bool:
        return any(n in self.roles.heads for n in self.open)

    def titled(self, title: str, name: str) -> None:
        if self.in_head() or name in self.roles.titles and not self.depth:
            self.titles.setdefault("head", title)
            return
        self.titles.setdefault("text", title)
        if self.depth > 1:
            return  # the title of a section inside a section
        if title.lower() in self.roles.last:
            self.done = True
        elif name in self.roles.headings:
            self.sections.append((title, []))
        elif not self.sections[-1][1]:
            self.sections[-1] = title, []

    def close_block(self) -> None:
        if self.block is not None:
            if said := self.said(self.block):
                self.sections[-1][1].append(said)
            self.block = None

    def read(self, text: str) -> _Reader:
        at = 0
        while not self.done and (mark := _MARK.search(text, at)):
            self.text(_unescaped(text[at : mark.start()]))
            at = mark.end()
            if mark["data"] is not None:
                self.text(mark["data"])
            elif mark["name"]:
                name = mark["name"].lower()
                if mark["end"]:
                    self.end(name)
                else:
                    self.start(name, mark["attributes"])
                    if name in RAW and not mark["attributes"].endswith("/"):
                        close = re.compile(rf"</{name}\b", re.I).search(text, at)
                        at = close.start() if close else len(text)
        if not self.done:
            self.text(_unescaped(text[at:]))
            self.close_to(0)
            self.close_block()
        return self


#: Characters of mark-up that are read before what was read of them leaves Python's objects.
SLAB_CHARS = 4_000_000
_KIND = pa.struct([("title", pa.string()), ("year", pa.int32()), ("licence", pa.string()), ("summary", pa.string()), ("sections", pa.list_(pa.struct([("number", pa.int32()), ("title", pa.string()), ("paragraphs", pa.list_(pa.string()))])))])


def _records(roles: Roles):
    def of(texts: pa.Array) -> pa.Array:
        done, out, size = [], [], 0
        for text in texts:
            if size > SLAB_CHARS:
                done.append(pa.array(out, _KIND))
                out, size = [], 0
            if not text.is_valid:
                out.append(None)
                continue
            text = text.as_py()
            size += len(text)
            read = _Reader(roles).read(text)
            told = [(t, p) for t, p in read.sections if p]
            summary = " ".join(x for t, p in told if t.lower() in roles.summary for x in p)
            kept = [(t, p) for t, p in told if t.lower() not in roles.summary]
            sections = [{"number": i, "title": t, "paragraphs": p} for i, (t, p) in enumerate(kept, 1)]
            title = read.titles.get("head", read.titles.get("text", "") if roles.named_by_text else "")
            out.append({"title": title, "year": read.year, "licence": read.licence, "summary": summary, "sections": sections})
        return pa.concat_arrays([*done, pa.array(out, _KIND)])

    return of


def records(df: DataFrame, text: str = "html", roles: Roles = Roles(), out: str = "record") -> DataFrame:  # noqa: B008
    """Add struct(title, year, licence, summary, sections) read from mark-up; sections are (number from 1, title, paragraphs), those without paragraphs left out.

    Each paragraph, and each item of a list that stands on its own, is one; white space (`blanks`) is one blank. Figures, tables
    and what else is `skipped` are left out, the text after them is kept. Sections inside sections belong to the outer one. The
    text ends at a section whose title is one of `last`; sections of `summary` become the summary. The title is that of the head,
    else (if `named_by_text`) the first of the text; the year is the latest of the head. Text before any section has the title
    "". A null text gives a null record; an empty one no sections. Elements that are never closed end with what they stand in.
    """
    made = _records(roles)

    @F.arrow_udf(_RECORD)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield made(texts)

    return df.withColumn(out, read(text))


def paragraphs(df: DataFrame, keys: list[str], text: str = "html", roles: Roles = Roles()) -> DataFrame:  # noqa: B008
    """(keys, section, title, pos, paragraph): a row for each paragraph of records(), numbered from 1 within its section."""
    read = records(df.select(*keys, text), text, roles, "__record")
    sections = read.select(*keys, F.explode("__record.sections").alias("__s"))
    return sections.select(*keys, F.col("__s.number").alias("section"), F.col("__s.title").alias("title"), F.posexplode("__s.paragraphs").alias("pos", "paragraph")).withColumn("pos", F.col("pos") + 1)


def section_texts(df: DataFrame, keys: list[str], text: str = "html", roles: Roles = Roles()) -> DataFrame:  # noqa: B008
    """(keys, section, title, text): each section's paragraphs as lines, as passages() and library() take them."""
    read = records(df.select(*keys, text), text, roles, "__record")
    sections = read.select(*keys, F.explode("__record.sections").alias("__s"))
    return sections.select(*keys, F.col("__s.number").alias("section"), F.col("__s.title").alias("title"), F.array_join("__s.paragraphs", "\n").alias("text"))
