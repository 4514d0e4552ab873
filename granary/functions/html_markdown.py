"""HTML to Markdown in one pass: a stack of lists and quotes, and buffers for links, tables and code."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is dropped, and those that end a paragraph.
DROPPED = frozenset(("script", "style", "noscript", "form", "iframe", "object", "embed", "head", "template", "svg"))
VOID = frozenset(("embed", "br", "hr", "img", "input", "meta", "link", "area", "base", "col", "source", "track", "wbr"))
BLOCKS = frozenset("address article aside body dd details div dl dt fieldset figcaption figure footer header html main nav p section summary".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
_BREAK = "\x00"


class _Emitter(HTMLParser):
    """containers: lists (their counter, from 0) and quotes (None) that are open; each block is written behind their marks."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.blocks, self.parts = base, [], []
        self.containers: list[list] = []
        self.marker, self.heading, self.dropped = "", 0, []
        self.inline: list[tuple[str, int, str]] = []
        self.rows, self.pre = None, None

    def _text(self) -> str:
        words = " ".join("".join(self.parts).replace("\r", " ").split())
        self.parts, self.inline = [], []
        return "  \n".join(x.strip() for x in words.split(_BREAK)).strip()

    def _write(self, text: str, tight: bool = False) -> None:
        lines = []
        for n, line in enumerate(text.split("\n")):
            prefix = "".join("> " if c[0] == "quote" else "" if k == self._last_list() and not n and self.marker else "  " for k, c in enumerate(self.containers))
            lines.append((prefix + (self.marker if not n else "") + line).rstrip() if not line.endswith("  ") else prefix + (self.marker if not n else "") + line)
        self.blocks.append((tight, "\n".join(lines)))
        self.marker = ""

    def _last_list(self) -> int:
        return max((k for k, c in enumerate(self.containers) if c[0] != "quote"), default=-1)

    def flush(self) -> None:
        if self.rows is not None:  # text of a table belongs to its cells
            return
        tight = bool(self.marker)
        if text := self._text():
            self._write("#" * self.heading + " " * bool(self.heading) + text, tight)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED and tag not in VOID:
            self.dropped.append(tag)
        if self.dropped or tag in DROPPED or self.pre is not None:
            return
        if tag == "br":
            self.parts.append(_BREAK)
        elif tag in MARKS or tag == "a":
            self.inline.append((tag, len(self.parts), dict(attrs).get("href") or ""))
        elif tag in ("td", "th"):
            self._end_cell()
            self.cell = True
        elif tag == "tr":
            self._end_cell()
            if self.rows is not None:
                self.rows.append([])
        elif tag == "table" and self.rows is None:
            self.flush()
            self.rows, self.cell = [], False
        elif self.rows is not None:
            self.parts.append(" ")
        elif tag in ("ul", "ol", "blockquote"):
            self.flush()
            self.containers.append(["quote"] if tag == "blockquote" else [tag, 0])
        elif tag == "li":
            self.flush()
            at = self._last_list()
            if at >= 0:
                self.containers[at][1] += 1
            self.marker = f"{self.containers[at][1]}. " if at >= 0 and self.containers[at][0] == "ol" else "- "
        elif tag == "pre":
            self.flush()
            self.pre = []
        elif tag == "hr":
            self.flush()
            self._write("---")
        elif tag in HEADINGS:
            self.flush()
            self.heading = HEADINGS[tag]
        elif tag in BLOCKS:
            self.flush()

    def _end_cell(self) -> None:
        if self.rows is not None and self.cell:
            self.rows = self.rows or [[]]
            self.rows[-1].append(self._text().replace("  \n", " ").replace("|", "\\|"))
            self.cell = False

    def _close_inline(self, tag: str) -> None:
        at = next((k for k in range(len(self.inline) - 1, -1, -1) if self.inline[k][0] == tag), None)
        if at is None:
            return
        _, start, href = self.inline.pop(at)
        inner = "".join(self.parts[start:])
        if not inner.strip():
            return
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        words = inner.strip()
        if tag == "a":
            url = urljoin(self.base, href.strip()) if href.strip() else ""
            words = f"[{words}]({url.replace(' ', '%20')})" if urlsplit(url).scheme in ("http", "https", "mailto") else words
        else:
            words = MARKS[tag] + words + MARKS[tag]
        self.parts[start:] = [lead + words + tail]

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            return
        if self.pre is not None:
            if tag == "pre":
                code = "".join(self.pre).strip("\n")
                self.pre = None
                if code.strip():
                    fence = "```" if "```" not in code else "````"
                    self._write(f"{fence}\n{code}\n{fence}")
        elif tag in MARKS or tag == "a":
            self._close_inline(tag)
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "table" and self.rows is not None:
            self._end_cell()
            rows, self.rows = [r for r in self.rows if any(r)], None
            if rows:
                width = max(map(len, rows))
                lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
                self._write("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
            self.parts = []
        elif self.rows is not None:
            self.parts.append(" ")
        elif tag in ("ul", "ol", "blockquote"):
            self.flush()
            self.marker = ""
            kind = "quote" if tag == "blockquote" else tag
            at = next((k for k in range(len(self.containers) - 1, -1, -1) if self.containers[k][0] == kind), None)
            if at is not None:
                del self.containers[at:]
        elif tag in HEADINGS:
            self.flush()
            self.heading = 0
        elif tag == "li" or tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if self.pre is not None:
            self.pre.append(data)
        elif self.rows is None or self.cell:
            self.parts.append(data.replace(_BREAK, ""))


def markdown_of(html: str | None, base: str | None = None) -> str:
    """A page's Markdown; empty without html. Tags that are never closed end with the page."""
    emitter = _Emitter(base or "")
    try:
        emitter.feed(html or "")
        emitter.close()
    except ValueError:  # a url that is none
        pass
    for tag in ("pre", "table"):
        if not emitter.dropped:
            emitter.handle_endtag(tag)
    emitter.flush()
    out = ""
    for tight, block in emitter.blocks:
        out += ("\n" if tight else "\n\n") * bool(out) + block
    return out.strip()


def markdown(html: Column, base: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def convert(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([markdown_of(p, u) for p, u in zip(pages, urls, strict=True)], dtype=object)

    return convert(html, base)


def q_pages_markdown(spark, sf_dir):
    """Every page's Markdown, its links resolved against the page's url."""
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", markdown(F.col("html"), F.col("url")).alias("markdown"))
    return found.select("page_id", "markdown", F.length("markdown").cast("long").alias("n_chars"), F.size(F.regexp_extract_all("markdown", F.lit(r"\]\(https?://"), F.lit(0))).cast("long").alias("n_links"))


QUERIES = {"pages_markdown": (q_pages_markdown, None)}
