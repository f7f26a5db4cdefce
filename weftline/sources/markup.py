"""Markup sources: OCR word boxes, page records, book sections; one parse for each file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_BOX = re.compile(r"bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)")
_CONF = re.compile(r"x_wconf (\d+)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Words(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.words, self.open, self.depth = 0, [], None, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        if "ocr_page" in classes:
            self.page += 1
        if self.open is None and {"ocrx_word", "ocr_word"} & set(classes):
            self.open, self.depth = {"title": found.get("title") or "", "id": found.get("id"), "text": ""}, 0
        if self.open is not None and tag not in _VOID:
            self.depth += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.open is not None and tag not in _VOID:
            self.depth -= 1
            if self.depth <= 0:
                box, conf, text = _BOX.search(self.open["title"]), _CONF.search(self.open["title"]), " ".join(self.open["text"].split())
                if text:
                    self.words.append((self.page, self.open["id"], text, *([int(x) for x in box.groups()] if box else [None] * 4), int(conf[1]) if conf else None))
                self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open["text"] += data


def ocr_words(html: str) -> list[tuple]:
    """(page, id, text, x1, y1, x2, y2, conf) of each word with text; pages count from 1."""
    parser = _Words()
    parser.feed(html)
    parser.close()
    return parser.words


def read_ocr(files: DataFrame) -> DataFrame:
    """Words of OCR files (file_id, html), in page order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, pos, *w) for f, html in zip(batch["file_id"], batch["html"], strict=True) for pos, w in enumerate(ocr_words(html or ""))]
            yield pd.DataFrame(rows, columns=["file_id", "pos", "page", "word_id", "word", "x1", "y1", "x2", "y2", "conf"]).astype({c: "Int32" for c in ("pos", "page", "x1", "y1", "x2", "y2", "conf")})

    return files.select("file_id", "html").mapInPandas(run, "file_id string, pos int, page int, word_id string, word string, x1 int, y1 int, x2 int, y2 int, conf int")


class _Page(HTMLParser):
    """Title, heading, author, links, chapter table and headings of an index page."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.h1, self.author = base, "", "", ""
        self.links: list[dict] = []
        self.rows: list[list[dict]] = []
        self.headings: list[dict] = []
        self.stack: list[tuple[str, str]] = []
        self.in_table = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        classes = found.get("class") or ""
        if tag == "table" and "chapter-download" in classes:
            self.in_table = True
        if tag == "a":
            self.links.append({"url": urljoin(self.base, found.get("href") or ""), "label": ""})
        if tag == "tr" and self.in_table:
            self.rows.append([])
        if tag in ("td", "th") and self.in_table and self.rows:
            self.rows[-1].append({"text": "", "href": None, "raw": None, "head": tag == "th"})
        if tag == "a" and self.in_table and self.rows and self.rows[-1] and self.rows[-1][-1]["href"] is None:
            self.rows[-1][-1] |= {"href": urljoin(self.base, found.get("href") or ""), "raw": found.get("href")}
        anchor = found.get("id") or (found.get("name") if tag == "a" else None)
        if anchor and self.headings and any(re.fullmatch("h[1-6]", t) for t, _ in self.stack) and self.headings[-1]["anchor"] is None:
            self.headings[-1]["anchor"] = anchor
        if re.fullmatch("h[1-6]", tag):
            self.headings.append({"level": int(tag[1]), "anchor": found.get("id") or found.get("name"), "text": ""})
        if tag not in _VOID:
            self.stack.append((tag, classes))

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.in_table = False
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        tags = {t for t, _ in self.stack}
        if tags & {"script", "style"}:
            return
        if "title" in tags:
            self.title += data
        if "h1" in tags:
            self.h1 += data
        if any("book-page-author" in c for _, c in self.stack):
            self.author += data
        if "a" in tags and self.links:
            self.links[-1]["label"] += data
        if tags & {"td", "th"} and self.in_table and self.rows and self.rows[-1]:
            self.rows[-1][-1]["text"] += data
        if any(re.fullmatch("h[1-6]", t) for t in tags) and self.headings:
            self.headings[-1]["text"] += data


#: Headers of chapter tables and the columns that they mean; without headers, columns stand in this order.
COLUMNS = {"section": "section", "chapter": "chapter", "reader": "reader", "time": "time", "duration": "time"}
GENERIC_TITLES = ("librivox", "home", "untitled", "index")


def page_record(html: str, base: str = "") -> dict:
    """Title, author, links and chapters of an index page."""
    page = _Page(base)
    page.feed(html)
    page.close()
    squeeze = lambda x: " ".join(x.split())
    titles = [t for t in (squeeze(page.h1), squeeze(page.title)) if t and t.lower() not in GENERIC_TITLES]
    names, chapters = ["section", "chapter", "reader", "time"], []
    for row in page.rows:
        texts = [squeeze(c["text"]) for c in row]
        if row and all(c["head"] for c in row):
            names = [COLUMNS.get(t.lower(), t.lower()) for t in texts]
            continue
        cells = dict(zip(names, texts + [""] * (len(names) - len(texts)), strict=False))
        href = next((c["href"] for n, c in zip(names, row, strict=False) if n == "reader" and c["href"]), None)
        reader = re.search(r"/reader/(\d+)|peopleid=(\d+)", href or "")
        if len(row) >= 2 and cells.get("chapter"):
            audio = row[0]["raw"] if row else None
            chapters.append({"section": cells.get("section", ""), "chapter": cells["chapter"], "reader": cells.get("reader", ""), "reader_id": next((g for g in reader.groups() if g), None) if reader else None, "time": cells.get("time", ""), "audio": audio})
    return {"title": titles[0] if titles else None, "author": squeeze(page.author) or None, "links": [{"url": x["url"], "label": squeeze(x["label"])} for x in page.links], "chapters": chapters, "headings": [{**h, "text": squeeze(h["text"])} for h in page.headings]}


RECORD = (
    "file_id string, title string, author string, links array<struct<url:string,label:string>>, "
    "chapters array<struct<section:string,chapter:string,reader:string,reader_id:string,time:string,audio:string>>, headings array<struct<level:int,anchor:string,text:string>>, status string"
)


def read_pages(files: DataFrame) -> DataFrame:
    """Page records of (file_id, html, base); a page that cannot be parsed has its error as status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, html, base in zip(batch["file_id"], batch["html"], batch["base"], strict=True):
                try:
                    rows.append({"file_id": f, **page_record(html or "", base or ""), "status": "ok"})
                except (ValueError, AssertionError) as error:
                    rows.append({"file_id": f, "title": None, "author": None, "links": [], "chapters": [], "headings": [], "status": str(error)})
            yield pd.DataFrame(rows, columns=["file_id", "title", "author", "links", "chapters", "headings", "status"])

    return files.select("file_id", "html", "base").mapInPandas(run, RECORD)
