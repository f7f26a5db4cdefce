"""Books from index pages: text links, chapter records, cast lists, main texts by host, fetching."""

from __future__ import annotations

import html
import re
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from weftline.functions import text as T

# Hosts of book texts, phrases of links to them, words that begin a chapter's name, placeholders.
TEXT_HOSTS = r"(?i)(gutenberg\.org|wikisource\.org|standardebooks\.org|fadedpage\.com)"
LINK_PHRASES = ("online text", "project gutenberg", "read")
SECTION_WORDS = ("chapter", "chapters", "section", "part", "book")
FILL_IN, FILL_IN_AUDIO, FILL_IN_WORDS, AUDIO_BASE = "FILL_IN", "FILL_IN.mp3", "FILL_IN.json", "https://archive.org/"
MOST_NAME_WORDS = 8
# Fixed value: a line of a cast list, `character: <a href=...>reader</a>`, after a line break or the block's start.
CAST_LINE = re.compile(r"(?:^|<br\s*/?>)\s*(?:<strong>\s*Cast\s*</strong>\s*<br\s*/?>\s*)?([^:<]{1,120}?)\s*:\s*<a [^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", re.I | re.S)

_CAST = ArrayType(StructType([StructField(n, StringType()) for n in ("character", "reader_name", "reader_link")]))


def text_links(pages: DataFrame) -> DataFrame:
    """(file_id, place, url, label) of links to known text hosts whose label says so; the first of equal URLs."""
    each = pages.select("file_id", F.posexplode("links").alias("place", "x")).select("file_id", "place", "x.url", T.collapse("x.label").alias("label"))
    said = F.lit(False)
    for phrase in LINK_PHRASES:
        said = said | F.lower("label").contains(phrase)
    kept = each.filter(F.col("url").rlike(TEXT_HOSTS) & said)
    first = kept.groupBy("file_id", "url").agg(F.min(F.struct("place", "label")).alias("m"))
    return first.select("file_id", "m.place", "url", F.when(F.col("m.label") != "", F.col("m.label")).otherwise(F.col("url")).alias("label"))


def chapter_records(pages: DataFrame) -> DataFrame:
    """(file_id, place, chapter, audio_file, words_file, text_url) of page records; one stub for a page without chapters."""
    shared = text_links(pages).groupBy("file_id").agg(F.min_by("url", "place").alias("text_url"))
    each = pages.select("file_id", F.posexplode_outer("chapters").alias("place", "x")).join(shared, "file_id", "left")
    number = T.section_label("x.section")
    named = F.lower("x.chapter").rlike("^(" + "|".join(SECTION_WORDS) + ")")
    label = F.when(number.isNotNull() & ~named, F.concat(number, F.lit(": "), "x.chapter")).otherwise(F.col("x.chapter"))
    link = F.trim("x.audio")
    audio = F.when(link.rlike("^https?://"), link).when(link != "", F.concat(F.lit(AUDIO_BASE), F.regexp_replace(link, "^/+", "")))
    words = F.concat(F.regexp_extract(audio, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit(".json"))
    return each.select(
        "file_id",
        F.coalesce("place", F.lit(0)).alias("place"),
        F.coalesce(label, F.lit("chapter_1")).alias("chapter"),
        F.coalesce(audio, F.lit(FILL_IN_AUDIO)).alias("audio_file"),
        F.coalesce(words, F.lit(FILL_IN_WORDS)).alias("words_file"),
        F.coalesce("text_url", F.lit(FILL_IN)).alias("text_url"),
    )


def plain(markup: str) -> str:
    """Markup without tags, character references decoded, white space single."""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", markup)).split())


@F.pandas_udf(StringType())
def plain_text(markup: pd.Series) -> pd.Series:
    return markup.map(lambda m: None if m is None else plain(m))


@F.pandas_udf(_CAST)
def cast_lines(pages: pd.Series, bases: pd.Series) -> pd.Series:
    """Characters and their readers in the description, or else in any paragraph or division; long names are no names."""

    def one(page: str, base: str) -> list[dict]:
        blocks = re.findall(r"""(?is)<p\b[^>]*class=["'][^"']*\bdescription\b[^>]*>(.*?)</p>""", page) or re.findall(r"(?is)<(?:p|div)\b[^>]*>(.*?)(?=</?(?:p|div)\b|$)", page)
        found = {}
        for block in blocks:
            for name, link, reader in CAST_LINE.findall(block.strip()):
                row = (plain(name), plain(reader), urljoin(base or "", link.strip()))
                if row[0] and row[1] and len(row[0].split()) <= MOST_NAME_WORDS:
                    found[row] = None
        return [dict(zip(("character", "reader_name", "reader_link"), row, strict=True)) for row in found]

    return pd.Series([one(p or "", b) for p, b in zip(pages, bases, strict=True)])


def cast(files: DataFrame) -> DataFrame:
    """(file_id, place, character, reader_name, reader_link, reader_id) of (file_id, html, base)."""
    each = files.select("file_id", F.posexplode(cast_lines("html", "base")).alias("place", "x"))
    return each.select("file_id", "place", "x.*", T.reader_id("x.reader_link").alias("reader_id"))


class _Parts(HTMLParser):
    """Text of a page with marks: whether a piece lies in a dropped element, in the first wanted one, in the body."""

    def __init__(self, drop: Callable, want: Callable) -> None:
        super().__init__(convert_charrefs=True)
        self.drop, self.want, self.open, self.pieces, self.first = drop, want, [], [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr", "img", "meta", "link", "input", "wbr", "col", "source"):
            return
        found = dict(attrs)
        classes, name = set((found.get("class") or "").split()), found.get("id") or ""
        node = (tag, self.drop(tag, classes, name), self.want(tag, classes, name))
        if node[2] and self.first is None:
            self.first = node
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not any(dropped for _, dropped, _ in self.open):
            self.pieces.append((data, any(n is self.first for n in self.open), any(t == "body" for t, *_ in self.open)))

    def text(self) -> str:
        for level in (1, 2):
            if any(p[level] for p in self.pieces):
                return "\n".join(p[0] for p in self.pieces if p[level])
        return "\n".join(p[0] for p in self.pieces)


def cleaner(drop: Callable[[str, set, str], bool], want: Callable[[str, set, str], bool] = lambda tag, classes, name: False) -> Callable[[str], str]:
    """A main-text function: `drop` and `want` see the tag, classes and id of each element."""

    def run(page: str) -> str:
        parts = _Parts(drop, want)
        parts.feed(page)
        parts.close()
        return parts.text()

    return run


_UNSEEN = ("script", "style")
#: Cleaners by a part of the host's name; add_cleaner() adds more, GENERIC is for all others.
CLEANERS: dict[str, Callable[[str], str]] = {
    "gutenberg.org": cleaner(lambda t, c, i: t in _UNSEEN or (t == "div" and ("chapter" in c or i == "pg-machine-header"))),
    "wikisource.org": cleaner(lambda t, c, i: t in _UNSEEN or bool(c & {"mw-editsection", "noprint", "navigation-box"}), lambda t, c, i: t == "div" and (i == "mw-content-text" or "mw-parser-output" in c)),
}
GENERIC = cleaner(
    lambda t, c, i: t in ("nav", "header", "footer", *_UNSEEN) or "sidebar" in c or i == "sidebar",
    lambda t, c, i: t in ("main", "article") or (t == "div" and (i in ("content", "main") or "content" in c)),
)


def add_cleaner(host: str, run: Callable[[str], str]) -> None:
    CLEANERS[host] = run


def main_texts(files: DataFrame) -> DataFrame:
    """(file_id, text) of (file_id, url, html), by the cleaner of the URL's host."""
    registry = dict(CLEANERS)

    @F.pandas_udf(StringType())
    def run(hosts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([next((f for key, f in registry.items() if key in (h or "")), GENERIC)(p or "") for h, p in zip(hosts, pages, strict=True)])

    return files.select("file_id", T.clean_text(run(T.url_host("url"), "html")).alias("text"))


def _open(url: str) -> tuple[bytes, str]:
    with urlopen(Request(url, headers={"User-Agent": "weftline"}), timeout=30) as found:  # noqa: S310 - the caller's own list
        return found.read(), found.headers.get("Content-Type") or ""


def _decoded(data: bytes, kind: str) -> str:
    said = re.search(r"charset=([\w-]+)", kind) or re.search(rb"charset=[\"']?([\w-]+)", data[:2048])
    name = (said[1].decode() if said and isinstance(said[1], bytes) else said[1]) if said else "utf-8"
    try:
        return data.decode(name)
    except (LookupError, UnicodeDecodeError):
        return data.decode("latin-1")


def fetch(urls: DataFrame, get: Callable[[str], tuple[bytes, str]] = _open, tries: int = 3, delay: float = 2.0) -> DataFrame:
    """(url, text, plain, error) of (url): fetched with retries; plain texts are told by their type or name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                for turn in range(tries):
                    try:
                        data, kind = get(url)
                        rows.append((url, _decoded(data, kind), "text/plain" in kind or url.endswith(".txt"), None))
                        break
                    except OSError as error:
                        if turn == tries - 1:
                            rows.append((url, None, None, str(error)))
                        else:
                            time.sleep(delay)
            yield pd.DataFrame(rows, columns=["url", "text", "plain", "error"])

    return urls.select("url").mapInPandas(run, "url string, text string, plain boolean, error string")


def fetched_texts(urls: DataFrame, **how: object) -> DataFrame:
    """(url, text, error): main texts of pages, plain texts as they are, both cleaned."""
    found = fetch(urls, **how)
    pages = main_texts(found.filter("not plain").select(F.col("url").alias("file_id"), "url", F.col("text").alias("html"))).select(F.col("file_id").alias("url"), "text", F.lit(None).cast("string").alias("error"))
    plain_ones = found.filter("plain or error is not null").select("url", T.clean_text("text").alias("text"), "error")
    return pages.unionByName(plain_ones)


def book_html(config: dict, listing: Callable[[str], list[str]], exists: Callable[[str], bool]) -> str:
    """Where the text of a book lies: as configured, else among the pages beside its index page."""
    if config.get("text_html") and exists(config["text_html"]):
        return config["text_html"]
    parts = (config.get("source_html") or "").split("/")
    if "index" in parts:
        parts[parts.index("index")] = "text"
        found = sorted(f for f in listing("/".join(parts[:-1])) if f.endswith(".html"))
        links = config.get("text_source_links") or [{}]
        number = re.search(r"/(\d+)(?:[/?#.]|$)", links[0].get("url") or "")
        named = [f for f in found if number and number[1] in f.rsplit("/", 1)[-1]]
        if found:
            return found[0] if len(found) == 1 else (named or found)[0]
    raise FileNotFoundError("no text page found; name it as text_html")


def joined_url(base: Column | str, link: Column | str) -> Column:
    """A link made absolute."""

    @F.pandas_udf(StringType())
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", x or "") for b, x in zip(bases, links, strict=True)])

    return run(base, link)
