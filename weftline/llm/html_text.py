"""HTML extraction by wrapper induction.

Pages of one host and layout share a template; a layout is the sequence of the
outer containers of a page. Of each, a bounded sample of SAMPLE_PAGES pages,
chosen by a hash of the page, is parsed, and those of different content are
aligned by simple tree matching. Aligned nodes with one text on the pages are
template, the others are slots. The slot in which the pages differ most, in
text outside links, is the article; the wrapper is the skeleton of the pages
with this slot, the template texts in it, and its slots that class or id call
furniture on most pages. Every page is then aligned with the wrapper: the text
of its article slot is the result, less template blocks and furniture at their
aligned places. Menus, headers, adverts, comments and footers go because they
lie outside the slot. Only pages without a wrapper (a host with a single page,
or copies of one) are read by the names of elements and classes.

The sample is picked by a pre-aggregated minimum for each (host, layout, slot),
so no host is gathered in one task, whatever its share of the pages. Wrappers
are one row for each host and layout and joined on these; Spark broadcasts them
if they are few and can split a hot host if they are many.

Edge cases: null or empty html gives an empty text; a null or broken url is a
host of its own; broken markup is repaired; elements nested deeper than 512 are
read as siblings; very long pages are sampled and read like others; an empty
table gives an empty result; repeated rows get equal results; other columns of
the input are kept, and text and n_chars replaced.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import dom
from weftline.llm.batches import append_columns, plain
from weftline.llm.kernels import Texts
from weftline.llm.scratch import Scratch

SAMPLE_PAGES = 8
#: Depth down to which containers make up the layout.
LAYOUT_DEPTH = 3
_CONTAINER = re.compile(r"<(/?)(body|div|section|article|main|table|header|nav|footer|aside|form|ul|ol|dl)\b([^<>]*)>", re.I)
_UNREAD = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|article)\b.*?</\1\s*>")
_NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*["']?([^"'>]*)""")


def host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def layout(html: str) -> int:
    """A number for the sequence of a page's outer containers; runs of one label count once."""
    labels: list[str] = []
    depth = 0
    for found in _CONTAINER.finditer(_UNREAD.sub("", html)):
        closing, tag, rest = found[1], found[2].lower(), found[3]
        if closing:
            depth = max(0, depth - 1)
            continue
        label = f"{depth} {tag} {' '.join(x[1].lower() for x in _NAMES.findall(rest))}"
        if depth < LAYOUT_DEPTH and labels[-1:] != [label]:
            labels.append(label)
        depth += 1
    return int.from_bytes(blake2b("|".join(labels).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def layouts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with their layout."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        return {"layout": [layout(texts.bytes_of(t).decode("utf-8", "replace")) for t in range(len(texts))]}

    return append_columns(pages, html, kernel, "layout long")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, layout, wrapper): the wrapper of each host and layout that has one, as JSON."""
    some = layouts(pages.select(host(url).alias("host"), F.col(html).alias("html"))).withColumn("h", F.xxhash64("html"))  # copies of a page take one slot
    picked = some.groupBy("host", "layout", F.pmod("h", F.lit(SAMPLE_PAGES)).alias("slot")).agg(F.min_by("html", "h").alias("html"))

    def induce(rows: pd.DataFrame) -> pd.DataFrame:
        found = dom.induce(rows.sort_values("slot")["html"].fillna("").tolist())
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "layout": [rows["layout"].iloc[0]], "wrapper": [json.dumps(found) if found else None]})

    return picked.groupBy("host", "layout").applyInPandas(induce, "host string, layout long, wrapper string").filter("wrapper is not null")


#: Wrappers that this Python worker has made ready.
_ready: dict[str, dom.Wrapper] = {}


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The pages with text, the main text."""
    scratch = Scratch(pages.sparkSession)
    found = scratch.write("wrappers", wrappers(pages, url, html), heavy=True)
    renamed, names, _ = plain(pages)
    placed = layouts(renamed.withColumn("host", host(names[url])), names[html])
    joined = placed.join(found, ["host", "layout"], "left").drop("host", "layout")

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        out = []
        for t, row in enumerate(rows.column(rows.schema.get_field_index("wrapper")).to_pylist()):
            if row is not None and row not in _ready:
                if len(_ready) > 1000:
                    _ready.clear()
                _ready[row] = dom.Wrapper(json.loads(row))
            out.append(dom.extract(texts.bytes_of(t).decode("utf-8", "replace"), _ready.get(row)))
        return {"text": out}

    done = append_columns(joined, names[html], kernel, "text string")
    kept = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in ("text", "n_chars")]
    return done.select(*kept, "text")
