"""Files: dispatch by ending, plain text, DOCX and HTML to text, and DOCX back with a revised text."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.text import extracted_text
from inkspan.operators.align import align_paragraphs, distribute

PLAIN = ("txt", "md", "markdown", "csv", "json", "rtf")
LARGEST, PAGE_LEAST = 50 << 20, 160
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DROPPED = {"script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "form", "title"}
READ = {"article", "main"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: The white space of the ECMAScript `\\s`.
WHITE = re.compile("[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def docx_text(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(WORD + "t")) for p in root.iter(WORD + "p"))


def docx_with(raw: bytes, revised: str) -> bytes:
    """The package with the paragraphs' texts replaced, each run's by what belongs to it; other parts stay as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for item in z.infolist():
            data = z.read(item)
            if item.filename == "word/document.xml":
                for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
                    ET.register_namespace(prefix, uri)
                root = ET.fromstring(data)
                parts = [p for p in root.iter(WORD + "p") if "".join(t.text or "" for t in p.iter(WORD + "t")).strip()]
                old = ["".join(t.text or "" for t in p.iter(WORD + "t")) for p in parts]
                new = align_paragraphs(old, [x.strip() for x in revised.split("\n\n") if x.strip()])
                for p, text in zip(parts, new):
                    runs = list(p.iter(WORD + "t"))
                    for t, part in zip(runs, distribute([t.text or "" for t in runs], text)):
                        t.text = part
                        if part != part.strip():
                            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            to.writestr(item, data)
    return out.getvalue()


class _Reader(HTMLParser):
    """The text of the body, and after it that of each article and main within, as the reference has it: their text comes twice.

    An element ends with its end tag or that of an element around it. What stands in the head is dropped by its own
    elements; other text and elements there belong to the body, whose tags may be missing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.open = [[]], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        part = len(self.parts) if tag in READ and not self.dropped() else None
        if part:
            self.parts.append([])
        self.open.append((tag, part))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        at = max((k for k, (name, _) in enumerate(self.open) if name == tag), default=None)
        if at is not None:
            del self.open[at:]

    def dropped(self) -> bool:
        return any(name in DROPPED for name, _ in self.open)

    def handle_data(self, data):
        if not self.dropped():
            for k in [0, *(part for _, part in self.open if part)]:
                self.parts[k].append(data)


def html_text(html: str | None) -> str:
    """The readable text of a whole page, in normal white space."""
    r = _Reader()
    r.feed(html or "")
    r.close()  # else text after the last tag that looks like the start of a mark stays in the buffer
    return WHITE.sub(" ", "".join("".join(p) for p in r.parts)).strip()


def page_texts(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> (url, text), null where a page has too little or isn't on the web."""

    @F.pandas_udf("string")
    def go(html: pd.Series) -> pd.Series:
        return html.map(html_text)

    t = go("html")
    return pages.select("url", t.alias("text")).withColumn("text", F.when((F.length("text") > PAGE_LEAST) & F.col("url").rlike("(?i)^https?:"), F.col("text")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, method, text, error) of the files under a path."""
    raw = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    raw = raw.select("path", "length", "content", ext.alias("ext"))
    method = F.when(F.col("length") > LARGEST, "too-large").when(F.col("ext").isin(*PLAIN), "plain-text").when(F.col("ext") == "docx", "docx").when(F.col("ext") == "pdf", "pdf").otherwise("unsupported")

    @F.pandas_udf("string")
    def docx(content: pd.Series) -> pd.Series:
        def one(b):
            try:
                return docx_text(b)
            except (zipfile.BadZipFile, KeyError, ET.ParseError):
                return None

        return content.map(one)

    raw = raw.withColumn("method", method)
    text = F.when(F.col("method") == "plain-text", F.decode("content", "UTF-8")).when(F.col("method") == "docx", docx(F.when(F.col("method") == "docx", F.col("content"))))
    return raw.select("path", "method", extracted_text(text).alias("text")).withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("no text: "), F.col("method"))))
