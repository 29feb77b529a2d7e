"""EPUB files as a Spark source: one task a file, blocks of text as rows; and the way back to a file.

`spark.dataSource.register(EpubSource)`, then `spark.read.format("epub").load(folder)`. Paths are read by Spark's own
binary reader in `read_epubs`, which works on any file system; the data source reads local or mounted folders.
"""

from __future__ import annotations

import glob
import io
import os
import posixpath
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, chapter_number int, document string, block_order int, block_id string, tag string, block_text string, error string"
#: Block elements, and document types of the spine.
BLOCK_TAGS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "li", "td", "table"])
DOCUMENT_TYPES = ("application/xhtml+xml", "application/x-dtbncx+xml")
DOCUMENT_ENDS = (".xhtml", ".html", ".htm")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def spine(book: zipfile.ZipFile) -> list[str]:
    """Documents of the book in reading order: the spine's ids looked up in the manifest."""
    container = ET.fromstring(book.read("META-INF/container.xml"))
    package = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
    root, base = ET.fromstring(book.read(package)), posixpath.dirname(package)
    manifest = {e.attrib["id"]: (e.attrib["href"], e.attrib.get("media-type", "")) for e in root.iter() if _local(e.tag) == "item"}
    listed = [manifest[e.attrib["idref"]] for e in root.iter() if _local(e.tag) == "itemref" and e.attrib["idref"] in manifest]
    return [posixpath.join(base, href) for href, kind in listed if kind in DOCUMENT_TYPES or href.lower().endswith(DOCUMENT_ENDS)]


def leaf_blocks(document: bytes) -> Iterator[tuple[str, str]]:
    """(tag, text) of block elements without a block right inside, in order, that have text of their own or right after
    their children; tables always count."""
    for e in ET.fromstring(document).iter():
        tag = _local(e.tag)
        if tag not in BLOCK_TAGS or any(_local(c.tag) in BLOCK_TAGS for c in e):
            continue
        own = (e.text or "").strip() or any((c.tail or "").strip() for c in e)
        if own or tag == "table":
            yield tag, "".join(e.itertext()).strip()


def book_rows(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of a book; a document that cannot be parsed gives one row with the error and no block."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        documents = spine(book)
    except Exception as e:
        yield path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
        return
    for n, name in enumerate(documents, 1):
        try:
            for i, (tag, text) in enumerate(list(leaf_blocks(book.read(name))), 1):
                yield path, n, name, i, f"ch{n:03d}_blk{i:03d}", tag, text, None
        except Exception as e:
            yield path, n, name, None, None, None, None, f"{type(e).__name__}: {e}"


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all EPUB files under a path that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(book_rows(p, content)), columns=names).astype({"chapter_number": "Int32", "block_order": "Int32"})

    return files.mapInPandas(parsed, SCHEMA)


class _Book(InputPartition):
    def __init__(self, path: str):
        self.path = path


class EpubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(os.path.join(self.path, "**", "*.epub"), recursive=True))
        return [_Book(p) for p in found]

    def read(self, partition: _Book) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from book_rows(partition.path, f.read())


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options)


def write_epub(chapters: list[tuple[str, list[str]]], path: str, title: str = "book") -> None:
    """A book from (title, paragraphs) of its chapters: the type first and stored, the rest deflated, in name order."""
    from xml.sax.saxutils import escape

    files = {"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'}
    items, refs = "", ""
    for n, (name, paragraphs) in enumerate(chapters, 1):
        body = "".join(f"<p>{escape(p)}</p>" for p in paragraphs)
        files[f"OEBPS/chapter{n}.xhtml"] = f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(name)}</title></head><body><h1>{escape(name)}</h1>{body}</body></html>'
        items += f'<item id="c{n}" href="chapter{n}.xhtml" media-type="application/xhtml+xml"/>'
        refs += f'<itemref idref="c{n}"/>'
    files["OEBPS/content.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/">{escape(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name], zipfile.ZIP_DEFLATED)
