"""Sources: text, HTML and EPUB files to offset-addressed blocks; JSON lines; content-addressed imports; snapshots."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import HEADING, u16_length
from tidemark.sources.formats import COLOPHON, Package, annotated_blocks, unframed

#: Encodings that are tried in turn where no mark tells.
ENCODINGS = ("utf-8-sig", "gb18030", "big5")
BLOCK_TAGS = frozenset("p div li blockquote pre h1 h2 h3 h4 h5 h6 tr section article dt dd figcaption".split())
SKIPPED_TAGS = frozenset("script style head nav noscript template".split())
#: Characters of a book; a longer file is refused, not cut.
MOST_CHARS = 60_000_000


def decode(raw: bytes) -> str:
    """Text of bytes: UTF-16 by its mark, else the first encoding that fits, else UTF-8 with replacements."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def text_blocks(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, source) of the non-empty lines, or of the paragraphs between blank lines where there are such."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    paragraphs = re.split(r"\n[ \t]*\n", text) if re.search(r"\S\n[ \t]*\n\s*\S", text) else text.split("\n")
    cleaned = (re.sub(r"\s+", " ", p).strip(" 　") for p in paragraphs)
    return [("h" if len(p) <= 120 and re.match(HEADING, p.lower()) else "p", p, None) for p in cleaned if p]


class _Blocks(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str | None]] = []
        self.text: list[str] = []
        self.kind, self.skipping = "p", 0

    def close_block(self) -> None:
        text = re.sub(r"[ \t\r\n\xa0]+", " ", "".join(self.text)).strip(" 　")
        if text:
            self.blocks.append((self.kind, text, None))
        self.text, self.kind = [], "p"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in SKIPPED_TAGS:
            self.skipping += 1
        elif tag == "img" and not self.skipping:
            self.close_block()
            self.blocks.append(("img", "", own.get("src")))
        elif tag in BLOCK_TAGS or tag == "br":
            self.close_block()
            self.kind = "h" if re.fullmatch(r"h[1-6]", tag) else "p"

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED_TAGS:
            self.skipping = max(0, self.skipping - 1)
        elif tag in BLOCK_TAGS:
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)


def html_blocks(source: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, source) of the blocks of a page, without scripts, styles and navigation; images have an empty text."""
    parser = _Blocks()
    parser.feed(source)
    parser.close()
    parser.close_block()
    return parser.blocks


def epub_blocks(raw: bytes) -> list[tuple[str, str, str | None]]:
    """Blocks of the chapters of an EPUB in reading order, each chapter that the contents name under a heading; raises ValueError for what is none."""
    package = Package(raw)
    titles: dict[str, str] = {}
    for title, _, path, _ in package.contents():
        titles.setdefault(path, title)
    out: list[tuple[str, str, str | None]] = []
    for path in package.spine():
        blocks = html_blocks(decode(package.files.read(path)))
        if (title := titles.get(path)) and not any(kind == "h" for kind, _, _ in blocks[:3]):
            out.append(("h", title, None))
        out += blocks
    return out


def plain_blocks(text: str) -> list[tuple[str, str, str | None]]:
    """Blocks of a plain text: Japanese ones without notes and readings, others without the frames of a licence."""
    if "［＃" in text[:4000] and ("《" in text[:4000] or COLOPHON in text):
        return annotated_blocks(text)[2]
    return text_blocks(unframed(text)[0])


def parse(name: str, raw: bytes) -> list[tuple[str, str, str | None]]:
    kind = name.rpartition(".")[2].lower()
    return epub_blocks(raw) if kind == "epub" else html_blocks(decode(raw)) if kind in ("html", "htm", "xhtml") else plain_blocks(decode(raw))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id, block_no, k, t, src, o, error of every file under a path.

    The id is the first 16 digits of the SHA-1 of the bytes, so that equal files are one book. o is the block's offset in
    UTF-16 units, blocks joined by a line feed. A blank or unreadable file gives one row with an error and no block; files of no bytes are skipped by the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.substring(F.sha1("content"), 1, 16).alias("book_id"), "path", "content").dropDuplicates(["book_id"])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, name, raw in batch.itertuples(index=False):
                try:
                    found = parse(name, bytes(raw))
                    error = None if found else "empty"
                    if sum(len(t) for _, t, _ in found) > MOST_CHARS:
                        found, error = [], "too long"
                except ValueError as problem:
                    found, error = [], str(problem)
                rows = [(book, i, k, t, src, None) for i, (k, t, src) in enumerate(found)] or [(book, None, None, None, None, error)]
                yield pd.DataFrame(rows, columns=["book_id", "block_no", "k", "t", "src", "error"]).astype({"block_no": "Int64"})

    rows = files.mapInPandas(blocks, "book_id string, block_no long, k string, t string, src string, error string")
    before = Window.partitionBy("book_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("o", F.when(F.col("block_no").isNotNull(), F.coalesce(F.sum(u16_length(F.col("t")) + 1).over(before), F.lit(0))))


def new_books(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Books not yet there, by their content id."""
    return found.join(existing.select("book_id").distinct(), "book_id", "left_anti")


def write_log(log: DataFrame, path: str) -> None:
    """The published log: partitions of books, sorted by position, so that a slice of positions reads few row groups."""
    log.repartition("book_id").sortWithinPartitions("book_id", "p", "ord").write.mode("overwrite").parquet(path)


def snapshot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, document, sha: each row as canonical JSON with its hash."""
    rest = sorted(c for c in rows.columns if c not in keys)
    packed = rows.select(*keys, F.to_json(F.struct(*rest)).alias("document"))
    return packed.withColumn("sha", F.sha2("document", 256))


def restore(snapshots: DataFrame, schema: str) -> DataFrame:
    """Rows of snapshots whose hash still fits; others are left out."""
    keys = [c for c in snapshots.columns if c not in ("document", "sha")]
    sound = snapshots.where(F.sha2("document", 256) == F.col("sha"))
    return sound.select(*keys, F.from_json("document", schema).alias("_r")).select(*keys, "_r.*")


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of append-only JSON lines; a line that does not parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
