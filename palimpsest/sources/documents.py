"""Statute XML, feeds, HTML lists, JSON interfaces and archives to rows.

Parsers take a column or a table of raw texts; fetching is not part of the engine. Only mixed-content formats leave the
JVM, in Arrow batches.
"""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType

from palimpsest.functions.text import html_text, squeeze

# The elements of the official statute XML, tables of contents and RSS.
_LAW = (
    "_builddate string, _doknr string, norm array<struct<_doknr:string,metadaten:struct<jurabk:string,langue:string,enbez:string,titel:string,"
    "gliederungseinheit:struct<gliederungsbez:string,gliederungstitel:string>,standangabe:array<struct<standtyp:string,standkommentar:string>>>,"
    "textdaten:struct<text:struct<Content:string>>>>"
)
_FEED = "channel struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,category:string,description:string>>>"
_TOC = "item array<struct<title:string,link:string>>"


def _plain(markup: Column) -> Column:
    """Text of mixed content: tags as blanks, white space squeezed."""
    return squeeze(F.regexp_replace(html_text(F.regexp_replace(markup, r"<(?!br|/p)[^<>]*>", " ")), r"<[^<>]*>", " "))


def parse_law(documents: DataFrame, key: str, xml: str) -> tuple[DataFrame, DataFrame]:
    """Acts (key, jurabk, long_title, stand, builddate, doknr, norm_count) and norms (key, norm_index, jurabk, enbez, titel, gliederung, text, doknr).

    Norms without a label are no rows, but their structural heading is carried forward to those that follow (W9), and the
    first abbreviation names the act. Broken XML gives an act of nulls without norms.
    """
    parsed = documents.select(key, F.from_xml(F.col(xml), _LAW, {"mode": "PERMISSIVE"}).alias("x"))
    norm = F.posexplode_outer("x.norm").alias("norm_index", "n")
    rows = parsed.select(key, F.col("x._builddate").alias("builddate"), F.col("x._doknr").alias("act_doknr"), norm)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    unit = F.col("n.metadaten.gliederungseinheit")
    rows = rows.select(
        key, "builddate", "act_doknr", F.coalesce("norm_index", F.lit(0)).alias("norm_index"), filled(F.col("n.metadaten.jurabk")).alias("jurabk"), filled(F.col("n.metadaten.langue")).alias("long_title"),
        filled(F.col("n.metadaten.enbez")).alias("enbez"), F.coalesce(F.trim("n.metadaten.titel"), F.lit("")).alias("titel"),
        F.when(unit.isNotNull(), F.concat_ws(" ", filled(unit["gliederungsbez"]), filled(unit["gliederungstitel"]))).alias("gliederung"),
        F.array_join(F.transform("n.metadaten.standangabe", lambda a: F.concat(F.trim(a["standtyp"]), F.lit(": "), F.trim(a["standkommentar"]))), " | ").alias("stand"),
        _plain(F.coalesce("n.textdaten.text.Content", F.lit(""))).alias("text"), F.col("n._doknr").alias("doknr"),
    )
    along = Window.partitionBy(key).orderBy("norm_index").rowsBetween(Window.unboundedPreceding, 0)
    norms = rows.withColumn("gliederung", F.coalesce(F.last("gliederung", True).over(along), F.lit(""))).withColumn("jurabk", F.coalesce("jurabk", F.first("jurabk", True).over(along)))
    first = lambda c: F.min_by(c, F.when(F.col("jurabk").isNotNull(), F.col("norm_index"))).alias(c)
    acts = rows.groupBy(key).agg(first("jurabk"), first("long_title"), first("stand"), F.max("builddate").alias("builddate"), F.max("act_doknr").alias("doknr"), F.count("enbez").alias("norm_count"))
    return acts, norms.where(F.col("enbez").isNotNull()).select(key, "norm_index", "jurabk", "enbez", "titel", "gliederung", "text", "doknr")


def parse_toc(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(slug, title, link) of tables of contents; of a slug listed twice the first entry counts, entries without title or path none."""
    rows = documents.select(key, F.from_xml(F.col(xml), _TOC).alias("x")).select(key, F.posexplode("x.item").alias("place", "t"))
    slug = F.lower(F.nullif(F.regexp_extract("t.link", r"/([^/?]+)/xml\.zip(?:$|\?)", 1), F.lit("")))
    title = F.nullif(squeeze(F.col("t.title")), F.lit(""))
    found = rows.select(key, "place", slug.alias("slug"), title.alias("title"), F.regexp_replace("t.link", r"\?.*$", "").alias("link")).where(F.col("slug").isNotNull() & F.col("title").isNotNull())
    return found.groupBy("slug").agg(F.min(F.struct(key, "place", "title", "link")).alias("r")).select("slug", "r.title", "r.link")


def parse_feed(documents: DataFrame, key: str, xml: str, id_pattern: str) -> tuple[DataFrame, DataFrame]:
    """(key, item_id, title, link, day) of the RSS items whose id can be read, and the rejected ones."""
    rows = documents.select(key, F.from_xml(F.col(xml), _FEED, {"mode": "PERMISSIVE"}).alias("x")).select(key, F.posexplode("x.channel.item").alias("place", "i"))
    ident = F.nullif(F.regexp_extract(F.coalesce("i.guid", "i.link"), id_pattern, 1), F.lit(""))
    written = F.regexp_extract(F.col("i.pubDate"), r"(\d{1,2}) (\w{3}) (\d{4})", 0)
    day = F.try_to_timestamp(F.regexp_replace(written, r"^(\d) ", "0$1 "), F.lit("dd MMM yyyy")).cast("date")
    items = rows.select(key, "place", ident.alias("item_id"), F.trim("i.title").alias("title"), F.col("i.link").alias("link"), day.alias("day"))
    return items.where(F.col("item_id").isNotNull()), items.where(F.col("item_id").isNull())


def html_rows(page: Column) -> Column:
    """array<array<string>>: the cells of each table row of a page as text."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", " "), r"(?U)\s+", " "))
    return F.transform(rows, lambda r: F.transform(cells(r), plain))


def official_page(page: Column) -> Column:
    """struct<title, published, md5>: what an official document page says of its file; missing parts are null."""
    meta = lambda name: F.nullif(F.trim(F.regexp_extract(page, rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)), F.lit(""))
    written = F.regexp_extract(page, r"(?is)MD5\b.{0,20}?\b([0-9a-f]{32})\b", 1)
    return F.struct(meta("title").alias("title"), meta("date").try_cast("date").alias("published"), F.lower(F.nullif(written, F.lit(""))).alias("md5"))


def register_entries(page: Column) -> Column:
    """map<string,string> of the terms and descriptions of a register page; of a term given twice the last counts."""
    pairs = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
    plain = lambda i: F.transform(F.regexp_extract_all(page, F.lit(pairs), F.lit(i)), lambda c: squeeze(F.regexp_replace(c, r"<[^<>]*>", " ")))
    entries = F.arrays_zip(plain(1).alias("k"), plain(2).alias("v"))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(plain(1), i + 2, F.greatest(F.size(plain(1)), F.lit(1))), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def union_of_orders(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of two listings of the same things, each once."""
    return first.unionByName(second, allowMissingColumns=True).dropDuplicates([key])


def listed(value: Column) -> Column:
    """A JSON value that is one thing or a list of things, as array<string> of their texts; null gives none."""
    as_list = F.from_json(value, "array<string>")
    single = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
    return F.when(value.isNull() | (F.trim(value) == "null"), F.array().cast("array<string>")).when(F.trim(value).startswith("["), as_list).otherwise(single)


def first_value(rows: DataFrame, key: str, order: str, columns: list[str], day: str | None = None) -> DataFrame:
    """Per key the first non-null of each column in ``order``; days before 1900 are placeholders and dropped."""
    if day:
        rows = rows.withColumn(day, F.when(F.col(day) >= F.lit("1900-01-01").cast("date"), F.col(day)))
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def changelog_events(rows: DataFrame, changed: str, deleted: str) -> DataFrame:
    """(work, kind): one row per changed or deleted work of a change log; entries without a work id are dropped."""
    part = lambda column, kind: rows.select(F.explode(column).alias("work")).select(F.nullif(F.trim("work"), F.lit("")).alias("work"), F.lit(kind).alias("kind"))
    return part(changed, "changed").unionByName(part(deleted, "deleted")).where(F.col("work").isNotNull())


def best_variant(rows: DataFrame, key: str, text: str, pattern: str = r"(?m)^(?:Artikel|§) \d") -> DataFrame:
    """Per key the variant with sections, then the longest."""
    return rows.groupBy(key).agg(F.max_by(text, F.struct(F.col(text).rlike(pattern), F.length(text))).alias(text))


_TAGS = re.compile(r"<[^<>]*>")


def unzip_texts(files: DataFrame) -> DataFrame:
    """(path, member, text) of the XML members of ZIP files read with ``binaryFile``; an unreadable file gives member null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith(".xml")]
                except zipfile.BadZipFile:
                    rows.append((path, None, None))
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, text string")


def mixed_text(xml: Column, element: str) -> Column:
    """array<string>: the text of every ``element`` with its mixed content, tails included."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        pattern = re.compile(rf"<{element}\b[^>]*>(.*?)</{element}>", re.S)
        return texts.map(lambda t: None if t is None else [" ".join(html.unescape(_TAGS.sub(" ", m)).split()) for m in pattern.findall(t)])

    return run(xml)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, on any executor: HDFS, an object store or a shared local folder."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read_file(path: str) -> bytes:
    system, inner = _located(path)
    with system.open_input_stream(inner) as f:
        return f.read()


def write_file(path: str, content: bytes) -> None:
    system, inner = _located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(content)


class PagedSource(DataSource):
    """A paged interface as a Spark source: pages follow a cursor until it repeats or is missing.

    Options: ``path`` (folder of saved pages ``<cursor>.json``, the first is ``start.json``), ``rows`` and ``next`` (names of the
    rows and the cursor in a page). Rows come as JSON text. A page that is missing ends the scan with an error, so that a
    torn download is no short result.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.rows, self.next = options["path"], options.get("rows", "documents"), options.get("next", "cursor")

    def partitions(self) -> list[InputPartition]:
        # A cursor is only known from the page before, so one task walks them; its memory is one page.
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        cursor, seen, number = "start", set(), 0
        while cursor and cursor not in seen:
            seen.add(cursor)
            page = json.loads(read_file(f"{self.folder}/{cursor}.json"))
            for row in page.get(self.rows) or []:
                yield number, json.dumps(row, ensure_ascii=False, sort_keys=True)
            cursor, number = page.get(self.next), number + 1
