"""Sinks: text, Markdown, HTML and JSON of documents; metadata reports; atomic writes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType
from pyspark.sql.window import Window

from quire.functions.text import escape_html, strip
from quire.operators.blocks import PAGE, page_text

FORMATS = ("text", "markdown", "json", "docling", "mineru")


def export(pages: DataFrame, format: str) -> DataFrame:  # noqa: A002
    """(doc_id, body) from (doc_id, page_index, page_text), pages in numeric order (SNK-01)."""
    if format not in FORMATS:
        raise ValueError(f"unknown export format {format!r}")
    rows = F.sort_array(F.collect_list(F.struct("page_index", "page_text")))
    g = pages.groupBy("doc_id").agg(rows.alias("rows"))
    if format == "text":
        body = F.array_join(F.transform("rows", lambda r: r["page_text"]), "\n\n")
    elif format == "markdown":
        parts = F.transform("rows", lambda r: F.concat(F.lit("## Page "), (r["page_index"] + 1).cast("string"), F.lit("\n\n"), r["page_text"]))
        body = F.concat(strip(F.array_join(parts, "\n\n")), F.lit("\n"))
    else:
        page = lambda r: F.struct(r["page_index"].alias("page_index"), F.split(r["page_text"], "\n").alias("lines"), r["page_text"].alias("text"))
        name = "document" if format == "docling" else "pages"
        head = [] if format == "json" else [F.lit(f"{format}_compatible").alias("schema")]
        body = F.to_json(F.struct(*head, F.transform("rows", page).alias(name)))
    return g.select("doc_id", body.alias("body"))


class DocumentExport(Protocol):
    """What an exporter offers (UDF-07)."""

    def export_tree(self, trees: DataFrame) -> DataFrame: ...
    def export_pages(self, pages: DataFrame) -> DataFrame: ...


class Exporter:
    """An exporter of one format for whatever a document comes as (STR-41)."""

    def __init__(self, format: str) -> None:  # noqa: A002
        if format not in FORMATS:
            raise ValueError(f"unknown export format {format!r}")
        self.format = format

    def export(self, source: DataFrame) -> DataFrame:
        """Trees (doc_id, tree), page texts (doc_id, page_index, page_text) or blocks, told apart by their columns."""
        if "tree" in source.columns:
            return self.export_tree(source)
        if "page_text" in source.columns:
            return self.export_pages(source)
        if {"block_index", "text"} <= set(source.columns):
            return self.export_pages(page_text(source))
        raise TypeError("neither trees, page texts nor blocks")

    def export_tree(self, trees: DataFrame) -> DataFrame:
        return self.export_pages(page_text(read_tree(trees)))

    def export_pages(self, pages: DataFrame) -> DataFrame:
        return export(pages, self.format)


def render_block(node_type: Column, text: Column, block_id: Column, box: list[Column], confidence: Column | None = None, level: Column | None = None) -> Column:
    """One block as HTML (SNK-03)."""
    t = escape_html(F.coalesce(text, F.lit("")))
    data = F.concat(F.lit(' data-block-id="'), block_id, F.lit('" data-bbox="'), F.format_string("%.4f,%.4f,%.4f,%.4f", *box), F.lit('"'))
    if confidence is not None:
        data = F.concat(data, F.when(confidence.isNotNull(), F.format_string(' data-confidence="%.3f"', confidence)).otherwise(""))
    h = F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.lit(6), level if level is not None else F.lit(1))).cast("string"))
    wrap = lambda tag: F.concat(F.lit(f"<{tag}"), data, F.lit(">"), t, F.lit(f"</{tag}>"))
    note = lambda name: F.concat(F.lit(f"<!-- {name}="), t, F.lit(" -->"))
    return (
        F.when(node_type == "section_header", F.concat(F.lit("<"), h, data, F.lit(">"), t, F.lit("</"), h, F.lit(">")))
        .when(node_type == "list_item", wrap("li"))
        .when(node_type == "code", F.concat(F.lit("<pre"), data, F.lit("><code>"), t, F.lit("</code></pre>")))
        .when(node_type == "figure", F.concat(F.lit("<figure"), data, F.lit("><figcaption>"), t, F.lit("</figcaption></figure>")))
        .when(node_type == "page_header", note("PageHeader")).when(node_type == "page_footer", note("PageFooter")).when(node_type == "page_number", note("PageNumber"))
        .otherwise(wrap("p"))
    )


def html(nodes: DataFrame, title: str = "Document") -> DataFrame:
    """(doc_id, body) from nodes (doc_id, page_index, block_index, node_type, html): runs of list items share a list.

    Runs are islands of a window per page (WIN-08); pages and documents are joined by ordered lists (SNK-02).
    """
    w = Window.partitionBy(*PAGE).orderBy("block_index")
    item = F.col("node_type") == "list_item"
    opens = item & ~F.coalesce(F.lag(item).over(w), F.lit(False))
    closes = item & ~F.coalesce(F.lead(item).over(w), F.lit(False))
    line = F.concat(F.when(opens, "<ul>\n").otherwise(""), F.col("html"), F.when(closes, "\n</ul>").otherwise(""))
    rows = nodes.withColumn("line", line)
    page = rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "line"))), lambda r: r["line"]), "\n").alias("inner"))
    page = page.withColumn("section", F.concat(F.lit('<section data-page-idx="'), F.col("page_index").cast("string"), F.lit('">\n'), "inner", F.lit("\n</section>")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "section"))), lambda r: r["section"]), "\n<!-- PageBreak -->\n")
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head><body>\n'
    return page.groupBy("doc_id").agg(F.concat(F.lit(head), body, F.lit("\n</body></html>")).alias("body"))


def table_html(cells: DataFrame, by: list[str]) -> DataFrame:
    """Grid as a table, row 0 as headers (SNK-04)."""
    tag = F.when(F.col("row_index") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    row = cells.withColumn("cell", cell).groupBy(*by, "row_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("column_index", "cell"))), lambda r: r["cell"]), "").alias("cells"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("row_index", "cells"))), lambda r: F.concat(F.lit("<tr>"), r["cells"], F.lit("</tr>")))
    return row.groupBy(*by).agg(F.concat(F.lit("<table>\n"), F.array_join(rows, "\n"), F.lit("\n</table>")).alias("html"))


def tree_json(nodes: DataFrame) -> DataFrame:
    """Document tree as JSON (SNK-07); ``read_tree`` reads it back."""
    node = F.struct("block_index", "node_type", "text", "x0", "y0", "x1", "y1")
    page = nodes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(node)).alias("children"))
    return page.groupBy("doc_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("page_index", "children"))).alias("pages"))).alias("tree"))


def read_tree(trees: DataFrame) -> DataFrame:
    """Nodes of JSON trees (PRJ-24)."""
    kind = "pages array<struct<page_index:long,children:array<struct<block_index:long,node_type:string,text:string,x0:double,y0:double,x1:double,y1:double>>>>"
    p = trees.select("doc_id", F.explode(F.from_json("tree", kind)["pages"]).alias("p"))
    return p.select("doc_id", "p.page_index", F.explode("p.children").alias("c")).select("doc_id", "page_index", "c.*")


PAGE_KEYS = ("quality", "structure", "sections", "layout", "tables", "routing")


def metadata_report(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Reported metadata of the pages that have any, as JSON per document (SNK-11, PRJ-21)."""
    keys = [k for k in keys if k in PAGE_KEYS]
    some = F.coalesce(*[F.col(k).isNotNull().cast("int").cast("string") for k in keys]) if keys else F.lit(None)
    row = F.struct("page_index", *keys)
    return pages.where(some.isNotNull()).groupBy("doc_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("pages"))).alias("report"))


def finite(c: Column) -> Column:
    """A number fit for JSON: NaN and infinities raise (PRJ-23)."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("number is not finite")).cast("double")).otherwise(c)


def unsafe(c: Column, kind: DataType) -> Column:
    """Whether a value holds a number that JSON has no form for, however deep; kinds that JSON lacks are refused at once (PRJ-23)."""
    if isinstance(kind, (StringType, BooleanType, ByteType, ShortType, IntegerType, LongType, NullType)):
        return F.lit(False)
    if isinstance(kind, (FloatType, DoubleType)):
        return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.exists(c, lambda x: unsafe(x, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: unsafe(x, kind.valueType)), F.lit(False))
    if isinstance(kind, StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | unsafe(c[f.name], f.dataType)
        return out
    raise TypeError(f"{kind.simpleString()} is not a kind of value that JSON has")


def safe_json(df: DataFrame, column: str) -> DataFrame:
    """``json`` of a column, or ``fault`` where it can't be written; the other columns as they are."""
    bad = unsafe(F.col(column), df.schema[column].dataType)
    return df.withColumn("json", F.when(~bad, F.to_json(column))).withColumn("fault", F.when(bad, "number is not finite")).drop(column)


def markdown_lines(c: Column) -> Column:
    """Lines of Markdown with their kind, for writers of other formats (SNK-05)."""
    kind = lambda x: F.when(x.rlike(r"^#{1,6}\s"), "heading").when(x.rlike(r"^\s*[-*+]\s"), "bullet").when(x.rlike(r"^\s*\d+\.\s"), "number").when(x.rlike(r"^---+$"), "break").when(x == "", "blank").otherwise("text")
    return F.transform(F.split(c, "\n"), lambda x: F.struct(kind(x).alias("kind"), F.regexp_replace(x, r"^(#{1,6}|\s*[-*+]|\s*\d+\.)\s+", "").alias("text")))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page texts as JSON; the committer makes the write one step (SNK-10)."""
    pages.write.mode("overwrite").json(path)


def write_binary(rows: DataFrame, writer: Callable[[dict], None], columns: list[str]) -> None:
    """Binary formats by an injected writer, one call per row (SNK-05, SNK-06, SNK-08, SNK-13)."""

    def run(part) -> None:
        for r in part:
            writer(r.asDict(recursive=True))

    rows.select(*columns).foreachPartition(run)
