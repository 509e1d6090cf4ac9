"""The report: per container its DestList and its link records, as rows and as HTML lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumptrail.functions.text import html_text
from jumptrail.operators.lookup import join_lookup

CONTAINER = ["host", "file"]

# Section, its column titles.
SECTIONS = [
    ("DestList", ["Entry #", "Path", "Last Modified"]),
    ("LNKs", ["Entry #", "Path", "Name string", "Command line arguments"]),
]
HEADER_COLOR = "#9acd32"


def index_join(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the files that the index lists; an index entry without a document adds nothing."""
    listed = index.select(*CONTAINER).distinct()
    return join_lookup(rows, listed, CONTAINER, "inner")


def _section(rows: DataFrame, name: str, *cells: Column) -> DataFrame:
    texts = [cell.cast("string") for cell in cells]
    texts += [F.lit(None).cast("string")] * (4 - len(texts))
    return rows.select(
        *CONTAINER,
        "appid",
        F.lit(name).alias("section"),
        "position",
        *(text.alias(f"c{i}") for i, text in enumerate(texts, 1)),
    )


def report_rows(index: DataFrame, entries: DataFrame, lnks: DataFrame) -> DataFrame:
    """(host, file, appid, section, position, c1..c4) of the listed containers, times as written."""
    listed, linked = index_join(index, entries), index_join(index, lnks)
    return _section(
        listed, "DestList", F.col("entry_number"), F.col("path"), F.col("last_modified_text")
    ).unionByName(
        _section(
            linked,
            "LNKs",
            F.col("position"),
            F.col("local_base_path"),
            F.col("name_string"),
            F.col("arguments"),
        )
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """`report_rows` of documents, entries and link records in one pass; columns of the container stay."""

    def rows(records: Column, section: str, *paths: str) -> Column:
        def row(record: Column, i: Column) -> Column:
            position = (F.col("first") + i + 1).cast("bigint")
            cells = [position.cast("string")] if section == "LNKs" else []
            for path in paths:
                cell = record
                for name in path.split("."):
                    cell = cell[name]
                cells.append(cell)
            cells += [F.lit(None).cast("string")] * (4 - len(cells))
            return F.struct(
                F.lit(section).alias("section"), position.alias("position"), *(cell.alias(f"c{n}") for n, cell in enumerate(cells, 1))
            )

        return F.coalesce(F.transform(records, row), F.array())

    entries = rows(F.col("DestList.DestListEntryV2"), "DestList", "_EntryNumber", "_Path", "_LastModified")
    lnks = rows(F.col("LNKs.LNK"), "LNKs", "LinkInfo._LocalBasePath", "NAME_STRING._String", "COMMAND_LINE_ARGUMENTS._String")
    kept = [name for name in docs.columns if name not in ("first", "part", "DestList", "LNKs")]
    number = F.when(F.col("section") == "DestList", F.col("c1").try_cast("bigint").cast("string")).otherwise(F.col("c1"))
    return docs.select(*kept, F.inline(F.concat(entries, lnks))).withColumn("c1", number)


def custom_report(rows: DataFrame, user_fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Report by a transform of the user's own in place of the default one."""
    return rows.transform(user_fn)


def _title_line(section: str, titles: list[str]) -> Column:
    row = "".join(f"<th>{title}</th>" for title in titles)
    head = f'<tr bgcolor="{HEADER_COLOR}">{row}</tr>'
    if section == "DestList":
        start = F.concat(F.lit("<h2>"), html_text("file"), F.lit(f"</h2><h2>{section}</h2>"))
        table = F.concat(F.lit('<table border="1" id="_t'), html_text("appid"), F.lit('">'))
    else:
        start, table = F.lit(f"<h2>{section}</h2>"), F.lit('<table border="1">')
    return F.concat(start, table, F.lit(head))


def _row_line() -> Column:
    def cells(n: int) -> Column:
        tds = [
            F.concat(F.lit("<td>"), html_text(f"c{i}"), F.lit("</td>")) for i in range(1, n + 1)
        ]
        return F.concat(F.lit("<tr>"), *tds, F.lit("</tr>"))

    line = F.lit(None)
    for section, titles in SECTIONS:
        line = F.when(F.col("section") == section, cells(len(titles))).otherwise(line)
    return line


def report_html(rows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """HTML lines: (host, file, appid, section, part, position, html), and the place in the index where rows have it.

    A table is a title line (part 0), a line per row (part 1) and an end line (part 2), so a long
    table is many rows and never one value. A container has both tables, even if one is empty. The
    containers come from the index; without one they are looked up among the rows.
    """
    place = ["place"] if "place" in rows.columns else []
    columns = [*CONTAINER, "appid", *place, "section", "part", "position", "html"]
    lines = rows.withColumn("part", F.lit(1)).withColumn("html", _row_line()).select(*columns)
    frames = F.array(
        *(
            F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), html.alias("html"))
            for section, titles in SECTIONS
            for part, html in ((0, _title_line(section, titles)), (2, F.lit("</table>")))
        )
    )
    containers = rows if index is None else index
    containers = containers.select(*CONTAINER, "appid", *place)
    ends = (
        (containers if index is not None else containers.distinct())
        .select("*", F.inline(frames))
        .withColumn("position", F.lit(0).cast("bigint"))
    )
    return lines.unionByName(ends.select(*columns))


def write_report(lines: DataFrame, path: str) -> None:
    """Text files per host and AppID; in file-name order they are the report of the container.

    Lines with a place in the index are written without folders: in file-name order they are one report of all
    containers, in the order of the index.
    """
    if "place" in lines.columns:
        keys = ["place", "section", "part", "position"]
        lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("html").write.text(path)
        return
    keys = ["host", "appid", "file", "section", "part", "position"]
    (
        lines.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("host", "appid", "html")
        .write.partitionBy("host", "appid")
        .text(path)
    )
