"""Workbooks and archives, read a member at a time.

A listing of files becomes a listing of their members, read from the directories at the files' ends; the members are dealt
over tasks, and a task seeks to its member and streams it.  Only the unpacking runs in Python; what the cells
mean is decided by DataFrame code.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .opening import open_file

CELL_SCHEMA = "path string, sheet string, row int, col int, text string"
BATCH = 20_000
# Bytes of a member that are unpacked and parsed at a time.
BLOCK_BYTES = 1 << 20


def dealt(units: DataFrame, *order: str) -> DataFrame:
    """Rows that each stand for much work, spread evenly over tasks."""
    spark = units.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return units.repartitionByRange(max(1, min(units.count(), most)), *order)


def column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n


def _local(el: ElementTree.Element) -> str:
    return el.tag.rsplit("}", 1)[-1]


def workbook_sheets(files: DataFrame) -> DataFrame:
    """``path, sheet, member`` of every sheet of listed workbooks."""

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as f, zipfile.ZipFile(f) as z:
                    rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                    for sheet in (el for el in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(el) == "sheet"):
                        target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
                        out.append((path, sheet.get("name"), target if target.startswith("xl/") else "xl/" + target))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["path", "sheet", "member"])

    return files.select("path").mapInArrow(sheets, "path string, sheet string, member string")


def sheet_cells(path: str, member: str) -> Iterator[tuple[int, int, str]]:
    """Non-empty cells of one sheet; read rows leave the tree, so a sheet takes no more memory than a row and the shared texts."""
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            events = ElementTree.iterparse(z.open("xl/sharedStrings.xml"), ("start", "end"))
            _, root = next(events)
            for event, el in events:
                if event == "end" and _local(el) == "si":
                    shared.append("".join(t.text or "" for t in el.iter() if _local(t) == "t"))
                    root.clear()
        above = None
        for event, el in ElementTree.iterparse(z.open(member), ("start", "end")):
            if event == "start":
                above = el if _local(el) == "sheetData" else above
            elif _local(el) == "row":
                for cell in el:
                    text = "".join(t.text or "" for t in cell.iter() if _local(t) in ("v", "t"))
                    if text:
                        ref = cell.get("r")
                        yield int(re.search(r"\d+", ref).group()), column_index(ref), shared[int(text)] if cell.get("t") == "s" else text
                above.clear()


def workbook_cells(files: DataFrame) -> DataFrame:
    """Listed workbooks (a column ``path``) to ``path, sheet, row, col, text`` cells; every sheet is a unit of work."""
    schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                cells: list[tuple] = []
                for cell in sheet_cells(unit["path"], unit["member"]):
                    cells.append((unit["path"], unit["sheet"], *cell))
                    if len(cells) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), schema.types, strict=True)], schema=schema)
                        cells = []
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), schema.types, strict=True)], schema=schema)

    return dealt(materialize(workbook_sheets(files), "sheets"), "path", "member").mapInArrow(unpack, CELL_SCHEMA)


def archive_members(files: DataFrame, suffix: str = ".csv") -> DataFrame:
    """``path, member, found`` of listed archives: members with the suffix, and how many the archive has; a null member if none."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with open_file(path) as f, zipfile.ZipFile(f) as z:
                    names = [i.filename for i in z.infolist() if i.filename.lower().endswith(suffix)]
                out += [(path, n, len(names)) for n in names or [None]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())],
                names=["path", "member", "found"])

    return files.select("path").mapInArrow(members, "path string, member string, found long")


def member_batches(path: str, member: str, columns: Sequence[str], sep: str, encoding: str) -> Iterator[pa.RecordBatch]:
    """Rows of one delimited member as text, a block at a time, bound by name; another header or a ragged row raises."""
    with open_file(path) as f, zipfile.ZipFile(f) as z, z.open(member) as stream:
        try:
            reader = pc.open_csv(
                stream, pc.ReadOptions(block_size=BLOCK_BYTES, encoding=encoding, use_threads=False),
                pc.ParseOptions(delimiter=sep, newlines_in_values=True), pc.ConvertOptions(column_types=dict.fromkeys(columns, pa.string())))
            if sorted(reader.schema.names) != sorted(columns):
                raise ValueError(f"archive header breaks the contract: {path} {member}")
            for batch in reader:
                yield batch.select(list(columns))
        except pa.ArrowInvalid as e:
            raise ValueError(f"ragged archive row or empty member: {path} {member}: {e}") from e


def archive_rows(
    files: DataFrame, columns: Sequence[str], suffix: str = ".csv", sep: str = ";", encoding: str = "utf8", members: int | None = 1,
) -> DataFrame:
    """Delimited members of listed archives (a column ``path``) to ``path, member, line`` and the contract's columns as text.

    Every member is a unit of work, read as a stream, so neither its size nor the archive's matters.  An archive
    with another number of members than ``members``, another header or a ragged row fails the job.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                if members is not None and unit["found"] != members:
                    raise ValueError(f"archive refused: {unit['found']} members: {unit['path']}")
                line = 1
                for rows in member_batches(unit["path"], unit["member"], columns, sep, encoding) if unit["member"] else ():
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([unit["path"]] * n, pa.string()), pa.array([unit["member"]] * n, pa.string()), pa.array(range(line, line + n), pa.int64()), *rows.columns],
                        names=["path", "member", "line", *columns])
                    line += n

    schema = f"path string, member string, line long, {', '.join(f'`{c}` string' for c in columns)}"
    return dealt(materialize(archive_members(files, suffix), "members"), "path", "member").mapInArrow(unpack, schema)


def locate_header(cells: DataFrame, sentinels: Sequence[str]) -> DataFrame:
    """First row per sheet that holds every sentinel name: ``(path, sheet, header_row)``."""
    found = cells.filter(F.col("text").isin(*sentinels)).groupBy("path", "sheet", "row").agg(
        F.size(F.collect_set("text")).alias("n")
    )
    return (
        found.filter(F.col("n") == len(sentinels))
        .groupBy("path", "sheet")
        .agg(F.min("row").alias("header_row"))
    )


def bind_headers(cells: DataFrame, sentinels: Sequence[str], depth: int = 1) -> DataFrame:
    """Body cells with the name of their column; ``depth=2`` also binds merged group names.

    A merged group name stands only over its first column, so it is carried right along
    the header row.  The window runs over one header row of a sheet (at most 16,384 cells
    by the file format), never over body rows.
    The cells are read several times: pass a written table, not the unpacking itself.
    Result: ``path, sheet, row, col, group, name, text``.
    """
    at = locate_header(cells, sentinels)
    placed = cells.join(at, ["path", "sheet"], "inner")
    top = placed.filter(F.col("row") == F.col("header_row"))
    body = placed.filter(F.col("row") >= F.col("header_row") + depth)
    if depth == 1:
        names = top.select("path", "sheet", "col", F.lit(None).cast("string").alias("group"), F.col("text").alias("name"))
    else:
        last = placed.filter(F.col("row") == F.col("header_row") + depth - 1).select(
            "path", "sheet", "col", F.col("text").alias("under"))
        along = Window.partitionBy("path", "sheet").orderBy("col")
        names = (
            top.select("path", "sheet", "col", F.col("text").alias("over"))
            .join(last, ["path", "sheet", "col"], "full_outer")
            .withColumn("group", F.last("over", ignorenulls=True).over(along))
            .select("path", "sheet", "col", "group", F.coalesce("under", "over").alias("name"))
        )
    return body.join(names, ["path", "sheet", "col"], "inner").select(
        "path", "sheet", "row", "col", "group", "name", "text")
