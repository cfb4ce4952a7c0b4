"""Delimited files under column contracts.

A header is compared by normalised name, as a set; rows are bound by name.  The first line of
every file is read in tasks before the load, so files of one load may order their columns
differently.  The reader checks each header again (``enforceSchema=false``), and a ragged row
fails the scan (``FAILFAST`` with CSV column pruning off, which would otherwise skip the check).
"""

from __future__ import annotations

import csv
import functools
import io
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, header_key
from .opening import open_plain


class ContractError(ValueError):
    """A file does not have the columns it is published with."""


@dataclass(frozen=True)
class Layout:
    """Columns and dialect of one edition of a publication."""

    columns: tuple[str, ...]
    sep: str = ";"
    encoding: str = "UTF-8"
    exact: bool = True
    null_value: str = ""
    options: Mapping[str, str] = field(default_factory=dict)


# fixed values: what Spark's reader and writer take in any session
_SPARK_CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")
_BYTES = "ISO-8859-1"


@functools.cache
def code_page(encoding: str) -> str | None:
    """Characters of the 256 bytes of a code page over ASCII that Spark does not take itself (a byte without one: U+FFFD); else null.

    Files of such a page are read and written as ISO-8859-1, which keeps every byte, and their texts are translated.
    """
    if encoding.lower() in _SPARK_CHARSETS:
        return None
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    if len(plane.encode(encoding, "ignore")) > 256:  # more than one byte a character
        return None
    page = bytes(range(256)).decode(encoding, "replace")
    return page if page[:128] == "".join(map(chr, range(128))) else None


def _bytes_of(text: str, layout: Layout) -> str:
    """A text of the layout as the reader sees its bytes."""
    return text if code_page(layout.encoding) is None else text.encode(layout.encoding).decode(_BYTES)


def _decoded(c: Column, layout: Layout) -> Column:
    page = code_page(layout.encoding)
    if page is None:
        return c
    own = [b for b in range(128, 256) if page[b] != chr(b)]
    return F.translate(c, "".join(map(chr, own)), "".join(page[b] for b in own))


def _encoded(c: Column, layout: Layout) -> Column:
    """Texts whose ISO-8859-1 bytes are those of the layout; what its page lacks is a question mark."""
    page = code_page(layout.encoding)
    if page is None:
        return c
    moved = {page[b]: chr(b) for b in range(128, 256) if page[b] not in (chr(b), "\ufffd")}
    moved |= {chr(b): "?" for b in range(128, 256) if chr(b) not in page}
    return F.translate(c, "".join(moved), "".join(moved.values()))


def _dialect(layout: Layout) -> dict[str, str]:
    given = {"sep": layout.sep, "escape": '"', **layout.options}  # a doubled quote is a quote
    encoding = layout.encoding if code_page(layout.encoding) is None else _BYTES
    return {"encoding": encoding, **{k: _bytes_of(v, layout) for k, v in given.items()}}


def _reader(spark: SparkSession, layout: Layout):
    return spark.read.option("nullValue", _bytes_of(layout.null_value, layout)).options(**_dialect(layout))


def write_contract(df: DataFrame, path: str, layout: Layout) -> None:
    """Text columns named by a layout as files of its dialect."""
    named = df.select(*[_encoded(F.col(f"`{c}`"), layout).alias(_bytes_of(c, layout)) for c in layout.columns])
    named.write.option("header", "true").options(**_dialect(layout)).csv(path)


def file_headers(spark: SparkSession, path: str | Sequence[str], layout: Layout) -> DataFrame:
    """``path, header, problem`` of every file of a load.

    Files are listed by Spark without being read; tasks open each one and take its first line only.  ``header`` is split but not
    interpreted, so duplicates stay visible; ``problem`` says why a file breaks the contract, and is null where it keeps it.
    Files of no bytes have no place in a listing by Spark.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")
    unmarked = "utf-8-sig" if layout.encoding.lower() in ("utf-8", "utf8") else layout.encoding
    escape = layout.options.get("quote", '"')

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, problems = [], []
            for name in batch.column("path").to_pylist():
                header, problem = [], "empty file"
                try:
                    with open_plain(name) as raw, io.TextIOWrapper(raw, encoding=unmarked, newline="") as text:
                        header = next(csv.reader(text, delimiter=layout.sep, quotechar=escape), [])
                    if header:
                        check_header(header, layout)
                        problem = None
                except (ContractError, UnicodeError) as e:
                    problem = str(e)
                headers.append(header)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array(headers, pa.list_(pa.string())), pa.array(problems, pa.string())], names=["path", "header", "problem"])

    return listed.mapInArrow(first_lines, "path string, header array<string>, problem string")


def header_violations(headers: DataFrame) -> DataFrame:
    """Gate over :func:`file_headers`: one violation for each file that breaks the contract, with its path."""
    return headers.where("problem IS NOT NULL").select(F.lit("header").alias("gate"), F.col("path").alias("key"), F.col("problem").alias("detail"))


def check_header(header: Sequence[str], layout: Layout) -> list[str]:
    """Normalised header in file order, or why it breaks the contract."""
    names = [header_key(h) for h in header]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ContractError(f"duplicate columns: {doubled}")
    wanted = {header_key(c) for c in layout.columns}
    missing, extra = sorted(wanted - set(names)), sorted(set(names) - wanted)
    if missing or (layout.exact and extra):
        raise ContractError(f"missing columns {missing}, unexpected columns {extra}")
    return names


def _literal(path: str) -> str:
    """A listed path as a pattern that means only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_contract(
    spark: SparkSession, path: str | Sequence[str], layout: Layout, select: Sequence[str] | None = None,
    with_path: bool = False,
) -> DataFrame:
    """All columns as text, named by their normal form, in contract (or ``select``) order.

    Files of one load may have their columns in any order: they are grouped by header, each header is one scan bound by
    name, and the scans are stacked.  A file that breaks the contract fails the load and is named; to load
    the others, pass the paths that :func:`file_headers` finds no problem with.
    ``with_path`` adds ``file_path``, from which publication and kind can be read.
    """
    # one row for each way of writing the header, however many files have it; readers take their files by path
    found = file_headers(spark, path, layout).groupBy("header", "problem").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    bad = sorted((p, r["problem"]) for r in found if r["problem"] is not None for p in r["paths"])
    if bad or not found:
        raise ContractError("; ".join(f"{p}: {why}" for p, why in bad[:5]) or f"no file: {path}")
    wanted = [header_key(c) for c in (select or layout.columns)]
    extra = [F.col("_metadata.file_path").alias("file_path")] if with_path else []
    scans = []
    for header, paths in sorted((r["header"], r["paths"]) for r in found):
        names = [_bytes_of(h, layout) for h in header]
        at = dict(zip(check_header(header, layout), names, strict=True))
        df = (
            _reader(spark, layout)
            .schema(T.StructType([T.StructField(h, T.StringType()) for h in names]))
            .option("header", "true")
            .option("enforceSchema", "false")
            .option("mode", "FAILFAST")
            .option("columnPruning", "false")
            .csv([_literal(p) for p in paths])
        )
        scans.append(df.select(*[_decoded(F.col(f"`{at[w]}`"), layout).alias(w) for w in wanted], *extra))
    return same_schema(scans)


def read_edition(
    spark: SparkSession, path: str | Sequence[str], edition: str, layouts: Mapping[str, Layout],
    select: Sequence[str] | None = None,
) -> DataFrame:
    """Contracted scan whose layout is looked up by edition; unknown editions fail."""
    if edition not in layouts:
        raise ContractError(f"no layout for edition {edition}")
    return read_contract(spark, path, layouts[edition], select).withColumn("edition", F.lit(edition))


def counted(df: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The same rows plus a count of all rows read, taken in the same pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def read_adaptive(
    spark: SparkSession, tables: Mapping[str, str], wide: str, key: Sequence[str], layouts: Mapping[str, Layout],
    active: str,
):
    """One legacy wide file, or the split tables merged on their key.

    ``tables`` maps part name to path; the wide layout applies when only ``wide`` is present.
    Returns the merged frame of :func:`operators.joins.merge_parts` in both cases.
    """
    from ..operators.joins import merge_parts

    parts = {name: read_contract(spark, path, layouts[name]) for name, path in tables.items()}
    if set(parts) == {wide}:
        return merge_parts(parts, key, active)
    if wide in parts:
        raise ContractError("wide file and split tables in one edition")
    return merge_parts(parts, key, active)


def same_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack dialects that were projected to one set of columns."""
    out = frames[0]
    for f in frames[1:]:
        if set(f.columns) != set(out.columns):
            raise ContractError(f"columns differ: {sorted(set(f.columns) ^ set(out.columns))}")
        out = out.unionByName(f)
    return out


def observation_dialects(
    annual: DataFrame | None, monthly: DataFrame | None, territories: DataFrame
) -> DataFrame:
    """Two vintages of an observation file as one table.

    Annual rows carry names only (``foco_id, data_pas, municipio, estado``); monthly
    rows carry a code (``id, data_hora_gmt, municipio_id``).  ``territories`` has
    ``code, name, state``; the name fallback compares folded name *and* state.
    """
    shape = ["id", "observed_at", "lat", "lon", "code"]
    out = []
    if annual is not None:
        named = territories.select("code", fold(F.col("name")).alias("_n"), fold(F.col("state")).alias("_s"))
        out.append(
            annual.withColumns({"_n": fold(F.col("municipio")), "_s": fold(F.col("estado"))})
            .join(named, ["_n", "_s"], "inner")
            .select(F.col("foco_id").alias("id"), F.col("data_pas").alias("observed_at"), "lat", "lon", "code")
        )
    if monthly is not None:
        coded = monthly.join(territories.select("code"), monthly["municipio_id"] == F.col("code"), "left_semi")
        out.append(
            coded.select(
                "id", F.col("data_hora_gmt").alias("observed_at"), "lat", "lon", F.col("municipio_id").alias("code")
            )
        )
    return same_schema([f.select(*shape) for f in out])


def read_with_rejects(spark: SparkSession, path: str, names: Sequence[str], sep: str = ";") -> DataFrame:
    """Rows and, instead of failing, the raw text of ragged ones in ``rejected``."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "rejected"]])
    return (
        spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "rejected").option("columnPruning", "false").csv(path)
    )


def drop_header_record(df: DataFrame, order: str = "row_index") -> DataFrame:
    """Flat statistical rows whose first row is a header record."""
    return df.filter(F.col(order) > 0)


def file_facts(df: DataFrame, pattern: str, names: Sequence[str], path: str = "_metadata.file_path") -> DataFrame:
    """Columns read from each row's file path through one pattern with named order."""
    return df.select("*", *[F.regexp_extract(F.col(path), pattern, i + 1).alias(n) for i, n in enumerate(names)])


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def family_to_rows(
    df: DataFrame, ids: Sequence[str], pattern: str, dims: Sequence[str], value: str = "value"
) -> DataFrame:
    """Unpivot the columns matching ``pattern``; its groups become the ``dims`` columns."""
    family = columns_like(df, pattern)
    if not family:
        raise ContractError(f"no column matches {pattern}")
    long = df.unpivot(list(ids), family, "_field", value)
    parts: list[Column] = [F.regexp_extract("_field", f"^(?:{pattern})$", i + 1).alias(d) for i, d in enumerate(dims)]
    return long.select(*ids, F.col("_field").alias("field"), *parts, value)
