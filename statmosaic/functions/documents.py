"""JSON documents: canonical digests, volatile keys, key walks over schemas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: keys that change at every collection without a change of content
VOLATILE = ("collectedAt", "attemptedAt", "lastSuccessAt")


def canonical_json(cols: Sequence[str]) -> Column:
    """JSON of the named columns in key order; nulls are written, so absence counts."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def digest(cols: Sequence[str]) -> Column:
    return F.sha2(canonical_json(cols), 256)


def content_digest(df: DataFrame, volatile: Sequence[str] = VOLATILE) -> Column:
    """Row digest that ignores collection dates."""
    return digest([c for c in df.columns if c not in volatile])


def without_volatile(df: DataFrame, volatile: Sequence[str] = VOLATILE) -> DataFrame:
    return df.drop(*volatile)


def field_paths(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    """Every field of a schema with its dotted path; ``[]`` marks array elements."""
    for field in schema.fields:
        yield from _walk(field.dataType, f"{prefix}{field.name}")


def _walk(kind: T.DataType, path: str) -> Iterator[tuple[str, T.DataType]]:
    yield path, kind
    if isinstance(kind, T.StructType):
        yield from field_paths(kind, path + ".")
    elif isinstance(kind, T.ArrayType):
        yield from _walk(kind.elementType, path + "[]")
    elif isinstance(kind, T.MapType):
        yield from _walk(kind.valueType, path + "{}")


def variant_number(doc: Column, path: str) -> Column:
    """Typed extraction from a JSON text; malformed or absent is null."""
    return F.try_variant_get(F.try_parse_json(doc), path, "double")


def entries_of(c: Column) -> Column:
    """Map entries in key order."""
    return F.array_sort(F.map_entries(c))
