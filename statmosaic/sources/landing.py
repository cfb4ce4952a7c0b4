"""Published pages, landed files and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_markup
from ..operators.windows import top_per_key
from .opening import open_file

# Bytes of a file that a task holds while it hashes it.
HASHED_BYTES = 1 << 20

LINK_PATTERN = r"""(?is)<a\s[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Anchors of whole pages: address (entities decoded) and visible label.

    A page is searched once for whole anchors; their parts are read from the short matches.
    """
    keep = [c for c in pages.columns if c != html]
    anchors = pages.select(*keep, F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK_PATTERN), F.lit(0))).alias("_a"))
    return anchors.select(
        *keep, F.replace(F.regexp_extract("_a", LINK_PATTERN, 1), F.lit("&amp;"), F.lit("&")).alias("href"),
        strip_markup(F.regexp_extract("_a", LINK_PATTERN, 2)).alias("label"),
    )


def absolute(base: Column, href: Column) -> Column:
    """Address of a link relative to the root of its page's host."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(root, href))


def official_links(links: DataFrame, host_pattern: str, path_pattern: str, schemes: Sequence[str] = ("https",)) -> DataFrame:
    """Links on official hosts and schemes whose path names an edition (first group of the pattern)."""
    u = F.col("url")
    scheme = F.regexp_extract(u, r"^([a-z]+)://", 1)
    host = F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return links.filter(scheme.isin(*schemes) & host.rlike(host_pattern) & path.rlike(path_pattern)).withColumn(
        "edition", F.regexp_extract(path, path_pattern, 1)
    )


def newest_edition(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Link with the newest edition per key; equal editions resolve to the smallest address.

    Links are reduced to distinct editions by hash before texts are compared, and only addresses of the newest are ordered.
    """
    keyed = links.withColumn("_key", F.struct(*keys))
    newest = keyed.select("_key", "edition").distinct().groupBy("_key").agg(F.max("edition").alias("edition"))
    last = keyed.join(newest, ["_key", "edition"], "left_semi")
    return top_per_key(last, keys, [F.col("url")]).select(*keys, "edition", "url")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Landed files with size, time and content hash."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                F.sha2("content", 256).alias("sha256"))
    )


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Landed files with size and time only; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


MANIFEST = "path string, size long, modified timestamp, sha256 string"


def refreshed_manifest(spark: SparkSession, path: str, manifest: DataFrame, glob: str = "*") -> DataFrame:
    """Inventory of a folder that opens only what the manifest does not know: ``path, size, modified, sha256, opened``.

    Files are listed without being read and joined with the manifest.  A file of known path, size and time keeps its
    hash; the others are opened by path inside the tasks of the same job and hashed piece by piece.
    Files that have left the folder leave the inventory.
    """
    known = manifest.select("path", "size", "modified", "sha256")
    listed = listing(spark, path, glob).join(known, ["path", "size", "modified"], "left")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, opened = batch.column("sha256").to_pylist(), []
            for i, name in enumerate(batch.column("path").to_pylist()):
                opened.append(digests[i] is None)
                if opened[i]:
                    with open_file(name) as f:
                        digest = hashlib.sha256()
                        while piece := f.read(HASHED_BYTES):
                            digest.update(piece)
                    digests[i] = digest.hexdigest()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("path", "size", "modified")), pa.array(digests, pa.string()), pa.array(opened, pa.bool_())],
                names=["path", "size", "modified", "sha256", "opened"])

    return listed.mapInArrow(hashed, f"{MANIFEST}, opened boolean")


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, size, hash) is not in the manifest; empty means: skip the run."""
    return current.join(manifest.select("path", "size", "sha256"), ["path", "size", "sha256"], "left_anti")


def export_csv(df: DataFrame, path: str, columns: Sequence[str], sep: str = ";") -> None:
    """Tidy export: exact columns in order, header in every file, empty text for null, blanks kept."""
    (
        df.select(*columns).write.option("header", "true").option("sep", sep).option("escape", '"')
        .option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    )


def write_snapshot(df: DataFrame, path: str, partition: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Canonical snapshot sink: columnar, or JSON lines for document readers."""
    df.write.partitionBy(*partition).format(fmt).save(path)


def land_raw(df: DataFrame, path: str, payload: str = "payload") -> None:
    """Raw responses under their own content hash, so equal content lands once per source."""
    hashed = df.withColumn("digest", F.substring(F.sha2(F.col(payload), 256), 1, 12))
    hashed.dropDuplicates(["source_id", "digest"]).write.partitionBy("source_id").parquet(path)


def write_features(df: DataFrame, path: str, feature: str = "feature") -> None:
    df.select(F.col(feature).alias("value")).write.text(path)
