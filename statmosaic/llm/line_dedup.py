"""Lines that many documents share, found on hashes and returned as keep bitmaps.

DataFrame functions only.  The lines' 128-bit hashes are range-partitioned with a salt of the
document, sorted by document and position inside, and streamed: the first line of a document under
a hash opens a document, and the openings add up over the salts.  A hash held by a third of all
lines is thus spread over ``SALTS`` ranges and no group is ever brought together.

Defined cases: a null or empty text is one empty line; a line whose key is shorter than
``min_chars`` is never dropped; a document is a row, and rows equal in doc_id and text count as one
document (rows that share a doc_id alone are documents each), though each is returned; an empty table
gives an empty result; own columns of any name pass through, but for those the result's names replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tables import fresh, row_key

SALTS = 32
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; texts of ASCII alone take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, row, pos, h1, h2 of every line whose key has ``min_chars`` code points."""
    def hashed(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    keyed = docs.select("doc_id", row_key().alias("row"), F.posexplode(F.transform(lines_of(fold_ascii(F.col("text"))), hashed)).alias("pos", "h"))
    return keyed.where("h IS NOT NULL").select("doc_id", "row", "pos", "h.h1", "h.h2")


def streamed(lines: DataFrame) -> DataFrame:
    """Lines in order of hash, document and position, with ``opens``: the document's first under the hash."""
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int"))
    placed = spread.repartitionByRange("h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "row", "pos")
    before = F.lag(F.struct("doc_id", "row")).over(order)
    return placed.withColumn("opens", before.isNull() | ~before.eqNullSafe(F.struct("doc_id", "row")))


def shared_lines(lines: DataFrame, min_docs: int, first: bool = False) -> DataFrame:
    """Hashes found in ``min_docs`` documents at least; with ``first`` also their very first place."""
    place = [F.min(F.struct("doc_id", "row", "pos")).alias("first")] if first else []
    per_salt = streamed(lines).where("opens").groupBy("h1", "h2", "salt").agg(F.count(F.lit(1)).alias("n"), *place)
    place = [F.min("first").alias("first")] if first else []
    return per_salt.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), *place).where(F.col("n_docs") >= min_docs)


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, row, ``drops``: word number -> 64 bits, a set bit for a dropped line.

    Words without a dropped line are left out, as are documents that keep every line: the keep
    bitmap is the complement.  ``keep_first`` spares the very first place of each shared line.
    """
    lines = materialize(line_hashes(docs, min_chars), "line-hashes")
    shared = materialize(shared_lines(lines, min_docs, keep_first), "shared-lines")
    hit = lines.join(shared, ["h1", "h2"])
    if keep_first:
        hit = hit.where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first")))
    bits = hit.select("doc_id", "row", (F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    per_word = bits.repartition("doc_id", "row").groupBy("doc_id", "row", "word").agg(F.bit_or("bit").alias("bits"))
    return per_word.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


RESULT = ("kept_text", "n_lines", "n_dropped")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, names: tuple[str, str, str] = RESULT) -> DataFrame:
    """The documents with their kept text, number of lines and of dropped lines beside their own columns.

    The new columns are called ``names``; own columns of these names give way to them.
    """
    # the bitmaps grow with the corpus, so they meet the texts by a merge at every size and are never broadcast
    doc, row, drops, own_row = fresh(docs, "doc", "row", "drops", "own_row")
    bitmaps = materialize(drop_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep_first), "line-bitmaps").toDF(doc, row, drops)
    marked = docs.withColumn(own_row, row_key())
    joined = marked.join(bitmaps.hint("merge"), marked["doc_id"].eqNullSafe(bitmaps[doc]) & (marked[own_row] == bitmaps[row]), "left")
    lines = lines_of(F.col("text"))
    zero = F.lit(0).cast("bigint")

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.try_element_at(F.col(drops), F.floor(i / 64).cast("int")), zero)
        return F.call_function("shiftright", mask, (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == zero

    kept = F.filter(lines, stays)
    dropped = F.aggregate(F.map_values(drops), zero, lambda a, x: a + F.bit_count(x))
    return joined.select(
        *[marked[c] for c in docs.columns if c.lower() not in {n.lower() for n in names}],
        F.when(F.col(drops).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(names[0]),
        F.size(lines).cast("bigint").alias(names[1]),
        F.coalesce(dropped, zero).alias(names[2]))
