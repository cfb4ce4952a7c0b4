"""Text Column factories: folding, codes, labels, links."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters and their bare letters, derived from Unicode itself."""
    src, dst = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BARE = _latin_folds()


def unaccent(c: Column) -> Column:
    """Drop combining marks and bare every precomposed Latin letter; plain ASCII passes untouched."""
    bare = F.translate(F.regexp_replace(c, r"\p{M}+", ""), _ACCENTED, _BARE)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(bare)


def fold(c: Column) -> Column:
    """Key form of a name: no accents, upper case, single blanks."""
    return F.trim(F.regexp_replace(F.upper(unaccent(c)), r"\s+", " "))


def header_key(name: str) -> str:
    """Normal form of a column header (driver side, one call per column)."""
    bare = "".join(
        c for c in unicodedata.normalize("NFKD", name.lstrip("﻿")) if not unicodedata.combining(c)
    )
    return re.sub(r"[^a-z0-9]", "", bare.lower())


def is_digits(c: Column, n: int | None = None) -> Column:
    return c.rlike(rf"^\d{{{n}}}$" if n else r"^\d+$")


def pad_code(c: Column, n: int) -> Column:
    """Restore leading zeros; anything non-numeric or over-long becomes null."""
    t = F.trim(c)
    return F.when(is_digits(t) & (F.length(t) <= n), F.lpad(t, n, "0"))


def is_year(c: Column) -> Column:
    return c.rlike(r"^\d{4}$")


def is_year_month(c: Column) -> Column:
    return c.rlike(r"^20\d{2}(0[1-9]|1[0-2])$")


def short_label(c: Column) -> Column:
    """Label without its dotted hierarchical number."""
    number = F.substring_index(c, "-", 1)
    numbered = c.contains("-") & F.forall(F.split(F.rtrim(number), r"\."), lambda part: part.rlike("^[0-9]+$"))
    return F.when(numbered, F.ltrim(F.substr(c, F.length(number) + 2))).otherwise(c)


def ellipsis(c: Column, n: int = 22) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def join_nonblank(sep: str, *cols: Column) -> Column:
    """Join parts, skipping null and blank ones."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def relabel(c: Column, exact: Mapping[str, str], prefixes: Sequence[tuple[str, str]] = ()) -> Column:
    """Title-cased label through an exact map, then by prefix; unmatched is null."""
    t = F.initcap(F.trim(c))
    out = F.lit(None).cast("string")
    for start, label in reversed(list(prefixes)):
        out = F.when(t.startswith(start), F.lit(label)).otherwise(out)
    for name, label in reversed(list(exact.items())):
        out = F.when(t == name, F.lit(label)).otherwise(out)
    return out


def latest_year_in(c: Column) -> Column:
    """Largest 20xx year written in a text, not part of a longer number."""
    years = F.regexp_extract_all(c, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def pipe_list(c: Column) -> Column:
    return F.array_join(F.array_sort(c), " | ")


def query_url(base: Column, params: Mapping[str, Column]) -> Column:
    """Request address with encoded parameters, for provenance columns."""
    parts = [F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(base, F.lit("?"), F.concat_ws("&", *parts))


def mentions(c: Column, name: str, state: str) -> Column:
    """Is ``NAME (STATE)`` listed, and not as the tail of a longer name?"""
    return fold(c).rlike(rf"(?<![A-Z]){re.escape(name)}\s*\({re.escape(state)}\)")


def strip_markup(c: Column) -> Column:
    """Visible text of an HTML fragment: tags dropped, basic entities decoded."""
    t = F.regexp_replace(c, r"<[^>]*>", "")
    # fixed values: the entities decoded; the ampersand must come last
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.trim(t)


def search_match(cols: Sequence[Column], needle: str) -> Column:
    """Accent- and case-insensitive containment over several columns."""
    wanted = unaccent(F.lit(needle.strip()))
    return F.contains(F.lower(unaccent(F.concat_ws(" ", *cols))), F.lower(wanted))
