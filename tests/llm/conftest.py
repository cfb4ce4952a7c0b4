"""Awkward documents, and the words, shingles and windows that plain Python finds in them."""

import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, row string, label int, hits string"


def words(text):
    return WHITE.findall(text or "")


@pytest.fixture(scope="session")
def awkward_rows():
    """(doc_id, text, lang): nulls, empties, white space, long texts, copies, near copies, shared lines and passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 9))) for _ in range(600)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, line = prose(60), "Shared LINE of the corpus"
    long_text = prose(9000)
    template = prose(160).split(" ")
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "one", "en"), (5, "One", "en"), (6, "two words", "fr"), (7, "\n\n\n", "en"),
        (8, long_text, "en"), (9, long_text, "en"), (10, long_text[:20000] + prose(500), "en"),
        (11, "x" * 300_000, "de"), (12, "y " * 3000, "de"), (13, prose(40) + " " + passage + " " + prose(40), "en"),
        (14, passage + "\n" + prose(20), "es"), (15, prose(300), "en"), (15, prose(310), "en"), (16, prose(200), "fr"), (16, None, "fr"),
        (None, prose(80), "en"), (None, None, None), (17, "\x1c\x1d odd\x85white　space   here", "en"),
        (18, "a b c a b c a b c a b c", "en"), (19, "Emoji \U0001F600 and 文字 Ünïcode ÀÉ", "xx")]
    rows += [(20 + i, f"{prose(12)}\n  {line if i % 2 else line.upper()}  \n{prose(9)}\n", "en") for i in range(14)]
    rows += [(40, rows[15][1], "en")] * 3  # one row three times, and a copy of another document
    rows += [(60 + i, " ".join(template[:k] + ["changed%d" % i] + template[k + 1 :]), "en") for i, k in enumerate(range(3, 150, 7))]
    return rows


def frame_of(spark, rows, parts=4):
    """Documents with further columns whose names operators use inside."""
    full = [(d, t, g, "src", len(t or ""), 3, "key", "row", 1, "hits") for d, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return frame_of(spark, awkward_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame_of(spark, [])


@pytest.fixture(scope="session")
def given(spark):
    """Documents of the smallest given tables."""
    path = "/root/testdata/sf0.001"
    if not Path(path).is_dir():
        pytest.skip("given tables are absent")
    return spark.read.parquet(f"{path}/documents.parquet")


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
