"""One query per operator on its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, filter_audit, grid_join, jaccard_join, line_dedup, packing, perplexity, pii, quality_model, substring_dedup, token_binary, token_counts, whitening
from .tables import documents, table

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


@query("op1_token_counts")
def token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, merged rank by rank."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_token_binary")
def token_binary_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded id matrices of all documents, best fit decreasing; one row per sequence, ids and positions as checksums."""
    packed = token_binary.packed_matrices(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_binary.matrix_digest(packed)


@query("op6_packing")
def packing_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens."""
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op8_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, {_KEY} AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT r, doc_id, line, pos, key IN (SELECT key FROM bad) AS dropped FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""")
def line_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more leave every document."""
    kept = line_dedup.drop_shared_lines(documents(spark, sf_dir), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op10_decontamination", f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i : i + least(13, len(ws)) - 1] AS w, least(13, len(ws)) AS n
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spans AS (SELECT r, n, i, ws[i : i + n - 1] AS w
          FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
occ AS (SELECT s.r, s.i, s.n, win.item FROM spans s JOIN win ON s.w = win.w AND s.n = win.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def decontamination_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that verbatim windows of the benchmark cover."""
    return decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op4_substring_dedup", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS w
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (w)),
l AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT l.r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM l ANTI JOIN gone USING (r, p) GROUP BY l.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""")
def substring_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that are repeated anywhere leave every document."""
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_ngram_jaccard_join", rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i : array_to_string(ws[i : i + 2], ' '))) END AS s FROM d),
cls AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY 1, 3),
post AS (SELECT c, n, unnest(s) AS w FROM cls),
links AS (SELECT a.c AS a, b.c AS b FROM post a JOIN post b ON a.w = b.w AND a.c <> b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT c AS a, c AS b FROM cls UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN cls ON list_sort(sets.s) = cls.s LEFT JOIN comp USING (c)""")
def ngram_jaccard_join_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of nine tenths of their 3-word shingles connect."""
    return jaccard_join.similar_groups(documents(spark, sf_dir))


@query("op2_quality_classifier")
def quality_classifier_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every whole text, learnt from the labelled rows that are not held out."""
    return quality_model.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op7_quality_rules")
def quality_rules_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every whole text, and whether rules and perplexity bands keep it."""
    return perplexity.quality_rules(documents(spark, sf_dir))


@query("op5_personal_data")
def personal_data_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans and those the labelers add."""
    return pii.personal_data(documents(spark, sf_dir))


@query("op11_embedding_whitening")
def embedding_whitening_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 32 leading components of their covariance, each scaled to variance one."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op12_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x : x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x : x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM u UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a AS r, min(vec_id) AS c FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
deg AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept
FROM v LEFT JOIN comp USING (r) LEFT JOIN deg USING (r)""")
def embedding_near_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label that cosines of 0.93 or more connect."""
    return grid_join.near_copies(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 5 * length(w.text))::INT
             + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
      FROM w LEFT JOIN firsts ON w.text = firsts.text LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || x.letter || y.letter || e.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, e.bit] AS bits
      FROM f a, f b, f x, f y, f e WHERE a.bit | b.bit | x.bit | y.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(step)),
t AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM t""")
def filter_audit_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from every source, in every order in which they can be applied."""
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
