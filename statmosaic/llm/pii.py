"""Personal data: exact base spans, and further spans that weak labelers agree on.

DataFrame functions only.  Base spans come from fixed patterns with checks.  Further candidates (credentials, phone
numbers without a plus sign, spelled-out addresses) come from loose patterns; a regex, a gazetteer and context
labelers vote on every candidate and every base span.  Spark counts the vote patterns (at most one for each
combination of votes), expectation-maximisation over these counts estimates how reliable each labeler is, with base spans as
known truth, and the posteriors train a naive Bayes classifier on span features, again from Spark's sums.

Positions: text is split by the pattern and the lengths of pieces and matches are added up, in code points.
Patterns begin only where a run begins and never give back what they took, so long runs cost their length.

Defined cases: a null or empty text has no span; repeated rows are judged each; candidates that overlap a base
span are left out; without candidates only base spans are returned; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# kinds in the order of the contract; what the method adds comes last
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    EMAIL: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    PHONE: r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    SECRET: r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
CUES = {
    EMAIL: r"(mail|contact|write)[^a-z0-9]*$", IP: r"(ip|host|server|addr|address)[^a-z0-9]*$", CARD: r"(card|visa|account|credit)[^a-z0-9]*$",
    PHONE: r"(tel|phone|call|fax|mobile|whatsapp)[^a-z0-9]*$", SECRET: r"(token|secret|passw(or)?d|key|auth|bearer)[^a-z0-9]*$"}
LISTED = {
    EMAIL: r"[. ](com|org|net|edu|gov|io|de|fr|es|uk|info)$", IP: r"^([1-9][0-9]?|1[0-9]{2}|2[0-2][0-9])\.", CARD: r"^[3-6]",
    PHONE: r"^(\+(1|33|34|44|49)|\(?[2-9])", SECRET: r"^([0-9a-f]{32,}|[0-9A-F]{32,}|(sk|pk|ghp|xox)[_-])"}
LABELERS = 5
CONTEXT = 24
# Elements that are folded into one growing array.
BLOCK = 512
_SPAN = "struct<kind:int,start:int,end:int,match:string,left:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``step`` makes of all elements before it, in order; ``items`` is a bound value.

    Elements are folded by blocks of ``BLOCK``: an array that grows is copied only as long as a block, or as the
    number of blocks, so many elements cost little more than each of them.
    """
    empty = F.array().cast("array<int>")

    def scan(values: Column, first: Column, fold: Callable[[Column, Column], Column]) -> Column:
        state = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(values, state, lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def folded(blocks: Column) -> Column:
        firsts = scan(blocks, start, lambda a, block: F.aggregate(block, a, step))
        return F.flatten(F.zip_with(blocks, firsts, lambda block, first: scan(block, first, step)))

    blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda i: F.slice(items, i, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, let(blocks, folded)).otherwise(empty)


def spans(text: Column, pattern: str, kind: int, holds: Callable[[Column], Column] | None = None) -> Column:
    """Matches of the pattern, leftmost and apart, that hold, with their places and what stands before them."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s, m: F.struct(s.alias("s"), m.alias("m")))

    def placed(pieces: Column) -> Column:
        # places are added up over all matches; only those that hold become spans
        ends = running(pieces, F.lit(0), lambda a, x: a + F.char_length(x["s"]) + F.char_length(x["m"]))
        return F.zip_with(pieces, ends, lambda x, at: F.struct(x["s"].alias("s"), x["m"].alias("m"), (at + F.char_length(x["s"])).alias("start")))

    found = let(F.filter(pieces, lambda x: x["m"].isNotNull()), placed)
    if holds is not None:
        found = F.filter(found, lambda x: holds(x["m"]))
    return F.transform(found, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["m"])).alias("end"), x["m"].alias("match"), F.right(x["s"], F.lit(CONTEXT)).alias("left")))


def apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` that overlap none of ``base``: one merge by start, once from the left and once from the right."""
    def mark(spans: Column, own: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x.alias("x")))

    def free(merged: Column) -> Column:
        reach = running(merged, F.lit(-1), lambda a, e: F.when(e["own"] == 0, F.greatest(a, e["end"])).otherwise(a))
        later = let(F.reverse(merged), lambda m: F.reverse(running(m, F.lit(2**31 - 1), lambda a, e: F.when(e["own"] == 0, F.least(a, e["start"])).otherwise(a))))
        past = F.zip_with(merged, reach, lambda e, r: F.struct(e["x"].alias("x"), ((e["own"] == 1) & (r <= e["start"])).alias("free")))
        both = F.zip_with(past, later, lambda y, n: F.struct(y["x"].alias("x"), (y["free"] & (n >= y["x"]["end"])).alias("free")))
        return F.transform(F.filter(both, lambda y: y["free"]), lambda y: y["x"])

    return F.when((F.size(found) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(mark(base, 0), mark(found, 1))), free)).otherwise(found)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the mod-10 check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    digits = _digits(match)
    if kind == IP:
        def small(part: Column) -> Column:
            number = F.ltrim(part, F.lit("0"))
            return F.when(F.length(number) <= 3, F.concat(F.lit("0"), number).cast("int") <= 255).otherwise(False)

        return F.forall(F.split(match, r"\."), small)
    if kind == CARD:
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _guard(kind: int, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == EMAIL:
        return text.contains("@")
    if kind == PHONE:
        return text.contains("+")
    return text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")

    def valid(kind: int) -> Callable[[Column], Column]:
        return lambda match: _valid(kind, match)

    return F.concat(*[F.when(_guard(k, text), spans(text, p, k, valid(k))).otherwise(none) for k, p in BASE.items()])


def loose_spans(text: Column) -> Column:
    none = F.array().cast(f"array<{_SPAN}>")
    guards = {EMAIL: text.rlike(r"[(\[]at[)\]]"), PHONE: text.rlike("[0-9]{4}"), SECRET: text.rlike("[0-9]")}
    return F.concat(*[F.when(guards[k], spans(text, p, k)).otherwise(none) for k, p in LOOSE.items()])


def _by_kind(kind: Column, values: dict[int, Column], other: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(other)


def votes(x: Column, base: bool) -> Column:
    """Votes of the labelers on a span, as text: + yes, - no, 0 nothing to say."""
    match, left, kind = x["match"], F.lower(x["left"]), x["kind"]
    said = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    share = F.length(_digits(match)) / F.length(match)
    shape = F.lit("+") if base else _by_kind(kind, {
        EMAIL: said(match.rlike("dot"), F.lit(False)),
        PHONE: said(match.rlike(r"^\([0-9]{3}\) |^[0-9]{3}[.-]"), F.lit(False)),
        SECRET: said(match.rlike("^([0-9a-f]{32,64}|[0-9A-F]{32,64})$"), ~match.rlike("[0-9].*[0-9].*[0-9].*[0-9]"))}, F.lit("0"))
    listed = said(_by_kind(kind, {k: F.lower(match).rlike(p) if k == EMAIL else match.rlike(p) for k, p in LISTED.items()}, F.lit(False)), F.lit(True))
    cue = said(_by_kind(kind, {k: left.rlike(p) for k, p in CUES.items()}, F.lit(False)), F.lit(False))
    assigned = said(left.rlike("""[=:][ ]*["']?$"""), (kind == SECRET) & left.rlike("[a-z] $"))
    density = F.lit("+") if base else _by_kind(kind, {SECRET: said(share.between(0.2, 0.95), F.lit(True)), PHONE: said(F.length(_digits(match)) == 10, F.lit(True))}, said(F.length(match) <= 64, F.lit(True)))
    return F.concat(shape, listed, cue, assigned, density)


def span_features(x: Column) -> Column:
    """Discrete features of a candidate, each named with its kind."""
    match, left, kind = x["match"], F.lower(x["left"]), x["kind"].cast("string")
    share = F.floor(F.length(_digits(match)) * 5 / F.length(match)).cast("string")
    size = F.least(F.floor(F.length(match) / 8), F.lit(10)).cast("string")
    flag = lambda c: c.cast("int").cast("string")
    cue = _by_kind(x["kind"], {k: left.rlike(p) for k, p in CUES.items()}, F.lit(False))
    parts = {"digits": share, "size": size, "cue": flag(cue), "quote": flag(left.rlike("""["']$""")), "equals": flag(left.rlike("[=:]")),
             "hex": flag(match.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "word": flag(match.rlike("[A-Za-z]{9}"))}
    return F.array(*[F.concat(kind, F.lit(f" {n} "), v) for n, v in parts.items()])


def labeler_posteriors(patterns: list[tuple[int, bool, str, int]], rounds: int = 60) -> dict[tuple[int, bool, str], float]:
    """Expectation-maximisation over counted vote patterns (kind, base, votes, n): each pattern's probability.

    A labeler that has nothing to say is no evidence.  One that votes is right with a probability of its own for each
    kind, a coin's at least; votes are independent given the truth; base spans are true; a kind's share of true
    candidates is its own.
    """
    start = {"+": 1.0, "-": -1.0, "0": 0.0}
    p = {(kind, base, vote): 1.0 if base else 1 / (1 + math.exp(-sum(start[v] for v in vote))) for kind, base, vote, _ in patterns}
    for _ in range(rounds):
        right: dict[tuple[int, int], list[float]] = {}
        share: dict[int, list[float]] = {}
        for kind, base, vote, n in patterns:
            q = p[kind, base, vote]
            for i, v in enumerate(vote):
                if v != "0":
                    yes, no = right.setdefault((kind, i), [4.0, 1.0])  # trusted four to one before any evidence
                    agreed = q if v == "+" else 1 - q
                    right[kind, i] = [yes + n * agreed, no + n * (1 - agreed)]
            if not base:
                yes, no = share.setdefault(kind, [1.0, 1.0])
                share[kind] = [yes + n * q, no + n * (1 - q)]
        for kind, base, vote, _ in patterns:
            if not base:
                odds = math.log(share[kind][0] / share[kind][1])
                for i, v in enumerate(vote):
                    if v != "0":
                        yes, no = right[kind, i]
                        odds += start[v] * max(math.log(yes / no), 0.0)
                p[kind, base, vote] = 1 / (1 + math.exp(-max(min(odds, 500.0), -500.0)))
    return p


def _weights(sums: list[tuple[str, float, float]]) -> dict[str, float]:
    """Log ratios of features from their sums (feature, yes, no), with one of each added."""
    by_name: dict[str, list[float]] = {}
    for feature, yes, no in sums:
        total = by_name.setdefault(feature.rsplit(" ", 1)[0], [0.0, 0.0, 0.0])
        by_name[feature.rsplit(" ", 1)[0]] = [total[0] + yes, total[1] + no, total[2] + 1]
    out = {}
    for feature, yes, no in sums:
        all_yes, all_no, many = by_name[feature.rsplit(" ", 1)[0]]
        out[feature] = math.log((yes + 1) / (all_yes + many)) - math.log((no + 1) / (all_no + many))
    for name, (yes, no, _) in by_name.items():  # the share of the kind, once
        out.setdefault(name.split(" ")[0], math.log((yes + 1) / (no + 1)))
    return out


def _listed(items: Column) -> Column:
    """kind:start:end of spans, by start, then kind."""
    ordered = F.sort_array(F.transform(items, lambda x: F.struct(x["start"].alias("s"), x["kind"].alias("k"), x["end"].alias("e"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and further candidates with votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), loose_spans(F.col("text")).alias("loose"))
    found = found.select("doc_id", "base", apart(F.col("loose"), F.col("base")).alias("loose"))
    lasting = lambda x, base: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes(x, base).alias("votes"), span_features(x).alias("features"))
    return found.select("doc_id", F.transform("base", lambda x: lasting(x, True)).alias("base"), F.transform("loose", lambda x: lasting(x, False)).alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every document."""
    found = materialize(candidates(docs), "span-candidates")
    each = found.select(F.explode("base").alias("x"), F.lit(True).alias("base")).union(found.select(F.explode("added"), F.lit(False)))
    counted = each.groupBy("x.kind", "base", "x.votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds * 2 * 3^LABELERS rows
    posterior = labeler_posteriors(sorted((r["kind"], r["base"], r["votes"], r["n"]) for r in counted))
    learnt = {f"{k} {v}": p for (k, base, v), p in posterior.items() if not base}
    score = F.lit(-1.0)
    if learnt:
        soft = F.create_map(*[c for k, p in learnt.items() for c in (F.lit(k), F.lit(p))])
        taught = found.select(F.explode("added").alias("x")).select("x.features", F.element_at(soft, F.concat(F.col("x.kind").cast("string"), F.lit(" "), F.col("x.votes"))).alias("p"))
        sums = taught.select(F.explode("features").alias("feature"), "p").groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
        weights = _weights(sorted((r["feature"], r["yes"], r["no"]) for r in sums))
        table = F.create_map(*[c for k, w in weights.items() for c in (F.lit(k), F.lit(w))])
        score = None

    def holds(x: Column) -> Column:
        if score is not None:
            return score > 0
        total = F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return total + F.coalesce(F.try_element_at(table, x["kind"].cast("string")), F.lit(0.0)) > 0

    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.concat("base", F.filter("added", holds))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
