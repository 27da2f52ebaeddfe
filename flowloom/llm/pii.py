"""Personal data by weak supervision, in built-in expressions only.

Labelers look at candidate spans: a *shape* labeler (patterns with checks such
as Luhn), a *gazetteer* labeler (known domains, titles, first names, words for
secrets), a *context* labeler (cue words to the left) and a *border* labeler
(what touches the span). Each says yes, no or nothing. How often each
combination of votes occurs is counted over all documents; expectation
maximisation on that table (at most 3**4 rows per kind) estimates how reliable
each labeler is and how likely each combination is personal data. The estimates
then train a naive Bayes classifier on features of the spans, again from counts.
Spans of the fixed base patterns always stay; the classifier adds others.

Texts are never exploded: candidates live in arrays on their document.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import cut_lineage, given_back, renamed

# Kinds in their output order, the base patterns (written so that
# each is matched without backtracking into a run; \G admits a match right
# after the last one), and the lists of the labelers.
KINDS = ["email", "ip", "card", "phone", "secret", "id", "iban", "name"]
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
EXTRA_NEEDS = r"[0-9=:]|[\[(][Aa][Tt][\])]|(?:Mr|Mrs|Ms|Dr|Prof)"
EXTRA = "|".join([
    rf"(?<![{LOCAL}])[{LOCAL}]++ ?[\[(][Aa][Tt][\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(][Dd][Oo][Tt][\])]) ?[A-Za-z0-9-]++)++",
    r"(?i:token|secret|password|passwd|api[_-]?key)[\"' ]{0,2}[=:][\"' ]{0,3}[A-Za-z0-9_/+.-]{8,}+",
    r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
])
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk"]
FIRST_NAMES = ["James", "Mary", "John", "Anna", "Peter", "Maria", "Paul", "Laura", "David", "Sarah", "Jean", "Marie", "Hans", "Jose", "Carlos", "Thomas"]
CUES = {
    "email": "e-?mail|mail|contact|write to", "ip": "ip|host|server|address|login", "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|fax|mobile|contact", "secret": "token|secret|password|passwd|key", "id": "ssn|social security|id|passport",
    "iban": "iban|bank|account|transfer", "name": "name|contact|dear|signed|author",
}
AGAINST = "version|isbn|issn|invoice|order|figure|page|line|chapter|section|ticket"
LABELERS = ("shape", "gazetteer", "context", "border")
YES, NO, NONE = 1, 0, 2
LEFT = 32


def _matches(text: Column, pattern: str) -> Column:
    """Array of (text, start, end) of the leftmost non-overlapping matches.

    Matches are put between two control characters and the text is split
    there; the same characters in the text itself were replaced before.
    """
    parts = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"),
                     F.array().cast("array<struct<m:string,start:int,end:int>>").alias("found"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        hit = F.struct(part.alias("m"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"),
                        F.when(acc["inside"], F.array_append(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def _none() -> Column:
    return F.array().cast("array<struct<m:string,start:int,end:int>>")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _extra_kind(m: Column) -> Column:
    return (
        F.when(m.rlike(r"^(?i:token|secret|password|passwd|api[_-]?key)[\"' ]{0,2}[=:]") | m.rlike("^[0-9a-f]{32,}+$"), "secret")
        .when(m.rlike(r"[\[(][Aa][Tt][\])]"), "email")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "id")
        .when(m.rlike("^[(]?[0-9]"), "phone").otherwise("name"))


def _labelled(text: Column, hit: Column, kind: Column, shape: Column, base: bool) -> Column:
    """A candidate with its votes and features."""
    left = F.lower(F.substr(text, F.greatest(hit["start"] - LEFT + 1, F.lit(1)), F.least(hit["start"], F.lit(LEFT))))
    m = hit["m"]
    cue = reduce(lambda acc, k: acc.when(kind == k, left.rlike(rf"(?<![a-z])(?:{CUES[k]})[^a-z]{{0,12}}$")), KINDS, F.when(F.lit(False), False))
    against = left.rlike(rf"(?<![a-z])(?:{AGAINST})[^a-z]{{0,8}}$")
    known = (
        F.when(kind == "email", F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS))
        .when(kind == "name", m.rlike("(?:" + "|".join(FIRST_NAMES) + ")") | m.rlike("^(?:Mr|Mrs|Ms|Dr|Prof)"))
        .when(kind == "secret", m.rlike("(?i)^(?:token|secret|password|passwd|api)"))
        .when(kind == "ip", ~m.rlike(r"^0|\.0\.0\.0$")))
    touch_left = F.substr(text, hit["start"], F.lit(1)).rlike("[0-9A-Za-z_]") & (hit["start"] > 0)
    touch_right = F.substr(text, hit["end"] + 1, F.lit(1)).rlike("[0-9A-Za-z_]")
    touches = F.coalesce(touch_left | touch_right, F.lit(False))
    n, digits = F.length(m), F.length(_digits(m))
    features = F.array(
        F.concat(F.lit("k"), kind),
        F.concat(F.lit("l"), F.floor(F.log2(n.cast("double"))).cast("int").cast("string")),
        F.concat(F.lit("d"), F.floor(digits * 4 / n).cast("int").cast("string")),
        F.concat(F.lit("s"), kind, F.when(shape, "1").otherwise("0")),
        F.concat(F.lit("t"), F.when(touches, "1").otherwise("0")),
        F.concat(F.lit("c"), F.when(cue, "1").otherwise("0")),
        F.concat(F.lit("g"), F.when(against, "1").otherwise("0")))
    return F.struct(
        kind.alias("kind"), hit["start"].alias("start"), hit["end"].alias("end"), F.lit(base).alias("base"),
        F.when(shape, YES).otherwise(NO).alias("shape"),
        F.when(known, YES).otherwise(NONE).alias("gazetteer"),
        F.when(against, NO).when(cue, YES).otherwise(NONE).alias("context"),
        F.when(touches, NO).otherwise(YES).alias("border"), features.alias("features"))


def _digit_count(low: int, high: int, m: Column) -> Column:
    return F.length(_digits(m)).between(low, high)


# Matches of a base pattern that are worth a vote though they fail its check.
NEAR = {"card": partial(_digit_count, 12, 19), "ip": lambda m: F.length(m) <= 20, "phone": partial(_digit_count, 7, 15)}


def _fails(kind: str, m: Column) -> Column:
    return ~_valid(kind, m) & NEAR[kind](m)


def _candidates_of(text: Column, hits: Column, kind: str, wanted, base: bool) -> Column:
    return F.transform(F.filter(hits, lambda h: wanted(h["m"])), lambda h: _labelled(text, h, F.lit(kind), F.lit(base), base))


def _count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_spans``: candidate spans with base flag, votes and features.

    NULL text counts as empty. Places are code points, ends exclusive.
    """
    raw = F.coalesce(text_col, F.lit(""))
    docs = docs.withColumn("_m_text", F.when(raw.rlike("[\u0001\u0002]"), F.translate(raw, "\u0001\u0002", "��")).otherwise(raw))
    text = F.col("_m_text")
    base, doubtful = [], []
    for kind, pattern in BASE.items():
        column = f"_m_{kind}"
        found = F.when(text.rlike(NEEDS[kind]), _matches(text, pattern)).otherwise(_none())
        docs = docs.withColumn(column, found)
        hits = F.col(column)
        base.append(_candidates_of(text, hits, kind, partial(_valid, kind), True))
        # What looks like the kind and fails its check is a candidate with a vote against it.
        if kind in NEAR:
            doubtful.append(_candidates_of(text, hits, kind, partial(_fails, kind), False))
    docs = docs.withColumn("_m_extra", F.when(text.rlike(EXTRA_NEEDS), _matches(text, EXTRA)).otherwise(_none()))
    extra = F.transform("_m_extra", lambda h: _labelled(text, h, _extra_kind(h["m"]), F.lit(True), False))
    return docs.withColumn("_spans", F.concat(*base, *doubtful, extra)).drop("_m_text", "_m_extra", *[f"_m_{k}" for k in BASE])


def vote_table(spans: DataFrame) -> DataFrame:
    """How often each combination of votes occurs per kind: at most 8 * 3**4 rows."""
    return (
        spans.select(F.explode("_spans").alias("s")).select("s.*")
        .groupBy("kind", *LABELERS).agg(F.count("*").alias("n")))


def estimate(votes: list[dict], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation maximisation over a vote table.

    Returns the probability of personal data of every (kind, votes), and per
    labeler (yes among true, yes among false). Labelers are taken as
    independent given the truth; rates are smoothed and kept inside (0, 1). An
    empty table gives empty results.
    """
    prior = {r["kind"]: 0.5 for r in votes}
    rate = {name: [0.8, 0.3] for name in LABELERS}
    posterior = {}
    for _ in range(rounds):
        posterior = {}
        for r in votes:
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            for name in LABELERS:
                yes, false = rate[name]
                if r[name] == YES:
                    odds += math.log(yes / false)
                elif r[name] == NO:
                    odds += math.log((1 - yes) / (1 - false))
            posterior[r["kind"], *[r[x] for x in LABELERS]] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        weight = [(r, r["n"], posterior[r["kind"], *[r[x] for x in LABELERS]]) for r in votes]
        for kind in prior:
            n = sum(w for r, w, _ in weight if r["kind"] == kind)
            prior[kind] = min(0.99, max(0.01, (sum(w * p for r, w, p in weight if r["kind"] == kind) + 1) / (n + 2)))
        for name in LABELERS:
            said = [(r[name] == YES, w, p) for r, w, p in weight if r[name] != NONE]
            true, false = sum(w * p for _, w, p in said), sum(w * (1 - p) for _, w, p in said)
            rate[name] = [min(0.99, max(0.01, (sum(w * p for y, w, p in said if y) + 4) / (true + 5))),
                          min(0.99, max(0.01, (sum(w * (1 - p) for y, w, p in said if y) + 1) / (false + 5)))]
    return posterior, rate


def train(spans: DataFrame) -> dict[str, float]:
    """Log odds per feature of the span classifier, from soft labels.

    One aggregation counts votes, a second one counts features under the
    estimated probabilities. Both results are bounded by the lists above (span
    lengths enter by powers of two). Key ``""`` holds the prior.
    """
    votes = [r.asDict() for r in vote_table(spans).collect()]
    posterior, _ = estimate(votes)
    if not posterior:
        return {"": 0.0}
    key = F.concat_ws(",", F.col("s.kind"), *[F.col(f"s.{n}").cast("string") for n in LABELERS])
    table = F.create_map(*[x for k, p in posterior.items() for x in (F.lit(",".join(map(str, k))), F.lit(float(p)))])
    rows = spans.select(F.explode("_spans").alias("s")).select("s.features", table[key].alias("p"))
    sums = rows.select(F.explode("features").alias("f"), "p").groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes = sum(r["yes"] for r in sums if r["f"].startswith("k"))
    no = sum(r["no"] for r in sums if r["f"].startswith("k"))
    out = {r["f"]: math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in sums}
    out[""] = math.log((yes + 1) / (no + 1))
    return out


def decided(spans: DataFrame, weights: dict[str, float], threshold: float = 0.0) -> DataFrame:
    """``found``: base spans and those the classifier accepts, by start and kind; each place and kind once."""
    table = F.create_map(*[x for f, w in weights.items() if f for x in (F.lit(f), F.lit(float(w)))]) if len(weights) > 1 else None
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def accepted(s):
        if table is None:
            return s["base"]
        odds = F.aggregate(s["features"], F.lit(float(weights[""])), lambda acc, f: acc + F.coalesce(table[f], F.lit(0.0)))
        return s["base"] | (odds > threshold)

    def slim(s):
        return F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    def new(s):
        """Not a base span, and none of those overlaps it."""
        return ~s["base"] & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    based = spans.withColumn("base", F.array_sort(F.transform(F.filter("_spans", lambda s: s["base"]), slim)))
    return based.withColumns({
        "found": F.array_sort(F.array_distinct(F.transform(F.filter("_spans", lambda s: s["base"] | (new(s) & accepted(s))), slim)))})


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, counts of the base kinds, ``base_sha256`` and ``spans``.

    NULL and empty texts give no spans; repeated rows are rows of their own; an
    empty table trains nothing and gives no rows; other columns are not read.
    """
    spans = cut_lineage(candidates(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "_spans"))
    rows = decided(spans, train(spans))
    counts = [_count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE]
    return rows.select(id_col, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets.

    Overlapping spans become one replacement, named after the first. Rows
    without spans, NULL texts included, stay as they are.
    """
    named, at = renamed(docs)
    spans = candidates(named, at[text_col])
    weights = train(cut_lineage(candidates(docs.select(text_col), text_col).select("_spans")))
    rows = decided(spans, weights)
    text = F.col(at[text_col])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        free = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(free, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            .otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("found") > 0, masked).otherwise(text)
    return rows.select(*[changed.alias(text_col) if name == text_col else column for name, column in zip(at, given_back(at))])
