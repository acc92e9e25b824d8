"""Personal data: spans by fixed rules, further spans by boosted trees. Native functions only.

High-recall generators propose candidates, which may overlap: the four base
patterns before their checks, telephone numbers without a country code, and mail
addresses written out. A candidate that passes the checks of its base pattern is a
base span and always stays; one that fails them is none. The two added generators
have no check: gradient-boosted trees score their candidates by format and context.
They learn from labelled findings made by rule from a fixed seed and, as further
positives, from distinct base spans of the table without their country code or with
at sign and dot written out. A calibrated threshold, the least at which the held-back
findings of the kind reach the wanted precision, selects further spans that overlap
no base span; of overlapping ones the better score wins.

Positions come from the matches and the gaps between them, so each text is scanned
once per pattern for each. Patterns are possessive, which changes no match and
keeps long runs linear.

All distinct base spans of the table count, in the fit and in the thresholds. Where a
kind has more of them than keep the labels about even, each weighs less. Findings
that agree in kind, label and features are one row with the sum of their weights.

Defined results: a null text counts as empty; no spans give counts of zero, an
empty ``spans`` and the checksum of the empty string; repeated rows and ids are
kept apart. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.session import stable

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
CONTEXT = 24
MADE_ROWS = 2000

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPOKEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}+"
PLAIN_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
WORD_HINTS = {
    "hint_mail": "mail|contact|write|@",
    "hint_call": "tel|phone|call|mobile|fax",
    "hint_card": "card|visa|account|pay",
    "hint_net": "ip|host|server|address|addr",
    "hint_number": r"\b(ref|order|part|serial|isbn|no|version|ticket|item|code|id|index|array|value)\b",
}
FEATURES = ("n_chars", "n_digits", "n_letters", "n_marks", "n_groups", "longest", "line_start", "after_letter", "before_letter", "kind", *WORD_HINTS)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the card checksum."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    each = F.transform(F.split(F.reverse(digits_of(m)), ""), lambda c, i: doubled(F.coalesce(c.try_cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def n_digits(m: Column) -> Column:
    return F.length(digits_of(m))


def small_parts(m: Column) -> Column:
    """Whether every dotted part is at most 255."""
    return F.forall(
        F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    )


# Source of candidates: kind, pattern, cheap test of the text, which candidates to keep, which are base spans.
SOURCES = (
    (0, EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True), lambda m: F.lit(True)),
    (1, IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: F.lit(True), small_parts),
    (2, CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda m: n_digits(m).between(12, 19), luhn),
    (3, PHONE, lambda t: t.contains("+"), lambda m: F.lit(True), lambda m: n_digits(m).between(9, 15)),
    (0, SPOKEN_EMAIL, lambda t: t.rlike(r"[\[(]at[\])]"), lambda m: F.lit(True), lambda m: F.lit(False)),
    (3, PLAIN_PHONE, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), lambda m: F.lit(True), lambda m: F.lit(False)),
)
CANDIDATE = "struct<first:int,kind:int,last:int,base:boolean,match:string,before:string,after:string>"


def candidates(text: Column, kind: int, pattern: str, test, keep, base) -> Column:
    """Array of candidates of one source with their positions and context."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    follow = F.zip_with(pairs, F.slice(gaps, 2, F.size(gaps)), lambda p, n: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), n.alias("next")))
    empty = F.array().cast(f"array<{CANDIDATE}>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.length(F.coalesce(x["hit"], F.lit("")))
        found = F.struct(
            at.alias("first"),
            F.lit(kind).alias("kind"),
            end.alias("last"),
            base(x["hit"]).alias("base"),
            x["hit"].alias("match"),
            F.lower(F.right(x["gap"], F.lit(CONTEXT))).alias("before"),
            F.left(F.coalesce(x["next"], F.lit("")), F.lit(CONTEXT)).alias("after"),
        ).cast(CANDIDATE)
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["held"], F.array(found))).otherwise(acc["held"]).alias("held"))

    folded = F.aggregate(follow, F.struct(F.lit(0).alias("at"), empty.alias("held")), step, lambda acc: acc["held"])
    return F.when(test(text), folded).otherwise(empty)


def with_features(found: DataFrame) -> DataFrame:
    """Format and context of a candidate, a column each; nothing that a base check looks at alone."""
    m = F.col("c.match")
    out = (
        found.withColumn("n_chars", F.length(m))
        .withColumn("n_digits", n_digits(m))
        .withColumn("n_letters", F.length(F.regexp_replace(m, "[^A-Za-z]", "")))
        .withColumn("n_marks", F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")))
        .withColumn("n_groups", F.size(F.split(m, "[^A-Za-z0-9]+")))
        .withColumn("longest", F.array_max(F.transform(F.split(m, "[^A-Za-z0-9]+"), lambda p: F.length(p))))
        .withColumn("line_start", F.col("c.before").rlike(r"(^|\n)$").cast("int"))
        .withColumn("after_letter", F.col("c.before").rlike(r"\p{L}\P{L}{0,1}$").cast("int"))
        .withColumn("before_letter", F.col("c.after").rlike(r"^\P{L}{0,1}\p{L}").cast("int"))
        .withColumn("kind", F.col("c.kind"))
    )
    for name, words in WORD_HINTS.items():
        out = out.withColumn(name, F.col("c.before").rlike(words).cast("int"))
    return out


def assembled(facts: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(facts)


def labelled_findings(rows: int = MADE_ROWS, seed: int = 31) -> list[tuple[int, str, str, str, bool]]:
    """Labelled findings (kind, before, match, after, label) of the two added generators, the same on every call."""
    r = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(r.choices(alphabet, k=r.randint(a, b)))
    word = lambda: pick(string.ascii_lowercase, 2, 9)
    out = []
    for i in range(2 * rows):
        kind, good = (0, 3)[i % 2], i // 2 % 4 == 0
        lead, after = " ".join(word() for _ in range(r.randint(0, 3))), r.choice((" ", ". ", ", ", "\n", "")) + word()
        if kind == 0:
            o, c = r.choice(("[]", "()"))
            space = r.choice((" ", " ", ""))
            name, host = (word() + r.choice((".", "_", "")) + word() + r.choice(("", pick(string.digits, 1, 3))), word()) if good else (pick(string.ascii_lowercase, 1, 2), pick(string.digits, 1, 3))
            match = f"{name}{space}{o}at{c}{space}{host}{space}{o}dot{c}{space}{r.choice(('com', 'org', 'net', 'de', 'io')) if good else word()}"
            told = ("mail ", "contact: ", "write to ", "e-mail: ", "") if good else ("array ", "value ", "index: ", "code ", "")
        else:
            sep = r.choice("-. ")
            area = pick(string.digits, 3, 3)
            match = (f"({area}) " if r.random() < 0.3 else area + sep) + pick(string.digits, 3, 3) + sep + pick(string.digits, 4, 4)
            told = ("call ", "phone: ", "tel ", "mobile ", "fax ", "") if good else ("ref ", "order ", "part ", "serial ", "isbn ", "ticket ", "item ", "version ")
        before = f"{lead} {r.choice(told)}"[-CONTEXT:]
        out.append((kind, before, match, after[:CONTEXT], good))
    return out


def masked(found: DataFrame, kind: int) -> DataFrame:
    """All distinct base spans of ``kind`` in the form of its added generator, as positives."""
    m = F.col("c.match")
    if kind == 0:
        form, pattern = F.regexp_replace(F.regexp_replace(m, "@", " [at] "), r"\.(?=[A-Za-z]{2,24}$)", " [dot] "), SPOKEN_EMAIL
    else:
        form, pattern = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*", ""), PLAIN_PHONE
    spans = found.filter(F.col("c.base") & (F.col("c.kind") == kind)).select(form.alias("match"), F.col("c.before").alias("before"), F.col("c.after").alias("after"))
    one = spans.filter(F.col("match").rlike(f"^(?:{pattern})$")).groupBy("match").agg(F.min(F.struct("before", "after")).alias("near"))
    return one.select(F.lit(kind).alias("kind"), "near.before", "match", "near.after", F.lit(True).alias("base"))


def samples(found: DataFrame) -> DataFrame:
    """(features, label, kind, held, weight) of the made findings and of all distinct base spans of the table."""
    names = ("kind", "before", "match", "after", "base")
    made = json.dumps([dict(zip(names, x, strict=True)) for x in labelled_findings()])
    schema = "array<struct<kind:int,before:string,match:string,after:string,base:boolean>>"
    own = F.lit(False).alias("own")
    findings = found.sparkSession.range(1).select(F.inline(F.from_json(F.lit(made), schema))).select("*", own)
    for kind in (0, 3):
        findings = findings.union(masked(found, kind).withColumn("own", F.lit(True)))
    held = F.pmod(F.xxhash64("c.match", "c.before", "c.after"), F.lit(4)) == 0
    facts = with_features(findings.select(F.struct(*names).alias("c"), "own")).withColumns({"label": F.col("c.base").cast("double"), "held": held})
    alike = stable(facts.groupBy(*FEATURES, "label", "held", "own").agg(F.count("*").alias("times")), "findings")
    times = {r["kind"]: r["times"] for r in alike.filter("own").groupBy("kind").agg(F.sum("times").alias("times")).collect()}  # a row per kind
    share = F.coalesce(*[F.when(F.col("own") & (F.col("kind") == k), F.lit(min(1.0, MADE_ROWS / 2 / n))) for k, n in times.items()], F.lit(1.0))
    weighed = alike.withColumn("weight", F.col("times") * share).groupBy(*FEATURES, "label", "held").agg(F.sum("weight").alias("weight"))
    return stable(assembled(weighed).select("features", "label", "kind", "held", "weight"), "samples")


def chosen_spans(found: DataFrame, precision: float) -> DataFrame | None:
    """(row, extras): further spans that the trees select; none if no threshold reaches the precision."""
    added = ((F.col("c.kind") == 0) & ~F.col("c.match").contains("@")) | ((F.col("c.kind") == 3) & ~F.col("c.match").startswith("+"))
    facts = assembled(with_features(found.filter(~F.col("c.base") & added)))
    learned = samples(found)
    model = GBTClassifier(maxIter=12, maxDepth=3, seed=5, featuresCol="features", labelCol="label", weightCol="weight").fit(learned.filter("NOT held"))
    chance = F.round(vector_to_array("probability").getItem(1), 3)
    curve = model.transform(learned.filter("held")).groupBy("kind", chance.alias("chance"))
    curve = curve.agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"))
    above = W.partitionBy("kind").orderBy(F.desc("chance"))
    reached = (
        curve.withColumn("share", F.sum("good").over(above) / F.sum("all").over(above))
        .filter(F.col("share") >= precision)
        .groupBy("kind")
        .agg(F.min("chance").alias("threshold"))
    )
    thresholds = {r["kind"]: r["threshold"] for r in reached.collect()}  # at most one row per kind
    if not thresholds:
        return None
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()], F.lit(2.0))
    return (
        model.transform(facts)
        .withColumn("chance", chance)
        .filter(F.col("chance") >= least)
        .groupBy("row")
        .agg(F.collect_list(F.struct("chance", F.col("c.first").alias("first"), F.col("kind"), F.col("c.last").alias("last"))).alias("extras"))
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ","
    )


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """(id, spans_base, spans_all) of every row; spans are arrays of (first, kind, last)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(*[candidates(text, *source) for source in SOURCES])
    facts = stable(docs.select(F.expr("uuid()").alias("row"), F.col(id_col).alias("doc"), found.alias("found")), "candidates")
    base = F.transform(F.filter("found", lambda c: c["base"]), lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last")))
    facts = facts.withColumn("base", base)
    extras = chosen_spans(facts.select("row", F.explode("found").alias("c")), precision)
    if extras is None:
        return facts.select(F.col("doc").alias(id_col), F.col("base").alias("spans_base"), F.col("base").alias("spans_all"))

    apart = lambda a, b: (a["last"] <= b["first"]) | (b["last"] <= a["first"])
    free = F.filter("extras", lambda e: F.forall("base", lambda b: apart(e, b)))
    best_first = F.array_sort(free, lambda a, b: F.when(a["chance"] > b["chance"], -1).when(a["chance"] < b["chance"], 1).otherwise(a["first"] - b["first"]))
    plain = lambda e: F.struct(e["first"].alias("first"), e["kind"].alias("kind"), e["last"].alias("last"))
    none = F.array().cast("array<struct<first:int,kind:int,last:int>>")
    picked = F.aggregate(best_first, none, lambda acc, e: F.when(F.forall(acc, lambda b: apart(e, b)), F.concat(acc, F.array(plain(e).cast("struct<first:int,kind:int,last:int>")))).otherwise(acc))
    return facts.join(extras, "row", "left").select(
        F.col("doc").alias(id_col),
        F.col("base").alias("spans_base"),
        F.concat("base", F.when(F.col("extras").isNull(), none).otherwise(picked)).alias("spans_all"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of each row of ``find_personal``."""
    def count(kind: int) -> Column:
        return F.size(F.filter("spans_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(len(KINDS)))
    return found.select(
        id_col, *counts, F.sha2(spans_text(F.col("spans_base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans_all")).alias("spans")
    )
