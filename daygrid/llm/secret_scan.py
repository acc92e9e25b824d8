"""Secrets in texts: high-recall candidates, false positives removed by a random forest.

Candidates are values in assignments to telling names, values with well-known
prefixes, key blocks and long runs of key characters. A random forest scores them
by length, character transitions (mean log chance of letter pairs under the
corpus' own words), dictionary coverage (share of letters in corpus words), the
path (whether a file or address encloses the value) and the neighbouring words.

The forest is trained from labelled findings: a table (before, value, after,
label), by default made by rule from a fixed seed in the forms that credentials
and their usual look-alikes have. The letter pairs are those of all words of all
documents; the dictionary holds the words whose share of them is at least
``WORD_SHARE``, which bounds it whatever the corpus' size.

Defined results: null and empty texts have no findings; repeated rows give their
findings each; of overlapping candidates the earliest, then longest, counts.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.llm.common import giving_back_at_end, small_batches, texts_of, with_row_key
from daygrid.session import checked_broadcast, stable

WORD_SHARE = 1e-4
HELD_WORDS = 400_000  # distinct tokens that a task counts before it hands them on
THRESHOLD = 0.5
TREES, DEPTH = 24, 7
NEAR = 40

NAMES = r"(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?|bearer)"
SOURCES = (
    re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,30}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*+)"),
    re.compile(r"\b(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"),
    re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<value>(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+={0,2}+)(?![A-Za-z0-9+/_=-])"),
)
ASSIGNED = re.compile(r"(?:=>|:=|[=:])(?=\s{0,3}[\"']?(?P<value>[^\s\"',;<>|]{8}))")
REST = re.compile(r"[^\s\"',;<>|]*+")
NAMED = re.compile(rf"{NAMES}[\w-]{{0,20}}[\"']?\s{{0,3}}$", re.I)
HINTS = re.compile(NAMES, re.I)
LOOKALIKES = re.compile(r"(?i)commit|sha-?(?:1|256|512)?\b|md5|checksum|digest|hash|uuid|guid|etag|revision|build|integrity|example|placeholder|dummy|sample|version|\bid\b")
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "distinct", "entropy", "switches", "transitions", "coverage",
    "hex_only", "uuid_form", "in_path", "assigned", "quoted", "named", "lookalike", "prefixed", "placeholder",
)


class Language:
    """Letter-pair chances and dictionary of a corpus."""

    def __init__(self, words: Iterable[str], pairs: dict[int, int]):
        counts = np.ones(27 * 27)
        for pair, n in pairs.items():
            counts[pair] += n
        counts = counts.reshape(27, 27)
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.words = frozenset(w for w in words if len(w) >= 3)
        self.longest = max(map(len, self.words), default=0)

    def transitions(self, value: str) -> float:
        """Mean log chance of the letter pairs; -6 without letters."""
        c = [ord(x) - 96 if "a" <= x <= "z" else 0 for x in value.lower()]
        pairs = [self.logs[a, b] for a, b in zip(c, c[1:], strict=False) if a or b]
        return float(np.mean(pairs)) if pairs else -6.0

    def coverage(self, value: str) -> float:
        """Share of characters in dictionary words, longest first."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(self.longest, len(low) - at), 2, -1):
                if low[at : at + n] in self.words:
                    covered, at = covered + n, at + n
                    break
            else:
                at += 1
        return covered / max(1, len(low))


def features(before: str, value: str, after: str, language: Language) -> list[float]:
    n = max(1, len(value))
    counts = np.array(list(Counter(value).values()) or [1]) / n
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    near = before[-NEAR:].lower()
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        len(counts) / n,
        float(-(counts * np.log2(counts)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        language.transitions(value),
        language.coverage(value),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(value.count("/") > 1 or re.search(r"[\w.-]*[/\\][\w./\\-]*$|https?:\S*$", near) is not None),
        float(re.search(r"[=:]\s*[\"']?$", near) is not None),
        float(near.endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(HINTS.search(near[-30:]) is not None),
        float(LOOKALIKES.search(near[-30:]) is not None),
        float(re.match(r"AKIA|ASIA|gh[pousr]_|sk_live_|xox|eyJ|-----BEGIN", value) is not None),
        float(re.search(r"(?i)x{4}|\*{3}|\.{3}|your|change|example|placeholder|dummy|\$\{|<|0{8}|1234567", value) is not None),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Non-overlapping candidate spans, the earliest and longest first."""
    spans = set()
    for source in SOURCES:
        for m in source.finditer(text):
            spans.add(m.span("value") if "value" in source.groupindex else m.span())
    end = 0  # of the run that was read last; signs inside it have values with the same end
    for m in ASSIGNED.finditer(text):
        if NAMED.search(text[max(0, m.start() - NEAR) : m.start()]):
            if m.start("value") >= end:
                end = REST.match(text, m.end("value")).end()
            spans.add((m.start("value"), end))
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or first >= out[-1][1]:
            out.append((first, last))
    return out


def letter_pairs(words: list[str], counts: list[int]) -> np.ndarray:
    """Occurrences of each pair of letters a-z in the words, 0 standing for a word's ends."""
    raw = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8)
    codes = np.where(raw == 32, 0, raw.astype(np.int64) - 96)
    weights = np.repeat(counts, [len(w) + 1 for w in words])
    out = np.zeros(27 * 27, np.int64)
    np.add.at(out, codes[:-1] * 27 + codes[1:], weights)
    return out


def language_of(docs: DataFrame, text_col: str, share: float = WORD_SHARE) -> Language:
    """Letter pairs of all words of all documents, and the words whose share of them reaches ``share``.

    Words are lower-case, of 2 to 20 letters a-z. Tasks count partially and Spark adds up, so
    that the result does not depend on how the rows lie; at most 1 / ``share`` words and
    729 pairs come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            low: Counter = Counter()
            for w, n in held.items():
                w = w.strip(string.punctuation).lower()
                if 1 < len(w) <= 20 and w.isascii() and w.isalpha():
                    low[w] += n
            held.clear()
            words, counts = list(low), list(low.values())
            pairs = letter_pairs(words, counts) if words else np.zeros(27 * 27, np.int64)
            at = np.flatnonzero(pairs)
            columns = [
                pa.array([*words, *[None] * len(at)], pa.string()),
                pa.array([*[None] * len(words), *at.tolist()], pa.int32()),
                pa.array([*counts, *pairs[at].tolist()], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["word", "pair", "n"])

        for _, texts in texts_of(batches, "counted_text"):
            for t in texts:
                held.update(t.split())
            if len(held) > HELD_WORDS:
                yield out()
        yield out()

    counted = docs.select(F.col(text_col).alias("counted_text")).mapInArrow(giving_back_at_end(count), "word string, pair int, n long")
    counted = stable(counted, "word_counts")
    pairs = {r["pair"]: r["n"] for r in counted.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for pair, n in pairs.items() if pair < 27)  # pairs that begin a word
    words = counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= share * total)
    return Language([r["word"] for r in words.select("word").collect()], pairs)


def labelled_findings(rows: int = 3000, seed: int = 29) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, value, after, label) in the usual forms, the same on every call."""
    r = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(r.choices(alphabet, k=r.randint(a, b)))
    hexes, mixed, base = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    upper = string.ascii_uppercase + string.digits
    wordy = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "to", "it", "is", "ar", "te")) for _ in range(r.randint(3, 9)))
    names = ("token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "auth_token", "passwd", "SECRET_KEY", "bearer")
    out = []
    for i in range(rows):
        lead = " ".join(wordy() for _ in range(r.randint(0, 3)))
        name, quote = r.choice(names), r.choice(('"', '"', "'", ""))
        sign = r.choice((" = ", "=", ": ", ":"))
        good = (
            (f"{lead} {name}{sign}{quote}", pick(hexes, 32, 64), quote),
            (f"{lead} {name}{sign}{quote}", pick(mixed, 12, 48), quote),
            (f"{lead} {name}{sign}{quote}", pick(base, 24, 60) + "==", quote),
            (f"{lead} {name}{sign}{quote}", pick(mixed + "!@#%^&*", 10, 20), quote),
            (f"{lead} ", r.choice(("AKIA", "ASIA")) + pick(upper, 16, 16), " "),
            (f"{lead} ", r.choice(("ghp_", "gho_")) + pick(mixed, 36, 36), " "),
            (f"{lead} Authorization{sign}Bearer ", "eyJ" + ".".join(pick(mixed, 20, 40) for _ in range(3)), " "),
            (f"{lead}\n", "-----BEGIN RSA PRIVATE KEY-----" + pick(base, 60, 200), "\n"),
            (f"{lead}\n", "-----BEGIN PRIVATE KEY-----" + pick(base, 600, 6000) + "-----END PRIVATE KEY-----", "\n"),
            (f"{lead} {name}{sign}{quote}", pick(r.choice((hexes, mixed, base)), 200, 6000), quote),
        )
        bad = (
            (f"{lead} commit ", pick(hexes, 40, 40), " "),
            (f"{lead} sha256:", pick(hexes, 64, 64), " "),
            (f"{lead} checksum{sign}{quote}", pick(hexes, 32, 40), quote),
            (f"{lead} id{sign}{quote}", "-".join(pick(hexes, k, k) for k in (8, 4, 4, 4, 12)), quote),
            (f"{lead} {name}{sign}{quote}", r.choice(("changeme", "your-token-here", "xxxxxxxxxxxx", "${SECRET}", "<password>", "********", "example-password", "placeholder")), quote),
            (f"{lead} {name}{sign}", wordy() + r.choice(("", ".", ",", wordy())), " "),
            (f"{lead} https://{wordy()}.example.com/", "/".join(wordy() + pick(string.digits, 1, 4) for _ in range(4)), " "),
            (f"{lead} ", "-".join(wordy() for _ in range(4)) + pick(string.digits, 1, 3), " "),
            (f"{lead} ", pick(string.digits, 24, 40), " "),
            (f"{lead} src/{wordy()}/", "_".join(wordy() for _ in range(4)) + "1", ".py"),
            (f"{lead} integrity=\"sha512-", pick(base, 60, 86), '"'),
            (f"{lead} data:image/png;base64,", pick(base, 200, 6000), '"'),
        )
        out.append((*r.choice(good), 1) if i % 2 else (*r.choice(bad), 0))
    return out


def trained(spark: SparkSession, language: Language, findings: list[tuple[str, str, str, int]]):
    rows = [(features(b, v, a, language), float(y)) for b, v, a, y in findings]
    frame = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, featuresCol="features", labelCol="label").fit(frame)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    findings: list[tuple[str, str, str, int]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, first, last, value_md5, score): the candidates that the forest keeps."""
    small_batches(docs.sparkSession)
    language = language_of(docs, text_col)
    model = trained(docs.sparkSession, language, findings or labelled_findings())
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches, "scanned_text"):
            at, spans, values, facts = [], [], [], []
            for i, t in enumerate(texts):
                for a, b in candidates(t):
                    at.append(i)
                    spans.append((a, b))
                    values.append(t[a:b])
                    facts.append(features(t[max(0, a - NEAR) : a], t[a:b], t[b : b + 8], shared.value))
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array([a for a, _ in spans], pa.int32()),
                pa.array([b for _, b in spans], pa.int32()),
                pa.array(values, pa.string()),
                pa.array(facts, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "first", "last", "value", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("scanned_text")).mapInArrow(
        giving_back_at_end(scan), f"doc {kind}, first int, last int, value string, x array<double>"
    )
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    return scored.withColumn("score", vector_to_array("probability").getItem(1)).filter(F.col("score") >= threshold).select(
        F.col("doc").alias(id_col), "first", "last", F.md5(F.col("value").cast("binary")).alias("value_md5"), "score"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each found secret replaced by ``mark``; ``n_chars`` follows the text.

    Spans belong to the row by its id and text together, with or without an id.
    """
    keyed, key = with_row_key(docs)
    found = stable(find_secrets(keyed, key), "secrets")
    name = f"{key}_spans"
    while name in docs.columns:
        name += "_"
    spans = stable(found.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias(name)), "secret_spans")
    pieces = F.aggregate(
        name,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda acc, s: F.struct(
            s["last"].alias("at"), F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["first"] - acc["at"]), F.lit(mark)).alias("done")
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    plain = F.col(name).isNull()
    joined = keyed.join(checked_broadcast(spans), key, "left").withColumn("text", F.when(plain, F.col("text")).otherwise(pieces))
    return joined.withColumn("n_chars", F.when(plain, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)
