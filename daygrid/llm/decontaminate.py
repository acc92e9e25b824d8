"""Benchmark passages in documents, by SimHash of item-sized windows. Native functions only.

A window of a document has as many words as the item. Weighted-shingle similarity
above zero needs a shared shingle, so windows are opened only where a shingle of an
item stands, aligned with it; this drops no window that could pass. Each window gets
a 64-bit SimHash of its weighted shingles. Fingerprints are cut into 8 blocks, and
the index holds every block value within 2 bits of an item's: by the pigeonhole
principle all fingerprints within ``RADIUS`` = 8 * 3 - 1 bits are found. Candidates
within the radius are verified by the exact similarity: characters of the shared
shingles over characters of all shingles of window and item.

Words are lower-cased runs without white space; a shingle is five words, or the
whole item if it is shorter.

Defined results: null or empty texts and items match nothing, neither do rows
without an id; a document shorter than an item is one window; repeated rows and
ids give one result per id and item; of equal windows the first counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daygrid.llm.common import with_row_key
from daygrid.session import checked_broadcast, stable

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS, BLOCK_RADIUS = 64, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_BITS = BITS // BLOCKS
SPACE = "[ \t-\r]+"  # space and the five ASCII controls from tab to carriage return


def words_of(text: str) -> Column:
    return F.expr(f"array_remove(split(lower({text}), '{SPACE}'), '')")


def weighted_shingles(words: str, length: str) -> Column:
    """Distinct (key, weight) of the runs of ``length`` words; the weight is their characters."""
    return F.expr(
        f"""array_distinct(transform(
            IF(size({words}) < {length} OR {length} < 1, array(), sequence(1, size({words}) - {length} + 1)),
            i -> named_struct(
                'key', xxhash64(array_join(slice({words}, int(i), {length}), ' ')),
                'weight', length(array_join(slice({words}, int(i), {length}), '')))))"""
    )


def simhash(shingles: str) -> Column:
    """64 sign bits of the weighted votes of the keys' bits."""
    return F.expr(
        f"""aggregate({shingles}, array_repeat(0, {BITS}),
            (acc, s) -> transform(acc, (v, i) -> v + IF(getbit(s.key, i) = 1, s.weight, -s.weight)),
            acc -> aggregate(sequence(0, {BITS - 1}), 0L, (h, i) -> h | IF(get(acc, i) > 0, shiftleft(1L, i), 0L)))"""
    )


def block_value(fingerprint: str, block: str) -> str:
    return f"int(shiftright({fingerprint}, {block} * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1})"


def similarity(a: str, b: str) -> Column:
    """Weight of the shared shingles over the weight of all."""
    weight = "aggregate({}, 0L, (t, s) -> t + s.weight)"
    return F.expr(f"{weight.format(f'array_intersect({a}, {b})')} / {weight.format(f'array_union({a}, {b})')}")


def item_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item with words: n_item, k (shingle length), shingles, fingerprint."""
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("item_text"))
    return stable(
        items.distinct()
        .withColumn("item_words", words_of("item_text"))
        .withColumn("n_item", F.size("item_words"))
        .filter("n_item > 0")
        .withColumn("k", F.least("n_item", F.lit(SHINGLE)))
        .withColumn("item_shingles", weighted_shingles("item_words", "k"))
        .withColumn("item_print", simhash("item_shingles"))
        .drop("item_text"),
        "items",
    )


def windows_at_anchors(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows (doc, item, start, window) opened by a shared shingle."""
    found = None
    for k in sorted(r[0] for r in items.select("k").distinct().collect()):  # at most five lengths
        keyed = (
            items.filter(F.col("k") == k)
            .select("item_id", "n_item", F.posexplode(F.expr(f"transform(sequence(1, n_item - {k} + 1), i -> slice(item_words, int(i), {k}))")).alias("at", "run"))
            .select("item_id", "n_item", "at", F.xxhash64(*[F.get("run", F.lit(j)) for j in range(k)]).alias("anchor"))
        )
        keyed = stable(keyed.distinct(), "anchors")
        shifted = ", ".join(["words"] + [f"slice(words, {j + 1}, greatest(size(words) - {j}, 0))" for j in range(1, k)])
        here = (
            docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).alias("doc"), words_of(text_col).alias("words"))
            .filter(F.size("words") >= k)
            .select("doc", "words", F.posexplode(F.expr(f"arrays_zip({shifted})")).alias("pos", "run"))
            .select("doc", "words", "pos", F.xxhash64(*[F.col("run").getField(str(j) if j else "words") for j in range(k)]).alias("anchor"))
            .join(checked_broadcast(keyed), "anchor")
            .withColumn("start", F.greatest(F.lit(0), F.col("pos") - F.col("at")))
            .select("doc", "item_id", "start", F.expr("slice(words, start + 1, n_item)").alias("window"))
            .groupBy("doc", "item_id", "start", "window")
            .agg(F.lit(1).alias("one"))
            .drop("one")
        )
        found = here if found is None else found.unionByName(here)
    return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, at_least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, item_id, start_word, n_words, similarity): the best window of each document and item at or above ``at_least``."""
    items = item_index(benchmark)
    opened = windows_at_anchors(docs, items, id_col, text_col)
    if opened is None:  # no item has a word
        return docs.limit(0).select(
            F.col(id_col), F.lit(0).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")
        )
    masks = [sum(1 << b for b in c) for n in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), n)]
    index = (
        items.select("item_id", "item_print", "item_shingles", "k", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
        .withColumn("value", F.expr(block_value("item_print", "block")))
        .withColumn("value", F.explode(F.expr(f"transform(array({', '.join(map(str, masks))}), m -> value ^ m)")))
    )
    lengths = items.select("item_id", "k")
    probes = (
        opened.join(F.broadcast(lengths), "item_id")
        .withColumn("shingles", weighted_shingles("window", "k"))
        .withColumn("print", simhash("shingles"))
        .select("doc", "item_id", "start", F.size("window").alias("n_words"), "shingles", "print", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
        .withColumn("value", F.expr(block_value("print", "block")))
    )
    best = W.partitionBy("doc", "item_id").orderBy(F.desc("similarity"), "start")
    return (
        probes.join(checked_broadcast(stable(index, "blocks")).drop("k"), ["item_id", "block", "value"])
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .withColumn("similarity", similarity("shingles", "item_shingles"))
        .filter(F.col("similarity") >= at_least)
        .select("doc", "item_id", "start", "n_words", "similarity")
        .distinct()
        .withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select(F.col("doc").alias(id_col), "item_id", F.col("start").alias("start_word"), "n_words", "similarity")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with their own columns; each by its own text, with or without an id."""
    keyed, key = with_row_key(docs)
    held = stable(contaminated(keyed, benchmark, id_col=key).select(key).distinct(), "contaminated")
    return keyed.join(checked_broadcast(held), key, "left_anti").select(docs.columns)


def contaminated_sql(at_least: float = SIMILARITY) -> str:
    """The same by brute force over the aligned windows, without fingerprints, in DuckDB."""
    return f"""
    WITH i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{SPACE}'), lambda x: x <> '') AS w
               FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
    items AS (SELECT item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS k FROM i WHERE len(w) > 0),
    lists AS (SELECT item_id, n, k, list_transform(range(1, n - k + 2), lambda p: w[p : p + k - 1]) AS runs FROM items),
    starts AS (SELECT item_id, n, k, unnest(runs) AS run, unnest(range(len(runs))) AS nth FROM lists),
    d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPACE}'), lambda x: x <> '') AS w
          FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    ks AS (SELECT DISTINCT k FROM items),
    runs AS (SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda p: w[p : p + k - 1])) AS run
             FROM d JOIN ks ON len(w) >= k),
    opened AS (SELECT DISTINCT doc_id, item_id, n, k, greatest(0, pos - nth) AS start FROM runs JOIN starts USING (run, k)),
    windows AS (SELECT doc_id, item_id, start, k, d.w[start + 1 : start + n] AS v, items.w AS w
                FROM opened JOIN d USING (doc_id) JOIN items USING (item_id, n, k)),
    sets AS (SELECT doc_id, item_id, start, len(v) AS n_words,
                    list_distinct(list_transform(range(1, len(v) - k + 2), lambda p: v[p : p + k - 1])) AS a,
                    list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: w[p : p + k - 1])) AS b FROM windows),
    sums AS (SELECT doc_id, item_id, start, n_words,
                    list_sum(list_transform(list_intersect(a, b), lambda r: length(array_to_string(r, '')))) AS shared,
                    list_sum(list_transform(a, lambda r: length(array_to_string(r, '')))) AS x,
                    list_sum(list_transform(b, lambda r: length(array_to_string(r, '')))) AS y FROM sets),
    scored AS (SELECT doc_id, item_id, start, n_words, CAST(shared AS DOUBLE) / CAST(x + y - shared AS DOUBLE) AS similarity FROM sums)
    SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words, similarity
    FROM scored WHERE similarity >= {at_least}
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
