"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the words at the marked places of a mask; the other places may differ. The two masks together
meet every window of WINDOW = 15 words with at most three substitutions (checked by a test over all placements), so
no overlap of similarity 0.8 is missed. Seeds of the documents are joined to those of the benchmark; around each hit
the words are compared on the hit's diagonal, and a window that contains the hit with 12 of 15 equal words is an
overlap. Items of 5 to 14 words are found by pairs of words and need 0.8 of their words. Items of one to four words stand
in ordinary text by chance; a document overlaps them if it has these words and no others.

The benchmark's seeds (seed, item, place) are counted and broadcast in blocks of at most BLOCK_SEEDS, however long an item
is; the documents are never gathered, and a hit keeps only the words that its windows can reach. The items' words are
broadcast below the same bound and joined by a shuffle beyond it.

Defined results: a null text or item has no words; a null doc_id or item_id is carried like any other; rows that
repeat under one doc_id share their result; items that repeat are each reported; texts and items of any length are
compared whole; with an empty benchmark every document is clean, and an empty table gives no rows; other columns are not
read, and drop_contaminated keeps them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS, SHORT_MASK = ("11111", "110101001"), "11"
WINDOW, SIMILARITY, LEAST_WORDS = 15, 0.8, 5
#: Seeds of the benchmark that are broadcast at once, and words.
BLOCK_SEEDS = 1_000_000
#: Words of a document that are worked on in one row.
PORTION = 1024


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(mask: str, number: int) -> Column:
    """Seeds of one mask at every place of h where it fits."""
    places = [k for k, c in enumerate(mask) if c == "1"]
    starts = F.when(F.size("h") >= len(mask), F.sequence(F.lit(0), F.size("h") - len(mask))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(number), *(F.get("h", i + k) for k in places)))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a generator keeps the optimizer from copying its expression into
    each place where it is used, filters and lambdas included."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    return _held(df, "seeds", F.concat(*(_seeds(m, k) for k, m in enumerate(masks))))


def _place(masks: tuple[str, ...], n: Column) -> Column:
    """Place among n words of the seed at pos of the masks' seeds laid end to end."""
    place, before = F.col("pos"), F.lit(0)
    for mask in masks[:-1]:
        before = before + F.greatest(n - len(mask) + 1, F.lit(0))
        place = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(place)
    return place


def _hits(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], n_words: int) -> DataFrame:
    """Overlaps of docs(doc_id, h) with items(item_id, h): doc_id, item_id, diagonal, matched, start, stop."""
    held = items.select("item_id", F.xxhash64("h").alias("item"), F.col("h").alias("g"))
    filed = _with_seeds(held.select("item", F.col("g").alias("h")).distinct(), masks).withColumn("n", F.size("h")).select("item", "n", F.posexplode("seeds").alias("pos", "seed"))
    filed = filed.select("seed", "item", "n", _place(masks, F.col("n")).alias("item_at"))
    found = _with_seeds(_portions(docs), masks).select("doc_id", "offset", "h", F.posexplode("seeds").alias("pos", "seed"))
    blocks, hits = -(-n_words * len(masks) // BLOCK_SEEDS), []
    for block in range(blocks):
        own = filed.where(F.pmod("seed", F.lit(blocks)) == block) if blocks > 1 else filed
        hits.append(_around(found.join(F.broadcast(own), "seed"), masks))
    hit = reduce(DataFrame.unionByName, hits)
    # a hit has the few words that its windows can reach; those of the item are looked up for it
    hit = hit.join(F.broadcast(held) if n_words <= BLOCK_SEEDS else held, "item")
    equal = lambda q: F.when((q + F.col("diagonal") >= 0) & (F.get("g", q) == F.get("around", q + F.col("diagonal") - F.col("from"))), F.lit(1)).otherwise(F.lit(0))
    hit = _held(hit, "same", F.transform(F.sequence("lo", "hi"), equal))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("same") - F.col("width") + 1)),
            lambda s: F.struct(F.aggregate(F.slice("same", s, F.col("width")), F.lit(0), lambda a, x: a + x).alias("matched"), (-s).alias("s")),
        )
    )
    hit = _held(hit, "best", best).select("doc_id", "item_id", "diagonal", "lo", "width", "best")
    hit = hit.where(F.col("best.matched") >= F.ceil(F.col("width") * F.lit(SIMILARITY)))
    start = F.col("diagonal") + F.col("lo") - F.col("best.s") - 1
    return hit.select("doc_id", "item_id", "diagonal", (F.col("best.matched") / F.col("width")).alias("similarity"), start.alias("start"), (start + F.col("width")).alias("stop"))


def _portions(docs: DataFrame) -> DataFrame:
    """docs(doc_id, h) in portions of PORTION words, each with the words around it that a window can reach: the place of
    a portion's first word is its offset. A portion bounds what one row becomes when its seeds are exploded."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)), F.lit(PORTION))
    cut = docs.select("doc_id", "h", F.explode(starts).alias("at")).withColumn("offset", F.greatest(F.lit(0), F.col("at") - 2 * WINDOW))
    whole = F.when(F.size("h") <= PORTION, F.col("h")).otherwise(F.slice("h", F.col("offset") + 1, F.col("at") - F.col("offset") + PORTION + 2 * WINDOW))
    return _held(cut.select("doc_id", "offset", whole.alias("words")), "h", F.col("words")).select("doc_id", "offset", "h")


def _around(hit: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Hits with the words of the document that a window around the seed can hold: those of the item from lo to hi."""
    diagonal = F.col("offset") + _place(masks, F.size("h")) - F.col("item_at")
    hit = hit.select("doc_id", "offset", "h", "item", "n", "item_at", diagonal.alias("diagonal"), F.least(F.lit(WINDOW), F.col("n")).alias("width"))
    hit = hit.withColumn("lo", F.greatest(F.lit(0), F.col("item_at") - F.col("width") + 1)).withColumn("hi", F.least(F.col("n") - 1, F.col("item_at") + F.col("width") - 1))
    hit = hit.withColumn("from", F.greatest(F.col("offset"), F.col("lo") + F.col("diagonal")))
    return hit.select("doc_id", "item", "diagonal", "width", "lo", "hi", "from", F.slice("h", F.col("from") - F.col("offset") + 1, F.col("hi") + F.col("diagonal") - F.col("from") + 1).alias("around"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document, item and diagonal that overlap: best similarity and the words covered (start, stop)."""
    hashed = lambda c: F.transform(words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.xxhash64(w))
    docs = _held(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "h", hashed("t")).select("doc_id", "h")
    items = _held(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")), "h", hashed("t")).select("item_id", "h").where(F.size("h") > 0)
    kinds = ((f"size(h) >= {WINDOW}", MASKS), (f"size(h) >= {LEAST_WORDS} and size(h) < {WINDOW}", (SHORT_MASK,)), (f"size(h) < {LEAST_WORDS}", ()))
    sizes = items.select(*(F.sum(F.when(F.expr(c), F.size("h"))).alias(f"n{k}") for k, (c, _) in enumerate(kinds))).first()
    found = [_hits(docs, items.where(c), masks, n) for n, (c, masks) in zip(sizes, kinds, strict=True) if n and masks]
    if sizes[-1]:
        whole = docs.where(kinds[-1][0]).join(items.where(kinds[-1][0]), "h")
        found.append(whole.select("doc_id", "item_id", F.lit(0).alias("diagonal"), F.lit(1.0).alias("similarity"), F.lit(0).alias("start"), F.size("h").alias("stop")))
    if not found:
        return docs.select("doc_id", docs["doc_id"].alias("item_id"), F.lit(0).alias("diagonal"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("stop")).where("false")
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("doc_id", "item_id", "diagonal").agg(F.max("similarity").alias("similarity"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, the items found (sorted) and the best similarity."""
    found = overlaps(docs, benchmark, id_col, text_col).groupBy("doc_id")
    found = found.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    ids, found = docs.select(F.col(id_col).alias("doc_id")), found.withColumnRenamed("doc_id", "found_id")
    both = ids.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return both.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap an item, with all columns."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
bench AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs),
items AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM bench WHERE len(w) >= {LEAST_WORDS}),
likely AS (
  SELECT doc_id, item_id, t.place - i.place AS diagonal FROM tokens t JOIN items i USING (word)
  GROUP BY ALL HAVING count(*) >= ceil({SIMILARITY} * least({WINDOW}, any_value(n)))),
met AS (
  SELECT doc_id, item_id, diagonal, n, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i.place RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS matched
  FROM likely JOIN tokens t USING (doc_id) JOIN items i USING (item_id, word) WHERE t.place - i.place = diagonal),
every AS (
  SELECT doc_id, item_id, matched / least({WINDOW}, n) AS similarity FROM met WHERE matched >= ceil({SIMILARITY} * least({WINDOW}, n))
  UNION ALL SELECT doc_id, item_id, 1.0 FROM docs JOIN bench USING (w) WHERE len(w) BETWEEN 1 AND {LEAST_WORDS - 1}),
best AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, max(similarity) AS similarity FROM every GROUP BY doc_id)
SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, []::BIGINT[]) AS item_ids, coalesce(similarity, 0.0) AS similarity
FROM documents LEFT JOIN best USING (doc_id)
"""
