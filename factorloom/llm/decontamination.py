"""Benchmark passages in documents, by spaced seeds. DataFrame functions only.

A mask picks some of a span's words and ignores the others, so a substituted word spoils
only the seeds that look at it. Seeds of documents meet seeds of the benchmark by hash; a
hit names a document, an item and a diagonal, and the whole diagonal is then compared word
by word: any stretch of it may be the overlap, so a gap between two copied passages spoils
neither, and one hit is enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.components import fresh, saved

#: words of a seed, as places in its span
MASKS = ((0, 1, 2, 5, 7), (0, 2, 3, 6, 7))
SPAN = 8
#: words that must agree (the whole item, if it has fewer), and their share of the overlap
MIN_WORDS, SHARE = 10, 0.8
#: seeds of the benchmark up to which they are broadcast (about 40 bytes each); more are joined by shuffle
BROADCAST_SEEDS = 1_000_000
#: documents with a hit up to which their ids are broadcast; more are joined by shuffle
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def seeds(hashes: Column, places: tuple[int, ...], span: int, mask: int) -> Column:
    """A seed for each start of a span in an array of word hashes."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (span - 1), F.lit(0)))
    return F.transform(starts, lambda first, i: F.xxhash64(F.lit(mask), *(first if not p else F.get(hashes, i + p) for p in places)))


def seed_rows(df: DataFrame, id_col: str, masks: list[tuple[tuple[int, ...], int]], place: str) -> DataFrame:
    """id, place of the seed's first word, seed, span."""
    hashed = df.select(id_col, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    parts = [hashed.select(id_col, F.lit(span).alias("span"), F.posexplode(seeds(F.col("h"), places, span, k)).alias(place, "seed")) for k, (places, span) in enumerate(masks)]
    return reduce(DataFrame.unionByName, parts)


def best_stretch(places: Column, least: Column, share: float) -> Column:
    """matched, -words, -place of the best stretch of a diagonal, NULL if none counts. places: the item's words that agree, ascending.

    A stretch from one agreeing word to another counts if ``least`` words agree and they are
    ``share`` of it; most agreeing words are best, then fewest words, then the first.
    """
    n = F.size(places)
    kind = "struct<matched:int,words:int,place:int>"
    stretch = lambda i, j: F.struct(j - i + 1, -(F.get(places, j) - F.get(places, i) + 1), -F.get(places, i)).cast(kind)
    good = lambda i, j: (j - i + 1) >= share * (F.get(places, j) - F.get(places, i) + 1)
    last = lambda i: F.aggregate(F.sequence(i + least - 1, n - 1), F.lit(-1), lambda best, j: F.when(good(i, j), j).otherwise(best))
    none = F.lit(None).cast(kind)
    search = F.aggregate(F.sequence(F.lit(0), n - least), none, lambda best, i: F.array_max(F.array(best, F.transform(F.array(last(i)), lambda j: F.when(j >= 0, stretch(i, j)))[0])))
    return F.when(n < least, none).when(good(F.lit(0), n - 1), stretch(F.lit(0), n - 1)).otherwise(search)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_matched: the best overlap of each document and item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. An overlap
    counts if ``min_words`` of its words agree (all, for an item with fewer) and they are at
    least ``share`` of its length. Null or empty texts and null ids give no rows; rows that
    share an id count together; repeated rows count once. Empty tables give no rows. Items
    shorter than a mask's span are looked for whole, without substitutions. A diagonal whose
    ends agree well enough takes time in proportion to the item, another its square.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("b")).distinct()
    short = [r[0] for r in items.where(F.size("b").between(1, SPAN - 1)).select(F.size("b")).distinct().collect()]  # SPAN - 1 values at most
    masks = [(m, SPAN) for m in MASKS] + [(tuple(range(n)), n) for n in sorted(short)]
    of_items = seed_rows(items.select("item_id", F.col("b").alias("w")), "item_id", masks, "item_at").withColumn("whole", F.col("span") < SPAN)
    lengths = items.select("item_id", F.size("b").alias("n_item"))
    # a short item's seed must be all of it
    of_items = of_items.join(lengths, "item_id").where("not whole or span = n_item").select("item_id", "item_at", "seed").distinct()
    if of_items.count() <= BROADCAST_SEEDS:
        of_items = F.broadcast(of_items)
    worded = docs.select("doc_id", words(F.col("text")).alias("w"))
    hits = seed_rows(worded, "doc_id", masks, "doc_at").drop("span").join(of_items, "seed")
    diagonals = saved(hits.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct())
    ids = diagonals.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:  # texts without a hit need not travel
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    met = diagonals.join(items, "item_id").join(docs, "doc_id").withColumn("w", words(F.col("text")))
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("b"), F.size("w") - F.col("shift")) - 1
    places = F.when(last >= first, F.filter(F.sequence(first, last), lambda k: F.get("b", k) == F.get("w", k + F.col("shift")))).otherwise(F.array().cast("array<int>"))
    compared = met.select("doc_id", "item_id", "shift", F.least(F.lit(min_words), F.size("b")).alias("least"), places.alias("places"))
    judged = compared.withColumn("s", best_stretch(F.col("places"), F.col("least"), share))
    found = F.when(F.col("s").isNotNull(), F.struct("s.matched", "s.words", (F.col("s.place") - F.col("shift")).alias("at"), F.col("s.place").alias("place")))
    # a filter on ``s`` before the aggregate would be pushed down and work ``places`` out anew for every step of the search
    best = judged.groupBy("doc_id", "item_id").agg(F.max(found).alias("best")).where("best is not null")
    return best.select("doc_id", "item_id", (-F.col("best.at")).alias("doc_start"), (-F.col("best.place")).alias("item_start"), (-F.col("best.words")).alias("n_words"), F.col("best.matched").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with all their columns whatever their names.

    Each row is judged by its own text, also if its doc_id is null or repeated; equal rows
    fare alike. Null and empty texts stay. Empty tables give no rows; without a benchmark
    every row stays.
    """
    key, h = fresh("key", docs.columns), F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h")))
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    flat = [F.coalesce(F.col(key)["doc_id"], F.lit(-1)), F.col(key)["doc_id"].isNull(), F.col(key)["h"]]
    names = [fresh(f"key{k}", docs.columns) for k in range(3)]
    keyed, found = (x.select(*(docs.columns if x is keyed else []), *(c.alias(n) for c, n in zip(flat, names))) for x in (keyed, found))
    return keyed.join(found, names, "left_anti").select(docs.columns)


#: the same rule over all diagonals, without seeds: every pair of equal words names one
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS b FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS doc_at FROM d),
bw AS (SELECT item_id, least({MIN_WORDS}, len(b)) AS needed, unnest(b) AS word, unnest(range(len(b))) AS item_at FROM b),
diagonals AS (
  SELECT doc_id, item_id, needed, doc_at - item_at AS shift, list(item_at ORDER BY item_at) AS m
  FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= needed),
opened AS (SELECT *, unnest(range(len(m))) AS i FROM diagonals),
stretches AS (SELECT *, unnest(range(i + needed - 1, len(m))) AS j FROM opened),
sized AS (SELECT doc_id, item_id, m[i + 1] + shift AS doc_start, m[i + 1] AS item_start, m[j + 1] - m[i + 1] + 1 AS n_words, j - i + 1 AS n_matched FROM stretches),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_words, doc_start, item_start) AS r
  FROM sized WHERE n_matched >= {SHARE} * n_words)
SELECT doc_id, item_id, doc_start::INT AS doc_start, item_start::INT AS item_start, n_words::INT AS n_words, n_matched::INT AS n_matched FROM ranked WHERE r = 1
"""
