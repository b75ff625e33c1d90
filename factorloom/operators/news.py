"""News: which companies a text names, which articles are one story, and what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import article_id, content_hash, news_id, normalise_text, strip_legal_suffix
from factorloom.sources.store import written

#: aliases up to which the dictionary is broadcast; a larger one is joined by shuffle
BROADCAST_ALIASES = 2_000_000
BODY_FACTOR, ROUNDUP_COMPANIES, ROUNDUP_CONFIDENCE = 0.70, 3, 0.5
#: fixed values: words on which a shortened name may not end
CONNECTIVES = ("of", "and", "the", "for", "in", "on", "at", "to", "a")


def story_keys(articles: DataFrame, text: str = "text") -> DataFrame:
    """Adds content_hash of the normalised text."""
    return articles.withColumn("content_hash", content_hash(F.col(text)))


def first_of_story(articles: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds is_first: the earliest article of each story; the rest are duplicates."""
    return articles.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def alias_candidates(instruments: DataFrame, groups: list[str] = (), common: list[str] = (), curated: DataFrame | None = None) -> DataFrame:
    """alias, isin, source, confidence: the most confident of each.

    Of a company (isin, symbol, name): its name without legal suffixes (0.85 if it is one
    word), its symbol, curated names (symbol, alias), the first two words of a longer name
    (without connectives at the end, and not if all are common words), and the first word.
    No alias is shorter than three letters, nor a single word that names a group of companies
    or is common.
    """
    full, symbol = strip_legal_suffix(normalise_text(F.col("name"))), normalise_text(F.col("symbol"))
    words = F.split(full, " ")
    prefix = F.trim(F.regexp_replace(F.concat(F.lit(" "), F.array_join(F.slice(words, 1, 2), " ")), f"( ({'|'.join(CONNECTIVES)}))+$", ""))
    ordinary = F.forall(F.split(prefix, " "), lambda w: w.isin(list(common))) if common else F.lit(False)
    of = lambda alias, source, confidence: F.struct(alias.alias("alias"), F.lit(source).alias("source"), confidence.alias("confidence"))
    made = F.array(
        of(full, "NAME", F.when(F.size(words) > 1, 0.95).otherwise(0.85)),
        of(symbol, "SYMBOL", F.lit(0.90)),
        of(F.when((F.size(words) >= 3) & (F.size(F.split(prefix, " ")) >= 2) & ~ordinary, prefix), "NAME_PREFIX", F.lit(0.90)),
        of(F.when(F.size(words) > 1, words[0]), "NAME_SHORT", F.lit(0.60)),
    )
    rows = instruments.select("isin", F.explode(made).alias("a")).select("isin", "a.*")
    if curated is not None:
        own = instruments.join(curated.withColumnRenamed("alias", "_alias"), F.upper(instruments["symbol"]) == F.upper(curated["symbol"]))
        rows = rows.unionByName(own.select("isin", normalise_text(F.col("_alias")).alias("alias"), F.lit("CURATED").alias("source"), F.lit(0.95).alias("confidence")))
    blocked = (F.length("alias") < 3) | F.col("alias").isin([*groups, *common]) if groups or common else F.length("alias") < 3
    rows = rows.where(F.col("alias").isNotNull() & ~blocked)
    return rows.groupBy("alias", "isin").agg(F.max(F.struct("confidence", "source")).alias("m")).select("alias", "isin", "m.source", "m.confidence")


def split_conflicts(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases of one company, and those that more than one claims (alias, companies)."""
    claims = candidates.groupBy("alias").agg(F.count_distinct("isin").alias("companies"))
    return candidates.join(claims.where("companies = 1").select("alias"), "alias", "left_semi"), claims.where("companies > 1")


def mentions(articles: DataFrame, aliases: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, start, n, alias, isin, confidence: the longest alias at each place; a hit inside a longer hit is none.

    Each word of a text, with the words ahead of it that an alias can have, meets the aliases
    that begin with it; so a text makes a row a word, whatever the length of aliases.
    """
    longest = aliases.agg(F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1)).alias("_longest"))  # one row
    worded = articles.select(id_col, F.split(normalise_text(F.col(text)), " ").alias("_w")).crossJoin(F.broadcast(longest))
    ahead = F.transform("_w", lambda x, i: F.struct(x.alias("first"), F.concat(F.array_join(F.slice(F.col("_w"), i + 1, F.col("_longest")), " "), F.lit(" ")).alias("ahead")))
    rows = worded.select(id_col, F.posexplode(ahead).alias("start", "x")).select(id_col, "start", "x.*")
    few = aliases.select("alias", "isin", "confidence", F.split("alias", " ")[0].alias("first"), F.size(F.split("alias", " ")).alias("n"))
    met = rows.join(F.broadcast(few) if few.count() <= BROADCAST_ALIASES else few, "first").where(F.startswith("ahead", F.concat("alias", F.lit(" "))))
    before = Window.partitionBy(id_col).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    held = (F.coalesce(F.max(end).over(before), F.lit(0)) >= end) | (F.max("n").over(Window.partitionBy(id_col, "start")) > F.col("n"))
    return met.withColumn("_held", held).where("not _held").select(id_col, "start", "n", "alias", "isin", "confidence")


def best_mentions(headline: DataFrame, body: DataFrame, id_col: str) -> DataFrame:
    """id, isin, confidence, method: the best mention of each company; the body counts less than the headline."""
    rows = headline.select(id_col, "isin", "n", "confidence", F.lit("HEADLINE").alias("method")).unionByName(body.select(id_col, "isin", "n", F.round(F.col("confidence") * BODY_FACTOR, 4).alias("confidence"), F.lit("BODY").alias("method")))
    w = Window.partitionBy(id_col, "isin").orderBy(F.desc("confidence"), F.desc("method"), F.desc("n"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(id_col, "isin", "confidence", "method")


def demote_roundups(rows: DataFrame, id_col: str) -> DataFrame:
    """Articles on more than ROUNDUP_COMPANIES companies say little of each."""
    many = F.count("*").over(Window.partitionBy(id_col)) > ROUNDUP_COMPANIES
    return rows.withColumn("_m", many).withColumn("confidence", F.when(F.col("_m"), F.least("confidence", F.lit(ROUNDUP_CONFIDENCE))).otherwise(F.col("confidence"))).withColumn("method", F.when(F.col("_m"), "ROUNDUP").otherwise(F.col("method"))).drop("_m")


def store_new(incoming: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that are neither stored nor repeated among themselves. Keys may be NULL: such rows equal each other."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    known = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return first.join(known, same, "left_anti")


def store_articles(articles: DataFrame, mentions: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to store, one for each article and company it names (isin NULL where it names none), and one row of statistics.

    articles: url, headline, published_at; mentions: article_id, isin, confidence, method;
    stored: news_id, isin, content_hash, day. A story - company, headline and day - is stored
    once, so one that comes back on another day is news again; so is an article's row.
    """
    named = articles.select("url", "headline", "published_at", article_id(F.col("url"), F.col("headline"), F.col("published_at")).alias("article_id"), content_hash(F.col("headline")).alias("content_hash"), F.to_date("published_at").alias("day"))
    rows = named.join(mentions, "article_id", "left").withColumn("news_id", news_id(F.col("article_id"), F.col("isin")))
    fresh = store_new(rows, stored, ["isin", "content_hash", "day"], ["published_at", "news_id"])
    fresh = store_new(fresh, stored, ["news_id"], ["published_at"])
    came = rows.agg(F.count("*").alias("rows"), F.count_distinct("article_id").alias("articles"), F.count_if(F.col("isin").isNull()).alias("unresolved"))
    kept = fresh.agg(F.count("*").alias("stored"))
    return fresh, came.crossJoin(F.broadcast(kept)).withColumn("duplicates", F.col("rows") - F.col("stored"))  # one row each


def reresolved(old: DataFrame, new: DataFrame, scores: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Changes between two resolutions, and the scores that outlive them: those of rows that were not removed."""
    changes = written(resolution_changes(old, new, id_col))
    return changes, scores.join(changes.where("change = 'REMOVED'").select(id_col, "isin"), [id_col, "isin"], "left_anti")


def confirmed(articles: DataFrame, best: DataFrame, id_col: str) -> DataFrame:
    """Attributed articles (id, isin) that do name their company, with the mention's confidence and method. best: ``best_mentions`` of the same articles."""
    return articles.join(best.select(id_col, "isin", "confidence", "method"), [id_col, "isin"])


def signed_scores(odds: DataFrame, labels: list[str]) -> DataFrame:
    """text, label, score of a model's odds (text, p: an array in the order of ``labels``): the likeliest label, and positive less negative odds."""
    best = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*map(F.lit, labels))
    at = lambda label: F.get("p", F.lit(labels.index(label)))
    return odds.select("text", F.element_at(names, best).alias("label"), (at("positive") - at("negative")).alias("score"))


def resolution_changes(old: DataFrame, new: DataFrame, id_col: str, columns: list[str] = ()) -> DataFrame:
    """id, isin, change (ADDED, REMOVED, CHANGED) between two resolutions, and ``columns`` of the new one (NULL where it has no row)."""
    a = old.select(id_col, "isin", F.struct("method", F.round("confidence", 4)).alias("old"))
    b = new.select(id_col, "isin", F.struct("method", F.round("confidence", 4)).alias("new"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    both = a.join(b, [id_col, "isin"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("CHANGED").alias("change")
    return both.select(id_col, "isin", change, *(F.col(f"_new_{c}").alias(c) for c in columns))


def score_once(rows: DataFrame, text: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds what ``scorer`` says of each distinct text (it maps a frame of ``text`` to text, label, score)."""
    return rows.join(scorer(rows.select(text).distinct()), text, "left")


def scoring_text(headline: Column, body: Column) -> Column:
    return F.when(body.isNull() | (F.trim(body) == "") | (F.trim(body) == F.trim(headline)), F.trim(headline)).otherwise(F.concat(F.trim(headline), F.lit(". "), F.trim(body)))
