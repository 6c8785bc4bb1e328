"""The fact base: upserts with refusals, synonym expansion, snapshot differences with unknowns, repeats matched in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def import_rows(known: DataFrame, incoming: DataFrame, key: str, checked: str, released: str) -> DataFrame:
    """key and outcome of each incoming key: new, updated (known from a release and checked later), or a refusal: duplicate in the
    release, own (not from a release), or not newer."""
    once = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(checked).alias("_checked"))
    have = known.select(F.col(key), F.col(checked).alias("_known"), F.col(released).alias("_released"))
    outcome = (
        F.when(F.col("_n") > 1, "duplicate").when(F.col("_known").isNull(), "new").when(~F.col("_released"), "own").when(F.col("_checked") > F.col("_known"), "updated").otherwise("not newer")
    )
    return once.join(have, key, "left").select(key, outcome.alias("outcome"))


def expanded(queries: DataFrame, query_id: str, words: str, synonyms: DataFrame) -> DataFrame:
    """query_id, word, weight: the query's words at 1, and at 0.5 the other terms of each group that the query has a term of.

    synonyms: group, term (one word). The groups are a small controlled list and join by word.
    """
    own = queries.select(query_id, F.explode(words).alias("word"))
    groups = own.join(synonyms, own["word"] == synonyms["term"]).select(query_id, "group").distinct()
    more = groups.join(synonyms, "group").select(query_id, F.col("term").alias("word"), F.lit(0.5).alias("weight"))
    return own.withColumn("weight", F.lit(1.0)).unionByName(more).groupBy(query_id, "word").agg(F.max("weight").alias("weight"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, kind: str, state: str, unknown: DataFrame) -> DataFrame:
    """key, kind, event (new, gone, changed). An item isn't gone while its kind could not be read (``unknown``: kind)."""
    a = before.select(key, F.col(kind).alias("_kind_a"), F.col(state).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(key, F.col(kind).alias("_kind_b"), F.col(state).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, key, "full").withColumn(kind, F.coalesce("_kind_b", "_kind_a"))
    j = j.join(unknown.select(kind).distinct().withColumn("_unread", F.lit(True)), kind, "left")
    event = F.when(F.col("_in_a").isNull(), "new").when(F.col("_in_b").isNull() & F.col("_unread").isNull(), "gone").when(F.col("_in_b") & ~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, kind, event.alias("event")).where(F.col("event").isNotNull())


def repeats_paired(fresh: DataFrame, old: DataFrame, text: str, fresh_id: str, old_id: str) -> DataFrame:
    """fresh_id with the old row of the same text; the first fresh row meets the first old one, and so on."""
    nth = lambda i: F.row_number().over(Window.partitionBy(text).orderBy(i))
    a = fresh.select(text, fresh_id, nth(fresh_id).alias("_n"))
    b = old.select(text, F.col(old_id).alias("_old"), nth(old_id).alias("_n"))
    return a.join(b, [text, "_n"], "left").select(fresh_id, F.col("_old").alias(old_id))


def catalog_verdict(names: DataFrame, name: str, catalog: DataFrame, key_of) -> DataFrame:
    """offered or withdrawn by the exact key of the name, else unclear. catalog: name, offered."""
    listed = catalog.select(key_of(F.col("name")).alias("_key"), "offered").groupBy("_key").agg(F.max("offered").alias("offered"))
    verdict = F.when(F.col("offered").isNull(), "unclear").when(F.col("offered"), "offered").otherwise("withdrawn")
    return names.withColumn("_key", key_of(F.col(name))).join(listed, "_key", "left").select(*names.columns, verdict.alias("verdict"))


def keyed_overlap(texts: DataFrame, text_id: str, keys: Column, prints: DataFrame, salt: str) -> DataFrame:
    """text_id, cls, n: distinct keys of a text whose salted hash is a known print (hash, cls)."""
    h = F.substring(F.sha2(F.concat(F.lit(salt), F.col("_key")), 256), 1, 16)
    hit = texts.select(text_id, F.explode(F.array_distinct(keys)).alias("_key")).withColumn("hash", h)
    return hit.join(prints, "hash").groupBy(text_id, "cls").agg(F.count(F.lit(1)).alias("n"))
