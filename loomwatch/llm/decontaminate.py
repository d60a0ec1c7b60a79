"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Every window of ``width`` consecutive item words (the whole item, if shorter) is sought in every
document. Words are ordered by rarity, by their counts over all documents. A window that occurs
must bring its rarest word with it, so that word alone is its necessary prefix: only document
words equal to some window's prefix word become candidates. The prefix's place in the window
gives the start in the document (positional bound), the window must fit before the end (length
bound), and the candidate holds if the document's words there equal the window's.

The windows are the small side. They are broadcast in blocks of at most ``block_rows`` windows,
so what is broadcast is bounded whatever the benchmark's size; each block is one pass over the
documents. Nothing is grouped but by document.

Defined cases: null and empty texts have no words, and an item without words has no window;
rows that share doc_id and text come back alike; equal windows of several items count for each
item; a text of any length is read whole; empty documents give an empty table, and an empty
benchmark marks nothing; input columns named like an added one are replaced, all others are returned
as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomwatch.llm.names import col, fresh
from loomwatch.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters once ASCII letters are lower case, and the same before.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows in one broadcast block, and words whose corpus counts may be broadcast at once.
BLOCK_ROWS = 50_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ``lower`` does the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), lambda w: w != "")


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: (win array, items array of ids that have it)."""
    words = items.select(col(id_col).cast("string").alias("item"), words_of(col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    wins = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("win"))
    return wins.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(df: DataFrame, by: list[str], rows: int) -> list[DataFrame]:
    """``df`` split by hash into parts of about ``rows`` rows."""
    n = max(1, -(-df.count() // rows))
    return [df.where(F.pmod(F.xxhash64(*by), F.lit(n)) == i) for i in range(n)]


def corpus_counts(texts: DataFrame, vocabulary: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(word, n) over all documents, of the words of ``vocabulary`` that occur."""
    found = []
    for block in _blocks(vocabulary, ["word"], block_rows):
        each = texts.select(F.explode(words_of(F.col("text"))).alias("word"))
        found.append(each.join(F.broadcast(block), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, found)


def prefixed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their prefix: (word, at, len, win, items), at the rarest word's first place."""
    each = windows.select("win", "items", F.posexplode("win").alias("at", "word"))
    ranked = each.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("win").agg(F.min(F.struct("n", "word", "at")).alias("p"), F.first("items").alias("items"))
    # A word that no document has means that the window occurs in none.
    return rarest.where("p.n > 0").select("p.word", "p.at", F.size("win").alias("len"), "win", "items")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(_id, _tk, hits, item_ids) of each document with an occurrence.

    hits: the sorted distinct numbers (from 0) of the words that lie in some occurrence;
    item_ids: the sorted distinct ids of the items with one.
    """
    texts = docs.select(col(text_col).alias("text"))
    windows = materialize(item_windows(items, item_id_col, item_text_col, width), "windows")
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = corpus_counts(texts, vocabulary, block_rows)
    prefixes = materialize(prefixed(windows, counts), "window-prefixes")
    keyed = docs.select(col(id_col).alias("_id"), F.xxhash64(col(text_col)).alias("_tk"), words_of(col(text_col)).alias("_w"))
    found = []
    for block in _blocks(prefixes, ["win"], block_rows):
        each = keyed.select("_id", "_tk", "_w", F.posexplode("_w").alias("_at", "word"))
        start = F.col("_at") - F.col("at")
        candidates = each.join(F.broadcast(block), "word").where((start >= 0) & (start + F.col("len") <= F.size("_w")))
        hits = candidates.where(F.slice("_w", start + 1, F.col("len")) == F.col("win"))
        found.append(hits.select("_id", "_tk", start.alias("s"), "len", "items"))
    hits = reduce(DataFrame.unionByName, found)
    covered = F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1)))
    return hits.groupBy("_id", "_tk").agg(F.collect_set(F.struct("s", "len")).alias("spans"), F.collect_set("items").alias("i")).select(
        "_id", "_tk", F.array_sort(F.array_distinct(covered)).alias("hits"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("item_ids")
    )


def mark_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), item_ids and contaminated.

    With ``keep_text`` False only the id comes with them, and no text is shuffled.
    """
    added = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    names = [c for c in docs.columns if c.lower() not in added] if keep_text else [id_col]
    words, dk, gid, gtk, hits, ids = fresh(docs, "_words", "_dk", "_id", "_tk", "_hits", "_ids")
    found = contamination(docs, items, id_col, text_col, **options)
    found = found.select(F.col("_id").alias(gid), F.col("_tk").alias(gtk), F.size("hits").alias(hits), F.col("item_ids").alias(ids))
    n_words = F.regexp_count(F.coalesce(col(text_col), F.lit("")), F.lit(WORD_ANY_CASE))
    keyed = docs.select(*map(col, names), n_words.cast("long").alias(words), F.xxhash64(col(text_col)).alias(dk))
    joined = keyed.join(found, col(id_col).eqNullSafe(col(gid)) & (col(dk) == col(gtk)), "left")
    marked = col(hits).isNotNull()
    return joined.select(
        *map(col, names), col(words).alias("n_words"), F.when(marked, col(hits)).otherwise(0).cast("long").alias("n_hit"),
        F.when(marked, F.size(col(ids))).otherwise(0).cast("long").alias("n_items"),
        F.coalesce(col(ids), F.array().cast("array<string>")).alias("item_ids"), marked.alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without an occurrence, with their columns as they are."""
    dk, gid, gtk = fresh(docs, "_dk", "_id", "_tk")
    found = contamination(docs, items, id_col, text_col, **options).select(F.col("_id").alias(gid), F.col("_tk").alias(gtk))
    keyed = docs.withColumn(dk, F.xxhash64(col(text_col)))
    return keyed.join(found, col(id_col).eqNullSafe(col(gid)) & (col(dk) == col(gtk)), "left_anti").select(*map(col, docs.columns))
