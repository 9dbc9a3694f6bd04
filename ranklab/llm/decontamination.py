"""Benchmark decontamination by a positional inverted index.

1. *Index.* The postings (term, document, position) of the benchmark's
   vocabulary over all documents are stored as a table.
2. *Windows.* ``WINDOW`` consecutive words of a benchmark item (all words of a
   shorter item) are a phrase; its terms are ranked by the length of their
   posting lists.
3. *Intersection.* The list of a phrase's rarest term, shifted by the term's
   offset, gives the starts at which the phrase may occur; they are intersected
   with the shifted list of the second rarest, and then with all others. What is
   left are the exact occurrences.
4. *Proximity.* On request, phrases whose two rarest terms stand within a
   distance of each other are reported from the same lists.

Only DataFrame operations are used. Benchmark tables (vocabulary, phrases) are
broadcast when they have at most ``BROADCAST_ROWS`` rows, else joined.

Defined cases: null text has no words; items without words give no phrase;
repeated documents are each reported; a null id is kept; repeated items count
by their id; items with a null id are searched like any other, count as one item
in ``n_items`` and are not in ``items`` (nor its digest); empty tables give no
hits (all documents clean) or an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

WINDOW = 10
BROADCAST_ROWS = 200_000
#: Everything but ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after folding A-Z: ASCII that is neither digit nor letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words in order. A separator at either end leaves an empty string there."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def word_count(words: Column) -> Column:
    ends = (F.element_at(words, 1) == "").cast("int") + (F.element_at(words, -1) == "").cast("int")
    return F.when(F.size(words) == 1, 1 - (F.element_at(words, 1) == "").cast("int")).otherwise(F.size(words) - ends).cast("long")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a stored table) marked for broadcast where its size is proven."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, window: int) -> DataFrame:
    """(phrase, item_id, words) of every window of every item."""
    words = F.filter(words_of(fold(F.col("text"))), lambda w: w != "")
    some = items.select(F.col("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return (some.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("words"))
            .select(F.concat_ws(" ", "words").alias("phrase"), "item_id", "words"))


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, doc, key, pos) of the vocabulary (term_id, term) in ``docs`` (doc, key, text)."""
    tokens = docs.select("doc", "key", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    known = vocabulary.withColumn("folded", F.lower("term"))
    # lower() also folds other letters: a wider key, then the exact form
    exact = (F.col("word") == F.col("term")) | (fold(F.col("word")) == F.col("term"))
    return tokens.join(small(known), (F.lower("word") == F.col("folded")) & exact).select("term_id", "doc", "key", "pos")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key): the id with 0 for null, and a fingerprint of the text and of
    whether the id is null; equal only for equal rows."""
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(doc.isNull(), text).alias("key"), text.alias("text"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, proximity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, key, phrase_id, start, length) of all exact occurrences, and
    (phrase_id, item_id). With ``proximity`` the first table has instead the
    starts (of the rarest term) at which the phrase's two rarest terms stand
    within that many words."""
    found = stored(phrases(items, window))
    distinct = found.groupBy("phrase").agg(F.first("words").alias("words")).withColumn("phrase_id", F.xxhash64("phrase"))
    distinct = stored(distinct)
    of_item = stored(found.join(distinct.select("phrase", "phrase_id"), "phrase").select("phrase_id", "item_id").distinct())
    terms = distinct.select("phrase_id", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
    vocabulary = stored(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    index = stored(postings(docs, vocabulary))
    lengths = index.groupBy("term_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("phrase_id").orderBy(F.coalesce("n", F.lit(0)), "term_id", "offset")  # at most `window` rows each
    plan = stored(terms.join(vocabulary, "term").join(lengths, "term_id", "left").withColumn("rank", F.row_number().over(order))
                  .select("phrase_id", "length", "offset", "term_id", "rank"))
    first, second = plan.where("rank = 1"), plan.where("rank = 2")
    at = (index.join(small(first), "term_id").select("doc", "key", "phrase_id", "length", (F.col("pos") - F.col("offset")).alias("start")).distinct())
    after = second.select("phrase_id", F.col("offset").alias("next"), F.col("term_id").alias("next_term"))
    rare = index.join(small(stored(second.select("term_id").distinct())), "term_id").select(
        F.col("term_id").alias("next_term"), F.col("doc"), F.col("key"), F.col("pos").alias("next_pos"))
    both = at.join(small(after), "phrase_id")
    if proximity is not None:
        one = both.join(small(first.select("phrase_id", F.col("offset").alias("rare_offset"))), "phrase_id")
        near = one.join(rare, ["doc", "key", "next_term"]).where(F.abs(F.col("next_pos") - F.col("start") - F.col("rare_offset")) <= proximity)
        return near.select("doc", "key", "phrase_id", "start", "length").distinct(), of_item
    alone = at.where("length = 1")
    pair = both.withColumn("next_pos", F.col("start") + F.col("next")).join(rare, ["doc", "key", "next_term", "next_pos"], "left_semi")
    pair = stored(pair.select("doc", "key", "phrase_id", "length", "start"))
    rest = plan.where("rank > 2").select("phrase_id", "offset", "term_id")
    wanted = pair.join(small(rest), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
    hit = index.join(small(stored(pair.select("doc", "key").distinct())), ["doc", "key"], "left_semi")
    same = ["doc", "key", "phrase_id", "start", "length"]
    full = (wanted.join(hit, ["doc", "key", "term_id", "pos"], "left_semi").groupBy(same).agg(F.count("*").alias("n"))
            .where(F.col("n") == F.col("length") - 2).select(same))
    return stored(alone.select(same).unionByName(pair.where("length = 2").select(same)).unionByName(full)), of_item


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings, without null), contaminated of every row."""
    base = keyed(docs, id_col, text_col)
    some = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    found, of_item = occurrences(base, some, window)
    places = F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)
    hits = (found.select("doc", "key", "start", "length").distinct().groupBy("doc", "key")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long").alias("n_hit")))
    names = (found.select("doc", "key", "phrase_id").distinct().join(small(of_item), "phrase_id")
             .groupBy("doc", "key").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("nameless")))
    counted = base.select("doc_id", "doc", "key", word_count(words_of(F.col("text"))).alias("n_words"))
    out = counted.join(hits, ["doc", "key"], "left").join(names, ["doc", "key"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      (F.size(F.coalesce("items", none)) + F.coalesce("nameless", F.lit(0))).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "doc", "key")
