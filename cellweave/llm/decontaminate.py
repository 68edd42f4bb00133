"""Benchmark passages in training documents, by winnowing.

Of every document and item the hashes of k words in a row are taken, and of each sliding window of them the least is
kept. Any passage of `width` words that both share holds a whole window, so both keep the same hash of it: the join of
kept hashes misses no such passage. Hits are then extended: the document's windows of `width` words are compared, as
words, with the items'.

Scale: texts are never shuffled for the search; only kept hashes (two of seven words) are joined, by broadcast while the
benchmark's are counted to be few and by shuffle otherwise. Documents with a hit are compared once per distinct text, so
a third of all rows being copies costs one comparison. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, plan_bytes, table
from .native import gram_hashes, hashed, let, lower_ascii, small, split_words, text_key, up_to

APART = "[\\x00-/:-`{-\\x7f]+"
GRAM = 5
MOST_BROADCAST = 1_000_000


def item_words(text: Column) -> Column:
    """Words in the sense of the benchmark: runs of digits, letters a to z (A to Z lower-cased) and non-ASCII."""
    return split_words(lower_ascii(text), APART)


def winnowed(hashes: Column, width: int, gram: int = GRAM) -> Column:
    """The least gram hash of every window of `width` words, each once."""
    over = width - gram + 1
    return let(gram_hashes(hashes, gram), lambda g: F.array_distinct(F.transform(up_to(F.size(g) - (over - 1)), lambda i: F.array_min(F.slice(g, i + 1, over)))))


def kept_hashes(words: Column, width: int, short: list[int]) -> Column:
    """What a document keeps: winnowed hashes, and for items of fewer words all hashes of that many."""
    return let(hashed(words), lambda h: F.concat(winnowed(h, width), *[F.array_distinct(gram_hashes(h, n)) for n in short]))


def windows_of(words: Column, width: Column) -> Column:
    return F.transform(up_to(F.size(words) - width + 1), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice(words, i + 1, width)).alias("window")))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with text (null: empty) and h1, h2, which stand for it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, text.alias("text"), *text_key(text))


def hits(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """h1, h2, n_hit, n_items, ids of every distinct text (keyed) with a hit. An item without words has no window;
    repeated items count once."""
    space = Workspace(docs.sparkSession, "winnowing")
    items = items.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("words")).filter("item IS NOT NULL AND size(words) > 0")
    items = items.withColumn("wide", F.least(F.size("words"), F.lit(width)))
    short = sorted(r[0] for r in items.filter(F.col("wide") < width).select("wide").distinct().collect())  # under `width` values
    own = F.when(F.col("wide") == width, winnowed(hashed(F.col("words")), width))
    for n in short:
        own = own.when(F.col("wide") == n, gram_hashes(hashed(F.col("words")), n))
    prints = small(space.save(items.select(F.explode(own).alias("print")).distinct(), "prints"), MOST_BROADCAST)
    windows = items.select("item", "wide", F.explode(windows_of(F.col("words"), F.col("wide"))).alias("w"))
    windows = windows.groupBy("wide", F.col("w.window").alias("window")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = small(space.save(windows, "windows"), MOST_BROADCAST)

    hit = docs.select("h1", "h2", F.explode(kept_hashes(item_words(F.col("text")), width, short)).alias("print")).join(prints, "print", "left_semi").select("h1", "h2").distinct()
    hit = space.save(hit, "hit")
    texts = docs.join(hit, ["h1", "h2"], "left_semi").select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    words = texts.select("h1", "h2", item_words(F.col("text")).alias("words"))
    there = None
    for n in [width, *short]:
        part = words.select("h1", "h2", F.lit(n).alias("wide"), F.explode(windows_of(F.col("words"), F.lit(n))).alias("w"))
        there = part if there is None else there.unionByName(part)
    found = there.select("h1", "h2", "wide", "w.at", "w.window").join(windows, ["wide", "window"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "wide")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["wide"] - 1)))))
    return found.select("h1", "h2", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("ids"))


def held(found: DataFrame) -> DataFrame:
    """Hits as a table, broadcast if its files are small, so that copies of one text need not meet in one task; else
    adaptive execution splits what is skewed."""
    saved = Workspace(found.sparkSession, "hits").save(found, "found")
    return F.broadcast(saved) if plan_bytes(saved) <= 4 << 20 else saved


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null or wordless text: no words, no hits. Rows that share a doc_id, or have none, are judged by their own text.
    Extra columns are ignored."""
    docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    base = docs.select("doc_id", "h1", "h2", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(held(hits(docs, items, width)), ["h1", "h2"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_words", count("n_hit"), count("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs without contaminated ones; columns as they are."""
    found = held(hits(keyed(docs), items, width).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")))
    h1, h2 = text_key(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, (h1 == found["_h1"]) & (h2 == found["_h2"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
il AS (SELECT item, ws, least(len(ws), 10) AS wide FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, wide, array_to_string(ws[a : a + wide - 1], ' ') AS win FROM (SELECT item, ws, wide, unnest(range(1, len(ws) - wide + 2)) AS a FROM il)),
dw AS (SELECT doc_id, wide, a, array_to_string(ws[a : a + wide - 1], ' ') AS win FROM (SELECT doc_id, ws, wide, unnest(range(1, len(ws) - wide + 2)) AS a FROM d, (SELECT DISTINCT wide FROM il))),
m AS (SELECT doc_id, dw.wide, a, item FROM dw JOIN iw USING (wide, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + wide)) AS p FROM (SELECT DISTINCT doc_id, wide, a FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
