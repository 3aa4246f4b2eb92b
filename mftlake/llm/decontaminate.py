"""Benchmark decontamination by a broadcast hash set of word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, packed, pick, read, unpacked

#: what parts words: every ASCII character but digits and letters (after lower-casing A-Z)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 8
#: windows of the benchmark that are broadcast at most, and bytes of their words and item ids; beyond either, the join shuffles
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: stands for the text itself among its window hashes; joins the row of the same hash that has no words
HEADER = 0


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _windows(w: Column, hashes: Column, n: int) -> Column:
    """Hashes of the windows of ``n`` words, by their place from 0."""
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def _placed(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"), F.lit(n).alias("n")))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``_h``, ``_gram`` (the words), ``_len`` and ``_items`` (sorted) of every distinct window; an item of fewer words is one window."""
    rows = pick(items, _item=id_col, _text=text_col).select("_item", words(F.col("_text")).alias("_w")).filter(F.size("_w") > 0)
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - F.lit(window - 1), F.lit(1))))
    grams = rows.select("_item", "_w", place.alias("_i")).select("_item", F.slice("_w", F.col("_i"), window).alias("_gram"))
    return (
        grams.groupBy("_gram")
        .agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
        .select(F.xxhash64(F.transform("_gram", lambda x: F.xxhash64(x))).alias("_h"), "_gram", F.size("_gram").alias("_len"), "_items")
    )


def scan(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of ``df``: ``_id``, ``_key`` (hash and length of its text), ``_n_words``, ``_n_hit``, ``_items``, ``_spans``.

    The benchmark's windows are normalised and hashed; the hash set is broadcast when its counted size allows, and
    joined by a shuffle otherwise, to which each window brings its words. Every window of every text is looked up while its words are scanned, and a match is
    verified word by word. ``_items``: sorted item ids (strings) with an occurring window. ``_spans``: disjoint ranges
    of hit words, as (first, end) from 0, end exclusive. A null text has no words. Rows that repeat identifier
    and text get equal answers, one each. Empty tables give no hits or no rows; other columns are not read.
    """
    grams = item_windows(items, item_col, item_text, window)
    size = F.sum(F.octet_length(F.array_join("_gram", " ")) + F.octet_length(F.array_join("_items", " ")))
    lengths = {r["_len"]: r for r in grams.groupBy("_len").agg(F.count("*").alias("rows"), size.alias("bytes")).collect()}  # one row per length, so at most ``window``
    header = df.sparkSession.range(1).select(
        F.lit(HEADER).cast("bigint").alias("_h"), F.lit(None).cast("array<string>").alias("_gram"), F.lit(0).alias("_len"), F.lit(None).cast("array<string>").alias("_items")
    )
    table = grams.unionByName(header)
    shipped = sum(r["rows"] for r in lengths.values()) <= broadcast_windows and sum(r["bytes"] for r in lengths.values()) <= BROADCAST_BYTES
    if shipped:
        table = F.broadcast(table)
    rows = pick(df, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    rows = rows.select("_id", F.struct(F.xxhash64("_text").alias("x"), F.length("_text").alias("n")).alias("_key"), words(F.col("_text")).alias("_w"))
    rows = rows.select("_id", "_key", "_w", F.transform("_w", lambda x: F.xxhash64(x)).alias("_wh"))
    at = [_placed(_windows(F.col("_w"), F.col("_wh"), n), n) for n in sorted(lengths)]
    first = F.array(F.struct(F.lit(HEADER).cast("bigint").alias("h"), F.lit(-1).alias("i"), F.lit(0).alias("n")))
    looked = rows.select("_id", "_key", "_w", F.explode(F.concat(first, *at)).alias("_at")).select("_id", "_key", "_w", "_at.h", "_at.i", "_at.n")
    own, count = F.slice("_w", F.col("i") + 1, F.col("n")), F.when(F.col("n") == 0, F.size("_w")).alias("_n_words")
    if not shipped:
        # a window takes its own words along, not its text's
        looked = looked.select("_id", "_key", "h", "i", "n", F.when(F.col("n") > 0, own).alias("_own"), count)
        own, count = F.col("_own"), F.col("_n_words")
    same = (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_len")) & ((F.col("n") == 0) | (own == F.col("_gram")))
    hits = looked.join(table, same).select("_id", "_key", "i", "n", count, "_items")
    # what each hit adds to the words covered so far
    before = Window.partitionBy("_id", "_key").orderBy("i", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(F.col("n") > 0, F.col("i") + F.col("n"))).over(before), F.lit(0))
    fresh = hits.withColumn("_from", F.greatest("i", reached)).withColumn("_to", F.col("i") + F.col("n"))
    found = fresh.groupBy("_id", "_key").agg(
        F.max("_n_words").cast("bigint").alias("_n_words"),
        F.count_if(F.col("n") == 0).cast("int").alias("_rows"),
        F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"),
        F.sort_array(F.collect_set(F.when((F.col("n") > 0) & (F.col("_to") > F.col("_from")), F.struct("_from", "_to")))).alias("_spans"),
    )
    return found.select(
        "_id",
        "_key",
        "_n_words",
        F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["_to"] - x["_from"]).alias("_n_hit"),
        F.sort_array("_items").alias("_items"),
        "_spans",
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"),
    ).drop("_copy")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words in ``spans``; what stood between words goes with the word before it.

    What remains is the original, character for character.
    """
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    word = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.length(F.regexp_extract(lowered, r"\A" + GAP, 0))

    def kept(sizes: Column) -> Column:
        """One walk over the spans: each adds up the words since the last one, so that a text takes linear time."""
        over = lambda begin, end: F.aggregate(F.slice(sizes, begin + 1, end - begin), F.lit(0), lambda n, x: n + x)
        return F.aggregate(
            spans,
            F.struct(F.lit(0).alias("word"), lead.alias("at"), F.lit(0).alias("done"), F.array().cast("array<string>").alias("out")),
            lambda s, x: F.struct(
                x["_to"].alias("word"),
                (s["at"] + over(s["word"], x["_to"])).alias("at"),
                (s["at"] + over(s["word"], x["_to"])).alias("done"),
                F.concat(s["out"], F.array(F.substring(text, s["done"] + 1, s["at"] + over(s["word"], x["_from"]) - s["done"]))).alias("out"),
            ),
            lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["done"] + 1, F.length(text))),
        )

    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(F.transform(word, lambda w: F.length(w))), kept), F.lit(0))).otherwise(text)


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **options) -> DataFrame:
    """The rows of ``df`` without those that hold windows of ``min_items`` items or more; the rest lose their hit words.

    Rows with no hit stay as they are. All columns stay; only ``text_col`` of a row with hits changes.
    """
    found = scan(df, items, id_col, text_col, **options).filter(F.size("_items") > 0).select("_id", "_key", "_items", "_spans").distinct()
    found = found.select(F.col("_id").alias("_hit_id"), F.col("_key").alias("_hit_key"), F.size("_items").alias("_n"), "_spans")
    names = df.columns
    rows = packed(df, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    rows = rows.withColumn("_key", F.struct(F.xxhash64("_text").alias("x"), F.length("_text").alias("n")))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_hit_id")) & F.col("_key").eqNullSafe(F.col("_hit_key")), "left")
    place = next(i for i, n in enumerate(names) if n == text_col) if text_col in names else [n.lower() for n in names].index(text_col.lower())
    kept = joined.filter(F.coalesce("_n", F.lit(0)) < min_items)
    kept = kept.withColumn("_text", F.when(F.col("_n").isNull(), F.col("_text")).otherwise(without_spans(F.col("_text"), F.col("_spans"))))
    return unpacked(kept.withColumn("_row", F.col("_row").withField(f"_c{place}", F.col("_text"))), names)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_items") >= 2).alias("contaminated"),
    )


_SQL_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP3_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, list_slice(w, i, least(i + 7, len(w))) AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len(gram) AS n FROM grams),
docs AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n
),
hits AS (
  SELECT r, i, n, item_id FROM (SELECT r, i, n, list_slice(w, i, i + n - 1) AS gram FROM places) JOIN grams USING (gram)
),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT doc_id,
       CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
