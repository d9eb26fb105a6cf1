"""Benchmark decontamination by spaced-seed hashing, with built-in DataFrame functions only.

Each mask is a fixed set of token offsets; the tokens between them are ignored, so a substituted word
spoils only the windows in which a mask reads it. Hashes of the masked windows of all training
documents meet those of the benchmark, and a hit fixes a diagonal: the alignment of an item with a
document. Around it the item is laid over the document word by word, and the pair is a leak if some
``WINDOW`` successive words of the item (all of a shorter item) agree in at least ``SIMILARITY``.

The masks that an item is read by follow its length and are complete: whichever words that rule lets
differ, some mask reads none of them (the tests enumerate all patterns). Items of under five words
may differ in none, so one mask reads them whole. Documents are read by the masks of the lengths that
the benchmark has.

The benchmark's seeds are broadcast only while their measured number is under ``BROADCAST_SEEDS``;
beyond it the join is a shuffle, salted so that a passage in most documents is spread over ``SALTS``
tasks. Texts are read a second time for candidates alone, and the alignments of one document come in
lists of at most ``STRETCH`` for each item, however repetitive and long the text.

Defined cases: words are runs of letters and digits, lowered; null and empty texts have none; items
without words match nothing; very long texts are read whole; repeated documents are each found and
count once for each doc_id and text, repeated item_ids with other texts are items of their own whose
best match counts; empty tables give no rows; extra columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, sealed, written

#: Offsets that each mask reads, for items of seven words and more; all ignore some position.
MASKS = ((0, 1, 2, 3, 5), (0, 2, 3, 4, 5), (0, 1, 2, 5, 6))
#: Ten words may differ in the fourth and seventh, which leaves none of MASKS a whole window.
TEN = (0, 1, 2, 4, 5)
#: Items of five and six words: each mask ignores one word of five.
SHORT = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
SIMILARITY, WINDOW = 0.8, 12
BROADCAST_SEEDS, SALTS = 1_000_000, 32
STRETCH = 4096


def masks_of(words: int) -> tuple[tuple[int, ...], ...]:
    """The masks that read an item of so many words."""
    if words < 5:
        return (tuple(range(words)),) if words else ()
    if words < 7:
        return SHORT
    return (*MASKS, TEN) if words == 10 else MASKS


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lowered runs of letters and digits, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, masks: dict, *keys: str) -> DataFrame:
    """keys, pos, seed: the masked hashes of every window of ``h``. masks: each mask and the condition on a row that it is read."""
    span = 1 + max(max(m) for m in masks)
    shifted = F.arrays_zip(*[F.slice("h", o + 1, F.greatest(F.size("h") - o, F.lit(0))).alias(f"w{o}") for o in range(span)])
    words = [c for c in rows.columns if c != "h" and c not in keys]
    windows = rows.select(*keys, *words, F.posexplode(shifted).alias("pos", "z"))
    read = [F.when(when & F.col("z")[f"w{max(m)}"].isNotNull(), F.xxhash64(F.lit(sum(1 << o for o in m)), *[F.col("z")[f"w{o}"] for o in m])) for m, when in masks.items()]
    return windows.select(*keys, "pos", F.explode(F.array(*read)).alias("seed")).filter("seed is not null")


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    items = pick(benchmark, item_id=item_id, text=text).select("item_id", word_hashes(F.col("text")).alias("h"))
    return items.withColumn("item_key", F.xxhash64("item_id", "h")).withColumn("item_words", F.size("h"))


def _item_masks(items: DataFrame) -> dict:
    """The masks of the lengths that the items have, and the condition on item_words that each is read. The driver sees at most eleven numbers."""
    lengths = items.select(F.least("item_words", F.lit(11)).alias("n")).distinct().collect()
    of: dict = {}
    for n in sorted(r.n for r in lengths):
        for mask in masks_of(n):
            of.setdefault(mask, []).append(n)
    return {mask: F.least("item_words", F.lit(11)).isin(found) for mask, found in of.items()}


def _met(found: DataFrame, item_seeds: DataFrame) -> DataFrame:
    """Document seeds that are item seeds too."""
    if item_seeds.count() <= BROADCAST_SEEDS:
        return found.join(F.broadcast(item_seeds), "seed")
    salted = item_seeds.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return found.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"]).drop("salt")


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per leaked (document, item): doc_id, item_id, matched (words that agree), item_words, best_window (agreeing words of the best window), row (hash of the document's text)."""
    items = written(_items(benchmark, item_id, item_text), "items")
    masks = _item_masks(items) or {MASKS[0]: F.lit(True)}  # of an empty benchmark
    item_seeds = written(seeds(items, masks, "item_key", "item_words").withColumnRenamed("pos", "item_pos").distinct(), "item-seeds")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("text"))
    read = seeds(rows.select("doc_id", "row", word_hashes(F.col("text")).alias("h")), dict.fromkeys(masks, F.lit(True)), "doc_id", "row")
    diag = F.col("pos") - F.col("item_pos")
    diagonals = _met(read, item_seeds).select("doc_id", "row", F.floor(diag / STRETCH).alias("stretch"), F.struct("item_key", "item_words", diag.alias("diag")).alias("hit")).distinct()
    found = written(diagonals.groupBy("doc_id", "row", "stretch").agg(F.collect_list("hit").alias("hits")), "hits").drop("stretch").withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    # A repeated row is joined once for each copy and found once, since results are grouped below.
    candidates = rows.join(found, rows.doc_id.eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "hits", word_hashes(F.col("text")).alias("h"))

    def around(hit):
        first = F.greatest(hit["diag"], F.lit(0))
        length = F.least(hit["diag"] + hit["item_words"], F.size("h")) - first  # a second use of h, so that Spark does not compute it anew for each hit
        return F.struct(hit["item_key"].alias("item_key"), F.greatest(-hit["diag"], F.lit(0)).alias("skip"), F.slice("h", first + 1, F.greatest(length, F.lit(0))).alias("near"))

    laid = candidates.select("doc_id", "row", F.transform("hits", around).alias("laid")).select("doc_id", "row", F.explode("laid").alias("x")).select("doc_id", "row", "x.*")
    both = laid.join(items.select("item_key", "item_id", "item_words", F.col("h").alias("item")), "item_key")
    agree = F.zip_with(F.col("near"), F.slice("item", F.col("skip") + 1, F.size("near")), lambda a, b: F.when(a == b, 1).otherwise(0))
    flags = both.withColumn("flags", agree).withColumn("w", F.least(F.lit(WINDOW), "item_words")).filter(F.size("flags") >= F.col("w"))
    sums = F.transform(F.sequence(F.lit(0), F.size("flags") - F.col("w")), lambda i: F.aggregate(F.slice("flags", i + 1, F.col("w")), F.lit(0), lambda a, x: a + x))
    judged = flags.withColumn("best", F.array_max(sums)).filter(F.col("best") >= F.ceil(F.col("w") * F.lit(SIMILARITY)))
    return judged.groupBy("doc_id", "row", "item_id").agg(
        F.max(F.aggregate("flags", F.lit(0), lambda a, x: a + x)).cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"), F.max("best").cast("long").alias("best_window")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """docs without the rows that hold a leak, with their own columns."""
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    docs, restored = sealed(docs, doc_id, text)
    bad = written(find_leaks(docs, benchmark, **columns).select(F.col("doc_id").alias("_bad_id"), F.col("row").alias("_bad_row")).distinct(), "leaks")
    keyed = docs.withColumn("_row", F.xxhash64(F.col(text)))
    return restored(keyed.join(bad, F.col(doc_id).eqNullSafe(F.col("_bad_id")) & F.col("_row").eqNullSafe(F.col("_bad_row")), "left_anti"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "matched", "item_words", "best_window")
