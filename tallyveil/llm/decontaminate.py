"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Texts are lower-cased and cut into words at white space. A benchmark item of n words is looked for in windows of
n words. Of all windows only those are left out that cannot be the result: a window whose places with a shingle of
items of n words are too few for the similarity, and a window that does not end with such a shingle, because the
window one word before it (which is inside the text, or the window is the first) then has at least as many in common.

Every window and item gets a 64-bit SimHash of its words (each word as often as it stands there). The fingerprints are
cut into ``BLOCKS`` blocks. Of two fingerprints within ``radius`` bits, at least one block differs in at most
``radius // BLOCKS`` bits, so the index holds each item's blocks with all such flips, and a look-up by equality
finds every fingerprint within the radius. The default radius of 20 lies over three standard deviations beyond the
distance expected at the lowest similarity asked for; equal passages have distance 0. Candidates are then
compared exactly: shingles of ``width`` words, weighted by how often they occur, sum of minima over sum of maxima.

The items' shingles and index are broadcast in slices of a bounded number of rows; a larger benchmark takes
several passes over the documents.

Defined results: null and empty texts and items match nothing; an item of fewer than ``width`` words is one
shingle of its whole sequence; a document shorter than an item is one window; one row per document and item with
its most similar (then first) window; rows with the same doc_id count as one document; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import fits_broadcast, fresh_name, table, written

BITS, BLOCKS = 64, 7
#: Words of benchmark items that one pass broadcasts (some 40 MB with the fingerprint index).
PASS_WORDS = 200_000
#: Window starts that are broadcast, as (key, length, starts); more are joined by shuffle.
BROADCAST_STARTS = 100_000
#: Contaminated rows that are broadcast, as 8-byte keys, to be left out; more are left out by a shuffle join.
BROADCAST_KEYS = 500_000
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words of a text; one empty word for an empty text."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although ``use`` refers to it for every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of the shingles in order, with repeats; the whole sequence for fewer words."""
    return once(words, lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - width, F.lit(0))), lambda i: F.xxhash64(F.slice(ws, i + 1, width))
    ))


def simhash(words: Column) -> Column:
    """64-bit SimHash: each bit is the majority of that bit over the words' hashes."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def majority(hashes: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, none, lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(one))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", one, b)).otherwise(none)

    bits = once(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), none, lambda found, b: found.bitwiseOR(majority(hashes, b))
    ))
    # Never null: the planner would otherwise test it for null, and compute it, before windows are made distinct.
    return F.coalesce(bits, none)


def block_layout() -> list[tuple[int, int]]:
    """(first bit, bits) of every block."""
    edges = [round(BITS * k / BLOCKS) for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_value(bits: Column, block: int) -> Column:
    first, size = block_layout()[block]
    return F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))


def flips(size: int, most: int) -> list[int]:
    """All masks over ``size`` bits with at most ``most`` bits set."""
    return [m for m in range(1 << size) if m.bit_count() <= most]


def item_index(items: DataFrame, radius: int) -> DataFrame:
    """Items spelled out by (n_words, block, value) for every value within reach of the item's block."""
    def reach(b: int) -> Column:
        masks = F.array(*[F.lit(m).cast("bigint") for m in flips(block_layout()[b][1], radius // BLOCKS)])
        return F.transform(masks, lambda m: F.struct(F.lit(b).alias("block"), block_value(F.col("item_bits"), b).bitwiseXOR(m).alias("value")))

    entries = F.concat(*[reach(b) for b in range(BLOCKS)])
    spelled = items.select("item_key", "n_words", "item_bits", F.explode(entries).alias("e"))
    return spelled.select("item_key", "n_words", "item_bits", "e.block", "e.value").distinct()


def _starts(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(row_key, n_words, starts): where windows begin that end with a shared shingle and hold enough of them.

    Of a window of ``most`` shingles and an item of as many, ``least`` shared places are needed for the similarity.
    In the ascending places the one ``least - 1`` before the window's last must be inside the window. Shared means
    with any item of n words, so groups and windows do not grow with the number of items that hold one shingle.
    """
    posted = items.select("n_words", F.explode("item_shingles").alias("h")).distinct()
    sizes = [r[0] for r in items.select(F.least("n_words", F.lit(width))).distinct().collect()]  # width values at most
    found = None
    for size in sizes:
        last = F.size("words") - size
        places = F.when(last >= 0, F.sequence(F.lit(0), last))
        shingle = F.xxhash64(F.array(*[F.get("words", F.col("i") + k) for k in range(size)]))
        mine = posted.filter(F.least("n_words", F.lit(width)) == size)
        shared = (
            docs.select(_row_key(), words_of(F.col("text")).alias("words")).select("row_key", "words", F.explode(places).alias("i"))
            .select("row_key", (last + 1).alias("held"), "i", shingle.alias("h")).join(F.broadcast(mine), "h")
            .select("row_key", "n_words", (F.col("n_words") - size + 1).alias("most"), "held", "i")
        )
        found = shared if found is None else found.unionByName(shared)
    if found is None:
        return None
    groups = found.groupBy("row_key", "n_words", "most", "held").agg(F.array_sort(F.collect_set("i")).alias("places"))
    # least * 100 >= (shingles of both - least) * percent, in whole numbers; at least one place.
    both = (F.least("most", "held") + F.col("most")) * percent
    groups = groups.withColumn("least", F.greatest(F.ceil(both / (100 + percent) - F.lit(1e-9)).cast("int"), F.lit(1)))
    inside = F.transform("places", lambda p, k: F.when(
        (k >= F.col("least") - 1) & (p - F.get("places", F.greatest(k - F.col("least") + 1, F.lit(0))) < F.col("most")), F.greatest(p - F.col("most") + 1, F.lit(0))
    ))
    return groups.select("row_key", "n_words", F.array_distinct(F.array_compact(inside)).alias("starts")).filter("size(starts) > 0")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("row_key")


def _windows(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Distinct (doc_id, n_words, start, window) of all windows that can reach the similarity."""
    starts = _starts(docs, items, width, percent)
    if starts is None:
        return None
    starts = written(starts, "window-starts")
    # Texts are read again and only those with starts are cut, so no text travels with every place.
    keyed = docs.select("doc_id", "text", _row_key()).join(F.broadcast(starts) if fits_broadcast(starts, BROADCAST_STARTS) else starts, "row_key")
    found = keyed.select("doc_id", "n_words", words_of(F.col("text")).alias("words"), F.explode("starts").alias("start"))
    return found.select("doc_id", "n_words", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("n_words")), " ").alias("window")).distinct()


def _matches(docs: DataFrame, items: DataFrame, width: int, percent: int, radius: int) -> DataFrame | None:
    windows = _windows(docs, items, width, percent)
    if windows is None:
        return None
    looked = windows.withColumn("bits", simhash(F.split("window", " ")))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), block_value(F.col("bits"), b).alias("value")) for b in range(BLOCKS)])
    looked = looked.select("*", F.explode(blocks).alias("e")).select("doc_id", "n_words", "start", "window", "bits", "e.block", "e.value")
    pairs = looked.join(F.broadcast(item_index(items, radius)), ["n_words", "block", "value"]).drop("n_words")
    differ = F.col("bits").bitwiseXOR(F.col("item_bits"))
    # A pair is taken up at the first of the blocks that bring it together.
    first = F.coalesce(*[F.when(F.bit_count(block_value(differ, b)) <= radius // BLOCKS, b) for b in range(BLOCKS)])
    pairs = pairs.filter((F.bit_count(differ) <= radius) & (first == F.col("block")))
    pairs = pairs.join(F.broadcast(items.select("item_key", "item_id", "item_shingles")), "item_key")
    pairs = pairs.withColumn("shingles", shingles_of(F.split("window", " "), width))
    count = lambda side, x: F.size(F.filter(side, lambda y: y == x))
    least = F.aggregate(
        F.array_distinct("item_shingles"), F.lit(0), lambda n, x: n + F.least(count("shingles", x), count("item_shingles", x))
    )
    pairs = pairs.withColumn("least", least).withColumn("most", F.size("shingles") + F.size("item_shingles") - F.col("least"))
    return pairs.filter(F.col("least") * 100 >= F.col("most") * percent).select(
        "doc_id", "item_id", "start", (F.col("least") / F.col("most")).alias("similarity"), F.bit_count(differ).cast("int").alias("distance")
    )


def contaminated(docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 75, radius: int = 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start, similarity, distance): documents that hold a passage like a benchmark item."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    listed = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text).cast("string")).alias("item_words")).filter("item_words[0] <> ''")
    listed = listed.select("item_id", "item_words", F.xxhash64("item_words").alias("item_key"), F.size("item_words").alias("n_words"), shingles_of(F.col("item_words"), width).alias("item_shingles"), simhash(F.col("item_words")).alias("item_bits"))
    words, longest = listed.agg(F.sum("n_words"), F.max("n_words")).first()
    passes = -(-(words or 0) // PASS_WORDS)
    result = None
    for k in range(passes):
        part = listed.filter(F.pmod("item_key", F.lit(passes)) == k) if passes > 1 else listed
        found = _matches(rows, part, width, percent, radius)
        if found is not None:
            result = found if result is None else result.unionByName(found)
    if result is None:
        kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *listed.schema]}
        schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start int, similarity double, distance int"
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("best")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.s")).alias("start"), "best.similarity", (-F.col("best.d")).alias("distance"))


def clean_documents(docs: DataFrame, items: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no passage like a benchmark item."""
    key = fresh_name(docs, "contaminated_key")
    # A row is known by its id and text together, so that rows without id are judged one by one.
    keyed = docs.withColumn(key, F.xxhash64(doc_id, text))
    found = contaminated(keyed.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), items, **settings)
    bad = written(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(F.broadcast(bad) if fits_broadcast(bad, BROADCAST_KEYS) else bad, key, "left_anti").drop(key)


def op4_contaminated_documents(spark, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"op4_contaminated_documents": op4_contaminated_documents}
