"""Near-duplicate groups by min-max hashing, with links confirmed on full shingle sets.

Signatures. Each of ``permutations`` hash functions is evaluated once per shingle, and both its smallest and its
largest value are kept: two samples of the set for one evaluation. For both, two sets agree with probability
equal to their Jaccard similarity, and the two samples of one function are negatively correlated, so the share
of agreeing values has a lower variance than with as many separate functions. The values are cut into bands of
``band`` values; texts that agree on a whole band share a bucket. With the defaults (112 functions, 224 values,
bands of 5) a pair at similarity 0.75 shares no bucket with probability 1e-5, one at 0.85 with 1e-11.

Groups. Texts with equal shingle sets form one class, represented by one row. Then links are looked for twice:

1. Each bucket's most connected member leads, and every other member is compared with it. This settles groups
   of copies of any size with one comparison per member.
2. Buckets that still hold several components are cut into blocks of about ``BLOCK`` members, and every two
   blocks of a bucket meet in one task with their texts. Members of one component are passed over, pairs whose
   signatures agree on less than ``floor`` of their values are ruled out (0.6 lies five standard deviations
   below the estimate of a pair at 0.75), and the others are compared where they are, so only links leave the
   task. A pair is taken up in the first bucket it shares.

A comparison reads both whole texts and is exact for the given similarity (on 64-bit hashes of shingles).
Comparisons with one leader are dealt out in blocks, so a leader of millions of copies is not one task.
Components run over confirmed links only, in the shared folder.

Defined results: null, empty and white-space texts have no shingles and link with nothing; fewer words than
``width`` make one shingle of the whole sequence; repeated rows fall into one class, and each of them is
returned; a null doc_id takes part, but never names a component; extra columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import PIECE_BYTES, fresh_name, table, tidied, written
from tallyveil.llm.shingles import draws, mix, shingle_hashes, shingle_sets, text_pieces
from tallyveil.operators.graph import components

#: Members of a bucket that are matched together, and comparisons with one leader that travel together.
BLOCK = 256
_U = np.uint64


def min_max(hashes: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest and largest value of each text under every permutation, one row per text with shingles."""
    factors, shifts = draws(permutations, 21) | _U(1), draws(permutations, 22)
    values = np.empty((len(at), 2 * permutations), _U)
    for k in range(permutations):
        turned = hashes * factors[k] + shifts[k]
        turned ^= turned >> _U(29)
        values[:, 2 * k] = np.minimum.reduceat(turned, at)
        values[:, 2 * k + 1] = np.maximum.reduceat(turned, at)
    # The two values of one permutation stand in different bands.
    return np.concatenate([values[:, ::2], values[:, 1::2]], axis=1)


def band_keys(values: np.ndarray, band: int) -> np.ndarray:
    """Band hashes of each row of ``min_max``; equal keys of different bands do not meet."""
    bands = values.shape[1] // band
    cut = values[:, : bands * band].reshape(len(values), bands, band)
    weights = draws(band, 23) | _U(1)
    return mix((mix(cut) * weights).sum(axis=2, dtype=_U) + draws(bands, 24))


def sketches(docs: DataFrame, width: int, permutations: int, band: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, n_shingles, class_a, class_b, bands, signature) of every row.

    The mark is a hash of the text as it stands, the class a 128-bit hash of the set, the signature the lowest
    byte of every min-max value.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands = 2 * permutations // band
        for batch in tidied(batches):
            for a, b, data, offsets in text_pieces(batch.column(2), PIECE_BYTES):
                hashes, at = shingle_hashes(data, offsets, width)
                sizes, first, second = np.zeros(b - a, np.int64), np.zeros(b - a, _U), np.zeros(b - a, _U)
                for i in range(b - a):
                    if at[i + 1] > at[i]:
                        own = np.unique(hashes[at[i] : at[i + 1]])
                        sizes[i], first[i], second[i] = len(own), mix(own).sum(dtype=_U), mix(own * _U(0x2545F4914F6CDD1D)).sum(dtype=_U)
                filled = np.flatnonzero(sizes)
                values = min_max(hashes, at[:-1][filled], permutations) if len(filled) else np.zeros((0, 2 * permutations), _U)
                keys = band_keys(values, band).view(np.int64).ravel()
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n_bands, 0))]).astype(np.int32)
                marks = np.full(b - a, None, object)
                marks[filled] = [row.tobytes() for row in values.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), pa.array(marks, pa.binary()),
                    ],
                    names=["doc_id", "mark", "n_shingles", "class_a", "class_b", "bands", "signature"],
                )

    schema = "doc_id bigint, mark bigint, n_shingles bigint, class_a bigint, class_b bigint, bands array<bigint>, signature binary"
    return _rows(docs, text, doc_id).mapInArrow(sketch, schema)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    whole = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(whole).alias("mark"), whole.alias("text"))


def linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(source, target) of the (node, leader) pairs whose whole shingle sets are similar enough."""
    blocks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    leads = blocks.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    leads = leads.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")), "leader")
    rows = dealt.join(texts, "node").join(leads, ["leader", "block"]).select("node", "leader", "text", "leader_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_set = None, None
        for batch in tidied(batches):
            leaders, found = batch.column(1).to_pylist(), np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in text_pieces(batch.column(2), PIECE_BYTES):
                for i, own in enumerate(shingle_sets(data, offsets, width), a):
                    if leaders[i] != known:
                        known = leaders[i]
                        ((_, _, bytes_, ends),) = text_pieces(batch.column(3).slice(i, 1), PIECE_BYTES)
                        known_set = shingle_sets(bytes_, ends, width)[0]
                    common = len(np.intersect1d(own, known_set, assume_unique=True))
                    found[i] = 100 * common >= percent * (len(own) + len(known_set) - common)
            yield batch.filter(pa.array(found)).select([0, 1]).rename_columns(["source", "target"])

    return rows.mapInArrow(compare, "source string, target string")


def matched(members: DataFrame, width: int, percent: int, floor: float) -> DataFrame:
    """(source, target) links between different components, from buckets cut into blocks.

    ``members`` has band, key, node, component, size, signature, bands, text and the bucket's number of blocks.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band", "node", "component", "size", "signature", "bands", "text")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(block: pa.RecordBatch) -> tuple[list, list]:
        sides = np.asarray(block.column("mine"))
        left = np.flatnonzero(sides == block.column("i")[0].as_py())
        right = np.flatnonzero(sides == block.column("j")[0].as_py())
        marks = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint8).reshape(len(sides), -1)
        names = np.array(block.column("node").to_pylist(), object)
        _, groups = np.unique(np.array(block.column("component").to_pylist()), return_inverse=True)
        sizes = np.asarray(block.column("size"))
        keys = np.asarray(block.column("bands").flatten()).reshape(len(sides), -1)
        here, need = block.column("band")[0].as_py(), floor * marks.shape[1]
        sets: dict[int, np.ndarray] = {}

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                ((_, _, data, offsets),) = text_pieces(block.column("text").slice(i, 1), PIECE_BYTES)
                sets[i] = shingle_sets(data, offsets, width)[0]
            return sets[i]

        a_out, b_out = [], []
        for x in left:
            y = right[(groups[right] != groups[x]) & (names[right] > names[x] if len(right) == len(left) and right[0] == left[0] else True)]
            y = y[100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])]
            y = y[(marks[y] == marks[x]).sum(axis=1) >= need] if len(y) else y
            y = y[(keys[y] == keys[x]).argmax(axis=1) == here] if len(y) else y
            for other in y.tolist():
                common = len(np.intersect1d(shingles(x), shingles(other), assume_unique=True))
                if 100 * common >= percent * (sizes[x] + sizes[other] - common):
                    a_out.append(names[x])
                    b_out.append(names[other])
        return a_out, b_out

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(tidied(batches)):
            if batch is not None:
                whole = pa.Table.from_batches([rest, batch] if rest is not None else [batch]).combine_chunks().to_batches()[0]
            else:
                whole = rest
            if whole is None or not whole.num_rows:
                continue
            unit = [np.asarray(whole.column(c)) for c in ("key", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(u) != 0 for u in unit], axis=0)) + 1), whole.num_rows]
            last = len(cuts) - (1 if batch is None else 2)
            sources, targets = [], []
            for a, b in zip(cuts[:last], cuts[1 : last + 1]):
                if b - a > 1:
                    x, y = pairs_of(whole.slice(a, b - a))
                    sources += x
                    targets += y
            rest = whole.slice(cuts[last]) if batch is not None else None
            if sources:
                yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(targets)], names=["source", "target"])

    return units.mapInArrow(match, "source string, target string")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _placed(docs: DataFrame, *, percent: int = 75, width: int = 5, permutations: int = 112, band: int = 5, floor: float = 0.6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, mark, n_shingles, node, component) of every row; node and component are null without shingles."""
    node = F.concat_ws(":", "n_shingles", F.hex("class_a"), F.hex("class_b"))
    sketched = written(sketches(docs, width, permutations, band, text, doc_id).withColumn("node", F.when(F.col("n_shingles") > 0, node)), "sketches")
    # One row stands for all texts with the same set; ordinary copies end here.
    classes = sketched.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    spelled = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = spelled.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = written(spelled.join(crowded, "key"), "members")
    if members.isEmpty():
        groups = docs.sparkSession.createDataFrame([], "node string, component string")
    else:
        groups = _link(docs, sketched, classes, members, percent, width, floor, text, doc_id)
    placed = sketched.select("doc_id", "mark", "n_shingles", "node").join(groups, "node", "left")
    return placed.withColumn("component", F.coalesce("component", "node"))


def near_groups(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; links have 100 * intersection >= percent * union."""
    placed = _placed(docs, **settings)
    names = placed.filter("node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component_id, F.lit(False))
    return placed.join(names, "component", "left").select("doc_id", "n_shingles", component_id.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of every group: that of the smallest doc_id.

    Rows without shingles all stay; rows without doc_id stay only in groups of such rows.
    """
    placed = written(_placed(docs, text=text, doc_id=doc_id, **settings), "placed")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    first = placed.filter("node IS NOT NULL").groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.mark")
    stay = first.withColumn("alone", F.lit(True)).unionByName(placed.filter("node IS NULL").select("doc_id", "mark").distinct().withColumn("alone", F.lit(False)))
    # Only rows that stand several times in the table, id and text alike, need a second look.
    repeated = placed.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("r_id"), F.col("mark").alias("r_mark"))
    stay = stay.join(repeated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left")
    number, mark, once = (fresh_name(docs, n) for n in ("stay_id", "stay_mark", "stay_once"))
    stay = stay.select(F.col("doc_id").alias(number), F.col("mark").alias(mark), (F.col("alone") & F.col("r_mark").isNotNull()).alias(once))
    own = docs[doc_id].cast("bigint"), F.xxhash64(docs[text].cast("string"))
    found = docs.join(stay, own[0].eqNullSafe(stay[number]) & (own[1] == stay[mark]))
    single = found.filter(~F.col(once)).select(*docs.columns)
    return single.unionByName(found.filter(once).dropDuplicates([number, mark]).select(*docs.columns))


def _link(docs, sketched, classes, members, percent, width, floor, text, doc_id) -> DataFrame:
    """(node, component) of all nodes with a confirmed link."""
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    # Whole text of one row of every class that shares a bucket.
    wanted = weights.select("node").join(classes.select("node", F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("mark")), "node")
    rows = _rows(docs, text, doc_id)
    found = rows.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (rows["mark"] == wanted["mark"])).select("doc_id", rows["mark"], "node", "text")
    texts = written(found.dropDuplicates(["doc_id", "mark", "node"]).select("node", "text"), "texts")
    led = members.join(weights, "node")
    leaders = led.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    first = members.join(leaders, "key").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "leader")
    first = first.groupBy("a", "b").agg(F.min("leader").alias("leader")).select(F.expr("IF(a = leader, b, a)").alias("node"), "leader")
    links = written(linked(first, texts, width, percent), "links")
    groups = components(links)
    inside = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    inside = inside.join(mixed, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("members")
    inside = inside.join(classes.select("node", "size", "signature", "bands"), "node").join(texts, "node")
    return components(written(links.unionByName(matched(inside, width, percent, floor)), "links"))


def op1_near_duplicates(spark, folder: str) -> DataFrame:
    return near_groups(table(spark, folder, "documents"))


ORACLES = {
    "op1_near_duplicates": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS own FROM cut),
flat AS (SELECT doc_id, len(own) AS n, unnest(own) AS s FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON x = doc_id
""",
}
QUERIES = {"op1_near_duplicates": op1_near_duplicates}
