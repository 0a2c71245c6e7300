"""Corpus operators: identifiers, provenance, cluster terms and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.text import is_term, raw_tokens
from tallyveil.operators.ordering import top_rows
from tallyveil.session import cut_lineage


def first_filled(df: DataFrame, sources: Sequence[tuple[str, str]], name: str, last_label: str = "title_only") -> DataFrame:
    """F-14: first non-empty of several text columns, with the label of where it came from."""
    label = F.lit(last_label)
    value = F.lit("")
    for column, source in reversed(list(sources)):
        filled = F.coalesce(F.trim(column), F.lit("")) != ""
        label = F.when(filled, F.lit(source)).otherwise(label)
        value = F.when(filled, F.trim(column)).otherwise(value)
    return df.withColumns({name: value, f"{name}_source": label})


def missing_members(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """J-10 / J-11 / IO-11: rows of ``wanted`` whose key is not there yet."""
    return wanted.join(have.select(key), key, "left_anti")


def extend_with_missing(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return have.unionByName(missing_members(have, wanted, key).select(*have.columns))


def mark_members(df: DataFrame, accepted: DataFrame, key: str, name: str = "selected") -> DataFrame:
    """J-12: membership flag; an existing flag is replaced (re-marking)."""
    flag = accepted.select(key).distinct().withColumn("_m", F.lit(True))
    return df.drop(name).join(flag, key, "left").withColumn(name, F.coalesce("_m", F.lit(False))).drop("_m")


def _row_terms(found: Column) -> Column:
    """Distinct tokens of one text with their counts, from a sorted copy of its tokens."""

    def runs(words: Column) -> Column:
        last = F.size(words)
        places = F.sequence(F.lit(0), last - 1)
        starts = F.when(last > 0, F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array(starts), lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), last) - i).cast("bigint").alias("tf"))))[0]

    # A lambda over a single element names the sorted array, so that it is made once.
    return F.transform(F.array(F.sort_array(found)), runs)[0]


def document_terms(docs: DataFrame, doc: str, text: str, keep: Sequence[str] = (), markup: bool = True) -> DataFrame:
    """One row per distinct token of a document with its count.

    The tokens of a text are counted inside its row, so nothing is shuffled for documents of one row. Documents of
    several rows are counted across them.
    """
    keys = [doc, *keep]
    several = cut_lineage(docs.groupBy(*keys).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    terms = lambda d: d.select(*keys, F.inline(_row_terms(raw_tokens(F.col(text), markup)))).filter(is_term(F.col("term"), markup))
    if several.isEmpty():
        return terms(docs)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    split = terms(docs.join(several, same, "left_semi")).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    return terms(docs.join(several, same, "left_anti")).unionByName(split)


def cluster_terms(docs: DataFrame, doc: str, text: str, cluster: str, n: int, markup: bool = True, by: Sequence[str] = (), groups: str | None = None) -> DataFrame:
    """G-01: frequency in the cluster times ln(N / (1 + df)), terms of two documents or more.

    ``by`` keeps several clusterings apart; then ``groups`` is an array of structs (by, cluster), so that a text is read once for all of them.
    """
    by = list(by)
    spread = (lambda d, *rest: d.select(*rest, F.inline(groups))) if groups else (lambda d, *rest: d)
    total = spread(docs).groupBy(*by).agg(F.count("*").alias("_docs"))
    pairs = spread(document_terms(docs, doc, text, [groups or cluster], markup), "term", "tf")
    # Written once, a row per term of a cluster: texts are not read again for the document frequencies.
    by_term = cut_lineage(pairs.groupBy(*by, cluster, "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("_df")))
    df = by_term.groupBy(*by, "term").agg(F.sum("_df").alias("df")).filter("df > 1")
    known = by_term.drop("_df").join(df, [*by, "term"])
    scored = (known.join(total, by) if by else known.crossJoin(total)).select(
        *by, cluster, "term", "tf", "df", (F.col("tf") * F.ln(F.col("_docs") / (1 + F.col("df")))).alias("score")
    )
    # Scores are rounded before ranking so that ties fall to the term, not to float noise.
    return top_rows(scored.withColumn("_s", F.round("score", 9)), [*by, cluster], [F.col("_s").desc(), F.col("term")], n).drop("_s")


def flag_clusters(terms: DataFrame, cluster: str, keywords: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """G-02: does any top term belong to the keyword set?"""
    listed = F.array(*[F.lit(k) for k in keywords])
    # At most n terms per cluster were kept by the term ranking.
    return terms.groupBy(*by, cluster).agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn(
        "flagged", F.arrays_overlap("terms", listed)
    )


def most_cited(papers: DataFrame, by: Sequence[str], citations: str, key: str, n: int) -> DataFrame:
    """L-02 / G-10: the n most cited per group; missing counts as zero, ties by key."""
    counted = papers.withColumn("_c", F.coalesce(citations, F.lit(0)))
    if not by:
        # A global list needs no ranking of all rows: each task keeps its best n.
        counted = counted.orderBy(F.col("_c").desc(), key).limit(n)
    return top_rows(counted, by, [F.col("_c").desc(), F.col(key)], n).withColumn(citations, F.col("_c")).drop("_c")


def cluster_report(papers: DataFrame, cluster: str, key: str, marked: str, citations: str, terms: DataFrame, n_cited: int = 3) -> DataFrame:
    """G-03: size, marked members, top terms and most cited members per cluster."""
    size = papers.groupBy(cluster).agg(F.count("*").alias("members"), F.count_if(marked).alias("marked"))
    words = terms.groupBy(cluster).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda t: t["term"]), ", ").alias("terms")
    )
    cited = most_cited(papers.select(cluster, key, citations), [cluster], citations, key, n_cited).groupBy(cluster).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(key).cast("string").alias("k")))),
                                 lambda t: t["k"]), ", ").alias("most_cited")
    )
    return size.join(words, cluster, "left").join(cited, cluster, "left")


def source_coverage(df: DataFrame, source: str) -> DataFrame:
    """G-11: documents per provenance label."""
    return df.groupBy(source).agg(F.count("*").alias("documents"))


def top_weighted(edges: DataFrame, n: int) -> DataFrame:
    """L-01: the n heaviest positive pairs."""
    return edges.filter("weight > 0").orderBy(F.desc("weight"), "source", "target").limit(n)


def edge_summary(edges: DataFrame) -> DataFrame:
    """L-03: number of edges, linked nodes and weight range."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().agg(F.count("*").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight")).crossJoin(ends)


