"""Survey archives, delimited files, Parquet, JSON corpora and front matter."""

from __future__ import annotations

import csv
import io
import shutil
import tempfile
import zipfile
from collections import Counter, deque
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain, islice, repeat
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.functions.codes import normalise_doi

DELIMITERS = (",", ";", "|")  # fixed values: tried in this order


def _spooled(stream: IO[bytes]) -> IO[bytes]:
    """A stream that can be searched: in memory while small, on the task's disk beyond."""
    copy = tempfile.SpooledTemporaryFile(max_size=1 << 26)
    shutil.copyfileobj(stream, copy)
    copy.seek(0)
    return copy


def survey_stream(content: bytes, wanted: str) -> IO[bytes] | None:
    """The survey member of an archive or of archives inside it, the shallowest first; None without one."""
    waiting: deque[IO[bytes]] = deque([io.BytesIO(content)])
    while waiting:
        archive = zipfile.ZipFile(waiting.popleft())
        kinds = {entry: entry.filename.rsplit(".", 1)[-1].lower() for entry in archive.infolist()}
        tables = [e for e, kind in kinds.items() if kind == "csv" and wanted in e.filename.upper()]
        if tables:
            return archive.open(tables[0])
        waiting.extend(_spooled(archive.open(e)) for e, kind in kinds.items() if kind == "zip")
    return None


def survey_batches(content: bytes, wanted: str, batch: int) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Header and row batches of the wanted member; nothing when the archive has none."""
    stream = survey_stream(content, wanted)
    if stream is None:
        return
    # Zero bytes stand between values in some waves and mean nothing.
    lines = map(str.translate, io.TextIOWrapper(stream, "latin-1", newline=""), repeat({0: None}))
    first = next(lines, "")
    counts = Counter(c for c in first if c in DELIMITERS)
    table = csv.reader(chain([first], lines), delimiter=max(DELIMITERS, key=counts.__getitem__))
    header = next(table, [])
    while rows := list(islice(table, batch)):
        yield header, rows


def survey_columns(archives: DataFrame, columns: Sequence[str], wanted: str = "CAP_600", batch: int = 5000) -> DataFrame:
    """IO-01: named columns of the survey member inside (nested) zip archives.

    ``archives`` has ``path`` and ``content``, as ``spark.read.format("binaryFile")`` gives.
    One archive is one task; rows are streamed out in batches and cut down to the wanted
    columns before they leave the task. A column the wave does not have is NULL; short rows
    are dropped (IO-02). Column names are matched without regard to case.
    """
    names = list(columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for header, rows in survey_batches(content, wanted, batch):
                    place = {c.upper(): i for i, c in enumerate(header)}
                    whole = [r for r in rows if len(r) >= len(header)]
                    picked = {"path": [path] * len(whole)}
                    for n in names:
                        i = place.get(n.upper())
                        picked[n] = [None if i is None else r[i] for r in whole]
                    yield pd.DataFrame(picked, dtype=object)

    schema = ", ".join(["path string", *[f"`{n}` string" for n in names]])
    return archives.select("path", "content").mapInPandas(read, schema)


def survey_rows(archives: DataFrame, wanted: str = "CAP_600", batch: int = 5000) -> DataFrame:
    """IO-01 for exploring a wave: every field as (path, header, fields), short rows included."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for header, rows in survey_batches(content, wanted, batch):
                    yield pd.DataFrame({"path": path, "header": [header] * len(rows), "fields": rows})

    return archives.select("path", "content").mapInPandas(read, "path string, header array<string>, fields array<string>")


def read_survey_archives(spark: SparkSession, path: str, columns: Sequence[str], wanted: str = "CAP_600") -> DataFrame:
    """IO-01 from a folder of archives: the named columns only."""
    return survey_columns(spark.read.format("binaryFile").load(path), columns, wanted)


def complete_rows(rows: DataFrame, header: str = "header", fields: str = "fields") -> DataFrame:
    """IO-02: rows with fewer fields than the header are dropped."""
    return rows.filter(F.size(fields) >= F.size(header))


def split_rows(lines: DataFrame, header: Sequence[str], sep: str = ";", text: str = "text") -> DataFrame:
    """IO-02 for plain text lines: split, drop short rows, name the columns."""
    parts = lines.withColumn("_f", F.split(text, f"\\Q{sep}\\E", -1)).filter(F.size("_f") >= len(header))
    return parts.select(*[c for c in lines.columns if c != text], *[F.col("_f")[i].alias(h) for i, h in enumerate(header)])


def field(name: str) -> Column:
    """Value of a named field of ``survey_rows`` output, NULL when the wave has no such column."""
    place = F.array_position("header", name)
    return F.when(place > 0, F.try_element_at("fields", place.cast("int")))


def read_simple_survey(spark: SparkSession, path: str) -> DataFrame:
    """IO-03: one delimited file; semicolon if it is more frequent than comma in the header."""
    head = spark.read.text(path).head(1)
    first = head[0]["value"] if head else ""
    sep = ";" if first.count(";") > first.count(",") else ","
    return spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1")


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-04: UTF-8 file with a header row and a known schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """IO-05."""
    return spark.read.csv(path, sep="\t", header=True)


def coerce_numbers(df: DataFrame, numbers: Mapping[str, str]) -> DataFrame:
    """IO-06, second part: unreadable or missing numbers become zero."""
    zero = {c: F.coalesce(F.col(c).try_cast(kind), F.lit(0).cast(kind)) for c, kind in numbers.items()}
    return df.withColumns(zero)


def read_typed_csv(spark: SparkSession, path: str, numbers: Mapping[str, str]) -> DataFrame:
    """IO-06: ids stay strings, numbers are coerced."""
    return coerce_numbers(spark.read.csv(path, header=True), numbers)


def read_columns(spark: SparkSession, path: str, required: Sequence[str], wished: Sequence[str]) -> DataFrame:
    """IO-07: required columns plus those wished-for columns the file really has."""
    df = spark.read.parquet(path)
    return df.select(*required, *[c for c in wished if c in df.columns and c not in required])


def scan(spark: SparkSession, path: str, columns: Sequence[str], equal: Mapping[str, object] | None = None,
         among: Mapping[str, Sequence] | None = None, not_among: Mapping[str, Sequence] | None = None) -> DataFrame:
    """IO-08: many Parquet files with predicates and projection that reach the scan."""
    df = spark.read.parquet(path)
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c) == v)
    for c, v in (among or {}).items():
        df = df.filter(F.col(c).isin(list(v)))
    for c, v in (not_among or {}).items():
        df = df.filter(~F.col(c).isin(list(v)))
    return df.select(*columns)


CORPUS_SCHEMA = (
    "meta struct<query:string>, papers array<struct<paperId:string, title:string, abstract:string, year:int, venue:string, "
    "citationCount:bigint, influentialCitationCount:bigint, externalIds:map<string,string>, tldr:struct<text:string>, "
    "fieldsOfStudy:array<string>>>"
)


def read_corpus(spark: SparkSession, path: str, multi_line: bool = True, schema: str = CORPUS_SCHEMA) -> DataFrame:
    """IO-09: papers of nested corpus documents, one row each, with the query they came from."""
    docs = spark.read.json(path, schema=schema, multiLine=multi_line)
    return docs.select(F.col("meta.query").alias("query"), F.explode("papers").alias("p")).select("query", "p.*")


def flatten_papers(papers: DataFrame) -> DataFrame:
    """F-15: nested fields with defaults."""
    return papers.select(
        F.col("paperId").alias("paper"), F.coalesce("title", F.lit("")).alias("title"),
        normalise_doi(F.coalesce(F.try_element_at("externalIds", F.lit("DOI")), F.lit(""))).alias("doi"),
        F.coalesce("tldr.text", F.lit("")).alias("tldr"), F.try_element_at("fieldsOfStudy", F.lit(1)).alias("field"),
        F.coalesce("citationCount", F.lit(0)).alias("citations"), "year", "venue",
    )


FRONT_MATTER = r"(?s)\A---(.*?)---"


def front_matter(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """IO-10: key, identifier and screening status of the leading block; key falls back to the file stem."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)

    def value(name: str) -> Column:
        return F.trim(F.regexp_extract(block, rf'(?m)^{name}:[ \t]*"?([^"\n]+?)"?[ \t]*$', 1))

    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return texts.filter(F.col(text).rlike(FRONT_MATTER)).select(
        F.when(value("key") != "", value("key")).otherwise(stem).alias("key"),
        normalise_doi(value("doi")).alias("doi"), value("screening").alias("screening"),
    )


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return front_matter(texts)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered text lines per file, for the anchor checks."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return number_lines(texts, "file", "text")


def number_lines(texts: DataFrame, file: str, text: str) -> DataFrame:
    lines = texts.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\r\n|\n|\r", -1)).alias("_n", "text"))
    return lines.select("file", (F.col("_n") + 1).alias("line"), "text")
