"""Session helpers: builder defaults and lineage cuts on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session used by the tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyveil")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of every Column operation are only wanted when debugging.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster; a fresh one only on a local master that names none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a table that must outlive executors."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are written once and re-read, also after executor loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short fixed list as a local relation, so that its size is known to the planner."""
    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(text(x) for x in v)})"
        return str(v)

    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    body = ", ".join(f"({', '.join(text(v) for v in row)})" for row in rows)
    names = ", ".join(f"`{n}`" for n, _ in fields)
    casts = ", ".join(f"CAST(`{n}` AS {k}) AS `{n}`" for n, k in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
