"""Published figures as tables: upsert, staleness, anchors in texts and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.functions.codes import cited_decimals, parse_cited

DEFAULT_DECIMALS = 4  # fixed value
DEFAULT_MODE = "half_up"  # fixed value
EXACT_DECIMALS = 18  # the decimal text of a double has no more that could be rounded away
MODES = ("half_up", "half_even", "floor")

# Anchor syntax and what counts as a numeral in a text.
ANCHOR = r"CANON:\s*([\w.\-]+)\s*=\s*([~×xX]?\s*[-0-9.,]+)(\s+variant-ok)?"
ANCHOR_WORD = r"(?i)\bcanon\b"
NUMERAL = r"(^|[^\w.])[×xX~]?\s*[0-9]+\.[0-9]+"


def with_rounded(df: DataFrame, value: Column, decimals: Column, mode: Column, name: str) -> DataFrame:
    """The value rounded with precision and mode given per row, as decimal(38,18) in column ``name``.

    NULL for an unknown mode or a negative precision: such a policy has no official value. The unit of the last place comes from a
    list by precision, remainders of decimals are exact, and the steps are columns of their own, so that none is spelled out twice.
    """
    kind = f"decimal(38,{EXACT_DECIMALS})"
    unit, half = (F.get(F.array(*[F.lit(f"{n}e-{d + (n == 5)}").cast(kind) for d in range(EXACT_DECIMALS)]), F.col("_decimals")) for n in (1, 5))
    first = df.withColumns({"_exact": value.cast("string").cast(kind), "_decimals": decimals, "_mode": mode})
    sized = first.withColumns({"_size": F.abs("_exact"), "_unit": unit, "_half": half})
    over = sized.withColumn("_over", (F.col("_size") % F.col("_unit")).cast(kind))
    parts = over.withColumn("_below", (F.col("_size") - F.col("_over")).cast(kind))
    odd = (F.col("_below") % (F.col("_unit") + F.col("_unit"))) != 0
    up = (
        F.when(F.col("_mode") == "half_up", F.col("_over") >= F.col("_half"))
        .when(F.col("_mode") == "half_even", (F.col("_over") > F.col("_half")) | ((F.col("_over") == F.col("_half")) & odd))
        .when(F.col("_mode") == "floor", (F.col("_exact") < 0) & (F.col("_over") > 0))
    )
    rounded = parts.withColumn("_rounded", F.when(up, (F.col("_below") + F.col("_unit")).cast(kind)).otherwise(F.col("_below")))
    signed = F.when(F.col("_exact") < 0, -F.col("_rounded")).otherwise(F.col("_rounded"))
    out = F.when(F.col("_decimals") >= EXACT_DECIMALS, F.col("_exact")).otherwise(signed)
    known = F.col("_mode").isin(*MODES) & (F.col("_decimals") >= 0)
    return rounded.withColumn(name, F.when(known, out.cast(kind))).drop("_exact", "_decimals", "_mode", "_size", "_unit", "_half", "_over", "_below", "_rounded")


def content_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """R-01: SHA-256 of files, and of folders over the names and digests of their files: (name, sha). Computed in the tasks, a file each."""
    parts = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        own = F.substring_index("path", path.rstrip("/"), -1)
        each = files.select(own.alias("file"), F.sha2("content", 256).alias("sha"))
        listed = F.sort_array(F.collect_list(F.struct("file", "sha")))
        whole = F.sha2(F.array_join(F.transform(listed, lambda f: F.concat(f["file"], F.lit(":"), f["sha"])), "\n").cast("binary"), 256)
        parts.append(each.agg(F.when(F.count("*") == 1, F.max("sha")).otherwise(whole).alias("sha"), F.count("*").alias("_n")).filter("_n > 0").select(F.lit(path).alias("name"), "sha"))
    return reduce(DataFrame.unionByName, parts)


def with_provenance(figures: DataFrame, scripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """R-01: figures (family, variant, script, input_names, ...) with ``script_sha`` and ``inputs``, sorted (name, sha) pairs of all inputs.

    ``scripts`` and ``manifest``: name, sha. What is not in them has a null digest.
    """
    made = figures.join(scripts.select(F.col("name").alias("script"), F.col("sha").alias("script_sha")), "script", "left")
    used = figures.select("family", "variant", F.explode("input_names").alias("name")).join(manifest, "name", "left")
    pairs = used.groupBy("family", "variant").agg(F.sort_array(F.collect_list(F.struct("name", "sha"))).alias("inputs"))
    none = F.expr("cast(array() AS array<struct<name:string,sha:string>>)")
    return made.drop("input_names").join(pairs, ["family", "variant"], "left").withColumn("inputs", F.coalesce("inputs", none))


PROVENANCE = ("unit", "estimator", "script", "script_sha", "inputs", "emitted_at")
ENTRY = (
    "family string, variant string, value double, display decimal(38,18), canonical boolean, needs_policy boolean, unit string, estimator string, "
    "script string, script_sha string, inputs array<struct<name:string,sha:string>>, emitted_at string"
)


def emit(existing: DataFrame, new: DataFrame, policy: DataFrame) -> DataFrame:
    """R-01: upsert by family and variant, rows as in ``ENTRY``.

    ``new``: family, variant, value and the columns of ``PROVENANCE``. ``policy``: family, canonical_variant, decimals,
    round_mode. Entries whose value, display, flags, script and inputs did not change keep their emission time; families
    without a policy are marked ``needs_policy``.
    """
    joined = new.join(policy, "family", "left")
    shown = with_rounded(joined, F.col("value"), F.coalesce("decimals", F.lit(DEFAULT_DECIMALS)), F.coalesce("round_mode", F.lit(DEFAULT_MODE)), "display")
    fresh = shown.select(
        "family", "variant", F.round("value", 6).alias("value"), "display",
        F.coalesce(F.col("canonical_variant") == F.col("variant"), F.lit(False)).alias("canonical"),
        F.col("canonical_variant").isNull().alias("needs_policy"), *PROVENANCE,
    )
    keys = ["family", "variant"]
    values = [c for c in fresh.columns if c not in keys]
    a = fresh.select(*keys, F.struct(*values).alias("n"))
    b = existing.select(*keys, F.struct(*values).alias("o"))
    joined = a.join(b, keys, "full_outer")
    same = F.lit(True)
    for c in values:
        if c not in ("emitted_at", "unit", "estimator", "script"):
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    unchanged = F.col("o").isNotNull() & same
    merged = F.when(F.col("n").isNull(), F.col("o")).otherwise(F.col("n").withField("emitted_at", F.when(unchanged, F.col("o.emitted_at")).otherwise(F.col("n.emitted_at"))))
    return joined.select(*keys, merged.alias("e")).select(*keys, "e.*")


def stale_entries(entries: DataFrame, scripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """R-02: entries of ``emit`` whose script or one of whose inputs is gone or has other content now: (family, variant, name, reason).

    ``scripts`` and ``manifest``: name, sha, as they are now.
    """
    keys = ["family", "variant"]
    made = entries.select(*keys, F.col("script").alias("name"), F.col("script_sha").alias("then"), F.lit("producer").alias("what"))
    used = entries.select(*keys, F.explode("inputs").alias("i")).select(*keys, "i.name", F.col("i.sha").alias("then"), F.lit("input").alias("what"))
    reasons = []
    for part, now in ((made, scripts), (used, manifest)):
        joined = part.join(now, "name", "left")
        gone = F.when(F.col("sha").isNull(), "missing").when(~F.col("sha").eqNullSafe(F.col("then")), "changed")
        reasons.append(joined.select(*keys, "name", F.concat_ws(" ", "what", gone).alias("reason"), gone.alias("_gone")).filter("_gone IS NOT NULL").drop("_gone"))
    return reasons[0].unionByName(reasons[1])


def find_anchors(lines: DataFrame) -> DataFrame:
    """R-03: anchors of every line: (file, line, key, cited, variant_ok)."""
    def group(i: int) -> Column:
        return F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(i))

    hits = lines.filter(F.contains("text", F.lit("CANON:"))).select(
        "file", "line", F.explode(F.arrays_zip(group(1).alias("key"), group(2).alias("cited"), group(3).alias("flag"))).alias("a")
    )
    return hits.select("file", "line", "a.key", F.trim("a.cited").alias("cited"), (F.col("a.flag") != "").alias("variant_ok"))


def malformed_anchors(lines: DataFrame) -> DataFrame:
    """R-03: lines that mention an anchor and an equals sign but do not parse."""
    text = F.col("text")
    return lines.filter(text.rlike(ANCHOR_WORD) & F.contains(text, F.lit("=")) & ~text.rlike(ANCHOR)).select("file", "line", F.trim("text").alias("text"))


def resolve(anchors: DataFrame, entries: DataFrame, policy: DataFrame) -> DataFrame:
    """R-04: full key first, otherwise the family's canonical variant."""
    e = entries.select(
        F.concat_ws(".", "family", "variant").alias("entry_key"), "family", "variant", "value", "canonical", "needs_policy"
    )
    full = e.select(F.col("entry_key").alias("key"), F.struct(*e.columns).alias("_full"))
    family = policy.select("family", "canonical_variant").join(
        e.withColumnRenamed("variant", "canonical_variant"), ["family", "canonical_variant"]
    ).withColumnRenamed("canonical_variant", "variant")
    by_family = family.select(F.col("family").alias("key"), F.struct(*[family[c] for c in e.columns]).alias("_family"))
    joined = anchors.join(full, "key", "left").join(by_family, "key", "left")
    out = joined.withColumn("_e", F.coalesce("_full", "_family")).withColumn(
        "by_family", F.col("_full").isNull() & F.col("_family").isNotNull()
    )
    return out.select(*anchors.columns, "by_family", "_e.*")


def check(lines: DataFrame, entries: DataFrame, policy: DataFrame, stale: DataFrame) -> DataFrame:
    """R-05: first rule each anchor breaks: (file, line, key, violation, blocking)."""
    resolved = resolve(find_anchors(lines), entries, policy).join(
        policy.select("family", "decimals", "round_mode"), "family", "left"
    ).join(stale.select("family", "variant", F.lit(True).alias("_stale")), ["family", "variant"], "left")
    decimals = F.coalesce("decimals", F.lit(DEFAULT_DECIMALS))
    resolved = with_rounded(resolved, F.col("value"), decimals, F.coalesce("round_mode", F.lit(DEFAULT_MODE)), "_official").withColumn("_cited", parse_cited("cited"))
    cited, official = F.col("_cited"), F.col("_official")
    rule = (
        F.when(F.col("entry_key").isNull(), "unknown key")
        .when(F.col("needs_policy"), "no policy")
        .when(~F.col("by_family") & ~F.col("canonical") & ~F.col("variant_ok"), "variant not canonical")
        .when(cited.isNull(), "unreadable value")
        .when(cited_decimals("cited") > decimals, "too many decimals")
        .when(official.isNull(), "no official value")
        .when(cited != official, "value differs")
        .when(F.col("_stale"), "stale")
    )
    broken = resolved.select("file", "line", "key", rule.alias("violation")).filter("violation IS NOT NULL")
    bad = malformed_anchors(lines).select("file", "line", F.lit(None).cast("string").alias("key"), F.lit("malformed").alias("violation"))
    return bad.unionByName(broken).withColumn("blocking", F.col("violation") != "stale")


def unanchored_numbers(lines: DataFrame) -> DataFrame:
    """R-06: lines with a numeral and no anchor on the same, previous or next line.

    Anchored lines are spread to their neighbours and removed by an anti join, so a very
    long file is not windowed in one task.
    """
    near = lines.filter(F.contains("text", F.lit("CANON:"))).select(
        "file", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line")
    )
    return lines.filter(F.col("text").rlike(NUMERAL)).join(near, ["file", "line"], "left_anti")


def reproduction_gate(computed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R-07: figures that miss the expected value by more than the tolerance."""
    joined = expected.join(computed, list(keys), "left")
    off = F.col("value").isNull() | (F.abs(F.col("value") - F.col("expected")) > F.col("tolerance"))
    return joined.withColumn("difference", F.col("value") - F.col("expected")).filter(off)


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when a gate found violations; reports a few of them."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {found}")
