"""Column functions against plain Python."""

import time
import math
import unicodedata
from decimal import ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyveil.functions import codes as K
from tallyveil.functions import geo, special
from tallyveil.functions import text as X
from tallyveil.functions.hashing import mixed_hash


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_zero_pad_keeps_long_codes(spark):
    assert apply(column(spark, ["7", "150101", "1501011", None]), K.zero_pad("v")) == ["000007", "150101", "1501011", None]


def test_weights(spark):
    d = column(spark, ["32,858", "", "0", "x", "-1", " 2,5 ", None])
    assert apply(d, K.weight_or_null("v")) == [32.858, None, None, None, None, 2.5, None]
    assert apply(d, K.weight_or_zero("v")) == [32.858, 0.0, 0.0, 0.0, -1.0, 2.5, 0.0]


def test_strict_int_and_multiplicity(spark):
    d = column(spark, [" 12 ", "-3", "1.0", "", "51", "0", None])
    assert apply(d, K.strict_int("v")) == [12, None, None, None, 51, 0, None]
    assert apply(d, K.event_multiplicity(K.strict_int("v"))) == [12, 1, 1, 1, 1, 1, 1]
    sub = K.capped_subcount(F.col("v"), F.lit(3).cast("bigint"), F.lit(1))
    assert apply(column(spark, [5, 2, None], "bigint"), sub) == [3, 2, 1]


def test_doi_prefixes_are_stripped_in_sequence(spark):
    d = column(spark, [" HTTPS://doi.org/doi:10.1/A ", "doi.org/10.2/b", "10.3/c", "http://doi.org/https://doi.org/x"])
    assert apply(d, K.normalise_doi("v")) == ["10.1/a", "10.2/b", "10.3/c", "https://doi.org/x"]


def test_cited_numerals(spark):
    d = column(spark, ["× 4.6", "~1,234.5", "4,6", "x7", "", "-0.5", "1.2.3"])
    got = apply(d, K.parse_cited("v"))
    assert [None if v is None else float(v) for v in got] == [4.6, 1234.5, None, 7.0, None, -0.5, None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-10**6, 10**6), min_size=5, max_size=20))
def test_rounding_matches_decimal(spark, raw):
    values = [v / 1000 for v in raw]
    d = column(spark, values, "double")
    for mode, ref in (("half_up", ROUND_HALF_UP), ("half_even", ROUND_HALF_EVEN), ("floor", ROUND_FLOOR)):
        want = [Decimal(str(v)).quantize(Decimal("0.01"), rounding=ref) for v in values]
        assert apply(d, K.canonical_round("v", 2, mode)) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aábcÉñÜ zÇ ", max_size=12), min_size=3, max_size=10))
def test_folding_matches_unicode_decomposition(spark, words):
    want = ["".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)).strip() for w in words]
    assert apply(column(spark, words), K.fold_text("v")) == want


def test_log_gamma(spark):
    xs = [1e-3, 0.5, 1.0, 2.5, 10.0, 1234.5, 1e6]
    d = special.with_lgamma(column(spark, xs, "double"), {"g": F.col("v")})
    for x, g in zip(xs, apply(d, F.col("g"))):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-10)


def test_beta_quantile_inverts_a_numeric_integral():
    for a, b in ((0.5, 0.5), (2.0, 5.0), (40.0, 300.0), (0.3, 90.0)):
        for p in (0.025, 0.5, 0.975):
            q = float(special.beta_inverse(np.array([p]), np.array([a]), np.array([b]))[0])
            # Substituting x = sin(u)^2 removes the end-point singularities.
            u = np.linspace(0.0, math.asin(math.sqrt(q)), 400_001)[1:]
            f = 2 * np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
            log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
            mass = np.sum((f[1:] + f[:-1]) / 2 * np.diff(u)) / math.exp(log_b)
            assert mass == pytest.approx(p, abs=4e-3)


def test_known_tails(spark):
    d = spark.createDataFrame([(-0.5716, 41), (1.0, 10), (0.3, 2)], "rho double, n int")
    p = [r[0] for r in d.select(special.spearman_p(F.col("rho"), F.col("n"))).collect()]
    assert p[0] == pytest.approx(9e-5, abs=1e-5) and p[1] == 0.0 and p[2] is None
    c = spark.createDataFrame([(3.841459,)], "x double").select(special.chi2_tail(F.col("x"))).first()[0]
    assert c == pytest.approx(0.05, abs=1e-6)
    q = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0)], "a double, b double").select(special.beta_quantile(0.25, F.col("a"), F.col("b"))).collect()
    assert q[0][0] == pytest.approx(0.25, abs=1e-9) and q[1][0] is None


def test_hash_seeds_are_unrelated(spark):
    rows = spark.range(2000).select(mixed_hash(F.col("id"), 1).alias("a"), mixed_hash(F.col("id"), 2).alias("b")).toPandas()
    assert abs(rows["a"].corr(rows["b"])) < 0.08 and rows["a"].nunique() > 1990


def test_hexagons_contain_their_points(spark):
    d = spark.range(500).select((F.col("id") * 7 % 101 - 50).cast("double").alias("x"), (F.col("id") * 13 % 97 - 48).cast("double").alias("y"))
    q, r = geo.axial_cell(F.col("x"), F.col("y"), 4.0)
    d = d.withColumns({"q": q, "r": r})
    cx, cy = geo.cell_centre(F.col("q"), F.col("r"), 4.0)
    far = d.select(F.max(F.sqrt((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2))).first()[0]
    assert far <= 4.0 + 1e-9


def test_tokens(spark):
    d = column(spark, ["<p>The Models &amp; crime-maps \\alpha of inline-formula xx reporting</p>", None])
    assert apply(d, X.tokens(F.col("v"))) == [["crime-maps", "reporting"], []]
    assert apply(d, X.tokens(F.col("v"), markup=False))[0] == ["amp", "crime-maps", "inline-formula", "reporting"]


def test_marker_extraction(spark):
    body = "word " * 40
    plain = f"Title\nABSTRACT: {body}\nIntroduction more"
    columns = "left text here that is long enough     Abstract\n" + "\n".join(
        "keywords left              ".ljust(40) + f"right {i} part of the text" for i in range(10))
    d = column(spark, [plain, columns, "no marker", "Abstract tiny\nKeywords", None])
    start, end = r"\babstract\b[:.\s]*", r"\bintroduction\b|\bkeywords?\b"
    got = apply(d, X.between_markers(F.col("v"), start, end))
    assert got[0] == body.strip()
    assert got[1].startswith("right 0 part") and "keywords" not in got[1]
    assert got[2:] == ["", "", ""]


def test_keyword_groups(spark):
    d = column(spark, ["Deep learning for crime with under-report", "deep learning only", None])
    groups = [["deep learning"], ["crime", "criminal"], ["under-report"]]
    assert apply(d, X.all_groups(F.col("v"), groups)) == [True, False, False]
    assert apply(d, X.groups_hit(F.col("v"), groups)) == [3, 1, 0]


def test_draws_of_neighbouring_keys_differ(spark):
    # Keys and event numbers stay apart: no event of one key draws like one of the next, nor do large keys repeat.
    rows = spark.range(4).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(2500)))).select(mixed_hash(F.col("id"), 3, F.col("i")).alias("h"))
    assert rows.distinct().count() > 9_990
    large = spark.range(2).select(mixed_hash(F.col("id") * (1 << 31), 3).alias("h"))
    assert large.distinct().count() == 2
    assert spark.sql("SELECT 'q' AS q").select(mixed_hash(F.lit("1:2"), 1) >= 0).first()[0]


def test_rounding_beyond_six_decimals(spark):
    d = spark.sql("SELECT CAST(1.123456785 AS DOUBLE) AS v")
    assert str(d.select(K.canonical_round("v", 8)).first()[0]) == "1.12345679"
    assert str(d.select(K.canonical_round("v", 7, "floor")).first()[0]) == "1.1234567"


def test_marker_parts_are_made_once_per_text(spark):
    words = [f"word{i}" for i in range(20_000)]
    text = "\n".join(["y" * 30 + " abstract: z"] + [" " * 40 + w for w in words])
    d = spark.createDataFrame([(text,)], "v string")
    began = time.monotonic()
    assert d.select(X.between_markers(F.col("v"), "abstract", "keywords")).first()[0] == " ".join(words)
    assert time.monotonic() - began < 30
