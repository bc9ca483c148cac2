"""Sort keys, literal-safe search and the role classifier."""

from pyspark.sql import functions as F

from crateflow.functions.text import contains_ci, sort_key_a, sort_key_b
from crateflow.operators.derive import ROLE_KEYWORDS, role_pattern


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


def test_sort_key_a_strips_in_order(spark):
    assert _one(spark, sort_key_a("x"), """."'x""") == "'X"
    assert _one(spark, sort_key_a("x"), "...abc") == "ABC"
    assert _one(spark, sort_key_a("x"), '"quoted') == "QUOTED"


def test_sort_key_b_first_match_only(spark):
    assert _one(spark, sort_key_b("x"), 'A.B."C') == 'AB."C'
    assert _one(spark, sort_key_b("x"), "plain") == "PLAIN"


def test_search_escapes_wildcards(spark):
    df = spark.createDataFrame([("100% pure",), ("100 pure",), ("a_b",), ("axb",)], "t string")
    assert df.filter(contains_ci("t", "100%")).count() == 1
    assert df.filter(contains_ci("t", "a_b")).count() == 1
    assert df.filter(contains_ci("t", "a_b", wildcards=True)).count() == 2
    assert df.filter(contains_ci("t", "PURE")).count() == 2


def test_role_classifier_is_case_insensitive(spark):
    df = spark.createDataFrame([("Electric Guitar",), ("Design",), ("MC",), ("Written-By",), ("Mixed By",),
                                ("Photography By",)], "role string")
    hits = {r.role for r in df.filter(F.col("role").rlike(role_pattern())).collect()}
    assert hits == {"Electric Guitar", "MC", "Written-By", "Mixed By"}
    assert len(ROLE_KEYWORDS) == 80
