import pytest
from pyspark.sql import functions as F

from siltstone.functions import text


def value(spark, column, **row):
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "given, want",
    [("온도보정", "온도 도보 보정"), ("온도보정알고리즘", "온도 도보 보정 정알 알고 고리 리즘"), ("ABC온도 sensor 보정!", "온도 보정"), ("한글+English혼합", "한글 혼합"), ("plain only 123", ""), ("", ""), ("가", "")],
)
def test_bigrams(spark, given, want):
    assert " ".join(value(spark, text.cjk_bigrams(F.col("t")), t=given)) == want


@pytest.mark.parametrize("given, want", [("온도보정", ["온도", "보정"]), ("온도보정기", ["온도", "보정"]), ("온도", ["온도"]), ("abc", [])])
def test_query_bigrams(spark, given, want):
    assert value(spark, text.cjk_query_bigrams(F.col("t")), t=given) == want


def test_index_tokens_fold_case_and_marks(spark):
    assert value(spark, text.index_tokens(F.col("t")), t="Crème_BRÛLÉE été-2 Straße") == ["creme", "brulee", "ete", "2", "straße"]


def test_query_tokens_drop_stopwords_and_repetitions(spark):
    assert value(spark, text.query_tokens(F.col("t")), t="Who owns Project Mercedes-Benz, project? 뭐야 a_b") == ["owns", "Project", "Mercedes-Benz", "a_b"]


@pytest.mark.parametrize("n, want", [(8, 8), (9, 8), (3, 3)])
def test_candidate_tokens(spark, n, want):
    words = [f"w{i}" for i in range(n)]
    got = value(spark, text.candidate_tokens(F.split("t", " ")), t=" ".join(words))
    assert got == (words if n <= 8 else words[:4] + words[-4:]) and len(got) == want


def test_excerpt_window_and_marks(spark):
    content = "x" * 500 + "  needle\n\there " + "y" * 500
    got = value(spark, text.excerpt(F.col("c"), F.split("t", " ")), c=content, t="needle nothing")
    assert got.startswith("… ") and got.endswith(" …") and "needle here" in got
    assert value(spark, text.excerpt(F.col("c"), F.split("t", " ")), c="", t="a") == ""
    assert value(spark, text.excerpt(F.col("c"), F.split("t", " ")), c="short text", t="zzz") == "short text"


@pytest.mark.parametrize("path, stem, suffix", [("a/b/c.tar.GZ", "c.tar", ".gz"), (".env", ".env", ""), ("a/.keep_1.md", ".keep_1", ".md"), ("noext", "noext", "")])
def test_path_parts(spark, path, stem, suffix):
    assert value(spark, text.stem(F.col("p")), p=path) == stem and value(spark, text.suffix(F.col("p")), p=path) == suffix


def test_page_path_and_fence_and_json(spark):
    import hashlib

    path = "a/__Weird name!! (1).md"
    assert value(spark, text.page_path(F.col("p")), p=path) == f"wiki/sources/Weird-name-1-{hashlib.sha1(path.encode()).hexdigest()[:12]}.md"
    assert value(spark, text.fence(F.col("c")), c="a ```` b") == "`````" and value(spark, text.fence(F.col("c")), c="") == "```"
    assert value(spark, text.json_string(F.col("c")), c='quote " and 한글\n') == '"quote \\" and 한글\\n"'
