import pytest
from pyspark.sql import functions as F

from lexhaven.functions import text
from lexhaven.functions.arrays import once, totals_before
from lexhaven.functions.errors import error_status
from lexhaven.functions.text import first_characters, led
from lexhaven.functions.vectors import relevance_band, score_of, squared_l2
from lexhaven.schemas import SOURCE_UNITS, STATUSES, TEMPLATE_UNITS, checked


def apply(spark, fn, values, ddl="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {ddl}")
    return [r.out for r in df.select("n", fn(F.col("v")).alias("out")).orderBy("n").collect()]


def test_extname(spark):
    names = ["/a/b.gs", "a..gs", "/x.y/.gs", "noext", "a.", "/d.ir/file", "A.GS"]
    assert apply(spark, text.extname, names) == [".gs", ".gs", "", "", ".", "", ".GS"]


def test_paths(spark):
    assert apply(spark, lambda c: text.relative_to(c, "/r/"), ["/r/a/b.gs", "/x/c.gs"]) == ["a/b.gs", "c.gs"]
    assert apply(spark, text.strip_scheme, ["file:/a/b", "file:///a", "s3://bucket/k/x", "/p"]) == ["/a/b", "/a", "/k/x", "/p"]


def test_small_text_functions(spark):
    assert apply(spark, text.not_blank, [" \n\t", "", " a "]) == [False, False, True]
    assert apply(spark, text.text_lines, ["a\n\nb\n"]) == [["a", "", "b", ""]]
    assert apply(spark, text.to_number, ["12", "x", None]) == [12, 0, 0]
    assert apply(spark, text.empty_to_null, ["", "a", None]) == [None, "a", None]
    assert apply(spark, text.percent, [0.41666], "double") == ["41.7%"]
    assert apply(spark, text.snippet, ["a\nb", "x" * 200, "y" * 201]) == ["a b", "x" * 200, "y" * 200 + "..."]
    assert apply(spark, text.package_of, ["// c\n  package a.b\n", "x package y", ""]) == ["a.b", None, None]


def test_session_id(spark):
    got = spark.sql("select timestamp'2024-03-04 05:06:07.089' as t").select(text.sortable_session(F.col("t"))).first()[0]
    assert got == "2024-03-04T05-06-07-089Z"


def test_totals_before(spark):
    lists = [[], [5], list(range(1000)), None, [1] * 70_000]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(lists)], "n int, v array<int>")
    got = [r.out for r in df.select("n", totals_before("v").alias("out")).orderBy("n").collect()]
    assert got[0] == [] and got[1] == [0] and got[3] is None
    assert got[2] == [sum(range(n)) for n in range(1000)] and got[4] == list(range(70_000))


def test_once_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), ("a",)], "v string")
    assert {r.o for r in df.select(once(F.col("v")).alias("o")).collect()} == {None, "a"}


def test_distance_and_score(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(squared_l2(F.col("a"), F.col("b")).alias("d")).select("d", score_of(F.col("d")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(25.0, 1 / 26), (0.0, 1.0)]


def test_bands_meet_at_their_limits(spark):
    scores = [1 / (1 + d) for d in (0, 1.4, 1.5, 1.6, 3.9, 4.0, 4.1)]
    assert apply(spark, relevance_band, scores, "double") == ["high", "high", "moderate", "moderate", "moderate", "moderate", "weak"]


@pytest.mark.parametrize("message,status", [
    ("maximum context length", "token_limit"),
    ("Unexpected token in file", "token_limit"),
    ("HTTP 429", "rate_limit"),
    ("RATE LIMIT hit while parsing", "rate_limit"),
    ("Syntax error in chunk", "parse_error"),
    ("bad chunk of embedding", "chunk_error"),
    ("EMBED failed on upsert", "embedding_error"),
    ("upsert timed out", "storage_error"),
    ("disk full", "unknown_error"),
    (None, "unknown_error"),
])
def test_error_status_takes_the_first_match(spark, message, status):
    assert apply(spark, error_status, [message]) == [status]


def test_closed_sets(spark):
    assert apply(spark, lambda c: checked(c, STATUSES, "status"), ["success"]) == ["success"]
    for bad in ("done", None):
        with pytest.raises(Exception, match="unknown status"):
            apply(spark, lambda c: checked(c, STATUSES, "status"), [bad])


def test_first_characters_of_patterns():
    assert [first_characters(r[4]) for r in SOURCE_UNITS] == list("cieefpupc")
    assert [first_characters(r[4]) for r in TEMPLATE_UNITS] == ["<", "<", "<", "<$", "<"]
    unclear = ["", "a|", "|a", "a?b", "a*", "a{0}", "(?i)a", "a(?i)b", "[ab]c", r"\bfoo", r"\d+", "^a", ".", "(a)?b", "(a|b)c", "x[|]y", r"\Qa|b\E"]
    assert [p for p in unclear if first_characters(p) is not None] == []
    assert first_characters(r"a\|b") == "a" and first_characters("a(b|c)|d") == "ad"


def test_unclear_patterns_are_not_led():
    assert led("X", ["a", "b?"]) == led("X", []) == "X"
    assert led("X", ["a", r"\$"], "{") == r"(?=[\$a\{])(?:X)"


def test_prefix_sums_beyond_an_int(spark):
    df = spark.createDataFrame([([1 << 32] * 1100,), ([],)], "v array<bigint>")
    got = [r[0] for r in df.select(totals_before("v", "0L")).collect()]
    assert got == [[n << 32 for n in range(1100)], []]
