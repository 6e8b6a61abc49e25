import hashlib
import math

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexhaven.operators import chunks
from lexhaven.schemas import CHUNKS, unit_list


def cut(text, size, overlap):
    """Pieces by the plain loop, with their starts."""
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = end - overlap


def frame(spark, texts):
    rows = [(f"c{n}", t, 10, 500, "h") for n, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "id string, content string, line_start int, line_end int, content_hash string"
    )


@pytest.mark.parametrize("size,overlap", [(1000, 200), (10, 0), (10, 9), (7, 3), (50, 40)])
def test_pieces_equal_the_loop(spark, size, overlap):
    step = size - overlap
    lengths = [0, 1, size - 1, size, size + 1, size + step, size + step + 1, 10 * size, 40 * size + 3]
    texts = ["".join(chr(97 + i % 26) if i % 11 else "\n" for i in range(n)) for n in lengths]
    texts.append("é😀\n" * (12 * size))
    got = chunks.split_chunks(frame(spark, texts), size, overlap).collect()
    by_id = {}
    for row in got:
        by_id.setdefault(row.id.split("_sub")[0], []).append(row)
    for n, text in enumerate(texts):
        want = cut(text, size, overlap)
        rows = sorted(by_id[f"c{n}"], key=lambda r: r.sub_index or 0)
        assert [r.content for r in rows] == [t for _, t in want]
        if len(want) == 1:
            assert rows[0].id == f"c{n}" and rows[0].sub_index is None and rows[0].line_start == 10
        else:
            assert [r.id for r in rows] == [f"c{n}_sub{i}" for i in range(len(want))]
            assert [r.line_start for r in rows] == [10 + s // 100 for s, _ in want]
        assert all(r.line_end == 500 and r.content_hash == "h" for r in rows)
        assert [r.piece_hash for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for _, t in want]


@pytest.mark.parametrize("copies", [3, 400])
def test_exact_lines(spark, copies):
    text = "ab\ncdef\n\nxyz" * copies
    rows = chunks.split_chunks(frame(spark, [text]), 20, 5, line_mode="exact").collect()
    for r, (start, piece) in zip(sorted(rows, key=lambda r: r.sub_index), cut(text, 20, 5)):
        assert r.line_start == 10 + text[:start].count("\n")
        assert r.line_end == r.line_start + piece.count("\n")


def test_estimated_line_start_may_pass_line_end(spark):
    row = frame(spark, ["x" * 3000]).withColumn("line_end", F.lit(11))
    last = chunks.split_chunks(row).orderBy(F.col("sub_index").desc()).first()
    assert last.line_start > last.line_end


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 300), st.data())
def test_closed_form_of_the_count(length, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    n = 1 if length <= size else math.ceil((length - overlap) / (size - overlap))
    assert n == len(cut("x" * length, size, overlap))


def test_neighbours_overlap(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(5000))
    rows = chunks.split_chunks(frame(spark, [text]), 300, 70).orderBy("sub_index").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.content[-70:] == b.content[:70]
    assert rows[0].content + "".join(r.content[70:] for r in rows[1:]) == text


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (10, -1)])
def test_overlap_must_be_below_size(spark, size, overlap):
    with pytest.raises(ValueError):
        chunks.split_chunks(frame(spark, ["x"]), size, overlap)
    with pytest.raises(ValueError):
        chunks.split_counters(frame(spark, ["x"]), size, overlap)


def test_counters(spark):
    row = chunks.split_counters(frame(spark, ["a" * 10, "a" * 1001, "a" * 5000])).first()
    assert row.asDict() == {"chunks": 3, "oversized": 2, "pieces": 1 + 2 + 6, "extra_pieces": 6}


def unit(**changes):
    base = dict(
        content="body", absolute_path="/r/a.gs", relative_path="a.gs", module="m", package=None,
        class_name="", method_name="f", chunk_type="function", language="gosu", line_start=3,
        line_end=4, chunk_index=0,
    )
    return {**base, **changes}


def test_id_leaves_out_what_is_missing(spark):
    rows = [unit(), unit(line_start=0), unit(chunk_index=7), unit(package="p.q", class_name="C")]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "content string, absolute_path string, relative_path string, module string, package string, "
        "class_name string, method_name string, chunk_type string, language string, line_start int, "
        "line_end int, chunk_index int",
    )
    digest = hashlib.sha256(b"body").hexdigest()
    want = [
        ["m", "a.gs", "f", "function", "3", "4", digest[:16], "0"],
        ["m", "a.gs", "f", "function", "4", digest[:16], "0"],
        ["m", "a.gs", "f", "function", "3", "4", digest[:16], "7"],
        ["m", "a.gs", "p.q", "C", "f", "function", "3", "4", digest[:16], "0"],
    ]
    got = chunks.assemble_chunks(df)
    assert got.columns == [f.name for f in CHUNKS.fields]
    assert {r.id for r in got.collect()} == {hashlib.md5(":".join(w).encode()).hexdigest() for w in want}
    assert {r.content_hash for r in got.collect()} == {digest}


def test_unknown_chunk_type_fails(spark):
    df = spark.createDataFrame([("x", "poem", 1)], "content string, chunk_type string, line_start int")
    with pytest.raises(Exception, match="unknown chunk type"):
        chunks.assemble_chunks(df).collect()


def test_own_chunker(spark):
    files = spark.createDataFrame([("/r/a.txt", "one\ntwo")], "path string, text string")

    def lines(batch):
        rows = [
            dict(absolute_path=p, relative_path=p, content=line, chunk_type="file", language="text",
                 line_start=i + 1, line_end=i + 1, chunk_index=i)
            for p, t in zip(batch["path"], batch["text"]) for i, line in enumerate(t.split("\n"))
        ]
        return pd.DataFrame(rows)

    got = chunks.chunk_with(files, lines).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["one", "two"]
    assert got[0].id == hashlib.md5(
        ":".join(["/r/a.txt", "file", "1", "1", hashlib.sha256(b"one").hexdigest()[:16], "0"]).encode()
    ).hexdigest()


def test_own_chunker_in_sql(spark):
    def lines(text, language):
        return [(line, language, n, n) for n, line in enumerate(text.split("\n"), 1)]

    chunks.register_chunker(spark, "lines_of", lines)
    rows = [("b", 1, "x", "five"), ("a", 2, "x", "three"), ("a", 1, "x", "one\ntwo"), ("c", 1, "x", None), ("d", 1, "x", "")]
    spark.createDataFrame(rows, "relative_path string, part int, language string, text string").createOrReplaceTempView("parts")
    got = spark.sql("SELECT * FROM lines_of(TABLE(parts) PARTITION BY relative_path ORDER BY part)")
    assert got.columns == ["relative_path", "part", "language", "content", "chunk_type", "line_start", "line_end", "chunk_index"]
    assert sorted((r.relative_path, r.part, r.content, r.line_start, r.chunk_index) for r in got.collect()) == [
        ("a", 1, "one", 1, 0), ("a", 1, "two", 2, 1), ("a", 2, "three", 3, 2), ("b", 1, "five", 1, 0), ("d", 1, "", 1, 0)]
    assert spark.sql("SELECT * FROM lines_of(TABLE(SELECT * FROM parts WHERE part > 9))").count() == 0
    with pytest.raises(Exception, match="needs the columns text"):
        spark.sql("SELECT * FROM lines_of(TABLE(SELECT relative_path, language FROM parts))").collect()


def test_chunks_per_file(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "absolute_path string")
    assert {tuple(r) for r in chunks.chunks_per_file(df).collect()} == {("a", 2), ("b", 1)}


def test_unit_list():
    assert unit_list(" a, b ,,c,") == ["a", "b", "c"]


def test_split_is_narrow_and_stays_in_the_jvm(spark, plan_of):
    plan = plan_of(chunks.split_chunks(frame(spark, ["x"]), line_mode="exact"))
    assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan
