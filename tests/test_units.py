import re

import pytest
from pyspark.sql import functions as F

from given_data import SMALL
from lexhaven.operators import blocks, chunks, regions
from lexhaven.plans import inputs
from lexhaven.schemas import DEFAULT_SOURCE_UNITS, SOURCE_UNITS, units_table

SOURCE = '''package a.b.c

uses lib.api.Base
// class Fake {
class Foo extends Bar {
  var s = "} class Q { \\" } "
  function one(a : int) : String { if (a > 1) { return "x{" } else { return 'y}' } }
  property get Name() : String {
    return s
  }
  class Inner { function two() {} }
  /* } { */
}
interface I {
  function abs(x : int) : int
  function abs2();
}
enum E { A, B }
enhancement Ext : Foo { function three() { } }
'''


def files(spark, *texts):
    return spark.createDataFrame([(f"/f{n}.gs", t) for n, t in enumerate(texts)], "path string, text string")


def rows(df):
    return df.orderBy("path", "chunk_index").collect()


def test_units_in_document_order(spark):
    got = rows(blocks.extract_blocks(files(spark, SOURCE)))
    seen = [(r.chunk_type, r.name, r.enclosing_class, r.line_start, r.line_end) for r in got]
    assert seen == [
        ("class", "Foo", None, 5, 13),
        ("function", "one", "Foo", 7, 7),
        ("property", "Name", "Foo", 8, 10),
        ("class", "Inner", "Foo", 11, 11),
        ("function", "two", "Inner", 11, 11),
        ("interface", "I", None, 14, 17),
        ("function", "abs", "I", 15, 15),
        ("function", "abs2", "I", 16, 16),
        ("enum", "E", None, 18, 18),
        ("class", "Ext", None, 19, 19),
        ("function", "three", "Ext", 19, 19),
    ]
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert {r.package for r in got} == {"a.b.c"}
    by_name = {r.name: r for r in got}
    assert by_name["one"].content == SOURCE.split("\n")[6].strip()
    assert by_name["abs"].content == "function abs(x : int) : int"
    assert by_name["abs2"].content == "function abs2();"
    assert by_name["Foo"].class_name == "Foo" and by_name["Foo"].method_name is None
    assert by_name["one"].method_name == "one" and by_name["one"].class_name is None


def test_children_are_repeated_in_their_parents(spark):
    got = {r.name: r.content for r in rows(blocks.extract_blocks(files(spark, SOURCE)))}
    assert got["two"] in got["Inner"] and got["Inner"] in got["Foo"]


def test_chosen_units_and_unmapped_types(spark):
    got = rows(blocks.extract_blocks(files(spark, SOURCE), ("uses_statement", "package_declaration")))
    assert [(r.chunk_type, r.content, r.chunk_index) for r in got] == [
        ("file", "package a.b.c", 0), ("file", "uses lib.api.Base", 1),
    ]
    assert all(r.class_name is None and r.method_name is None for r in got)


def test_catalogue_as_a_table(spark):
    table = units_table(spark, SOURCE_UNITS)
    got = rows(blocks.extract_blocks(files(spark, SOURCE), ("enum_declaration",), table))
    assert [r.name for r in got] == ["E"]


def test_empty_and_plain_texts(spark):
    assert rows(blocks.extract_blocks(files(spark, "", "no units here", "var x = {1, 2}"))) == []


def test_declaration_at_the_end_has_no_body(spark):
    got = rows(blocks.extract_blocks(files(spark, "function f() : int\n\n")))
    assert [r.content for r in got] == ["function f() : int"]


def test_issues(spark):
    df = blocks.block_issues(files(spark, "class X {\n function f() {\n", "}\n class Y { }\n }", SOURCE))
    got = {r.path: [i.asDict() for i in r.issues] for r in df.collect()}
    assert got["/f0.gs"] == [
        dict(type="MISSING", start_line=1, start_column=1, end_line=3, end_column=1, text="class X {\n function f() {\n"),
        dict(type="MISSING", start_line=2, start_column=2, end_line=3, end_column=1, text="function f() {\n"),
    ]
    assert got["/f1.gs"] == [
        dict(type="ERROR", start_line=1, start_column=1, end_line=1, end_column=2, text="}"),
        dict(type="ERROR", start_line=3, start_column=2, end_line=3, end_column=3, text="}"),
    ]
    assert got["/f2.gs"] == []


def test_issue_text_is_cut(spark):
    got = blocks.block_issues(files(spark, "class X {" + "a" * 500)).first().issues
    assert len(got[0].text) == 200


def test_strings_with_many_escapes(spark):
    text = 'class A { var s = "' + '\\"{' * 200_000 + '" }\nclass B { }'
    assert [r.name for r in rows(blocks.extract_blocks(files(spark, text)))] == ["A", "B"]


def naive(text):
    """Units by a character walk with a stack."""
    quiet = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/', re.S)
    kinds = {"class": "class", "interface": "interface", "enum": "enum", "enhancement": "class", "function": "function"}
    declared = re.compile(r"\b(?:(class|interface|enum|enhancement|function)\s+(\w+)|(property)\s+(?:get|set)\s+(\w+))")
    at, stack, pending, out = 0, [], None, []
    while at < len(text):
        skip = quiet.match(text, at)
        if skip:
            at = skip.end()
            continue
        unit = declared.match(text, at) if at == 0 or not re.match(r"\w", text[at - 1]) else None
        if unit:
            kind = kinds[unit[1]] if unit[1] else "property"
            pending = (kind, unit[2] or unit[4], at)
            at = unit.end()
            continue
        if text[at] == "{":
            stack.append(pending)
            pending = None
        elif text[at] == "}" and stack:
            top = stack.pop()
            if top:
                out.append((top[2], top[0], top[1], text[top[2] : at + 1]))
        at += 1
    return [u[1:] for u in sorted(out)]


def test_units_equal_a_naive_walk(spark):
    df = inputs.source_files(spark, SMALL).select("path", "text")
    want = {r.path: naive(r.text) for r in df.collect()}
    got = {path: [] for path in want}
    for r in rows(blocks.extract_blocks(df)):
        got[r.path].append((r.chunk_type, r.name, r.content))
    assert got == want
    assert sum(map(len, got.values())) > 500


TEMPLATE = """<%@ params(a : int) %>
text ${a} <%-- <% hidden %> --%>
<% for (i in 1..a) {
%> <%= i %> <%! var z = 1 %>
<% } %>
<%%> <% unfinished"""


def test_regions_in_order(spark):
    got = rows(regions.extract_regions(files(spark, TEMPLATE)))
    assert [(r.unit_type, r.chunk_type, r.line_start, r.line_end) for r in got] == [
        ("directive", "template_directive", 1, 1),
        ("expression", "template_block", 2, 2),
        ("scriptlet", "template_block", 3, 4),
        ("expression", "template_block", 4, 4),
        ("declaration", "template_block", 4, 4),
        ("scriptlet", "template_block", 5, 5),
        ("scriptlet", "template_block", 6, 6),
    ]
    assert got[2].content == "<% for (i in 1..a) {\n%>"
    assert [r.chunk_index for r in got] == list(range(7))


def test_chosen_regions(spark):
    got = rows(regions.extract_regions(files(spark, TEMPLATE), ("expression", "comment")))
    assert [(r.unit_type, r.chunk_type, r.chunk_index) for r in got] == [
        ("expression", "template_block", 0), ("comment", "file", 1), ("expression", "template_block", 2),
    ]


def test_many_regions(spark):
    text = "x\n<%= 1 %>\n" * 2000
    got = rows(regions.extract_regions(files(spark, text)))
    assert [r.line_start for r in got] == [2 + 2 * n for n in range(2000)]


def test_both_kinds_of_file(spark):
    df = spark.createDataFrame(
        [("/r/a.gs", "a.gs", "gosu", SOURCE), ("/r/b.gst", "b.gst", "gosu_template", TEMPLATE)],
        "path string, relative_path string, language string, text string",
    )
    got = chunks.chunk_files(df, "mod").collect()
    assert {(r.language, r.module) for r in got} == {("gosu", "mod"), ("gosu_template", "mod")}
    assert len({r.id for r in got}) == len(got) == 11 + 7


@pytest.mark.parametrize("extract", [blocks.extract_blocks, regions.extract_regions, blocks.block_issues])
def test_extraction_is_narrow_and_stays_in_the_jvm(spark, plan_of, extract):
    plan = plan_of(extract(spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text")))
    assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_default_units_are_known():
    assert set(DEFAULT_SOURCE_UNITS) <= {r[0] for r in SOURCE_UNITS}
