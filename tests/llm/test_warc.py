import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from lexhaven.llm import warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.binary(max_size=60)), max_size=5), st.sampled_from([1, 2]), st.booleans())
def test_arc_round_trip(records, version, packed):
    parts = [warc.arc_file_header("x.arc", "20200101000000", version)]
    parts += [warc.arc_record({"URL": url, "Archive-date": "20200102030405"}, body, version) for url, body in records]
    data = b"".join(warc.member(p) for p in parts) + b"\0" if packed else b"".join(parts)
    got = list(warc.read_arc(data))
    assert [body for _, body in got] == [body for _, body in records]
    assert all(f["Archive-date"] == "20200102030405" for f, _ in got)


def test_header_lines_of_both_versions():
    one = (b"filedesc://f 0.0.0.0 19960923142103 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
           b"some more bytes\nhttp://a/with space 1.2.3.4 19960923142104 text/html 5\nab\ncd\n\nhttp://b 1.2.3.4 1996 text/html 0\n\n")
    one = one.replace(b" 76\n", f" {one.index(b'http://a') - one.index(b'1 0 Org')}\n".encode())
    got = list(warc.read_arc(one))
    assert [(f["URL"], b) for f, b in got] == [("http://a/with space", b"ab\ncd"), ("http://b", b"")]
    assert warc.iso_date("1996") == "1996-01-01T00:00:00Z" and warc.iso_date("19960923142104") == "1996-09-23T14:21:04Z"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=6))
def test_warc_round_trip(blocks):
    data = b"".join(warc.member(warc.warc_record({"WARC-Type": "resource", "Absent": None}, b)) for b in blocks)
    assert [b for _, b in warc.read_warc(data)] == blocks


def test_identifiers_are_made_from_what_they_identify():
    made = [warc.record_id("u", "d", b"h", b"x"), warc.record_id("u", "d", b"h", b"x"), warc.record_id("u", "d", b"h", b"y")]
    assert made[0] == made[1] != made[2] and uuid.UUID(made[0][10:-1])


def brute(rows):
    body = {i: (h or "").encode() for i, _, h in rows}
    top = {}
    for i, b in body.items():
        if len(b) >= 1000:
            top[b] = max(i, top.get(b, i))
    return {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if top.get(b, i) != i else "response", top[b] if top.get(b, i) != i else None)
            for i, b in body.items()}


def archived(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(df).collect()}


def test_pages(given, spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = [(r.page_id, r.url, r.html) for r in given("pages").collect()]
    rows += [(1000 + i, u, h) for i, u, h in rows[:12]] + [(2000, rows[0][1], rows[0][2])]
    rows += [(3000, None, None), (3001, "with space", ""), (3002, "u", "WARC/1.0\r\n\r\nshort"), (3003, "u", "WARC/1.0\r\n\r\nshort"), (3004, "u", "ä\r\n\r\n" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    assert archived(df) == brute(rows)
    assert warc.archived(df.limit(0)).count() == 0


def test_repeated_and_unknown_keys(spark):
    long, other = "x" * 2000, "y" * 2000
    rows = [(9, "u", long), (9, "u", long), (3, "u", long), (None, "u", long), (9, "u", other), (None, None, other), (None, "v", "short"), (5, "u", None), (5, "u", None)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    bytes_ = lambda h: (len(h or ""), hashlib.sha1((h or "").encode()).hexdigest())
    want = [
        (9, *bytes_(long), "response", None), (9, *bytes_(long), "revisit", 9), (3, *bytes_(long), "revisit", 9), (None, *bytes_(long), "revisit", 9),
        (9, *bytes_(other), "response", None), (None, *bytes_(other), "revisit", 9), (None, *bytes_("short"), "response", None),
        (5, *bytes_(None), "response", None), (5, *bytes_(None), "response", None),
    ]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
