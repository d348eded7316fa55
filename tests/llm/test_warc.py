import base64
import hashlib

from stallwright.llm import warc
from stallwright.llm.common import fresh_path

from ..conftest import SMALL
from ..oracle import assert_same

PAGES = [(1, "http://a.example/x?y=1", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (3, None, None), (4, "http://c.example/a b\n", ""), (5, "http://d.example/é", "Ünï\r\n\r\nx"), (5, "http://d.example/é", "Ünï\r\n\r\nx"), (None, "u", "<p>same</p>"), (6, "http://e.example/", "z" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 7, "c") for r in rows], "page_id long, url string, html string, cap int, digest string")


def test_query_matches_oracle(spark):
    assert_same(warc.op6_warc_transactions(spark, SMALL), warc.SQL["op6_warc_transactions"], SMALL)


def test_awkward_rows(spark):
    got = sorted((tuple(r) for r in warc.archived_pages(pages(spark)).collect()), key=lambda r: r[0] or 0)
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(None, "<p>same</p>", "revisit", 2), (1, "<p>same</p>", "revisit", 2), (2, "<p>same</p>", "response", None), (3, "", "revisit", 4), (4, "", "response", None), (5, "Ünï\r\n\r\nx", "response", None), (5, "Ünï\r\n\r\nx", "response", None), (6, "z" * 300_000, "response", None)]
    assert got == [(i, len(h.encode()), digest(h), kind, to) for i, h, kind, to in want]
    assert warc.archived_pages(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_stored_each(spark):
    got = {r.page_id: r.record_type for r in warc.archived_pages(pages(spark), revisit_bytes=12).collect()}
    assert set(got.values()) == {"response"}


def test_round_trip_and_assembly(spark):
    manifest = warc.write_warc(pages(spark), fresh_path(spark, "w"))
    records = warc.read_warc(manifest)
    rows = warc.assemble(records).collect()
    assert len(rows) == 8 and records.count() == 24
    assert len({r.record_id for r in records.collect()}) == 24
    by = {r.metadata.fields.get("page-id"): r for r in rows}
    assert bytes(by["5"].payload).decode() == "Ünï\r\n\r\nx" and by["1"].payload is None
    assert by["2"].request.uri == "http://b.example/" and by["3"].uri is None
    assert by["1"].refers_to == by["2"].record_id
    assert warc.orphans(records).count() == 0
    lone = records.where("type <> 'response'")
    assert warc.orphans(lone).count() == 2 * 5
    assert all(r.request is not None for r in warc.assemble(lone).collect())


def test_repeated_rows_against_the_sql(spark, monkeypatch):
    import duckdb

    rows = [(1, "a", "<p>x</p>"), (1, "a", "<p>x</p>"), (1, "b", "<p>x</p>"), (2, "c", "<p>x</p>"), (2, "c", "<p>x</p>"), (3, "d", "<p>y</p>"), *[(4, "e", "many")] * 25, *[(5, "e", "many")] * 23]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(map(repr, c.sql(warc.OP6_SQL).select(*names).fetchall()))
    for copies in (1_000, 10):  # all copies in a row's task, and spread
        monkeypatch.setattr(warc, "COPIES", copies)
        got = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*names).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
