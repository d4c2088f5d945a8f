import hashlib

from plyforge.llm import common, queries, warc


def test_query_against_brute_force(spark):
    big, other = "x" * 1000, "é" * 600
    rows = [(1, "http://a/b?c", big), (2, "http://a/d", big), (9, None, big), (3, "http://e/\r\nWARC-Type: x", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (8, "u", other), (None, "u", big), (10, "u", "\r\n\r\n" * 900), (11, "", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    out = warc.captures(pages, common.scratch(spark, "warc"))
    got = sorted(tuple(r) for r in queries.warc_rows(out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1, ["page_id", "refers_to"]).collect())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = max(same) if len(raw) >= 1000 and page is not None else page
        want.append((-1 if page is None else page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == page else "revisit", -1 if first == page else first))
    assert got == sorted(want)
    shown = out.collect()
    ids = {r.capture_id: r.response.page_id for r in shown}
    revisits = [r for r in shown if r.record_type == "revisit"]
    assert all(ids[r.response.refers_to] == 9 for r in revisits if r.refers_to_page == 9)  # a record's own id
    assert all(r.response.refers_to not in ids for r in revisits if r.refers_to_page == 8)  # two rows have this page and payload
    joined = warc.captures(pages, common.scratch(spark, "warc"), most_broadcast=0)
    assert got == sorted(tuple(r) for r in queries.warc_rows(joined).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").fillna(-1, ["page_id", "refers_to"]).collect())
    assert all(r.n_requests == r.n_metadata == 1 and r.request.uri == r.response.uri and r.metadata is not None for r in shown)


def test_assembly_edges(spark):
    def row(at, kind, own, to):
        return ("f", at, kind, own, to, None, None, "u", 1, None, 1, "d")

    schema = warc.SCHEMA.replace(", payload binary", "")
    rows = [row(0, "response", "r1", None), row(1, "request", "q1", "r1"), row(2, "request", "q0", "r1"), row(3, "metadata", "m1", "q1"), row(4, "response", "r2", None), row(5, "request", "lost", "nowhere"), row(6, "metadata", "none", None)]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].request.id, got["r1"].n_requests, got["r1"].metadata.id) == ("q1", 2, "m1")
    assert (got["r2"].request, got["r2"].n_metadata) == (None, 0)
    assert warc.assemble(spark.createDataFrame([], schema)).count() == 0


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(1, "u", "täxt"), (2, "u", None)], "page_id long, url string, html string")
    files = warc.write(pages, common.scratch(spark, "warc"))
    got = {r.page_id: bytes(r.payload) for r in warc.read(spark, files, with_payload=True).filter("type = 'response'").collect()}
    assert got == {1: "täxt".encode(), 2: b""}
    assert warc.write(pages.limit(0), common.scratch(spark, "warc")) == []


def test_a_payload_of_half_the_pages_beyond_the_broadcast(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", "case when id % 2 = 0 then repeat('a', 1200) when id % 10 = 1 then repeat('b', 1100 + cast(id % 50 as int)) else concat(repeat('c', 1000), id) end as html").repartition(5)
    want = sorted(tuple(r) for r in queries.warc_rows(warc.captures(pages, common.scratch(spark, "warc"))).fillna(-1).collect())
    got = sorted(tuple(r) for r in queries.warc_rows(warc.captures(pages, common.scratch(spark, "warc"), most_broadcast=0)).fillna(-1).collect())
    assert got == want and len(got) == 3000 and sum(r[3] == "revisit" for r in got) > 1700
