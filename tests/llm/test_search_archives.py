"""Operators 7 and 8."""

import base64
import gzip
import hashlib
import itertools

import common
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import archives, topk_search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int, q string")


ROWS = [(0, [0.5, -0.25, 1.0]), (50, [0.5, -0.25, 1.0]), (1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3]), (3, [0.1, 0.2, 0.3]),
        (4, None), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [None, 0.0, 1.0]), (8, [0.0, 0.0, 0.0]),
        (100, []), (9, [2.0]), (10, [-1.0, -1.0, -1.0, 5.0]), (None, [1.0, 1.0, 1.0]), (11, [0.001, -0.001, 0.0])]


def brute(rows, every, k):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [None, 3, 1])
def test_top_k_edge_cases(spark, block):
    df = vectors(spark, [(i, v, 0, 1, "x") for i, v in ROWS])
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0, k=4, block=block)
    assert sorted(map(tuple, got.collect())) == brute(ROWS, 50, 4)


def test_top_k_random_with_ties_and_few_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 8) / 4).tolist()) for i in range(120)]
    df = vectors(spark, [(i, v, 0, 1, "x") for i, v in rows]).repartition(5)
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 7 == 0, block=16).collect())) == brute(rows, 7, 5)
    few = vectors(spark, [(0, [1.0], 0, 1, "x"), (3, [2.0], 0, 1, "x")])
    assert [tuple(r) for r in topk_search.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 3, 256 * 512)]
    assert topk_search.top_k(vectors(spark, []), F.col("vec_id") == 0).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows],
                                 "page_id long, url string, html string, digest string, place string")


PAGES = [(1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/y z", "<p>same</p>"), (3, None, None),
         (4, "", ""), (5, "http://c.example/é\n", "two\r\n\r\nparts\n\n"), (6, "http://d.example", "WARC/1.0\r\nWARC-Type: x\r\n\r\n"),
         (7, "http://e.example", "1 0 x\nfiledesc://y\n"), (8, "http://f.example", "é" * 9000), (9, "http://g.example", "<p>same</p>"),
         (None, "http://h.example", "<p>same</p>"), (None, "http://i.example", "lone"), (10, "u", "twin"), (10, "u", "twin")]


def expected(rows, min_bytes=0):
    out = []
    for n, (i, _, h) in enumerate(rows):
        data = (h or "").encode()
        same = [(j is not None, j or 0, m) for m, (j, _, g) in enumerate(rows) if (g or "") == (h or "")]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), max(same)[1] if max(same)[0] else None,
                    len(same) > 1 and len(data) >= min_bytes))
    return out


@pytest.mark.parametrize("min_bytes, size", [(0, 8 << 20), (6, 200)])
def test_round_trip(spark, monkeypatch, min_bytes, size):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", size)
    got = archives.archive_round_trip(pages(spark, PAGES).repartition(2), min_bytes).collect()
    want = expected(PAGES, min_bytes)
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == \
        sorted((w[0] or -1, w[1], w[2]) for w in want)
    for digest, rows in itertools.groupby(sorted(got, key=lambda r: r["payload_digest"]), key=lambda r: r["payload_digest"]):
        rows = list(rows)
        top, many = next((w[3], w[4]) for w in want if w[2] == digest)
        if not many:
            assert all(r["record_type"] == "response" and r["refers_to"] is None for r in rows)
            continue
        kept = [r for r in rows if r["record_type"] == "response"]
        assert len(kept) == 1 and kept[0]["page_id"] == top and kept[0]["refers_to"] is None
        assert all(r["refers_to"] == top for r in rows if r["record_type"] == "revisit")


def test_round_trip_equals_sql_and_handles_no_rows(spark):
    rows = [r for r in PAGES if r[0] is not None][:-1]
    cols, want = common.run_oracle(archives.OP7_SQL, {"pages": ("page_id bigint, url varchar, html varchar", rows)})
    got = archives.archive_round_trip(pages(spark, rows)).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert archives.archive_round_trip(pages(spark, [])).collect() == []


def test_both_arc_versions_are_written_and_malformed_ones_rejected(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 100)
    path = f"file://{tmp_path}/arc"
    archives.write_arc(pages(spark, PAGES).coalesce(1), path)
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "arc").glob("*.gz")]
    versions = {f.split(b"\n", 2)[1][:1] for f in files}
    assert versions == {b"1", b"2"}
    for f in files:
        for _, head, body in archives.read_arc(f):
            assert int(head["Archive-length"]) == len(body)
    good = archives.arc_start(1, "x", "20200101000000") + archives.arc_record(1, "x", 0, 1, "http://a", b"hi", "20200101000000")
    with pytest.raises(ValueError):
        list(archives.read_arc(good[:-5]))
    with pytest.raises(ValueError):
        list(archives.read_arc(good[good.index(b"http://a"):]))


def test_warc_fields_are_synthesised():
    assert archives.warc_date("20061103120501") == "2006-11-03T12:05:01Z" and archives.warc_date("2006") == "2006-01-01T00:00:00Z"
    a = archives.record_id("f", 10, "http://x", "2020")
    assert a == archives.record_id("f", 10, "http://x", "2020") != archives.record_id("f", 11, "http://x", "2020")
    assert a.startswith("urn:uuid:") and len(a) == 45


def test_records_of_other_crawlers(spark, tmp_path):
    """Name lookups, bodies without HTTP, any bytes, spaces in URLs, bare line feeds, headers that never end."""
    def record(url, kind, body):
        return url + b" 1.2.3.4 20061103120501 " + kind + b" %d\n" % len(body) + body + b"\n"

    latin = b"HTTP/1.0 200 OK\nX-Name: caf\xe9\n\n\xff\xfe\x00\r\n\r\nbytes"
    bodies = [(b"dns:a.example", b"text/dns", b"20061103120501\na.example. 60 IN A 1.2.3.4\n"),
              (b"http://a.example/b c", b"text/html", latin), (b"http://a.example/\xe9", b"text/html", latin + b"!"),
              (b"ftp://a.example/f", b"application/octet-stream", bytes(range(256))),
              (b"http://a.example/twin", b"text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: x\r\n\r\n" + latin.split(b"\n\n", 1)[1]),
              (b"http://a.example/cut", b"text/html", b"HTTP/1.1 204 No Content\r\nContent-Length: 0")]
    arc, warc = tmp_path / "arc", f"file://{tmp_path}/warc"
    arc.mkdir()
    (arc / "one.arc.gz").write_bytes(gzip.compress(archives.arc_start(1, "one", "20061103120501")
                                                   + b"".join(record(*b) for b in bodies)))
    archives.convert_to_warc(spark, f"file://{arc}", warc)
    payloads = [b[2] if not b[2].startswith(b"HTTP/") else b[2].split(b"\n\n", 1)[-1] for b in bodies]
    payloads[4], payloads[5] = payloads[1], b""
    got = archives.resolved(spark, warc).collect()
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == \
        sorted((len(p), archives.sha1_base32(p)) for p in payloads)
    assert sorted(r["record_type"] for r in got) == ["resource"] * 2 + ["response"] * 3 + ["revisit"]
    assert all(r["page_id"] is None and r["refers_to"] is None for r in got)
    found = {h["WARC-Target-URI"]: (h, b) for f in (tmp_path / "warc").glob("*.gz")
             for h, b in archives.read_warc(gzip.decompress(f.read_bytes())) if h["WARC-Type"] != "warcinfo"}
    assert set(found) == {"dns:a.example", "http://a.example/b%20c", "http://a.example/%E9", "ftp://a.example/f",
                          "http://a.example/twin", "http://a.example/cut"}
    assert found["dns:a.example"][0]["Content-Type"] == "text/dns" and found["ftp://a.example/f"][1] == bytes(range(256))
    assert found["http://a.example/%E9"][1] == latin + b"!"
