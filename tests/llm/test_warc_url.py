from __future__ import annotations

import hashlib

from helpers import DATA, assert_same

from kinloom.llm import url_filters, warc
from kinloom.llm.common import fresh_path
from kinloom.llm.queries import ORACLES, QUERIES, URL_RULES

NESTED = "a WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n é"


def test_oracles(spark, duck):
    for name in ("op1_warc", "op10_url_filters"):
        assert_same(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, ORACLES[name])


def test_warc_round_trip(spark):
    rows = [(1, "u", "x" * 200, 0), (2, "u", "x" * 200, 0), (3, None, None, 0), (4, "u\r\nv", NESTED * 3, 0), (5, "u", "WARC/1.1\r\n", 0), (6, "v", "", 0), (None, "z", "ü" * 120, 0), (7, "z", "ü" * 120, 0), (8, "s", "x" * 99, 0), (9, "s", "x" * 99, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")  # a column with a clashing name
    for width in (0, warc.BROADCAST_GROUPS):
        path = fresh_path(spark, "warc")
        warc.write_warc(df.coalesce(2), path, broadcast_groups=width)
        got = {r.page_id: r for r in warc.record_digests(warc.read_warc(spark, path, payloads=False)).collect()}
        for i, _, html, _ in rows:
            body = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, None: 7}
    blocks = {r["head"].split("<urn:page:")[1].split(">")[0]: bytes(r.block) for r in warc.read_warc(spark, path).collect()}
    assert blocks["4"] == (NESTED * 3).encode() and blocks["2"] == b"" and len(blocks) == len(rows)


def test_warc_small_ranges(spark):
    """Byte ranges that cut records anywhere give the same records."""
    df = spark.createDataFrame([(i, "u", f"{i} {NESTED}" * (i % 7)) for i in range(60)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write_warc(df.coalesce(1), path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        got = {int(r["head"].split("<urn:page:")[1].split(">")[0]): bytes(r.block).decode() for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got.keys() == set(range(60))
    assert all(v in ("", f"{i} {NESTED}" * (i % 7)) for i, v in got.items()) and got[13] == f"13 {NESTED}" * 6


def test_warc_cut_off(spark, tmp_path):
    """A last record that the file's end cuts off has no row; those before it have theirs."""
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(i, "u", f"{i} " * 100) for i in range(3)], "page_id long, url string, html string").coalesce(1), path)
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    for lost, kept in ((0, 3), (30, 2), (len(whole) - 20, 0)):
        (tmp_path / str(lost)).mkdir()
        (tmp_path / str(lost) / "a.warc").write_bytes(whole[: len(whole) - lost])
        assert warc.read_warc(spark, f"file://{tmp_path}/{lost}").count() == kept


def test_warc_empty(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.record_digests(warc.read_warc(spark, path, payloads=False)).count() == 0


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else "allow")


def test_url_edges(spark, monkeypatch):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/1?x#y", "x://org", "x://org/", "x://example.org/en/12", "x://notexample.org/en/1", "x://a.com/fr/", "x://com/de/?q", "x://É.COM/fr/#", "://", "x://a.b.c.d.example.org/es/a://b", "x://.org/", "x://h?com/fr/"]
    df = spark.createDataFrame([(i // 2, u, "x") for i, u in enumerate(urls + urls[:4])] + [(None, urls[3], "y")], "page_id long, url string, host string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(df, url_filters.rule_table(spark, URL_RULES)).collect())
    want = sorted((str(i), *brute(u, URL_RULES)) for i, u, _ in df.collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(url_filters, "PREFIX_HEX", 0)  # every prefix meets every rule: the full digests decide
    again = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(df, url_filters.rule_table(spark, URL_RULES)).collect())
    assert sorted(again, key=repr) == sorted(want, key=repr)
    assert url_filters.url_verdicts(df, url_filters.rule_table(spark, [])).where("verdict <> 'allow'").count() == 0
    assert url_filters.url_verdicts(df.limit(0), url_filters.rule_table(spark, URL_RULES)).count() == 0
