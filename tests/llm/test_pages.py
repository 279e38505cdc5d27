"""Operators on pages."""

import hashlib
from collections import Counter

import pytest
import zstandard
from helpers import frame

from cytomill.llm import queries, urls, warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def page(*aliases):
    return "<html><head>" + "".join(aliases) + "</head></html>"


def canonical(href):
    return f'<LINK href="{href}" rel="canonical">'


def test_url_rules_and_aliases(spark):
    hub = canonical("https://hub.example.com/en/1")
    rows = [
        (1, "http://A.Example.COM/en/7x?q=1", None), (2, "https://example.com/en/8", ""), (3, "http://notexample.net/de/8", None), (4, "http://m.example.net/de/80#x", "x"),
        (5, "no scheme", "x"), (6, None, "x"), (7, "http://x.fr/a", page(canonical("//hub.example.com/en/1"))), (8, "http://y.fr", page("<meta http-equiv='Refresh' content='0; URL=http://x.fr/a'>")),
        (9, "http://z.fr/b/c", page(canonical("../weird"))), (10, "http://free.fr/p", page(canonical("https://example.com/en/7"), hub)), (11, "http://q.de/net?a", page(canonical("mailto:x@y.z"))),
        (12, "http://w.fr/1", page(canonical("/2"))), (13, "http://w.fr/2", page(canonical("http://example.org/es/4"))), (2, "https://example.com/en/8", ""), (14, "http://com/en/", None), (15, "http:///p", None),
        (16, "http://abc.com", hub), (17, "http://abc.com?x", None),
    ]
    got = urls.judge_urls(frame(spark, rows, SCHEMA), queries.URL_RULES, redirects=spark.createDataFrame([("http://r.fr/", "http://w.fr/1"), (None, "http://x.fr")], "src string, dst string"))
    verdict = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(rows)
    assert verdict[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert verdict[2] == ("example.com", "/en/8", "com/en/", "block")
    assert verdict[3] == ("notexample.net", "/de/8", "net/de/", "allow")
    assert verdict[4] == ("m.example.net", "/de/80", "example.net/de/8", "block")
    assert verdict[5] == verdict[6] == ("", "", None, "allow")
    assert verdict[14][2:] == ("com/en/", "block") and verdict[15] == ("", "/p", None, "allow")
    # 10 ties the blocked hub to an allowed url: the explicit allow decides the whole group of urls without a rule
    assert {verdict[i][3] for i in (7, 8, 10, 16)} == {"allow"}
    assert {verdict[i][3] for i in (12, 13)} == {"block"} and verdict[17] == ("abc.com", "", None, "allow")
    without = {r.page_id: r.verdict for r in urls.judge_urls(frame(spark, [r for r in rows if r[0] != 10], SCHEMA), queries.URL_RULES).collect()}
    assert {without[i] for i in (7, 8, 16)} == {"block"} and without[1] == "allow"
    assert urls.judge_urls(frame(spark, [], SCHEMA), queries.URL_RULES).count() == 0


def test_links_are_read_as_a_browser_reads_them(spark):
    pad = "".join(f" a{i}='>' b{i}" for i in range(3000))
    rows = [
        ("http://a.fr/1", '<link rel="canonical" data-href="http://no.fr/" href="http://b.fr/">', "http://b.fr/"),
        ("http://a.fr/2", '<link data-rel="canonical" rel="icon" href="http://no.fr/">', None),
        ("http://a.fr/3", '<!-- <link rel="canonical" href="http://no.fr/"> --><link rel=canonical href=/x>', "http://a.fr/x"),
        ("http://a.fr/4", '<script>s = \'<link rel="canonical" href="http://no.fr/">\'</script>', None),
        ("http://a.fr/d/5", '<base href="//c.fr/q/r"><link href="s" rel="canonical">', "http://c.fr/q/s"),
        ("http://a.fr/6", """<link title="x href='http://no.fr/' >" rel='alternate canonical' href = 'http://b.fr/?a=1&amp;b=2'>""", "http://b.fr/?a=1&b=2"),
        ("http://a.fr/7", f"<link{pad} rel=canonical href=http://b.fr/7>", "http://b.fr/7"),
        ("http://a.fr/8", '<link rel="canonical" href="http://b.fr/8" href="http://no.fr/">', "http://b.fr/8"),
        ("http://a.fr/9", '<linked rel="canonical" href="http://no.fr/">', None),
        ("http://a.fr/10", '<meta name="url=http://no.fr" http-equiv="refresh" content="3;url=/y">', "http://a.fr/y"),
        ("http://a.fr/11", '<!-- <link rel="canonical" href="http://no.fr/">', None),
        (None, '<link rel="canonical" href="http://no.fr/">', None), ("http://a.fr/12", None, None),
    ]
    got = {r.src: r.dst for r in urls.alias_edges(spark.createDataFrame([r[:2] for r in rows], "url string, html string")).collect()}
    assert got == {u: t for u, _, t in rows if t}


def test_many_pages_point_to_one(spark):
    rows = [(i, f"http://s{i}.fr/", page(canonical("http://hub.org/es/" if i % 2 else f"http://s{i - 1}.fr/"))) for i in range(1, 301)]
    got = urls.judge_urls(spark.createDataFrame(rows, SCHEMA), queries.URL_RULES).groupBy("verdict").count().collect()
    assert [(r.verdict, r["count"]) for r in got] == [("block", 300)]


def test_archives_round_trip(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/\r\nEvil: 1", big), (2, None, big), (9, "http://b", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (None, "u", big), (8, "u", "long " * 400_000)]
    pages = frame(spark, rows, SCHEMA)
    archives = warc.write_archives(pages, archive_bytes=3000)
    got = warc.read_archives(archives)
    pay = {(r.page_id, r.refers_to, r.record_type, r.payload_bytes, r.payload_digest): r.payload for r in got.select("*", warc.page_key("record_id").alias("page_id"), warc.page_key("refers_to").alias("ref")).drop("refers_to").withColumnRenamed("ref", "refers_to").collect()}
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        newest = max(r[0] for r in rows if r[0] is not None and (r[2] or "") == (html or ""))
        revisit = len(data) >= 1000 and i != newest
        want[(i, newest if revisit else None, "revisit" if revisit else "response", len(data), hashlib.sha1(data).hexdigest())] += 1
    assert set(pay) == set(want) and got.count() == len(rows)
    assert all(p is None if k[2] == "revisit" else hashlib.sha1(p).hexdigest() == k[4] for k, p in pay.items())
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_dictionary_frame_and_files(spark, tmp_path):
    records = [warc.record_bytes(f"urn:page:{i}", f"http://a/{i}", f"<html>{'common words here ' * 20}{i}</html>".encode(), None, "1970-01-01T00:00:00Z") for i in range(500)]
    data = warc.pack_archive(records, 2048)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_DICTIONARY
    assert list(warc.archive_frames(data)) == records == list(warc.archive_frames(data, step=7))
    raw = zstandard.train_dictionary(2048, records).as_bytes()
    plain = (0x184D2A5D).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + b"".join(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(r) for r in records)
    assert list(warc.archive_frames(plain)) == records
    (tmp_path / "x.warc.zst").write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.zst"))
    assert warc.read_archives(files).count() == 500
    for broken in (data[:-3], data[:20], data[:-40] + b"\0" * 40):
        with pytest.raises(warc.ArchiveError):
            list(warc.archive_frames(broken))
    good = records[0]
    for wrong in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"common", b"comm0n", 1), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(wrong)
    with pytest.raises(Exception, match="cut short"):
        warc.read_archives(spark.createDataFrame([(bytearray(data[:-3]),)], "content binary")).count()
    assert warc.read_archives(spark.createDataFrame([(None,)], "content binary")).select(F.count("*")).first()[0] == 0
