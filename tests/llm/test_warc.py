"""Derivatives of responses, by hand and against DuckDB."""

import hashlib
import re
import time
from itertools import product

import duckdb
import pytest

from stridelog.llm import warc

HTML = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><a href="/x">link</a><!-- no --><p>one<br>two <b>bold</b></p><p>&lt;tag&gt; 1 < 2 $5 \\ &copy;</p></body></html>'


def made(spark, rows):
    return warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, block string, record_id string")))


def test_records(spark):
    records = {r.warc_type: r for r in warc.serialized(made(spark, [(1, "http://e/x", HTML, "n", "n")])).collect()}
    meta, text = records["metadata"], records["conversion"]
    assert text.block == "A & B\nlink\none\ntwo bold\n<tag> 1 < 2 $5 \\ ©"
    digest = "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert meta.source_digest == text.source_digest == digest and meta.refers_to == text.refers_to and meta.record_id != text.record_id
    assert meta.block.split("\r\n") == ["title: A & B", "language: en", "charset: utf-8", f"source-digest: {digest}", "source-header: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(HTML)}", "outlink: /x L a/@href", ""]
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest() and text.content_length == len(text.block.encode())
    assert text.record.startswith("WARC/1.1\r\nWARC-Type: conversion\r\n") and text.record.endswith(text.block + "\r\n\r\n") and f"WARC-Refers-To: {text.refers_to}\r\n" in text.record


def test_odd_rows(spark):
    rows = [(1, None, None, "", ""), (2, "u", "", "", ""), (2, "u", "", "", ""), (None, "v", "plain < text", "", ""), (3, "w", "<p>" * 5000 + "x" * 100_000, "", "")]
    out = made(spark, rows).collect()
    assert len(out) == 10 and {r.block for r in out if r.warc_type == "conversion"} == {"", "plain < text", "x" * 100_000}
    assert made(spark, rows).limit(0).count() == 0


def test_oracle(spark, data):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS FROM '{data}/pages.parquet'")
    got, want = warc.op7_warc_derivatives(spark, data), duckdb.sql(warc.SQL)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(*order).collect()) == sorted(want.select(*order).fetchall())


REFERENCES = "&eacute;&uuml;&#8217;&#x27;&#X1F600;&hellip;&nbsp;|&#160;|&amp;lt;|&nosuch;|&#0;|&#xD800;|&#1114112;|& ;|&;"


def test_references_and_quoting(spark):
    html = f"<html lang='d&auml;'><a class=x href='/a?b&amp;c'>1</a><a href=/bare>2</a><a href=\"/d\">3</a><p>{REFERENCES}</p>"
    got = made(spark, [(1, "u", html, "", "")])
    by = {r.warc_type: r.block for r in got.collect()}
    assert by["conversion"].splitlines()[-1] == "éü’'😀… | |&lt;|&nosuch;|&#0;|&#xD800;|&#1114112;|& ;|&;"
    assert "language: dä" in by["metadata"] and [x for x in by["metadata"].split("\r\n") if x.startswith("outlink")] == [f"outlink: {u} L a/@href" for u in ("/a?b&c", "/bare", "/d")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.execute("INSERT INTO pages VALUES (1, 'u', ?)", [html])
    assert sorted(r.record for r in warc.serialized(got).collect()) == sorted(r[0] for r in con.sql(f"SELECT record FROM ({warc.SQL})").fetchall())


BROKEN = ["<script>x", "<!-- x", "<style>y", "<a b ", "<a href=x ", "<p ", "<div/", "<title>t", "<title ", "<html ", "<html lang ", "<meta ", "<meta charset ", "<script", "<", "<!", "&amp", "<a\thref='", '<html lang="', "<!-- --", "</script", "</p x"]
ENDS = ["", ">", "</script>", "-->", "</style>", "</title>", " lang='de'>", "'>", '">end', "\n<p>end"]


def test_broken_markup_means_the_same(spark):
    """Every opening, closed late or never, against DuckDB's reading of the same patterns."""
    pages = [(i, "u", html) for i, html in enumerate([f"before {x * 3}{y} after" for x in BROKEN for y in ENDS] + [f"{x}{y}{z}" for x in BROKEN for y in ENDS[1:5] for z in BROKEN])]
    got = warc.serialized(warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))).select("page_id", "warc_type", "record")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT page_id, warc_type, record FROM ({warc.SQL})").fetchall())


def test_faster_blanks_match_the_same():
    """All texts of up to seven characters: what the faster patterns replace is what the meaning replaces."""
    for (pattern, by), (faster, same) in zip(warc.BLANKS, warc._BLANKS, strict=True):
        assert by == same
        for text in map("".join, (x for n in range(8) for x in product(" \t\na", repeat=n))):
            assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(faster, text)], text


@pytest.mark.parametrize("opening", BROKEN)
def test_a_megabyte_of_broken_markup(spark, opening):
    for end in ("", "</script>"):
        html = opening * (1_000_000 // len(opening)) + end
        began = time.perf_counter()
        assert made(spark, [(1, "u", html, "", "")]).agg({"content_length": "sum"}).first()[0] is not None
        assert time.perf_counter() - began < 10
