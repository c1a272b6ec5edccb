"""Operator 7: web-archive derivatives.

Each response gets two records that refer to it: metadata (title, language,
charset, outlinks, the source's HTTP headers and digest) and a plain-text
conversion. Identifiers are derived from content, so a rerun names records alike,
and every derived record keeps its source's identifier, target and date.
Everything is an expression over one row: no shuffle, no Python. Character references
are decoded once each, by number or by name; attributes may be quoted either way or bare.
The query returns each record as archives hold it, its block included.

Defined results: a null page is an empty one (empty text, no title, no links); a
null url is an empty target; null ids stay null; repeated rows give repeated
records; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Pages of this table carry no date of their own.
DATE = "1970-01-01T00:00:00Z"
_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
#: From markup to text, in order: the meaning.
MARKUP = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script[^>]*>.*?</script[^>]*>", ""),
    (r"(?is)<style[^>]*>.*?</style[^>]*>", ""),
    (rf"(?i)</?(?:{_BLOCK})(?:[ \t\r\n/][^>]*)?>", "\n"),
    (r"<[/!?A-Za-z][^>]*>", ""),
]
def _to_the_end(opening: str, more: str) -> tuple[str, str]:
    """Replaces by nothing, linear where markup is broken.

    Where an opening finds no end, no later one does: what would end a later one would
    end this one too. So it takes everything up to the end of the text at once and puts
    it back, instead of a search to the end from every opening.
    """
    return f"(?is){opening}(?:{more}|(?<=({opening}))(.*))", "$1$2"


#: How the first three are done. A comment's opening has no letters: told apart by case it is found by skipping.
_LINEAR = [(p.replace("(?is)", "(?s)"), by) for p, by in [_to_the_end("<!--", ".*?-->")]] + [ _to_the_end("<script", "[^>]*>.*?</script[^>]*>"), _to_the_end("<style", "[^>]*>.*?</style[^>]*>")]
#: A character reference: decimal, hexadecimal or by name.
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,15});"
#: Names of the standard library's table, and what text makes of them.
NAMED = {name: chr(n) for name, n in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
#: A single blank is left as it stands.
BLANKS = [(r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " "), (r" \n[ \n]*|\n[ \n]+", "\n")]
#: The same matches from one first class, so that most characters cost a single look.
_BLANKS = [(r"[ \t\r\f](?:[ \t\r\f]+|(?<=[\t\r\f]))", " "), (r"[ \n](?:\n[ \n]*|(?<=\n) [ \n]*)", "\n")]
#: Looked up in order: the names that pages use most come first.
_OFTEN = ("amp", "nbsp", "lt", "gt", "quot", "apos", "copy", "middot")
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: A title up to its end, or up to the text's end if it has none.
TITLE = r"(?is)<title(?:[^>]*>(.*?)</title|.*)"
#: Tags and what comes before and in an attribute's value.
LANGUAGE, CHARSET, OUTLINK = ("<html", rf"[^>]*\slang\s*=\s*{_VALUE}"), ("<meta", r"""[^>]* charset=["']?([A-Za-z0-9_-]+)"""), (r"<a\s", rf"[^>]*?\bhref\s*=\s*{_VALUE}")
_QUOTES = """^["']|["']$"""
_LINE = "\r\n"


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def decoded(x: Column) -> Column:
    """Character references replaced, each once; unknown names and impossible numbers stay."""
    names = F.from_json(F.lit(json.dumps({k: NAMED[k] for k in _OFTEN} | NAMED)), "map<string,string>")

    def character(e: Column) -> Column:
        digits = F.regexp_replace(e, "[&#xX;]", "")
        n = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        n = F.when(n == 160, F.lit(32)).otherwise(n)
        known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        number = F.when(known, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(F.substring(e, 2, 1) == "#", number).otherwise(names[F.btrim(e, F.lit("&;"))]), e)

    def replaced(t: Column) -> Column:
        both = F.zip_with(F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), lambda gap, e: F.concat(gap, F.when(e.isNull(), F.lit("")).otherwise(character(e))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(both, "")).otherwise(t)

    return _once(x, replaced)


def _ended(html: Column, pattern: str, by: str) -> Column:
    """A tag's replacement. No tag ends after the last >; up to there every opening finds its end, so that none is searched for in vain."""
    split = lambda t: _once(F.substring_index(t, ">", -1), lambda after: F.concat(F.regexp_replace(F.left(t, F.length(t) - F.length(after)), pattern, by), after))
    return _once(html, split)


def text_of_markup(html: Column) -> Column:
    for pattern, by in _LINEAR:
        html = F.regexp_replace(html, pattern, by)
    for pattern, by in MARKUP[len(_LINEAR) :]:
        html = _ended(html, pattern, by)
    html = decoded(html)
    for pattern, by in _BLANKS:
        html = F.regexp_replace(html, pattern, by)
    return F.btrim(html, F.lit(" \n"))


def _values(html: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute within tags. A tag without one is passed over whole: a later opening before its end would find none either."""
    return F.filter(F.regexp_extract_all(html, F.lit(f"(?i){tag}(?:{attribute}|[^>]*)"), F.lit(1)), lambda x: x != "")


def _first_value(html: Column, tag: str, attribute: str) -> Column:
    """Of most pages the first tag has it; others are read to their end."""
    first = F.regexp_extract(html, f"(?i){tag}(?:{attribute}|[^>]*)", 1)
    return _once(first, lambda v: F.when(v != "", v).otherwise(F.coalesce(F.get(_values(html, tag, attribute), F.lit(0)), F.lit(""))))


def _id(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response records: page_id, record_id, target_uri, date, http_headers, payload, payload_digest."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("target_uri"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(_LINE))
    rows = rows.select("*", F.lit(date).alias("date"), headers.alias("http_headers"), _digest(F.col("payload")).alias("payload_digest"))
    return rows.withColumn("record_id", _id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("payload_digest")))


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: its metadata and its conversion."""
    payload = F.col("payload")
    text = text_of_markup(payload)
    field = lambda name, value: _once(value, lambda v: F.when(v != "", F.concat(F.lit(f"{name}: "), v, F.lit(_LINE))).otherwise(""))
    one_line = lambda c: F.regexp_replace(c, "[\r\n]+", " ")
    value = lambda c: one_line(decoded(F.regexp_replace(c, _QUOTES, "")))
    links = F.array_join(F.transform(_values(payload, *OUTLINK), lambda x: F.concat(F.lit("outlink: "), value(x), F.lit(" L a/@href" + _LINE))), "")
    meta = F.concat(
        field("title", one_line(text_of_markup(F.regexp_extract(payload, TITLE, 1)))), field("language", value(_first_value(payload, *LANGUAGE))), field("charset", _first_value(payload, *CHARSET)),
        F.concat(F.lit("source-digest: "), F.col("payload_digest"), F.lit(_LINE)),
        F.regexp_replace("http_headers", "([^\r\n]+)\r\n", "source-header: $1\r\n"), links,
    )
    made = source.select("*", meta.alias("meta"), text.alias("text"))
    record = lambda kind, content, block: F.struct(F.lit(kind).alias("warc_type"), _id(kind, F.col("record_id")).alias("record_id"), F.lit(content).alias("content_type"), F.col(block).alias("block"))
    both = F.explode(F.array(record("metadata", "application/warc-fields", "meta"), record("conversion", "text/plain; charset=utf-8", "text")))
    rows = made.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", both.alias("r"))
    return rows.select("page_id", "r.warc_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type", F.octet_length("r.block").cast("bigint").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"), F.col("payload_digest").alias("source_digest"), F.col("r.block").alias("block"))


def serialized(records: DataFrame) -> DataFrame:
    """Adds ``record``: the whole record as archives hold it."""
    h = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c), F.lit(_LINE))
    head = F.concat(
        F.lit(f"WARC/1.1{_LINE}"), h("WARC-Type", "warc_type"), h("WARC-Record-ID", "record_id"), h("WARC-Refers-To", "refers_to"), h("WARC-Refers-To-Target-URI", "target_uri"), h("WARC-Refers-To-Date", "date"), h("WARC-Target-URI", "target_uri"),
        h("WARC-Date", "date"), h("WARC-Block-Digest", "block_digest"), h("Content-Type", "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit(_LINE)),
    )
    return records.withColumn("record", F.concat(head, F.lit(_LINE), F.col("block"), F.lit(_LINE * 2)))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialized(derive(responses(table(spark, sf_dir, "pages")))).drop("block")


def _sql() -> str:
    said = lambda x: "'" + x.replace("'", "''") + "'" if "\n" not in x else "chr(10)"

    def decoded(x: str) -> str:
        digits = "regexp_replace(z[2], '[&#xX;]', '', 'g')"
        n = f"CASE WHEN lower(z[2][3]) = 'x' THEN CAST('0x' || {digits} AS BIGINT) ELSE CAST({digits} AS BIGINT) END"
        number = f"list_transform([{n}], lambda n: CASE WHEN n = 160 THEN ' ' WHEN n BETWEEN 1 AND 1114111 AND n NOT BETWEEN 55296 AND 57343 THEN chr(CAST(n AS INTEGER)) END)[1]"
        character = f"CASE WHEN z[2] IS NULL THEN '' WHEN z[2][2] = '#' THEN coalesce({number}, z[2]) ELSE coalesce(names[trim(z[2], '&;')], z[2]) END"
        return f"list_transform([{x}], lambda t: array_to_string(list_transform(list_zip(string_split_regex(t, {said(REFERENCE)}), regexp_extract_all(t, {said(REFERENCE)})), lambda z: z[1] || {character}), ''))[1]"

    def text(x: str) -> str:
        for pattern, by in MARKUP:
            x = f"regexp_replace({x}, {said(pattern)}, {said(by)}, 'g')"
        x = decoded(x)
        for pattern, by in BLANKS:
            x = f"regexp_replace({x}, {said(pattern)}, {said(by)}, 'g')"
        return f"trim({x}, ' ' || chr(10))"

    line = "chr(13) || chr(10)"
    one = lambda x: f"regexp_replace({x}, '[\\r\\n]+', ' ', 'g')"
    field = lambda name, x: f"CASE WHEN {x} <> '' THEN '{name}: ' || {x} || {line} ELSE '' END"
    uid = lambda h: "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"
    extract = lambda p: f"regexp_extract(p, {said(p)}, 1)"
    value = lambda x: one(decoded(f"regexp_replace({x}, {said(_QUOTES)}, '', 'g')"))
    links = f"coalesce(array_to_string(list_transform(regexp_extract_all(p, {said("(?i)" + "".join(OUTLINK))}, 1), lambda x: 'outlink: ' || {value('x')} || ' L a/@href' || {line}), ''), '')"
    headers = f"'source-header: HTTP/1.1 200 OK' || {line} || 'source-header: Content-Type: text/html; charset=utf-8' || {line} || 'source-header: Content-Length: ' || strlen(p) || {line}"
    meta = " || ".join([field("title", one(text(extract(r"(?is)<title[^>]*>(.*?)</title")))), field("language", value(extract("(?i)" + "".join(LANGUAGE)))), field("charset", extract("(?i)" + "".join(CHARSET))), f"'source-digest: ' || d || {line}", headers, links])
    names = "MAP {" + ", ".join(f"'{k}': chr({ord(v)})" for k, v in NAMED.items()) + "}"
    head = lambda name, x: f"'{name}: ' || {x} || {line}"
    record = " || ".join([
        f"'WARC/1.1' || {line}", head("WARC-Type", "warc_type"), head("WARC-Record-ID", "record_id"), head("WARC-Refers-To", "refers_to"), head("WARC-Refers-To-Target-URI", "target_uri"), head("WARC-Refers-To-Date", "date"), head("WARC-Target-URI", "target_uri"),
        head("WARC-Date", "date"), head("WARC-Block-Digest", "block_digest"), head("Content-Type", "content_type"), head("Content-Length", "content_length"), f"{line} || block || {line} || {line}",
    ])
    return f"""WITH a AS (SELECT {names} AS names, page_id, coalesce(url, '') AS u, coalesce(html, '') AS p, 'sha256:' || sha256(coalesce(html, '')) AS d FROM pages),
b AS (SELECT *, sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || u || '|' || d) AS h FROM a), c AS (SELECT *, {uid("h")} AS rid FROM b),
r AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {meta} AS block FROM c UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text("p")} FROM c),
i AS (SELECT *, sha256(warc_type || '|' || rid) AS k FROM r),
o AS (SELECT page_id, warc_type, {uid("k")} AS record_id, rid AS refers_to, u AS target_uri, '{DATE}' AS date, content_type, strlen(block) AS content_length, 'sha256:' || sha256(block) AS block_digest, d AS source_digest, block FROM i)
SELECT * EXCLUDE (block), {record} AS record FROM o"""


SQL = _sql()
