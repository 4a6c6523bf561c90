"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

Each response gives one `conversion` record (the page's text) and one `metadata` record (the source's HTTP headers,
status, title, link count and digests). Both name the response in WARC-Refers-To, keep its target URI and date, and
name each other. Ids are UUIDs from a hash of the response id and the record type, so a rerun writes the same ids.
Everything is DataFrame functions over single rows: one scan, no shuffle, no Python.

Null payloads count as empty ones and still give both records; a null URI or date stays null; a null response id gives
records with the id of the empty string. Repeated responses give repeated records, with equal ids. Very long payloads are
worked on whole, as one value of one row. An empty table gives no rows. Columns of the input besides `record_id target_uri warc_date http_headers payload` are carried along, but for
those whose names, in any case, are those of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import exploding_columns

QUERY = "op1_warc_derivatives"

SOURCE = ["record_id", "target_uri", "warc_date", "http_headers", "payload"]
RECORD = ["warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block", "block_digest", "content_length"]
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|blockquote|pre"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: pattern and replacement, in order
TO_TEXT = [
    (r"(?is)<script[^>]*>.*?</script\s*>", " "),
    (r"(?is)<style[^>]*>.*?</style\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (rf"(?i)</?({BLOCK_TAGS})(\s[^>]*|/)?>", "\n"),
    (r"<[^>]*>", ""),
]
TIDY = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def plain_text(html: Column) -> Column:
    for pattern, to in TO_TEXT:
        html = F.regexp_replace(html, pattern, to)
    for name, to in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(to))
    for pattern, to in TIDY:
        html = F.regexp_replace(html, pattern, to)
    return html


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"))
    # counted on a clock without zone, so that the session's zone does not matter
    date = F.expr("date_format(timestampadd(SECOND, cast(pmod(coalesce(page_id, 0), 31536000) as int), timestamp_ntz'2024-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    return pages.select("page_id", uuid_of(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), headers.alias("http_headers"), html.alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records per response, columns RECORD, after the input's other columns."""
    other = exploding_columns(responses, [*SOURCE, *RECORD])
    payload = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    headers = F.coalesce(F.col("http_headers").cast("string"), F.lit(""))
    carried = (F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(0)).alias("other")  # as one value, so no name can clash
    parsed = responses.select(
        carried, F.col("record_id").alias("refers_to"), "target_uri", F.col("warc_date").cast("string").alias("warc_date"), headers.alias("source_headers"), digest(payload).alias("source_digest"),
        plain_text(payload).alias("_text"), plain_text(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title", 1)).alias("_title"),
        F.size(F.regexp_extract_all(payload, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("_links"), F.octet_length(payload).alias("_bytes"),
    )
    conversion_id, metadata_id = (uuid_of(F.lit(t), F.col("refers_to")) for t in ("conversion", "metadata"))
    fields = F.concat(
        F.lit("http-status: "), F.regexp_extract("source_headers", r"^HTTP/\S+ (\d+)", 1),
        F.lit("\r\nhttp-content-type: "), F.regexp_extract("source_headers", r"(?i)\r\ncontent-type: ([^\r\n]*)", 1),
        F.lit("\r\npayload-digest: "), F.col("source_digest"), F.lit("\r\npayload-length: "), F.col("_bytes").cast("string"),
        F.lit("\r\ntitle: "), F.replace(F.col("_title"), F.lit("\n"), F.lit(" ")), F.lit("\r\noutlinks: "), F.col("_links").cast("string"),
        F.lit("\r\nconversion: "), conversion_id, F.lit("\r\n"),
    )

    def record(kind: str, own: Column, sibling: Column, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), own.alias("record_id"), sibling.alias("concurrent_to"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = F.array(record("metadata", metadata_id, conversion_id, "application/warc-fields", fields), record("conversion", conversion_id, metadata_id, "text/plain; charset=utf-8", F.col("_text")))
    out = parsed.select("other", "refers_to", "target_uri", "warc_date", "source_headers", "source_digest", F.explode(both).alias("r"))
    return out.select(
        *[F.col("other")[c].alias(c) for c in other], "r.warc_type", "r.record_id", "refers_to", "r.concurrent_to", "target_uri", "warc_date", "r.content_type", "source_headers", "source_digest",
        "r.block", digest(F.col("r.block")).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """value: each record in WARC/1.1 form without its closing blank lines.

    The source's digest and each line of its HTTP headers, in order, are named fields of our own.
    """

    def line(name: str, value: str) -> Column:
        return F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(value).cast("string"), F.lit("\r\n"))).otherwise("")

    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = F.filter(F.split("source_headers", r"\r?\n"), lambda x: x != "")
    headers = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit("\r\n"))), "")
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *[line(*n) for n in names], F.coalesce(headers, F.lit("")), F.lit("\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """One gzip-compressed WARC file per partition."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def literal(s: str) -> str:
        return quoted(s) if s.isprintable() else " || ".join(quoted(c) if c.isprintable() else f"chr({ord(c)})" for c in s)

    def text(x: str) -> str:
        for pattern, to in TO_TEXT:
            x = f"regexp_replace({x}, {quoted(pattern)}, {literal(to)}, 'g')"
        for name, to in ENTITIES:
            x = f"replace({x}, {quoted(name)}, {literal(to)})"
        for pattern, to in TIDY:
            x = f"regexp_replace({x}, {quoted(pattern)}, {literal(to)}, 'g')"
        return x

    def uuid(x: str) -> str:
        cut = " || '-' || ".join(f"substr(md5({x}), {s}, {n})" for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cut} || '>'"

    crlf = "chr(13) || chr(10)"
    title = text(r"regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1)")
    return rf"""
WITH responses AS (
  SELECT page_id, {uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')")} AS refers_to, url AS target_uri,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(coalesce(page_id, 0) % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date,
         coalesce(html, '') AS payload
  FROM pages),
parsed AS (
  SELECT page_id, refers_to, target_uri, warc_date, strlen(payload) AS bytes, 'sha256:' || sha256(payload) AS source_digest,
         'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) || {crlf} AS source_headers,
         {text("payload")} AS txt, replace({title}, chr(10), ' ') AS title,
         len(regexp_extract_all(payload, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS links,
         {uuid("'conversion|' || refers_to")} AS cid, {uuid("'metadata|' || refers_to")} AS mid
  FROM responses),
records AS (
  SELECT *, 'conversion' AS warc_type, cid AS record_id, mid AS concurrent_to, 'text/plain; charset=utf-8' AS content_type, txt AS block FROM parsed
  UNION ALL
  SELECT *, 'metadata', mid, cid, 'application/warc-fields',
         'http-status: 200' || {crlf} || 'http-content-type: text/html; charset=utf-8' || {crlf} || 'payload-digest: ' || source_digest || {crlf} ||
         'payload-length: ' || bytes || {crlf} || 'title: ' || title || {crlf} || 'outlinks: ' || links || {crlf} || 'conversion: ' || cid || {crlf}
  FROM parsed)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date, content_type, source_headers, source_digest, block,
       'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length
FROM records
"""


ORACLE = _sql()
