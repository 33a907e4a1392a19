"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Method: every response record yields two records that refer to it.  The metadata record
(application/warc-fields) states the source's identifier, status, every header and its
digests, its title and number of links; the conversion record (text/plain) holds its text:
character references that end with a semicolon (all names of HTML, decimal and hexadecimal
numbers) are decoded in one pass, by the rules of HTML for numbers that are no characters.  Both carry
WARC-Refers-To, the source's target URI, date and payload digest, and a block digest and
length of their own.  Record identifiers are derived from the source's, so a task that is
run again writes the same records.

Responses come from WARC bytes (`parse_responses`) or are made from a table of pages
(`responses_from_pages`); `serialise` writes records as WARC/1.1 text.

Cases: a null address or body counts as empty; repeated rows give records of equal
identifiers; pages of any length are converted whole; a response without body has a
conversion record of length 0; an empty table gives no records; columns other than those
named are ignored.  Records that cannot be read are no responses; `broken_records` lists them.
A body is decoded by the charset of its header (UTF-8 without one), with replacements.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm._spark import table

CRAWL_DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

#: Parts of a page that hold no text of it.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->|<!doctype[^>]*>"
#: Tags that end a line of text.
BLOCKS = r"(?i)</?(?:br|p|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|header|footer|aside|main|form|blockquote|pre|title)\b[^>]*>"
ANY_TAG = r"<[A-Za-z/!?][^>]*>"
BLANKS = r"[ \t\r\f\x{a0}]+"
LINE_ENDS = r" ?\n[ \n]*"
REFERENCE = "&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def named_references() -> dict[str, str]:
    """Every named character reference with its semicolon, by the table of the standard library."""
    return {f"&{name}": text for name, text in html5.items() if name.endswith(";")}


def low_numbers() -> dict[str, str]:
    """Numbers 128 to 159 stand for the characters of Windows-1252, where it has one."""
    out = {}
    for n in range(128, 160):
        try:
            out[str(n)] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload_digest string, body string"


def _urn(*parts: Column) -> Column:
    """A record identifier from the MD5 of parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def decoded(text: Column) -> Column:
    """text with its character references decoded, each once."""
    names = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")  # a constant
    numbers = F.from_json(F.lit(json.dumps(low_numbers())), "map<string,string>")

    def number(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?0*([0-9A-Fa-f]*);$", 1)
        code = F.when(F.length(digits) > 7, F.lit(0)).when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(digits, 16, 10).cast("long")).otherwise(F.try_to_number(F.concat(F.lit("0"), digits), F.lit("99999999")).cast("long"))
        char = F.try_element_at(numbers, code.cast("string"))
        none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.when(none, F.lit("\ufffd")).otherwise(F.coalesce(char, F.decode(F.unhex(F.lpad(F.hex(F.when(none, 32).otherwise(code)), 8, "0")), "UTF-32")))

    parts = F.regexp_extract_all(text, F.lit(f"{REFERENCE}|[^&]+|&"), F.lit(0))
    one = F.transform(parts, lambda x: F.when(F.substring(x, 1, 2) == "&#", F.when(F.substring(x, -1, 1) == ";", number(x)).otherwise(x)).when((F.substring(x, 1, 1) == "&") & (F.length(x) > 1), F.coalesce(F.try_element_at(names, x), x)).otherwise(x))
    return F.when(F.instr(text, "&") > 0, F.array_join(one, "")).otherwise(text)


def page_text(html: Column) -> Column:
    """Plain text of a page: unseen parts and tags out, blocks on lines, references decoded, blanks folded."""
    out = F.regexp_replace(html, UNSEEN, "")
    out = F.regexp_replace(out, BLOCKS, "\n")
    out = F.regexp_replace(out, ANY_TAG, "")
    out = F.regexp_replace(decoded(out), BLANKS, " ")
    return F.trim(F.regexp_replace(out, LINE_ENDS, "\n"), F.lit(" \n"))


def responses_from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = CRAWL_DATE, keep_key: bool = True) -> DataFrame:
    """A response record for every page."""
    uri, body = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    number = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    digest = _digest(body)
    columns = [_urn(number, uri, digest).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("warc_date"), F.lit(HTTP_HEADERS).alias("http_headers"), digest.alias("payload_digest"), body.alias("body")]
    return pages.select(*[F.col(f"`{key}`").alias("page_id")] * keep_key, *columns)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every response: type metadata and type conversion.  A column page_id stays if there is one."""
    source = F.col("record_id")
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("body", r"(?is)<title[^>]*>([^<]*)", 1)), r"[\s\x{a0}]+", " "))
    links = F.size(F.split(F.lower("body"), r"<a\s[^>]*href")) - 1
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    kind = F.trim(F.regexp_extract("http_headers", r"(?i)content-type:([^\r\n]*)", 1))
    lines = F.split(F.regexp_replace("http_headers", r"\r\n[ \t]+", " "), "\r?\n")
    headers = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike("^HTTP/")), lambda x: F.concat(F.lit("source-http-header: "), x))
    facts = F.concat_ws("\r\n", F.concat(F.lit("source-record-id: "), source), F.concat(F.lit("source-status: "), status), F.concat(F.lit("source-content-type: "), kind), headers, F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")), F.concat(F.lit("source-length: "), F.octet_length("body").cast("string")), F.concat(F.lit("title: "), title), F.concat(F.lit("outlinks: "), links.cast("string")), F.lit(""))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), facts.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), page_text(F.col("body")).alias("block")),
    )
    key = ["page_id"] if "page_id" in responses.columns else []
    rows = responses.select(*key, source.alias("refers_to"), "target_uri", "warc_date", "http_headers", "payload_digest", F.explode(made).alias("_made"))
    rows = rows.select(*key, F.col("_made.warc_type").alias("warc_type"), "refers_to", "target_uri", "warc_date", "http_headers", "payload_digest", F.col("_made.content_type").alias("content_type"), F.col("_made.block").alias("block"))
    return rows.select(*key, "warc_type", _urn(F.col("refers_to"), F.col("warc_type")).alias("record_id"), "refers_to", "target_uri", "warc_date", "http_headers", "payload_digest", "content_type", F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "block")


def serialise(records: DataFrame) -> DataFrame:
    """One column `record`: the bytes of each derived record as WARC/1.1."""
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), F.col(column).cast("string")) for name, column in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))])
    return records.select(F.concat(head.cast("binary"), F.lit("\r\n\r\n").cast("binary"), F.col("block").cast("binary"), F.lit("\r\n\r\n").cast("binary")).alias("record"))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one WARC record; ValueError if it is none."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        headers[last] = value.strip()
    size = int(headers.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("record is cut short")
    return headers, rest[:size]


def _body_text(http: str, body: bytes) -> str:
    named = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9._:-]+)", http)
    try:
        kind = codecs.lookup(named[1]).name if named else "utf-8"
        return body.decode(kind, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def broken_records(records: DataFrame, column: str = "record") -> DataFrame:
    """(record, reason) of the rows that hold no whole WARC record; nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                try:
                    if data is not None:
                        parse_record(data)
                except ValueError as reason:
                    rows.append((data, str(reason)))
            yield pa.RecordBatch.from_pydict({"record": pa.array([r[0] for r in rows], pa.binary()), "reason": pa.array([r[1] for r in rows], pa.string())})

    return records.select(F.col(f"`{column}`").cast("binary")).mapInArrow(run, "record binary, reason string")


def parse_responses(records: DataFrame, column: str = "record") -> DataFrame:
    """Responses out of one WARC record a row; rows of other types, broken rows and nulls give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                try:
                    headers, block = parse_record(data or b"")
                except ValueError:
                    continue
                if headers.get("warc-type") != "response":
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                digest = headers.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
                rows.append((headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", ""), http.decode("latin-1") + "\r\n", digest, _body_text(http.decode("latin-1"), body)))
            names = [x.split()[0] for x in RESPONSE.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.string()) for k, n in enumerate(names)})

    return records.select(F.col(f"`{column}`").cast("binary")).mapInArrow(run, RESPONSE)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_from_pages(table(spark, sf_dir, "pages")))


def _sql_urn(*parts: str) -> str:
    digest = f"md5(concat_ws('|', {', '.join(parts)}))"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_decoded(text: str) -> str:
    """References of `text`: names by a MAP, numbers by chr."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in sorted(named_references().items())) + "}"
    low = "MAP {" + ", ".join(f"{k}: {quoted(v)}" for k, v in low_numbers().items()) + "}"
    code = "CASE WHEN lower(substr(x, 3, 1)) = 'x' THEN CAST('0x' || substr(x, 4, length(x) - 4) AS BIGINT) ELSE CAST(substr(x, 3, length(x) - 3) AS BIGINT) END"
    number = f"CASE WHEN length(x) > 11 THEN chr(65533) WHEN ({code}) IN (0) OR ({code}) > 1114111 OR ({code}) BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce({low}[{code}], chr(CAST({code} AS INTEGER))) END"
    one = f"CASE WHEN x LIKE '&#%;' THEN {number} WHEN x LIKE '&%;' THEN coalesce({names}[x], x) ELSE x END"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '{REFERENCE}|[^&]+|&'), lambda x: {one}), '')"


def _sql_text(html: str) -> str:
    out = f"regexp_replace({html}, '{UNSEEN}', '', 'g')"
    out = f"regexp_replace({out}, '{BLOCKS}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{ANY_TAG}', '', 'g')"
    out = f"regexp_replace({_sql_decoded(out)}, '{BLANKS}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{LINE_ENDS}', chr(10), 'g'), ' ' || chr(10))"


_CRLF = "chr(13) || chr(10)"
_SQL_FACTS = f" || {_CRLF} || ".join([
    "'source-record-id: ' || record_id",
    "'source-status: 200'",
    "'source-content-type: text/html; charset=utf-8'",
    "'source-http-header: Content-Type: text/html; charset=utf-8'",
    "'source-payload-digest: ' || payload_digest",
    "'source-length: ' || strlen(body)",
    "'title: ' || trim(regexp_replace(" + _sql_decoded(r"regexp_extract(body, '(?is)<title[^>]*>([^<]*)', 1)") + r", '[\s\x{a0}]+', ' ', 'g'))",
    r"'outlinks: ' || (len(string_split_regex(lower(body), '<a\s[^>]*href')) - 1)",
    "''",
])
OP10_SQL = f"""
WITH base AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body,
         'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages
), response AS (
  SELECT *, {_sql_urn("coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "payload_digest")} AS record_id FROM base
), made AS (
  SELECT page_id, 'metadata' AS warc_type, record_id AS refers_to, target_uri, payload_digest,
         'application/warc-fields' AS content_type, {_SQL_FACTS} AS block FROM response
  UNION ALL
  SELECT page_id, 'conversion', record_id, target_uri, payload_digest, 'text/plain; charset=utf-8', {_sql_text('body')} FROM response
)
SELECT page_id, warc_type, {_sql_urn('refers_to', 'warc_type')} AS record_id, refers_to, target_uri, '{CRAWL_DATE}' AS warc_date,
       'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} AS http_headers, payload_digest,
       content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, block
FROM made
"""
