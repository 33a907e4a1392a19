"""Site-relative line dedup: lines on too large a share of a site's pages go.

Method: rows are grouped by host.  For each (host, line) the number of pages that hold the
line is divided by the host's number of pages; a line on at least MIN_PAGES pages and on
more than RATIO of them is boilerplate and is taken out of every page of that host.
Only DataFrame functions run here.

Counting: each page gives each of its lines once (as a 64-bit hash) and one null, which
counts the page itself; counts are summed before the shuffle, so a host or a line that most
rows share is a few summed rows a task.  The counts are written once; lines on fewer than
MIN_PAGES pages are gone by then.  A host has fewer than (lines a page) / RATIO boilerplate
lines, so they are kept as one array of hashes a host.  The hosts' totals and these arrays
are broadcast if they are small by count, else joined with salted hosts.

Cases: null text stays null and counts as a page without lines; a null host is a site of
its own; blank lines are neither counted nor dropped; a text whose lines all go becomes
empty; repeated rows are pages each; ties cannot arise, as a line is judged by itself;
all columns of the input stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm._spark import BROADCAST_ROWS, table, written

RATIO = 0.05
MIN_PAGES = 3
#: Hosts whose arrays of boilerplate lines may be broadcast.
BROADCAST_SITES = 20_000
#: Parts of each host where a table of hosts is too large for a broadcast.
SALTS = 32


def host_of_url(url: Column) -> Column:
    """Lower-cased host of an http(s) address, without port; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def _hashes(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))


def _by_host(rows: DataFrame, salt: Column, hosts: DataFrame, most: int, how: str) -> DataFrame:
    """rows (with _site) joined with hosts (with _host, one row a host): by broadcast if hosts has at most `most` rows, else in SALTS parts of each host."""
    same = rows["_site"].eqNullSafe(hosts["_host"])
    if hosts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(hosts), same, how)
    parts = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    salted = hosts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return parts.join(salted, parts["_site"].eqNullSafe(salted["_host"]) & (parts["_salt"] == salted["_part"]), how)


def boilerplate(docs: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _line hash): the lines to drop at each host."""
    lines = F.coalesce(F.array_distinct(_hashes(F.split(F.col(f"`{text}`"), "\n"))), F.array().cast("array<bigint>"))
    pages = docs.select(host.alias("_site"), F.explode(F.concat(lines, F.array(F.lit(None).cast("long")))).alias("_line"))
    counts = written(pages.groupBy("_site", "_line").agg(F.count("*").alias("_with")).filter(F.col("_line").isNull() | (F.col("_with") >= min_pages)))
    totals = counts.filter("_line IS NULL").select(F.col("_site").alias("_host"), F.col("_with").alias("_pages"))
    joined = _by_host(counts.filter("_line IS NOT NULL"), F.col("_line"), totals, BROADCAST_ROWS, "inner")
    return joined.filter(F.col("_with") > ratio * F.col("_pages")).select("_host", "_line")


def dedup_lines(docs: DataFrame, host: Column | None = None, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of `text`; with counts=True also n_lines and n_dropped."""
    host = F.col("source") if host is None else host
    flagged = boilerplate(docs, host, text, ratio, min_pages)
    sites = written(flagged.groupBy("_host").agg(F.collect_set("_line").alias("_drop")))  # fewer than lines a page / ratio hashes each
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), host.alias("_site"))
    joined = _by_host(row, F.xxhash64(F.col(f"_row.`{text}`")), sites, BROADCAST_SITES, "left")
    whole = F.col(f"_row.`{text}`")
    lines = F.split(whole, "\n")
    stay = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_drop"), F.xxhash64(x)))
    kept = joined.select("_row", F.when(F.col("_drop").isNull(), lines).otherwise(stay).alias("_kept"))
    cleaned = F.when(whole.isNull(), F.lit(None).cast("string")).otherwise(F.array_join("_kept", "\n"))
    out = [cleaned.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns]
    if counts:
        n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        out += [n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size("_kept"), F.lit(0))).cast("long").alias("n_dropped")]
    return kept.select(*out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs, counts=True)


OP9_SQL = f"""
WITH lines AS (
  SELECT source, doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE text IS NOT NULL
), with_line AS (
  SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= {MIN_PAGES}
), total AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), dropped AS (
  SELECT w.source, list(w.line) AS lines FROM with_line w JOIN total t ON w.source IS NOT DISTINCT FROM t.source
  WHERE w.n > CAST({RATIO} AS DOUBLE) * t.pages GROUP BY w.source
), cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS had,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(x_.lines, []), x)) AS kept
  FROM documents d LEFT JOIN dropped x_ ON d.source IS NOT DISTINCT FROM x_.source
)
SELECT doc_id, source, CASE WHEN had IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(had), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(had) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""
