"""Landing of raw rows, cells and dates from exports, seeds and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, merges, ordering
from ..sources import files
from ..sources.tables import Tables
from .registry import query


@query("""WITH r AS (SELECT *, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS raw FROM orders)
SELECT 'run-1' AS run_id, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_index, o_orderkey::VARCHAR AS source_key, substr(sha256(raw), 1, 16) AS row_hash, raw, 'pending' AS status FROM r""")
def raw_landing(t: Tables) -> DataFrame:
    """All orders as the raw rows of an import run."""
    return files.land_raw(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "run-1", ["o_custkey", "o_orderkey"], "o_orderkey")


@query("""WITH runs AS (SELECT o_orderpriority AS source, o_orderkey AS run, md5((o_custkey % 7)::VARCHAR) AS file_hash, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders)
SELECT source, run, status, CASE WHEN status = 'completed' THEN 'done' WHEN EXISTS (SELECT 1 FROM runs x WHERE x.source = r.source AND x.file_hash = r.file_hash AND x.status = 'completed' AND x.run < r.run) THEN 'already_imported' ELSE 'import' END AS decision FROM runs r""")
def import_runs(t: Tables) -> DataFrame:
    """Import runs whose file an earlier completed run of the source has read."""
    o = t.orders
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    runs = o.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("run"), F.md5((F.col("o_custkey") % 7).cast("string")).alias("file_hash"), status.alias("status"))
    first = runs.where("status = 'completed'").groupBy("source", "file_hash").agg(F.min("run").alias("first"))
    j = runs.join(first, ["source", "file_hash"], "left")
    return j.select("source", "run", "status", F.when(F.col("status") == "completed", "done").when(F.col("first") < F.col("run"), "already_imported").otherwise("import").alias("decision"))


@query("""SELECT doc_id, left(text, list_max(list_filter(range(0, 22), lambda i: strlen(left(text, i)) <= 21))) AS capped, coalesce(nullif(trim(lang, ' '), ''), nullif(trim(source, ' '), ''), 'none') AS first_filled,
  list_filter(list_transform(regexp_split_to_array(text, '[|;]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS items,
  len(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?(?:cm|mm|kg|g|ml|l|%)?'))) AS n_numbers FROM documents WHERE text IS NOT NULL""")
def cell_values(t: Tables) -> DataFrame:
    """Byte caps, first filled values, lists and numbers of all documents."""
    d = t.documents.where("text is not null")
    numbers = text.numbers_in(F.col("text"))
    return d.select(
        "doc_id",
        text.utf8_cap(F.col("text"), 21).alias("capped"),
        F.coalesce(text.first_filled(F.col("lang"), F.col("source")), F.lit("none")).alias("first_filled"),
        text.split_list(F.col("text")).alias("items"),
        F.size(numbers).cast("long").alias("n_numbers"),
    )


#: Days, zoned and plain timestamps, and days in another form.
_DATES = """SELECT event_id, event_id % 17 = 0 AS broken, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%d.%m.%Y') END AS cell FROM events"""


@query(f"""WITH c AS (SELECT event_id, CASE WHEN broken THEN '2024-02-31' ELSE cell END AS cell FROM ({_DATES}) q)
SELECT event_id, cell, coalesce(regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(cell AS DATE) IS NOT NULL, false) AS is_date, cell LIKE '%Z' AS is_zoned, try_cast(replace(cell, 'Z', '') AS TIMESTAMP) AS at FROM c""")
def date_cells(t: Tables) -> DataFrame:
    """Cells as calendar dates, zoned timestamps, and parsed leniently (null if neither)."""
    i, ts = F.col("event_id"), F.col("ts")
    cell = F.when(i % 4 == 0, F.date_format(ts, "yyyy-MM-dd")).when(i % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "dd.MM.yyyy"))
    c = t.events.select("event_id", F.when(i % 17 == 0, "2024-02-31").otherwise(cell).alias("cell"))
    return c.select("event_id", "cell", text.real_date(F.col("cell")).alias("is_date"), text.zoned_timestamp(F.col("cell")).alias("is_zoned"), text.lenient_timestamp(F.col("cell")).alias("at"))


@query("""WITH seed(code, label, rank) AS (VALUES ('mercari', 'Mercari', 1), ('rakuten', 'Rakuten', 2), ('amazon', 'Amazon', 3), ('BUILDING', 'Building sites', 4))
SELECT code, label, rank FROM seed UNION ALL SELECT DISTINCT c_mktsegment, c_mktsegment, 99 FROM customer WHERE c_mktsegment NOT IN (SELECT code FROM seed)""")
def seeded_accounts(t: Tables) -> DataFrame:
    """Constant seeds over what is stored: known codes take the seed's values."""
    seeds = t.spark.createDataFrame([("mercari", "Mercari", 1), ("rakuten", "Rakuten", 2), ("amazon", "Amazon", 3), ("BUILDING", "Building sites", 4)], "code string, label string, rank int")
    stored = t.customer.select(F.col("c_mktsegment").alias("code"), F.col("c_mktsegment").alias("label"), F.lit(99).alias("rank")).distinct()
    return merges.upsert(stored, seeds, ["code"])


@query("""SELECT r_regionkey, r_name, n_nations, n_nations <= 5 AS within FROM (SELECT r_regionkey, r_name, count(*) AS n_nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)""")
def guarded_rows(t: Tables) -> DataFrame:
    """A limit that is an error when passed, and a row that has to be the only one."""
    n = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n_nations"))
    rows = ordering.at_most(joins.star(t.region, (n, "r_regionkey", "n_regionkey")).select("r_regionkey", "r_name", "n_nations"), 5)
    one = ordering.exactly_one(t.region.where("r_name = 'ASIA'").select(F.lit(5).alias("most")))
    return joins.with_single_row(rows, one).select("r_regionkey", "r_name", "n_nations", (F.col("n_nations") <= F.col("most")).alias("within"))


@query("""SELECT r_name, n_name, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def report_lines(t: Tables) -> DataFrame:
    """The lines of a report, as they are in the table."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("r_name", "n_name", files.json_line(F.col("n_name"), F.col("n_nationkey")).alias("line"))


@query("""SELECT '{"r_name":"' || r_name || '","n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"note":' || CASE WHEN n_nationkey % 2 = 0 THEN 'null' ELSE '"odd"' END || '}' AS line, (SELECT '{"rows":' || count(*) || '}' FROM nation) AS summary FROM nation JOIN region ON n_regionkey = r_regionkey""")
def report_written(t: Tables) -> DataFrame:
    """A report written as JSON lines with its summary, and both read back as text."""
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey", F.when(F.col("n_nationkey") % 2 != 0, "odd").alias("note"))
    folder = files.fresh_folder(t.spark, "report")
    files.write_report(rows, folder, t.nation.agg(F.count("*").alias("rows")))
    lines, summary = (t.spark.read.text(f"{folder}/{x}") for x in ("rows", "summary"))
    return lines.select(F.col("value").alias("line")).join(F.broadcast(summary.select(F.col("value").alias("summary"))))
