"""Reviews in depth: image issues, model issues, cycles, task lists, states, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statuses, text
from ..operators import dispositions, enrichment, images, ordering, quality
from ..sources import html
from ..sources.tables import Tables
from .registry import query

_SEVERITIES = "('low', 'medium', 'high', 'critical')"

#: One row for each (order, line number): numbers repeat in the table.
_LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)"


def _lines(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return t.lineitem.groupBy(*keys).agg(*[F.min(c).alias(c) for c in t.lineitem.columns if c not in keys])


#: Each order as a snapshot, its lines as images.
_IMAGES = f"""{_LINES}, img AS (SELECT l_orderkey AS snapshot, l_linenumber::INTEGER AS i, (l_partkey % 7)::VARCHAR AS url, CASE WHEN l_returnflag <> 'R' THEN (l_suppkey % 5)::VARCHAR END AS content, l_returnflag <> 'R' AS loaded, (l_quantity * 30)::INTEGER AS w, CASE WHEN l_tax > 0 THEN (l_extendedprice / 60)::INTEGER END AS h,
  l_linenumber = 1 AS main, CASE WHEN l_discount = 0.1 THEN 'UV 保証 ' || l_shipdate::VARCHAR WHEN l_discount = 0 THEN 'plain' END AS ocr FROM lines)"""


@query(f"""WITH {_IMAGES}, g AS (SELECT snapshot, list(i ORDER BY i) AS every, count(*) FILTER (WHERE loaded) AS n, coalesce(list(i ORDER BY i) FILTER (WHERE NOT loaded), []) AS broken, coalesce(list(i ORDER BY i) FILTER (WHERE NOT loaded AND main), []) AS main_broken,
  coalesce(list(i ORDER BY i) FILTER (WHERE loaded AND (w < 200 OR h < 200)), []) AS small, coalesce(list(i ORDER BY i) FILTER (WHERE loaded AND main AND (w < 500 OR h < 500)), []) AS weak FROM img GROUP BY snapshot)
SELECT snapshot, 'broken_image_url' AS type, CASE WHEN len(main_broken) > 0 THEN 'critical' ELSE 'high' END AS severity, 1.0::DOUBLE AS confidence, broken AS images FROM g WHERE len(broken) > 0
UNION ALL SELECT snapshot, 'missing_main_image', 'critical', 1.0, main_broken FROM g WHERE len(main_broken) > 0 UNION ALL SELECT snapshot, 'image_low_resolution', 'medium', 1.0, small FROM g WHERE len(small) > 0 UNION ALL SELECT snapshot, 'weak_main_image', 'high', 1.0, weak FROM g WHERE len(weak) > 0
UNION ALL SELECT snapshot, 'image_count_low', CASE n WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END, 1.0, every FROM g WHERE n < 3
UNION ALL SELECT snapshot, 'duplicate_url', 'medium', 1.0, list(i ORDER BY i) FROM img GROUP BY snapshot, url HAVING count(*) > 1 UNION ALL SELECT snapshot, 'duplicate_content', 'low', 1.0, list(i ORDER BY i) FROM img WHERE content IS NOT NULL GROUP BY snapshot, content HAVING count(*) > 1
UNION ALL SELECT snapshot, 'forbidden_claims', 'medium', 0.6, [i] FROM img WHERE contains(ocr, '保証')""")
def image_issues(t: Tables) -> DataFrame:
    """Issues of the images of all orders' lines."""
    c = F.col
    loaded = c("l_returnflag") != "R"
    ocr = F.when(c("l_discount") == 0.1, F.concat(F.lit("UV 保証 "), c("l_shipdate").cast("string"))).when(c("l_discount") == 0, "plain")
    shown = _lines(t).select(
        c("l_orderkey").alias("snapshot"), c("l_linenumber").cast("int").alias("image_index"), (c("l_partkey") % 7).cast("string").alias("url_hash"), (c("l_suppkey") % 5).cast("string").alias("content_hash"), loaded.alias("loaded"),
        F.round(c("l_quantity") * 30).cast("int").alias("width"), F.when(c("l_tax") > 0, F.round(c("l_extendedprice") / 60).cast("int")).alias("height"), (c("l_linenumber") == 1).alias("is_main"), ocr.alias("ocr_text"),
    )
    return images.image_issues(shown, "snapshot")


_SCORES = ", ".join(f"('{t}', '{s}')" for t, scores in quality.AFFECTED_SCORES.items() for s in scores)
_TYPES = ", ".join(f"({i}, '{x[0]}')" for i, x in enumerate(sorted(quality.ISSUE_TYPES)))


@query(f"""WITH types(i, type) AS (VALUES {_TYPES}), affects(type, score) AS (VALUES {_SCORES}), k AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_type, score, count(*) AS n_issues FROM k JOIN types ON i = k % 27 JOIN affects USING (type) GROUP BY ALL""")
def scores_affected(t: Tables) -> DataFrame:
    """Which scores the issues of each type of event lower."""
    names = F.array(*[F.lit(x[0]) for x in sorted(quality.ISSUE_TYPES)])
    k = F.get_json_object("props", "$.k").cast("int")
    return quality.affected_scores(t.events.select("event_type", F.get(names, k % 27).alias("type")), "event_type")


_ANSWER = """'{"issues": [{"type": "' || event_type || '", "severity": ' || CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"awful"' WHEN 2 THEN '3' ELSE '"high"' END || ', "affected_image_indexes": [' || CAST(k AS STRING) || ', "2", 1.5, null, true]}, {"type": ' || CASE WHEN k % 3 = 0 THEN '7' ELSE '""' END
  || '}, {"type": "second", "evidence": "' || event_type || '", "operator_note": "n", "affected_image_indexes": "no"}, ' || props || ', "text"]}'"""


@query(f"""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_id, event_type AS type, CASE WHEN k % 5 = 0 THEN 'medium' ELSE 'high' END AS severity, [k::DOUBLE, 1.5] AS images, '' AS evidence, 'visual review flagged: ' || event_type AS note FROM e WHERE k % 5 NOT IN (1, 2) UNION ALL SELECT event_id, 'second', 'medium', [], event_type, 'n' FROM e""")
def model_issues(t: Tables) -> DataFrame:
    """Issues in models' answers: numeric image places only, unknown severities dropped."""
    e = t.events.select("event_id", "event_type", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.select("event_id", F.expr(_ANSWER).alias("body")).select("event_id", F.inline(quality.model_issues(F.col("body"))))


@query("""WITH trig AS (SELECT user_id AS listing, 'm' || (user_id % 3) AS market, ts AS seen, event_type AS source FROM events WHERE event_type IN ('view', 'error')),
states AS (SELECT event_id, user_id AS listing, 'm' || (user_id % 3) AS market, ts AS created_at, ['not_reviewed', 'review_queued', 'reviewed', 'fix_needed', 'fix_in_progress', 'fix_ready_for_review', 're_review_queued', 'improved', 'approved', 'closed'][event_id % 10 + 1] AS status FROM events WHERE event_type = 'click' AND event_id % 4 = 0),
f AS (SELECT listing, market, arg_min({'seen': seen, 'source': source}, (seen, source)) AS t, count(*) AS n_triggers FROM trig GROUP BY ALL), s AS (SELECT listing, market, arg_max({'event_id': event_id, 'status': status}, (created_at, 'c' || event_id)) AS s FROM states WHERE status NOT IN ('approved', 'closed') GROUP BY ALL)
SELECT listing, market, CASE WHEN s IS NULL THEN substr(sha256(listing || ':' || market || ':' || epoch_us(t.seen)), 1, 16) ELSE 'c' || s.event_id END AS cycle, coalesce(s.status, 'not_reviewed') AS status, s IS NULL AS is_new, CASE WHEN s IS NULL THEN t.source END AS created_from, n_triggers FROM f LEFT JOIN s USING (listing, market)""")
def cycles_open_or_new(t: Tables) -> DataFrame:
    """The open cycle of each listing that a change triggers, stored or made now."""
    e = t.events.select(F.col("user_id").alias("listing"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("market"), "ts", "event_id", "event_type")
    triggers = e.where("event_type in ('view', 'error')").select("listing", "market", F.col("ts").alias("at"), F.col("event_type").alias("source"))
    names = F.array(*map(F.lit, (*quality.OPEN_CYCLES, "approved", "closed")))
    stored = e.where("event_type = 'click' and event_id % 4 = 0").select("listing", "market", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("cycle"), F.get(names, (F.col("event_id") % 10).cast("int")).alias("status"), F.col("ts").alias("created_at"))
    return quality.open_or_new_cycles(triggers, stored, ["listing", "market"])


@query("""WITH r AS (SELECT p_type AS policy, list_filter([CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'hero' END], lambda x: x IS NOT NULL) AS reasons FROM part), n AS (SELECT policy, count(*) AS n_runs FROM r GROUP BY policy)
SELECT policy, reason, count(*) AS n, round(count(*)::DOUBLE / any_value(n_runs), 6) AS share FROM (SELECT policy, unnest(reasons) AS reason FROM r) q JOIN n USING (policy) GROUP BY ALL""")
def policy_reasons(t: Tables) -> DataFrame:
    """How often each reason occurs under each policy, as number and share of its runs."""
    why = F.array_compact(F.array(F.when(F.col("p_size") < 10, "small"), F.when(F.col("p_retailprice") > 1000, "dear"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "hero")))
    runs = t.part.select(F.col("p_type").alias("policy"), F.explode(F.array_append(why, F.lit(""))).alias("reason"))  # '' once a run
    counts = runs.groupBy("policy", "reason").agg(F.count("*").alias("n"))
    n_runs = counts.where("reason = ''").select("policy", F.col("n").alias("n_runs"))
    return counts.where("reason <> ''").join(n_runs, "policy").select("policy", "reason", "n", F.round(F.col("n") / F.col("n_runs"), 6).alias("share"))


_TASKS = f"""{_LINES}, tasks AS (SELECT l_orderkey * 10 + l_linenumber AS task, l_linestatus AS status, l_returnflag AS task_type, floor(l_quantity / 10)::INTEGER AS priority, p_type AS platform, p_brand AS shop_code, CASE WHEN l_tax > 0.04 THEN 'person' ELSE 'team' END AS owner_type, 'o' || (l_suppkey % 9) AS owner_key,
  CASE WHEN l_discount > 0 THEN l_shipdate END AS due_date, CASE WHEN l_tax > 0 THEN l_shipdate + INTERVAL 3 DAY END AS scheduled_at, l_quantity > 30 AS approval_required, p_name AS title, p_type || ' ' || p_brand AS description FROM lines JOIN part ON p_partkey = l_partkey)"""


def _tasks(t: Tables) -> DataFrame:
    c = F.col
    return _lines(t).join(t.part, c("l_partkey") == c("p_partkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("task"), c("l_linestatus").alias("status"), c("l_returnflag").alias("task_type"), F.floor(c("l_quantity") / 10).cast("int").alias("priority"), c("p_type").alias("platform"), c("p_brand").alias("shop_code"),
        F.when(c("l_tax") > 0.04, "person").otherwise("team").alias("owner_type"), F.concat(F.lit("o"), (c("l_suppkey") % 9).cast("string")).alias("owner_key"), F.when(c("l_discount") > 0, c("l_shipdate")).alias("due_date"),
        F.when(c("l_tax") > 0, c("l_shipdate") + F.expr("INTERVAL 3 DAYS")).alias("scheduled_at"), (c("l_quantity") > 30).alias("approval_required"), c("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("description"),
    )


@query(f"""WITH {_TASKS} SELECT task, priority, due_date, scheduled_at FROM tasks WHERE status IN ('O', 'F') AND priority IN (2, 3, 4) AND task_type IN ('A', 'N', 'R') AND owner_type = 'person' AND due_date <= TIMESTAMP '2002-06-01' AND due_date >= TIMESTAMP '1993-01-01' AND scheduled_at >= TIMESTAMP '1993-01-01'
  AND scheduled_at <= TIMESTAMP '2002-06-02' AND NOT approval_required AND (contains(lower(title), 'red') OR contains(lower(description), 'red')) ORDER BY priority DESC, due_date, scheduled_at, task LIMIT 25 OFFSET 25""")
def task_page(t: Tables) -> DataFrame:
    """A page of tasks under optional filters, by three keys; filters that aren't set don't count."""
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    found = ordering.filtered(
        _tasks(t), ["title", "description"], status=["O", "F"], priority=[2, 3, 4], task_type=["A", "N", "R"], platform=None, shop_code=None, owner_type="person", owner_key=None, due_before=stamp("2002-06-01"), due_after=stamp("1993-01-01"),
        scheduled_after=stamp("1993-01-01"), scheduled_before=stamp("2002-06-02"), approval_required=False, search="RED",
    )
    return found.select("task", "priority", "due_date", "scheduled_at").orderBy(F.desc("priority"), "due_date", "scheduled_at", "task").offset(25).limit(25)


@query(f"""WITH {_TASKS}, page AS (SELECT * FROM tasks WHERE platform = 'PROMO' AND status = 'O' ORDER BY priority DESC, due_date DESC NULLS LAST, task LIMIT 200)
SELECT task, title, owner_key FROM page WHERE contains(lower(concat_ws(' ', task, platform, shop_code, task_type, status, owner_type, owner_key, title, description)), 'brand#1')""")
def queue_search(t: Tables) -> DataFrame:
    """A search over the fields of the first 200 items of a queue; it sees these only."""
    found = ordering.filtered(_tasks(t), platform="PROMO", status=["O"])
    fields = ["task", "platform", "shop_code", "task_type", "status", "owner_type", "owner_key", "title", "description"]
    return ordering.searched_after(found, [F.desc("priority"), F.desc_nulls_last("due_date"), F.asc("task")], 200, fields, " Brand#1 ").select("task", "title", "owner_key")


_DUE = "TIMESTAMP '1998-06-01'"


@query(f"""WITH {_TASKS}, s AS (SELECT task, due_date, scheduled_at, CASE (task % 7) WHEN 0 THEN 'done' WHEN 1 THEN 'canceled' WHEN 2 THEN 'blocked' WHEN 3 THEN 'waiting_approval' WHEN 4 THEN 'backlog' WHEN 5 THEN 'planned' ELSE 'review' END AS status FROM tasks),
open AS (SELECT * FROM s WHERE status NOT IN ('done', 'canceled'))
SELECT task, 'blocked' AS label FROM open WHERE status = 'blocked' UNION ALL SELECT task, 'waiting_approval' FROM open WHERE status = 'waiting_approval' UNION ALL SELECT task, CASE WHEN due_date < {_DUE} THEN 'overdue' WHEN due_date::DATE = {_DUE}::DATE THEN 'due_today' ELSE 'due_this_week' END FROM open WHERE status <> 'blocked' AND due_date <= {_DUE} + INTERVAL 7 DAY
UNION ALL SELECT task, 'scheduled_today' FROM open WHERE status <> 'blocked' AND scheduled_at::DATE = {_DUE}::DATE UNION ALL SELECT task, 'open_without_date' FROM open WHERE status IN ('backlog', 'planned') AND due_date IS NULL AND scheduled_at IS NULL""")
def due_groups(t: Tables) -> DataFrame:
    """Tasks under every label that holds as of a fixed day; blocked ones under that alone."""
    k, as_of, due, planned = F.col("task") % 7, F.lit("1998-06-01").cast("timestamp_ntz"), F.col("due_date"), F.col("scheduled_at")
    status = F.when(k == 0, "done").when(k == 1, "canceled").when(k == 2, "blocked").when(k == 3, "waiting_approval").when(k == 4, "backlog").when(k == 5, "planned").otherwise("review")
    x = _tasks(t).select("task", "due_date", "scheduled_at", status.alias("status")).where("status not in ('done', 'canceled')")
    blocked = F.col("status") == "blocked"
    due_label = F.when(due < as_of, "overdue").when(due.cast("date") == as_of.cast("date"), "due_today").when(due <= as_of + F.expr("INTERVAL 7 DAYS"), "due_this_week")
    undated = F.col("status").isin("backlog", "planned", "in_progress") & due.isNull() & planned.isNull()
    labels = F.array(F.when(F.col("status") == "waiting_approval", "waiting_approval"), due_label, F.when(planned.cast("date") == as_of.cast("date"), "scheduled_today"), F.when(undated, "open_without_date"))
    return x.select("task", F.explode(F.when(blocked, F.array(F.lit("blocked"))).otherwise(F.array_compact(labels))).alias("label"))


@query("""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS main, CASE WHEN doc_id % 3 = 0 THEN [lang, source, 'x'] ELSE [lang, 'x'] END AS items FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
a AS (SELECT doc_id, CASE WHEN main IS NULL OR list_contains(items, main) THEN items ELSE list_concat([main], items) END AS items FROM i) SELECT doc_id, unnest(generate_series(0, len(items) - 1))::INTEGER AS position, unnest(items) AS image FROM a""")
def main_image_first(t: Tables) -> DataFrame:
    """Images by position, with the main one in front where the list hasn't got it."""
    main = F.when(F.col("doc_id") % 4 != 0, F.col("source"))
    items = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source", F.lit("x"))).otherwise(F.array("lang", F.lit("x")))
    known = t.documents.where("lang is not null and source is not null")
    return known.select("doc_id", F.posexplode(enrichment.prepended(items, main)).alias("position", "image"))


_WORDS = "list_filter(regexp_split_to_array(concat_ws(' ', text, lang, source), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w, list_transform({_WORDS}, lambda x: lower(x)) AS l FROM documents) SELECT doc_id, left(array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), ' '), 80) AS title FROM w WHERE len(w) < 400")
def suggested_titles(t: Tables) -> DataFrame:
    """Titles from the words of short texts, language and source, each word once, at most 80 characters."""
    d = t.documents.where(F.size(F.filter(F.split(F.concat_ws(" ", "text", "lang", "source"), "\\s+"), lambda w: w != "")) < 400)
    return d.select("doc_id", text.suggested_title(F.col("text"), F.col("lang"), F.col("source")).alias("title"))


@query("""SELECT l_orderkey, l_linenumber, CASE trim((l_suppkey % 4)::VARCHAR) WHEN '2' THEN 'active' WHEN '1' THEN 'inactive' ELSE 'unknown' END AS by_code,
  CASE WHEN l_tax > 0.04 AND l_discount > 0.05 THEN 'inactive' WHEN l_tax > 0.04 THEN 'inactive' WHEN l_tax > 0 AND l_discount > 0.05 THEN 'active' WHEN l_discount <= 0.05 THEN 'inactive' ELSE 'unknown' END AS by_flags, CASE WHEN l_quantity - 20 > 0 THEN 'active' WHEN l_quantity - 20 > -10 THEN 'sold_out' ELSE 'unknown' END AS by_quantity,
  CASE l_linenumber WHEN 1 THEN 'active' WHEN 2 THEN 'active' WHEN 3 THEN 'inactive' WHEN 4 THEN 'inactive' WHEN 5 THEN 'sold_out' WHEN 6 THEN 'draft' ELSE 'unknown' END AS by_api FROM lineitem""")
def marketplace_states(t: Tables) -> DataFrame:
    """Codes, flags, quantities and interface states of all lines in one vocabulary."""
    c = F.col
    warehouse = F.when(c("l_tax") > 0.04, "1").when(c("l_tax") > 0, "0")
    search = F.when(c("l_discount") > 0.05, "1").otherwise("0")
    quantity = F.when(c("l_quantity") > 10, F.greatest(c("l_quantity") - 20, F.lit(0.0)))
    names = F.array(*map(F.lit, ("Opened", "active", "CLOSED", "inactive", "sold_out", "Draft", "gone")))
    return t.lineitem.select("l_orderkey", "l_linenumber", statuses.by_code(F.concat(F.lit(" "), (c("l_suppkey") % 4).cast("string"))).alias("by_code"), statuses.by_flags(warehouse, search).alias("by_flags"), statuses.by_quantity(quantity).alias("by_quantity"), statuses.by_api(F.get(names, (c("l_linenumber") - 1).cast("int"))).alias("by_api"))


_CODES = """coded AS (SELECT l_orderkey AS listing, CASE WHEN l_discount = 0 THEN ' ' WHEN l_tax = 0 THEN 'S' || (l_partkey + 100000000) ELSE ' S' || l_partkey END AS code FROM lineitem), known AS (SELECT 'S' || p_partkey AS code, p_brand AS variant FROM part),
r AS (SELECT listing, trim(coded.code, ' ') AS code, variant FROM coded LEFT JOIN known ON known.code = trim(coded.code, ' '))"""


def _codes(t: Tables) -> tuple[DataFrame, DataFrame]:
    code = F.when(F.col("l_discount") == 0, " ").when(F.col("l_tax") == 0, F.concat(F.lit("S"), (F.col("l_partkey") + 100000000).cast("string"))).otherwise(F.concat(F.lit(" S"), F.col("l_partkey").cast("string")))
    coded = t.lineitem.select(F.col("l_orderkey").alias("listing"), code.alias("code"))
    return enrichment.resolved_codes(coded, t.part.select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_brand").alias("variant")), "listing")


@query(f"WITH {_CODES} SELECT listing, CASE WHEN count(DISTINCT variant) = 1 THEN min(variant) END AS variant, count(*) AS n_codes, count(*) FILTER (WHERE variant IS NULL) AS n_unresolved FROM r GROUP BY listing")
def listing_variants(t: Tables) -> DataFrame:
    """The one variant that a listing's codes name, if it is one."""
    return _codes(t)[0]


@query(f"WITH {_CODES} SELECT listing, code, substr(sha256(code), 1, 12) AS fingerprint FROM r WHERE variant IS NULL")
def unresolved_codes(t: Tables) -> DataFrame:
    """The codes that name no variant, given back row by row."""
    return _codes(t)[1]


@query("""SELECT doc_id, coalesce(length(string_split(text, chr(10))[1]) < 30, true) OR coalesce(length(text) < 120, true) AS weak FROM documents""")
def weak_copies(t: Tables) -> DataFrame:
    """First lines under 30 or texts under 120 characters, or none."""
    return t.documents.select("doc_id", dispositions.weak_copy(F.split("text", "\n")[0], F.col("text")).alias("weak"))


_ANCHOR = '<a href="[^"]*"[^>]*>[^<]*</a>'
_CARD = {"shop": '<a href="/([^/"?#]+)', "item": '<a href="/[^/"?#]+/([^/"?#]+)', "title": "<a [^>]*>\\s*([^<]*?)\\s*</a>"}


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>')) AS b, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*"[^>]*>[^<]*</a>'), 1) AS place FROM pages),
f AS (SELECT page_id, place, regexp_extract(b, '<a href="/([^/"?#]+)', 1) AS shop, regexp_extract(b, '<a href="/[^/"?#]+/([^/"?#]+)', 1) AS item, regexp_extract(b, '<a [^>]*>[\\s\\x0B]*([^<]*?)[\\s\\x0B]*</a>', 1) AS title, regexp_extract(b, 'rank=([0-9]+)', 1) AS rank, regexp_matches(b, '(?i)sponsored') AS ad FROM c),
n AS (SELECT * FROM f WHERE NOT ad AND shop <> '' AND title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, shop, title ORDER BY place) = 1)
SELECT page_id, coalesce(try_cast(nullif(rank, '') AS INTEGER), place::INTEGER) AS rank, shop, nullif(item, '') AS item, title FROM n QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY place) <= 10""")
def page_cards(t: Tables) -> DataFrame:
    """The first ten different cards of each page, by its links: place and title, ads left out."""
    return html.ranked_cards(t.pages, "page_id", "html", _ANCHOR, _CARD, ["shop", "title"], "(?i)sponsored", "rank=(\\d+)", 10)
