"""Text reports on documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import aggregates, ordering
from ..sources.html import link_cards
from ..sources.tables import Tables
from . import scores
from .registry import query

#: Benchmark grams beyond so many are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
TERMS = ("the", "and", "tion", "worthless", "License")
TOPICS = (("licen", "gnu"), ("tion", "ment"), ("zzz",))

_TEXT_LISTING = "SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, lang AS category, n_chars AS price, doc_id % 3 AS images, doc_id % 5 AS stock, CASE WHEN doc_id % 4 = 0 THEN 'closed' ELSE 'active' END AS status FROM documents"


def _listings(t: Tables) -> DataFrame:
    """A document as a listing: its first line is the title, the rest the description."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.documents.select(
        "doc_id",
        title.alias("title"),
        F.substring("text", F.length(title) + 2, F.length("text")).alias("description"),
        F.col("lang").alias("category"),
        F.col("n_chars").alias("price"),
        (F.col("doc_id") % 3).alias("images"),
        (F.col("doc_id") % 5).alias("stock"),
        F.when(F.col("doc_id") % 4 == 0, "closed").otherwise("active").alias("status"),
    )


@query(f"""WITH x AS ({_TEXT_LISTING}), y AS (SELECT *, trim(title, ' ') AS t, trim(description, ' ') AS d FROM x),
s AS (SELECT *, greatest(0, 100 - CASE WHEN t = '' THEN 80 ELSE CASE WHEN length(t) < 18 THEN 25 ELSE 0 END + CASE WHEN contains(lower(t), category) THEN 0 ELSE 15 END + CASE WHEN t LIKE '%!!%' OR t LIKE '%★★%' THEN 20 ELSE 0 END END) AS title_score,
  greatest(0, 100 - CASE WHEN d = '' THEN 55 ELSE CASE WHEN length(d) < 80 THEN 30 ELSE 0 END + CASE WHEN regexp_matches(d, '(?i)(shipping|condition)') THEN 0 ELSE 15 END + CASE WHEN regexp_matches(d, '(?i)(sku|spu|material|size|colou?r)') THEN 0 ELSE 15 END END) AS description_score,
  100 - CASE images WHEN 0 THEN 35 WHEN 1 THEN 20 ELSE 0 END AS image_score,
  CASE WHEN price IS NULL OR price < 300 THEN 'high' WHEN price > 500000 THEN 'medium' WHEN stock <= 0 AND status = 'active' THEN 'medium' ELSE 'low' END AS pricing_risk FROM y),
o AS (SELECT *, least(100, greatest(0, floor(title_score * 0.3::DOUBLE + description_score * 0.3::DOUBLE + image_score * 0.2::DOUBLE + CASE pricing_risk WHEN 'high' THEN 35 WHEN 'medium' THEN 70 ELSE 100 END * 0.2::DOUBLE + 0.5)))::BIGINT AS overall_score FROM s)
SELECT doc_id, title_score::BIGINT AS title_score, description_score::BIGINT AS description_score, image_score::BIGINT AS image_score, pricing_risk, overall_score,
CASE WHEN pricing_risk <> 'low' THEN 'price_check' WHEN image_score < 70 THEN 'image_fix' WHEN title_score < 75 OR description_score < 75 THEN 'rewrite' WHEN status <> 'active' THEN 'manual_review' ELSE 'no_action' END AS action,
CASE WHEN pricing_risk <> 'low' THEN pricing_risk WHEN image_score < 70 THEN CASE WHEN overall_score < 60 THEN 'high' ELSE 'medium' END WHEN title_score < 75 OR description_score < 75 THEN CASE WHEN overall_score < 65 THEN 'high' ELSE 'medium' END WHEN status <> 'active' THEN 'medium' ELSE 'low' END AS action_priority FROM o""")
def audit_score(t: Tables) -> DataFrame:
    df = scores.audit(_listings(t), "title", "description", "category", "price", "images", "stock", "status")
    return df.select("doc_id", "title_score", "description_score", "image_score", "pricing_risk", "overall_score", "action", "action_priority")


def _share_sql(col: str, topics, weight: int) -> str:
    hits = " + ".join("(" + " OR ".join(f"contains({col}, '{x}')" for x in xs) + ")::INTEGER" for xs in topics)
    return f"floor(({hits})::DOUBLE / {len(topics)} * {weight} + 0.5)"


DECISION, TITLE_TOPICS, DIFFERENT = (("the", "des"), ("tion",), ("ing", "eau"), ("license",)), (("the", "le"), ("er",)), (("public",), ("ment", "hea"))
PRODUCT = ("the", "le")


@query(f"""WITH x AS ({_TEXT_LISTING}), y AS (SELECT *, concat_ws(chr(10), title, description) AS both, regexp_replace(lower(title), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS st, regexp_replace(lower(concat_ws(chr(10), title, description)), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS sb FROM x),
c AS (SELECT doc_id, {_share_sql('sb', DECISION, 40)}::BIGINT AS decision,
  ({_share_sql('st', TITLE_TOPICS, 20)} + CASE WHEN {' OR '.join(f"strpos(st, '{p}') BETWEEN 1 AND 9" for p in PRODUCT)} THEN 3 ELSE 0 END + CASE WHEN length(title) BETWEEN 30 AND 200 THEN 2 ELSE 0 END)::BIGINT AS title_quality,
  {_share_sql('sb', DIFFERENT, 20)}::BIGINT AS differentiation,
  (CASE WHEN length(description) BETWEEN 120 AND 3000 THEN 5 ELSE 0 END + CASE WHEN len(list_filter(string_split(description, chr(10)), lambda p: trim(p, ' ') <> '')) >= 5 THEN 4 ELSE 0 END + CASE WHEN contains(description, chr(10)) THEN 3 ELSE 0 END
   + CASE WHEN {' OR '.join(f"(length(sb) - length(replace(sb, '{p}', ''))) // {len(p)} > 4" for p in PRODUCT)} THEN 0 ELSE 3 END)::BIGINT AS readability FROM y)
SELECT *, decision + title_quality + differentiation + readability AS total FROM c""")
def commercial_score(t: Tables) -> DataFrame:
    parts = scores.commercial(F.col("title"), F.col("description"), DECISION, TITLE_TOPICS, DIFFERENT, PRODUCT, (30, 200), (120, 3000), (F.col("st"), F.col("sb")))
    listings = _listings(t).select("doc_id", "title", "description", text.squeeze(F.col("title")).alias("st"), text.squeeze(F.concat_ws("\n", "title", "description")).alias("sb"))
    df = listings.select("doc_id", *[c.alias(k) for k, c in parts.items()])
    return df.withColumn("total", F.col("decision") + F.col("title_quality") + F.col("differentiation") + F.col("readability"))


@query(f"""WITH x AS ({_TEXT_LISTING}), y AS (SELECT doc_id, length(trim(title, ' ')) < 28 AS a, length(description) < 120 AS b, len(list_filter(string_split(description, chr(10)), lambda p: p <> '')) < 3 AS c,
  length(description) > 0 AND len(list_distinct(list_filter(list_transform(string_split(description, chr(10)), lambda p: trim(p, ' ')), lambda p: p <> ''))) <= 2 AS d FROM x)
SELECT doc_id, least(100, 40 + a::INTEGER * 10 + b::INTEGER * 10 + c::INTEGER * 8 + d::INTEGER * 5)::BIGINT AS opportunity,
CASE WHEN NOT (a OR b OR c OR d) THEN 'low_commercial_coverage' ELSE concat_ws(',', CASE WHEN a THEN 'short_title' END, CASE WHEN b THEN 'short_description' END, CASE WHEN c THEN 'weak_structure' END, CASE WHEN d THEN 'thin_information' END) END AS reasons FROM y""")
def opportunity_score(t: Tables) -> DataFrame:
    score, why = scores.opportunity(F.col("title"), F.col("description"), F.lit(60))
    return _listings(t).select("doc_id", score.alias("opportunity"), why.alias("reasons"))


@query("""WITH x AS (SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS s FROM documents)
SELECT doc_id, floor(((contains(s, 'the'))::INTEGER + (contains(s, 'and'))::INTEGER + (contains(s, 'tion'))::INTEGER + (contains(s, 'worthless'))::INTEGER + (contains(s, 'license'))::INTEGER) * 100::DOUBLE / 5 + 0.5)::BIGINT AS term_coverage,
floor(((contains(s, 'licen') OR contains(s, 'gnu'))::INTEGER + (contains(s, 'tion') OR contains(s, 'ment'))::INTEGER + contains(s, 'zzz')::INTEGER) * 100::DOUBLE / 3 + 0.5)::BIGINT AS topic_coverage FROM x""")
def term_coverage(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", text.coverage(c, TERMS).alias("term_coverage"), text.topic_coverage(c, TOPICS).alias("topic_coverage"))


@query("""WITH b AS (SELECT item_id, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS s FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS s FROM documents),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(s) - 26), lambda i: array_to_string(list_slice(string_split(s, ''), i, i + 27), ''))) AS gram FROM b WHERE length(s) >= 28),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(s) - 26), lambda i: substr(s, i, 28))) AS gram FROM d WHERE length(s) >= 28)
SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (gram) GROUP BY 1, 2""")
def ngram_overlap(t: Tables) -> DataFrame:
    """Documents that share a 28-character stretch with a benchmark item. Up to
    BROADCAST_GRAMS grams of the items go to the documents, whose own grams are then
    not shuffled; beyond them both sides are."""
    squeezed = lambda df, key: df.select(key, text.squeeze(F.col("text")).alias("s"))
    grams = squeezed(t.benchmark, "item_id").select("item_id", F.explode(text.ngrams(F.col("s"), 28)).alias("gram"))
    items = grams.select("item_id", "gram", text.gram_hashes(F.col("gram"), 28)[0].alias("h"))
    if items.count() <= BROADCAST_GRAMS:
        items = F.broadcast(items)
    docs = squeezed(t.documents, "doc_id")
    found = docs.select("doc_id", F.posexplode(text.gram_hashes(F.col("s"), 28)).alias("pos", "h")).join(items, "h")
    # A text's matches are compared with its characters once more: equal hashes aren't enough.
    hits = found.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "item_id", "gram")).alias("hits"))
    met = docs.join(hits, "doc_id").select("doc_id", F.filter("hits", lambda x: F.substring(F.col("s"), x.pos + 1, F.length(x.gram)) == x.gram).alias("x"))
    return met.select("doc_id", F.explode(F.array_distinct(F.transform("x", lambda x: F.struct(x.item_id.alias("item_id"), x.gram.alias("gram"))))).alias("x")).groupBy("doc_id", "x.item_id").agg(F.count("*").alias("n_shared"))


@query("""WITH d AS (SELECT DISTINCT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS term FROM documents), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT d.lang, term, count(*) AS df, max(n) AS n FROM d JOIN n ON n.lang IS NOT DISTINCT FROM d.lang WHERE length(term) BETWEEN 2 AND 24 GROUP BY 1, 2)
SELECT lang, term, df FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS r FROM c WHERE df >= greatest(2, ceil(0.3 * n))) WHERE r <= 20""")
def df_terms(t: Tables) -> DataFrame:
    """For each language (null is one of its own) the 20 terms that most of its documents
    have, of those in 30 % of them; a top-k report."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: F.length(w).between(2, 24)))
    counts = t.documents.select("lang", F.explode(words).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("df"))
    n = t.documents.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("n_docs"))
    common = counts.join(n, F.col("lang").eqNullSafe(F.col("of_lang"))).where(F.col("df") >= F.greatest(F.lit(2), F.ceil(0.3 * F.col("n_docs"))))
    return ordering.running_position(common.select("lang", "term", "df"), ["lang"], [F.desc("df"), F.asc("term")], "place").where("place <= 20").drop("place")


@query("""SELECT page_id, c.pos::INTEGER AS card, c.href AS href, c.label AS label FROM (SELECT page_id, unnest(list_transform(range(len(h)), lambda i: {'pos': i + 1, 'href': h[i + 1], 'label': l[i + 1]})) AS c FROM (
SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages))""")
def html_cards(t: Tables) -> DataFrame:
    return link_cards(t.pages, "page_id", "html")


@query("""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<br\\s*/?\\s*>', chr(10), 'g'), '(?i)<li[^>]*>', chr(10) || '・', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(p|div|li|h1|h2|h3|h4|h5|h6|ul|ol|table)>', chr(10), 'g'), '(?i)</t[dh]>', ' | ', 'g') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</tr>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '&#39;', chr(39), 'g') AS x FROM d),
f AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS x FROM e),
g AS (SELECT page_id, trim(regexp_replace(x, '\\n\\n\\n+', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS x FROM f)
SELECT page_id, sha256(x) AS text_sha, length(x)::BIGINT AS n_chars FROM g""")
def visible_text(t: Tables) -> DataFrame:
    seen = text.visible_text(F.col("html"))
    return t.pages.select("page_id", F.sha2(seen, 256).alias("text_sha"), F.length(seen).cast("long").alias("n_chars"))


@query("""SELECT conv_id, turn, contains(text, '!!') AS repeated_marks, regexp_matches(text, '(?i)(shipping|condition|license)') AS mentions, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n_numbers, length(text)::BIGINT AS n_chars FROM conversations""")
def text_signals(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", text.repeated_marks(c).alias("repeated_marks"), c.rlike("(?i)(shipping|condition|license)").alias("mentions"), F.size(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"), F.length(c).cast("long").alias("n_chars"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS now, lag(string_split(text, ' ')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)
SELECT conv_id, turn, len(list_filter(now, lambda x: NOT list_contains(before, x)))::BIGINT AS n_added, len(list_filter(before, lambda x: NOT list_contains(now, x)))::BIGINT AS n_removed,
array_to_string(list_slice(list_filter(now, lambda x: NOT list_contains(before, x)), 1, 8), ' ') AS first_added FROM w WHERE before IS NOT NULL""")
def line_diff(t: Tables) -> DataFrame:
    """Words that a turn adds to and takes from the turn before (bags, not sets)."""
    words = F.split("text", " ")
    df = t.conversations.select("conv_id", "turn", words.alias("now"), F.lag(words).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("before")).where("before is not null")
    lacking = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.col(b), x))
    added = lacking("now", "before")
    return df.select("conv_id", "turn", F.size(added).cast("long").alias("n_added"), F.size(lacking("before", "now")).cast("long").alias("n_removed"), F.array_join(F.slice(added, 1, 8), " ").alias("first_added"))


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug, length(text) - length(replace(text, 'th', '')) AS th_chars, substr(sha256(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')), 1, 16) AS scope_hash FROM benchmark")
def string_keys(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.benchmark.select("item_id", text.slug(c).alias("slug"), (text.occurrences(c, "th") * 2).alias("th_chars"), F.substring(F.sha2(text.squeeze(c), 256), 1, 16).alias("scope_hash"))
