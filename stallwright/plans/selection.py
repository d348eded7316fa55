"""Selection of listings whose copy gains most, from keys and flags down to a few texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, funnel
from ..sources.tables import Tables
from .evidence import FACTS_OF, ROLES_OF, TERMS_OF, supplied_parts, variants_of
from .registry import query
from .scores import opportunity

#: Least opportunity, and how many listings are selected (a top-k report).
LEAST, MOST = 40, 50
STEPS = ("eligible", "has_copy", "rested", "linked", "no_hero", "has_product", "has_variants")

_FLAGS = f"""links AS (SELECT l_orderkey AS doc_id, l_partkey AS part, l_suppkey, l_discount FROM lineitem),
best AS (SELECT doc_id, arg_min(part, (-l_discount, part)) AS part FROM links GROUP BY doc_id),
made AS (SELECT l_partkey AS part, l_suppkey, min(l_linenumber) AS line FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 2000 GROUP BY ALL),
narrow AS (SELECT d.doc_id, lang IN ('en', 'fr') AND d.doc_id % 10 <> 0 AS eligible, n_chars > 0 AS has_copy, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) AS rested, b.part IS NOT NULL AS linked, p_type <> 'PROMO' AS no_hero,
  p_partkey IS NOT NULL AS has_product, b.part IN (SELECT part FROM made) AS has_variants, b.part FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN part ON p_partkey = b.part),
staged AS (SELECT *, CASE {' '.join(f'WHEN NOT coalesce({s}, false) THEN {i}' for i, s in enumerate(STEPS, 1))} END AS lost_at FROM narrow)"""


def _narrow(t: Tables) -> DataFrame:
    """Keys and flags of all listings; no text is read."""
    reviewed = t.labels.where("quality = 0").select("doc_id").distinct().withColumn("reviewed", F.lit(True))
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min_by("l_partkey", F.struct(-F.col("l_discount"), "l_partkey")).alias("p_partkey"))
    made = _made(t).select("p_partkey").distinct().withColumn("made", F.lit(True))
    listings = t.documents.select("doc_id", (F.col("lang").isin("en", "fr") & (F.col("doc_id") % 10 != 0)).alias("eligible"), (F.col("n_chars") > 0).alias("has_copy"))
    flagged = listings.join(reviewed, "doc_id", "left").join(best, "doc_id", "left").join(t.part.select("p_partkey", "p_type"), "p_partkey", "left").join(made, "p_partkey", "left")
    return funnel.staged(flagged, _steps())


def _steps() -> dict[str, Column]:
    c = F.col
    return dict(zip(STEPS, (c("eligible"), c("has_copy"), c("reviewed").isNull(), c("p_partkey").isNotNull(), c("p_type") != "PROMO", c("p_type").isNotNull(), c("made").isNotNull()), strict=True))


def _made(t: Tables) -> DataFrame:
    return supplied_parts(t).join(t.supplier.where("s_acctbal > 2000").select("s_suppkey"), "s_suppkey")


def _scored(t: Tables, left: DataFrame) -> DataFrame:
    """What is left, with texts, evidence and scores. A listing's variants are those of its
    product that it links to, or all if it links to none of them."""
    links = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("own", F.lit(True))
    own = left.select("doc_id", "p_partkey").join(_made(t), "p_partkey").join(links, ["doc_id", "s_suppkey"], "left")
    any_own = own.groupBy("doc_id").agg(F.bool_or("own").alias("any_own"))
    children = own.join(any_own, "doc_id").where("own or any_own is null").select("doc_id", "p_partkey", "s_suppkey", "line")
    titles = left.join(t.part.select("p_partkey", F.col("p_name").alias("title")), "p_partkey").select("doc_id", "title")
    facts = evidence.facts(titles, variants_of(t, children, "doc_id"), "doc_id")
    texts = t.documents.join(left.select("doc_id"), "doc_id").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("description"))
    scored = evidence.commercial_scores(texts, evidence.profiles(facts, "doc_id"), "doc_id")
    gain, why = opportunity(F.col("title"), F.col("description"), F.col("total"))
    return scored.select("doc_id", "decision", "title_quality", "differentiation", "readability", "total", gain.alias("opportunity"), why.alias("reasons"))


_SQUEEZE = "regexp_replace(lower({0}), '[ \\t\\n\\x0B\\f\\r　]+', '', 'g')"
_SCORED = f"""left_ AS (SELECT doc_id, part FROM staged WHERE lost_at IS NULL), own AS (SELECT doc_id, l.part, m.l_suppkey, line, EXISTS (SELECT 1 FROM links k WHERE k.doc_id = l.doc_id AND k.l_suppkey = m.l_suppkey) AS own FROM left_ l JOIN made m USING (part)),
v AS (SELECT doc_id AS spu, part, l_suppkey, line FROM own QUALIFY own OR NOT bool_or(own) OVER (PARTITION BY doc_id)), titles AS (SELECT doc_id AS spu, p_name AS title FROM left_ JOIN part ON p_partkey = part), {FACTS_OF}, {TERMS_OF}, own_terms AS (SELECT NULL::BIGINT AS p_partkey, NULL::VARCHAR[] AS own), {ROLES_OF},
x AS (SELECT doc_id, CASE WHEN contains(text, '.') THEN split_part(text, '.', 1) ELSE text END AS title, text AS description FROM documents JOIN left_ USING (doc_id)),
s AS (SELECT *, {_SQUEEZE.format('title')} AS st, {_SQUEEZE.format("title || chr(10) || description")} AS sb FROM x),
hit AS (SELECT doc_id, role, count(*) AS n, count(*) FILTER (WHERE len(list_filter(terms, lambda w: contains(sb, {_SQUEEZE.format('w')}))) > 0) AS n_hit FROM s JOIN numbered ON p_partkey = doc_id WHERE role <> 'title' GROUP BY ALL),
th AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda w: contains(st, {_SQUEEZE.format('w')}))) AS n_hit FROM s JOIN numbered ON p_partkey = doc_id WHERE role = 'title'),
sc AS (SELECT doc_id, title, description, coalesce((SELECT floor(n_hit::DOUBLE / n * 40 + 0.5) FROM hit h WHERE h.doc_id = s.doc_id AND role = 'decision'), 0)::BIGINT AS decision, coalesce((SELECT floor(n_hit::DOUBLE / n * 20 + 0.5) FROM hit h WHERE h.doc_id = s.doc_id AND role = 'difference'), 0)::BIGINT AS differentiation,
  (coalesce((SELECT floor(n_hit::DOUBLE / n * 20 + 0.5) FROM th WHERE th.doc_id = s.doc_id), 0) + CASE WHEN len(list_filter(identity_terms[1:3], lambda w: strpos(st, {_SQUEEZE.format('w')}) BETWEEN 1 AND 9)) > 0 THEN 3 ELSE 0 END + CASE WHEN length(title) BETWEEN 28 AND 110 THEN 2 ELSE 0 END)::BIGINT AS title_quality,
  (CASE WHEN length(description) BETWEEN 120 AND 1400 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(description, '【[^】]+】') OR len(list_filter(regexp_split_to_array(description, '[。\\n]'), lambda p: trim(p, ' ') <> '')) >= 5 THEN 4 ELSE 0 END + CASE WHEN regexp_matches(description, '[\\n・●■]') THEN 3 ELSE 0 END
   + CASE WHEN len(list_filter(identity_terms[1:3], lambda w: (length(sb) - length(replace(sb, {_SQUEEZE.format('w')}, ''))) / length({_SQUEEZE.format('w')}) > 4)) > 0 THEN 0 ELSE 3 END)::BIGINT AS readability FROM s JOIN tokens ON p_partkey = doc_id),
tot AS (SELECT *, decision + title_quality + differentiation + readability AS total FROM sc),
opp AS (SELECT *, length(trim(title, ' ')) < 28 AS a, length(description) < 120 AS b, NOT regexp_matches(description, '【[^】]+】') AND len(list_filter(string_split(description, chr(10)), lambda p: p <> '')) < 3 AS c,
  length(description) > 0 AND len(list_distinct(list_filter(list_transform(regexp_split_to_array(description, '[。\\n]'), lambda p: trim(p, ' ')), lambda p: p <> ''))) <= 2 AS d FROM tot),
final AS (SELECT doc_id, decision, title_quality, differentiation, readability, total, greatest(0, least(100, 100 - total + a::INTEGER * 10 + b::INTEGER * 10 + c::INTEGER * 8 + d::INTEGER * 5))::BIGINT AS opportunity,
  CASE WHEN NOT (a OR b OR c OR d) THEN 'low_commercial_coverage' ELSE concat_ws(',', CASE WHEN a THEN 'short_title' END, CASE WHEN b THEN 'short_description' END, CASE WHEN c THEN 'weak_structure' END, CASE WHEN d THEN 'thin_information' END) END AS reasons FROM opp)"""


@query(f"WITH {_FLAGS} SELECT step::INTEGER AS step, name, (SELECT count(*) FROM staged WHERE lost_at IS NULL OR lost_at > step) AS n_left FROM (VALUES (0, 'all'), {', '.join(f'({i}, {s!r})' for i, s in enumerate(STEPS, 1))}) q(step, name)")
def funnel_steps(t: Tables) -> DataFrame:
    """How many listings each step of the selection leaves."""
    return funnel.step_counts(_narrow(t), _steps())


@query(f"WITH {_FLAGS}, {_SCORED} SELECT * FROM final")
def generic_commercial_scores(t: Tables) -> DataFrame:
    """Scores under each listing's own profile, of all that pass the steps on keys."""
    return _scored(t, _narrow(t).where("lost_at is null").select("doc_id", "p_partkey"))


@query(f"WITH {_FLAGS}, {_SCORED} SELECT * FROM final WHERE opportunity >= {LEAST} ORDER BY opportunity DESC, doc_id LIMIT {MOST}")
def selection_funnel(t: Tables) -> DataFrame:
    """The listings whose copy could gain most; a top-k report."""
    left = _narrow(t).where("lost_at is null").select("doc_id", "p_partkey")
    return _scored(t, left).where(F.col("opportunity") >= LEAST).orderBy(F.desc("opportunity"), "doc_id").limit(MOST)
