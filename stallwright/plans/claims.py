"""Claim packs of all parts: suppliers are the variants, the largest supplier key the one selected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listing_copy as copy
from ..operators import claims
from ..sources.tables import Tables
from .copywriting import _TITLE, _title
from .evidence import supplied_parts
from .registry import query

_PACK = f"""v AS (SELECT l_partkey AS p, l_suppkey AS s, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
f AS (SELECT p, s, CASE WHEN p % 4 > 0 THEN p_size::VARCHAR || '.5' END AS weight, CASE WHEN line < 6 THEN line::VARCHAR END AS quantity, CASE WHEN s_acctbal > 0 THEN n_name END AS country, CASE p_size % 3 WHEN 0 THEN '要組立品' WHEN 1 THEN '完成品' END AS assembly FROM v JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT p, {', '.join(f"CASE WHEN count({x}) = count(*) AND min({x}) = max({x}) THEN min({x}) END AS c_{x}" for x in ('weight', 'quantity', 'country', 'assembly'))} FROM f GROUP BY p),
sel AS (SELECT f.* FROM f QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC) = 1),
x AS (SELECT p_partkey, {_TITLE} AS title, CASE WHEN p_partkey % 5 > 0 THEN 'item' END AS code, sel.*, c.* EXCLUDE (p) FROM part LEFT JOIN sel ON sel.p = p_partkey LEFT JOIN c ON c.p = p_partkey),
y AS (SELECT *, list_filter(['スーツケース', 'キャリーケース', 'キャリーバッグ'], lambda t: contains(title, t)) AS types, list_filter(['SS', 'S', 'M', 'L', 'XL'], lambda s: regexp_matches(upper(title), '(^|[^A-Z])' || s || '\\s*(サイズ|SIZE)($|[^A-Z])')) AS sizes,
  CASE p_partkey % 6 WHEN 0 THEN '2～3泊' WHEN 1 THEN '5～7泊' WHEN 3 THEN '10日' END AS trip FROM x),
r AS (SELECT p_partkey, title, list_filter([
  CASE WHEN len(types) > 0 THEN {{'id': 'parent.product_types', 'title': array_to_string(types, ' '), 'description': types[1] || CASE WHEN len(types) > 1 THEN '（' || array_to_string(types[2:], '／') || '）' ELSE '' END || 'です。'}} END,
  CASE WHEN len(sizes) > 0 THEN {{'id': 'parent.sizes', 'title': array_to_string(sizes, '／') || 'サイズ', 'description': 'サイズは' || array_to_string(sizes, '／') || 'です。'}} END, CASE WHEN trip IS NOT NULL THEN {{'id': 'parent.trip_duration', 'title': trip || '旅行', 'description': '旅行目安は' || trip || 'です。'}} END,
  CASE WHEN coalesce(CASE WHEN code IS NOT NULL THEN weight END, c_weight) IS NOT NULL THEN {{'id': CASE WHEN code IS NOT NULL AND weight IS NOT NULL THEN 'selected_variant' ELSE 'common_across_children' END || '.weight_kg', 'title': coalesce(CASE WHEN code IS NOT NULL THEN weight END, c_weight) || 'kg', 'description': '重量は' || coalesce(CASE WHEN code IS NOT NULL THEN weight END, c_weight) || 'kgです。'}} END,
  CASE WHEN coalesce(CASE WHEN code IS NOT NULL THEN quantity END, c_quantity) IS NOT NULL THEN {{'id': CASE WHEN code IS NOT NULL AND quantity IS NOT NULL THEN 'selected_variant' ELSE 'common_across_children' END || '.package_quantity', 'title': NULL, 'description': '内容数は' || coalesce(CASE WHEN code IS NOT NULL THEN quantity END, c_quantity) || '個です。'}} END,
  CASE WHEN coalesce(CASE WHEN code IS NOT NULL THEN country END, c_country) IS NOT NULL THEN {{'id': CASE WHEN code IS NOT NULL AND country IS NOT NULL THEN 'selected_variant' ELSE 'common_across_children' END || '.country_of_origin', 'title': NULL, 'description': '原産国は' || coalesce(CASE WHEN code IS NOT NULL THEN country END, c_country) || 'です。'}} END,
  CASE WHEN coalesce(CASE WHEN code IS NOT NULL THEN assembly END, c_assembly) IS NOT NULL AND NOT (len(types) > 0 AND coalesce(CASE WHEN code IS NOT NULL THEN assembly END, c_assembly) = '要組立品') THEN {{'id': CASE WHEN code IS NOT NULL AND assembly IS NOT NULL THEN 'selected_variant' ELSE 'common_across_children' END || '.assembly_status', 'title': NULL, 'description': '組立区分は' || coalesce(CASE WHEN code IS NOT NULL THEN assembly END, c_assembly) || 'です。'}} END
  ], lambda k: k IS NOT NULL) AS claims FROM y)"""
_TITLE_IDS = "['parent.sizes', 'selected_variant.weight_kg', 'parent.sizes', 'selected_variant.package_quantity', 'none']"


def _claims(t: Tables) -> DataFrame:
    size = F.col("p_size")
    v = supplied_parts(t).join(t.part, "p_partkey").join(t.supplier, "s_suppkey").join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    assembly = F.when(size % 3 == 0, "要組立品").when(size % 3 == 1, "完成品")
    facts = v.select("p_partkey", "s_suppkey", F.when(F.col("p_partkey") % 4 > 0, F.concat(size.cast("string"), F.lit(".5"))).alias("weight"), F.when(F.col("line") < 6, F.col("line").cast("string")).alias("quantity"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("country"), assembly.alias("assembly"))
    fields = ["weight", "quantity", "country", "assembly"]
    selected = facts.groupBy("p_partkey").agg(F.max_by(F.struct(*fields), "s_suppkey").alias("x")).select("p_partkey", "x.*")
    parts = t.part.select("p_partkey", _title().alias("title"), F.when(F.col("p_partkey") % 5 > 0, "item").alias("code"))
    whole = parts.join(selected, "p_partkey", "left").join(claims.common(facts, "p_partkey"), "p_partkey", "left")
    return whole.withColumn("claims", claims.renderable(F.col("title"), copy.sizes_in(F.col("title")), "code"))


@query(f"WITH {_PACK}, u AS (SELECT p_partkey, unnest(claims) AS c FROM r) SELECT p_partkey, c.id AS id, c.title AS title, c.description AS description FROM u")
def renderable_claims(t: Tables) -> DataFrame:
    """What the copy of each part may claim, from its title, its variants and the one selected."""
    return _claims(t).select("p_partkey", F.explode("claims").alias("c")).select("p_partkey", "c.id", "c.title", "c.description")


@query(f"""WITH {_PACK}, ids AS (SELECT *, list_filter({_TITLE_IDS}, lambda i, n: list_position({_TITLE_IDS}, i) = n) AS t, list_transform(claims, lambda c: c.id) AS d FROM r)
SELECT p_partkey, nullif(array_to_string(list_filter(list_transform(t, lambda i: list_filter(claims, lambda c: c.id = i)[1].title), lambda x: x IS NOT NULL), ' '), '') AS title, nullif(array_to_string(list_transform(claims, lambda c: c.description), chr(10)), '') AS description,
  list_concat(['title_claim_ids must not contain duplicates'], list_filter(list_transform(t, lambda i: CASE WHEN NOT list_contains(d, i) THEN 'Unknown or unavailable title claim ID: ' || i WHEN list_filter(claims, lambda c: c.id = i)[1].title IS NULL THEN 'Claim is not allowed in the title: ' || i END), lambda e: e IS NOT NULL)) AS errors FROM ids""")
def materialised_claims(t: Tables) -> DataFrame:
    """A selection of claims for each part as copy, with what is wrong in it."""
    asked = F.array(*map(F.lit, ("parent.sizes", "selected_variant.weight_kg", "parent.sizes", "selected_variant.package_quantity", "none")))
    title, description, errors = claims.materialised(F.col("claims"), asked, F.transform("claims", lambda c: c.id))
    return _claims(t).select("p_partkey", title.alias("title"), description.alias("description"), errors.alias("errors"))


_TERMS = ", ".join(f"{{'g': '{g}', 't': {[x.lower() for x in terms]}}}" for g, terms in claims.CLEANUP_GROUPS.items())


@query(f"""WITH {_PACK}, s AS (SELECT doc_id, lower(coalesce(text, '')) || CASE WHEN doc_id % 3 = 0 THEN ' 完成品のabs樹脂キャスター' ELSE '' END AS said, lower(array_to_string(list_transform(coalesce(claims, []), lambda c: concat_ws(' ', c.title, c.description)), chr(10))) AS allowed FROM documents LEFT JOIN r ON p_partkey = doc_id)
SELECT doc_id, list_transform(list_filter([{_TERMS}], lambda g: len(list_filter(g.t, lambda x: contains(said, x) AND NOT contains(allowed, x))) > 0), lambda g: g.g) AS unsupported FROM s""")
def unsupported_claim_groups(t: Tables) -> DataFrame:
    """Groups of terms in whole texts that no claim of the part with the text's number has."""
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " 完成品のABS樹脂キャスター").otherwise(""))
    texts = t.documents.select("doc_id", copy.nfkc(said).alias("said")).join(_claims(t).select(F.col("p_partkey").alias("doc_id"), "claims"), "doc_id", "left")
    return texts.select("doc_id", claims.unsupported_groups(F.col("said"), F.coalesce("claims", F.array().cast(f"array<{claims.CLAIM}>"))).alias("unsupported"))
