"""Listing copy on constructed titles and descriptions of all parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing_copy as copy
from ..functions import text
from ..sources.tables import Tables
from .registry import query

_WIDE = "".join(chr(c + 65248) if c != 32 else "　" for c in range(32, 127))
_ASCII = "".join(map(chr, range(32, 127)))

_TITLE = """CASE p_partkey % 6 WHEN 0 THEN 'スーツケース Sサイズ 2～3泊 ' || p_name WHEN 1 THEN '【新品】キャリーケース M/Lサイズ XLサイズ 5泊7泊 ' || p_name WHEN 2 THEN p_name || ' 高さ30cm 木製 リビング用'
  WHEN 3 THEN 'おしゃれ 人気 ' || p_name || ' SSサイズ、10日' WHEN 4 THEN upper(p_name) ELSE 'ソファ 2人掛け 電動 ' || p_name END"""


def _title() -> Column:
    name = F.col("p_name")
    forms = [F.concat(F.lit("スーツケース Sサイズ 2～3泊 "), name), F.concat(F.lit("【新品】キャリーケース M/Lサイズ XLサイズ 5泊7泊 "), name), F.concat(name, F.lit(" 高さ30cm 木製 リビング用")), F.concat(F.lit("おしゃれ 人気 "), name, F.lit(" SSサイズ、10日")), F.upper(name), F.concat(F.lit("ソファ 2人掛け 電動 "), name)]
    out = forms[5]
    for i, f in enumerate(forms[:5]):
        out = F.when(F.col("p_partkey") % 6 == i, f).otherwise(out)
    return out


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '')) AS compact, 'query:' || substr(sha256(lower(replace(p_name, ' ', ''))), 1, 16) AS scope_key, lower(replace(p_name, ' ', '')) AS bare FROM part""")
def compatible_forms(t: Tables) -> DataFrame:
    """Full-width names come back to their plain form."""
    wide = t.part.select("p_partkey", copy.nfkc(F.translate("p_name", _ASCII, _WIDE)).alias("n"))
    return wide.select("p_partkey", copy.compact(F.col("n")).alias("compact"), copy.scope_key(F.col("n")).alias("scope_key"), copy.bare(F.concat(F.lit("【"), F.col("n"), F.lit("】：・"))).alias("bare"))


@query(f"""WITH x AS (SELECT p_partkey, p_brand, p_size, {_TITLE} AS title FROM part),
tok AS (SELECT p_partkey, list_filter(regexp_split_to_array(title, '[\\s　／/・,，、【】［］()（）]+'), lambda w: length(w) BETWEEN 2 AND 24 AND NOT list_contains(['新品', 'おしゃれ', '人気', 'おすすめ', '送料無料', '高級'], w)) AS w FROM x)
SELECT x.p_partkey, title, list_filter(['SS', 'S', 'M', 'L', 'XL'], lambda s: regexp_matches(upper(title), '(^|[^A-Z])' || s || '\\s*(サイズ|SIZE)($|[^A-Z])')) AS sizes,
  CASE x.p_partkey % 6 WHEN 0 THEN '2～3泊' WHEN 1 THEN '5～7泊' WHEN 3 THEN '10日' END AS trip, list_filter(w, lambda v, i: list_position(w, v) = i)[1:10] AS tokens,
  regexp_matches(lower(title), 'cm|高さ|サイズ') AS dimension, contains(title, 'リビング') AS lifestyle, contains(title, '木製') AS detail, contains(title, '人気') AS claim,
  CASE p_size % 3 WHEN 0 THEN 'rakuten' WHEN 1 THEN 'unknown' ELSE 'mercari' END AS platform, p_size::VARCHAR || '.5cm x 3' AS plain FROM x JOIN tok USING (p_partkey)""")
def title_facts(t: Tables) -> DataFrame:
    """Sizes, trip lengths, tokens, keyword families, vocabulary and plain numbers."""
    x = t.part.select("p_partkey", "p_size", _title().alias("title"))
    title, size = F.col("title"), F.col("p_size")
    platform = F.when(size % 3 == 0, " Rakuten").when(size % 3 == 1, "ebay").otherwise("MERCARI ")
    number = F.concat(F.lit("0"), size.cast("string"), F.lit(".50cm x 3.00"))
    words = {k: F.lower(title).rlike(p).alias(k) for k, p in copy.IMAGE_WORDS.items()}
    return x.select("p_partkey", "title", copy.sizes_in(title).alias("sizes"), copy.trip_length(title).alias("trip"), copy.title_tokens(title).alias("tokens"), *words.values(), copy.vocabulary(platform, ["mercari", "rakuten", "amazon", "shopify"]).alias("platform"), copy.plain_numbers(number).alias("plain"))


@query(f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 6 IN (2, 5) THEN p_brand ELSE '' END AS category, {_TITLE} AS title FROM part),
q AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'スーツケース Sサイズ キャリーケース' WHEN 1 THEN 'スーツケース Lサイズ XLサイズ キャリーケース' WHEN 2 THEN category || ' 木製' WHEN 5 THEN category || ' 2人掛け 電動' END AS query FROM x)
SELECT p_partkey, query, 'query:' || substr(sha256(lower(replace(query, ' ', ''))), 1, 16) AS scope_key FROM q""")
def benchmark_scopes(t: Tables) -> DataFrame:
    """Search scope of each listing, null where it has neither a category nor sizes."""
    category = F.when((F.col("p_partkey") % 6).isin(2, 5), F.col("p_brand")).otherwise("")
    q = t.part.select("p_partkey", copy.scope_query(_title(), category).alias("query"))
    return q.select("p_partkey", "query", copy.scope_key(F.col("query")).alias("scope_key"))


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS v FROM documents), p AS (SELECT doc_id, v, list_filter(list_transform(regexp_split_to_array(v, '[。\\n]'), lambda s: trim(regexp_replace(s, '^[・0-9.\\s]+', ''), ' ')), lambda s: length(s) BETWEEN 2 AND 32) AS phrases,
  regexp_extract_all(v, '(?i)[0-9]+(?:\\.[0-9]+)?[ \\t\\n\\x0B\\f\\r]?(?:cm|mm|kg|g|L|ml|個|枚|台|段|人|歳)') AS measures FROM x), u AS (SELECT doc_id, v, list_concat(measures, phrases) AS w FROM p)
SELECT doc_id, CASE WHEN length(v) <= 48 THEN [v] ELSE list_filter(w, lambda z, i: list_position(w, z) = i)[1:8] END AS terms FROM u""")
def evidence_terms_of_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", copy.evidence_terms(F.coalesce("text", F.lit(""))).alias("terms"))


@query("""SELECT p_partkey, length(p_name) < 12 OR p_name IS NULL AS weak_title, p_size % 5 AS n_facts,
  list_filter([CASE WHEN p_size % 5 < 3 THEN 'insufficient_product_evidence' END, CASE WHEN p_size % 4 = 0 THEN 'unsupported_opportunity_type' END, CASE WHEN p_partkey % 7 = 0 THEN 'shop_not_enabled' END], lambda r: r IS NOT NULL) AS preflight,
  CASE WHEN p_size % 5 >= 3 AND p_size % 4 <> 0 AND p_partkey % 7 <> 0 THEN 'auto_fixable' ELSE 'needs_operator_review' END AS disposition FROM part""")
def preflight_dispositions(t: Tables) -> DataFrame:
    """Whether a listing may be fixed without an operator, and why not."""
    from ..operators import dispositions

    reasons = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("out_of_season"))).otherwise(F.array(F.lit("out_of_season"), F.lit("short_title")))
    why = dispositions.preflight(reasons, F.col("p_size") % 5, F.col("p_partkey") % 7 != 0)
    weak = dispositions.weak_copy(F.col("p_name"), None, 12, 0)
    return t.part.select("p_partkey", weak.alias("weak_title"), (F.col("p_size") % 5).alias("n_facts"), why.alias("preflight")).withColumn("disposition", F.when(F.size("preflight") == 0, "auto_fixable").otherwise("needs_operator_review"))


_RESULTS = """SELECT p_partkey, p_size % 11 = 0 AS failed, p_size % 3 <> 0 AS safe, p_size % 4 <> 0 AS preserved, p_size % 6 = 0 AS clash, p_size % 5 <> 0 AS gain, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 20 END AS delta, (p_partkey % 10) / 10.0::DOUBLE AS confidence FROM part"""


@query(f"""WITH r AS ({_RESULTS}), w AS (SELECT *, list_filter([CASE WHEN failed THEN 'pipeline_error' END, CASE WHEN NOT safe THEN 'safety_validation_failed' END, CASE WHEN NOT preserved THEN 'source_not_preserved' END, CASE WHEN clash THEN 'specification_conflict' END,
  CASE WHEN NOT gain THEN 'no_substantive_commercial_gain' END, CASE WHEN delta IS NULL OR delta < 8 THEN 'insufficient_commercial_gain' END, CASE WHEN confidence < 0.6 THEN 'confidence_below_threshold' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT p_partkey, reasons, len(reasons) > 0 AND NOT list_contains(reasons, 'pipeline_error') AS retried, CASE WHEN len(reasons) = 0 THEN 'auto_updated' WHEN NOT failed AND p_partkey % 2 = 0 THEN 'auto_updated_after_repair' ELSE 'needs_operator_review' END AS disposition,
  len(list_filter([contains(array_to_string(reasons, ','), 'safety') OR contains(array_to_string(reasons, ','), 'pipeline'), list_contains(reasons, 'source_not_preserved'), list_contains(reasons, 'specification_conflict'), contains(array_to_string(reasons, ','), 'commercial_gain'), list_contains(reasons, 'confidence_below_threshold')], lambda x: x)) AS n_instructions FROM w""")
def copy_loop_dispositions(t: Tables) -> DataFrame:
    """Results of the copy loop: reasons, one retry with instructions, final disposition.
    The retry of an even part succeeds."""
    from ..operators import dispositions

    k, size = F.col("p_partkey"), F.col("p_size")
    r = t.part.select(
        "p_partkey",
        dispositions.result_reasons(
            error=size % 11 == 0, safe=size % 3 != 0, preserved=size % 4 != 0, conflicts=F.when(size % 6 == 0, 1).otherwise(0), gain=size % 5 != 0, delta=F.when(k % 9 != 0, k % 20), confidence=(k % 10) / 10.0, least_delta=8, least_confidence=0.6
        ).alias("reasons"),
    )
    retried = dispositions.retries(F.col("reasons"))
    return r.select("p_partkey", "reasons", retried.alias("retried"), dispositions.final(F.col("reasons"), retried & (k % 2 == 0)).alias("disposition"), F.size(dispositions.instructions(F.col("reasons"))).cast("long").alias("n_instructions"))


@query("""SELECT p_partkey, p_type = 'PROMO' AND p_size > 10 AND (p_partkey % 10) / 10.0 >= 0.5 AND p_size % 4 > 0 AND p_partkey % 13 <> 0 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS applies FROM part""")
def auto_apply_gate(t: Tables) -> DataFrame:
    from ..operators import dispositions

    gate = dispositions.auto_applies(F.when(F.col("p_type") == "PROMO", "apply").otherwise("review"), F.col("p_size") > 10, (F.col("p_partkey") % 10) / 10.0, 0.5, F.col("p_size") % 4, F.col("p_partkey") % 13 == 0, F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3"])
    return t.part.select("p_partkey", gate.alias("applies"))


_COVERED = "floor(((contains({0}, 'the'))::INTEGER + (contains({0}, 'tion'))::INTEGER + (contains({0}, 'license'))::INTEGER) * 100::DOUBLE / 3 + 0.5)"
_TOPICS = "floor(((contains({0}, 'licen') OR contains({0}, 'gnu'))::INTEGER + (contains({0}, 'and') OR contains({0}, 'ment'))::INTEGER) * 100::DOUBLE / 2 + 0.5)"


@query(f"""WITH x AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS a, lower(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN replace(replace(coalesce(text, ''), 'the', 'a'), 'ment', '') ELSE coalesce(text, '') || ' License tion' END, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS b FROM documents),
c AS (SELECT doc_id, {_COVERED.format('a')} AS ta, {_COVERED.format('b')} AS tb, {_TOPICS.format('a')} AS da, {_TOPICS.format('b')} AS db FROM x), s AS (SELECT *, floor(ta * 0.45::DOUBLE + da * 0.55::DOUBLE + 0.5) AS before_score, floor(tb * 0.45::DOUBLE + db * 0.55::DOUBLE + 0.5) AS proposed_score FROM c)
SELECT doc_id, before_score::BIGINT AS before_score, proposed_score::BIGINT AS proposed_score, (proposed_score - before_score)::BIGINT AS score_delta,
  list_filter([CASE WHEN tb < ta THEN 'benchmark title coverage decreased' END, CASE WHEN db < da THEN 'benchmark description coverage decreased' END], lambda x: x IS NOT NULL) AS regressions FROM s""")
def benchmark_evaluation(t: Tables) -> DataFrame:
    """Proposed against stored whole texts: .45 title terms and .55 topics, and what got worse."""
    from ..operators import dispositions

    before = F.coalesce("text", F.lit(""))
    after = F.when(F.col("doc_id") % 3 == 0, F.replace(F.replace(before, F.lit("the"), F.lit("a")), F.lit("ment"), F.lit(""))).otherwise(F.concat(before, F.lit(" License tion")))
    terms, topics = ("the", "tion", "License"), (("licen", "gnu"), ("and", "ment"))
    scored = t.documents.select("doc_id", *[f(c, w).alias(n) for f, w, p in ((text.coverage, terms, "t"), (text.topic_coverage, topics, "d")) for n, c in ((f"{p}a", before), (f"{p}b", after))])
    return dispositions.against_benchmark(scored, ("ta", "da"), ("tb", "db")).select("doc_id", "before_score", "proposed_score", "score_delta", "regressions")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '最安 の棚' WHEN 1 THEN '幅30cm の棚' ELSE '幅30cm 最安 の棚' END AS title,
  CASE p_partkey % 4 WHEN 0 THEN p_name || 'です。色は白、最安です！木製のリビング用。' || chr(10) || '終わり' WHEN 1 THEN p_name || 'です。色は白、高さ30cm！木製のリビング用。' || chr(10) || '終わり'
    WHEN 2 THEN p_name || 'です。色は白、高さ30cm、最安です！終わり' ELSE p_name || 'です。色は白、高さ30cm、最安です！木製のリビング用。' || chr(10) || '終わり' END AS description, p_partkey % 4 = 3 AS unchanged FROM part""")
def repaired_copy(t: Tables) -> DataFrame:
    """Flagged words of the title and clauses of the description go; the rest stays."""
    k = F.col("p_partkey")
    errors = F.when(k % 4 == 0, F.array(F.lit("Generated copy includes unsourced numeric fact: 30cm"), F.lit("title too long"))).when(k % 4 == 1, F.array(F.lit("Generated copy includes prohibited claim: 最安"))).when(k % 4 == 2, F.array(F.lit("unsupported hard claim: 木製 リビング"))).otherwise(F.array(F.lit("title too long")))
    title = F.lit("幅30cm 最安 の棚")
    description = F.concat("p_name", F.lit("です。色は白、高さ30cm、最安です！木製のリビング用。\n終わり"))
    x = t.part.select("p_partkey", title.alias("old"), description.alias("text"), copy.issues_of(errors).alias("issues"))
    fixed = copy.repaired(copy.repair_parts(x, "old", "text", "issues"), "issues")
    return fixed.select("p_partkey", F.col("repaired_title").alias("title"), F.col("repaired_description").alias("description"), ((F.col("repaired_title") == F.col("old")) & (F.col("repaired_description") == F.col("text"))).alias("unchanged"))


@query("""SELECT p_partkey, array_to_string(list_filter(['【商品概要】', p_name, '', '【特徴・ベネフィット】', '・大容量の収納', '軽い', '', '【商品仕様】', '・サイズ: ' || p_size || 'cm', '色 | 白 |', CASE WHEN p_partkey % 2 = 0 THEN 'サイズ:' || (p_size + 1) || 'cm' END, '',
  '【使用シーン・おすすめ】', 'リビングに', '', '【お手入れ・注意事項】', CASE WHEN p_partkey % 3 = 0 THEN '水洗い不可' END], lambda x: x IS NOT NULL), chr(10)) AS description, CASE WHEN p_partkey % 2 = 0 THEN ['サイズ'] ELSE [] END AS conflicts FROM part""")
def composed_copy(t: Tables) -> DataFrame:
    """Source and addition under one set of sections, repeated lines once, and the
    specifications on which they differ."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    source = F.concat(F.col("p_name"), F.lit("<br>【特徴】<ul><li>大容量の収納</li></ul>【商品スペック】<ul><li>サイズ: "), size, F.lit("cm</li></ul><table><tr><td>色</td><td>白</td></tr></table>"))
    more = F.concat(F.lit("［概要］\n"), F.col("p_name"), F.lit("\n特徴\n軽い\n【スペック】\n"), F.when(k % 2 == 0, F.concat(F.lit("サイズ："), (F.col("p_size") + 1).cast("string"), F.lit("cm"))).otherwise(""), F.lit("\n対応シーン\nリビングに"), F.when(k % 3 == 0, "\n【お手入れ・注意事項】\n水洗い不可").otherwise(""))
    x = t.part.select("p_partkey", copy.nfkc(text.visible_text(source)).alias("a"), copy.nfkc(more).alias("b"))
    x = x.select("p_partkey", copy.section_lines(F.col("a")).alias("a"), copy.section_lines(F.col("b")).alias("b"))
    facts = lambda c: copy.specifications(copy.of_section(F.col(c), "specifications"))
    return x.select("p_partkey", copy.composed(F.col("a"), F.col("b")).alias("description"), copy.conflicts(facts("a"), facts("b")).alias("conflicts"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN [] WHEN 1 THEN ['Generated copy includes unsourced numeric fact: 45cm'] WHEN 2 THEN ['confidence must be a number between 0 and 1', 'Generated copy includes prohibited claim: 最安', 'Generated copy includes hard fact without trusted-fact evidence: キャスター']
  WHEN 3 THEN ['proposal makes no material change to title or description'] WHEN 4 THEN ['suggested title must not be blank when non-null'] ELSE ['suggested title exceeds 127 characters'] END AS errors FROM x""")
def proposal_validation(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    old = F.lit("棚 幅30cm")
    title = F.when(k == 0, "白い棚 幅30cm").when(k == 1, "白い棚 幅45cm").when(k == 2, "最安の棚 キャスター付").when(k == 3, old).when(k == 4, "  ").otherwise(F.repeat(F.lit("棚"), 128))
    confidence = F.when(k == 2, 1.5).otherwise(0.5)
    return t.part.select("p_partkey", copy.proposal_errors(title, F.lit(None).cast("string"), old, F.lit("x"), confidence, F.lit("幅: 30cm 白")).alias("errors"))


@query("""WITH x AS (SELECT p_partkey, p_partkey % 5 AS k FROM part)
SELECT p_partkey, k <> 3 AND k <> 4 AS is_object, CASE WHEN k < 3 THEN p_partkey::VARCHAR END AS title, CASE WHEN k IN (3, 4) THEN ['not an object'] WHEN k = 2 THEN ['confidence out of range', 'findings[1]: severity'] ELSE [] END AS errors FROM x""")
def model_answers(t: Tables) -> DataFrame:
    """JSON objects found in model answers, and what is wrong with their shape."""
    from ..operators import dispositions

    k, id_ = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    fine = F.concat(F.lit('{"title": "'), id_, F.lit('", "confidence": 0.5, "findings": [{"severity": "high"}]}'))
    odd = F.concat(F.lit('{"title": "'), id_, F.lit('", "confidence": 2, "findings": [{"severity": "low"}, {"severity": "awful"}]}'))
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), fine, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Sure! "), fine, F.lit(" Done."))).when(k == 2, odd).when(k == 3, "no json { here").otherwise("[1, 2]")
    x = t.part.select("p_partkey", copy.lenient_json(answer).alias("body"))
    return x.select("p_partkey", F.col("body").isNotNull().alias("is_object"), F.get_json_object("body", "$.title").alias("title"), dispositions.shape_errors(F.col("body")).alias("errors"))
