"""Evidence facts of products: what all variants of a product agree on, as long rows
with stable ids, an index from terms to evidence, and the profile built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import listing_copy as copy

#: Field dictionary: alternative keys, kind, label, whether a title may use it (fixed values).
FIELDS = (
    (("product-short-name", "product_short_name"), "identity", "商品種別", True),
    (("main_material",), "material", "主素材", True),
    (("representative_color_ja", "main_color"), "variant", "カラー", True),
    (("product_weight_kg",), "weight", "商品重量kg", True),
    (("assembled_size-height_cm",), "dimension", "組立時高さcm", False),
    (("assembled_size-width_cm",), "dimension", "組立時幅cm", False),
    (("assembled_size-length_cm",), "dimension", "組立時奥行cm", False),
    (("package_size-height_cm",), "dimension", "梱包高さcm", False),
    (("package_size-width_cm",), "dimension", "梱包幅cm", False),
    (("package_size-length_cm",), "dimension", "梱包奥行cm", False),
    (("package_size-weight_kg",), "weight", "梱包重量kg", False),
    (("package_quantity",), "quantity", "入数", False),
    (("country_of_origin_ja",), "origin", "原産国", False),
    (("assembly_status",), "assembly", "組立区分", False),
    (("耐荷重",), "specification", "耐荷重", True),
    (("features_from_images",), "feature", "画像確認済み特徴", True),
    (("product_features",), "feature", "仕入先商品特徴", True),
    (("product_specification",), "specification", "仕入先商品仕様", False),
)
#: Label of a product's own title, longest value, kinds that set a product apart, and
#: how many facts and terms a profile has (fixed values).
TITLE_LABEL, LONGEST_VALUE = "商品マスター名", 5000
DIFFERENTIATORS = ("material", "component", "feature", "specification")
DECISIONS, DIFFERENCES, TITLE_TERMS, LEADING_TERMS = 12, 8, 12, 3
NO_IDENTITY = "商品"


def _value(c: Column) -> Column:
    """Without white space around it, cut to the longest value; null if nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(c, "^[\\s\\p{Z}\\uFEFF]+|[\\s\\p{Z}\\uFEFF]+$", ""), 1, LONGEST_VALUE), F.lit(""))


def evidence_id(kind: Column, reference: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("."), F.substring(F.sha2(F.concat(reference, F.lit(":"), value), 256), 1, 12))


def consensus(variants: DataFrame, product: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """variants(product, payload map<string, string>) -> product, n_variants, agreed: for each
    field of the dictionary (of these kinds) the value of its first key that all variants have
    alike, as (pos, key, kind, label, title_eligible, value).

    Counts, minima and maxima by (product, key) combine before the shuffle, however many
    variants a product has; only keys of the dictionary are exploded."""
    spark = variants.sparkSession
    keys = [(key, pos, alt, kind, label, eligible) for pos, (alts, kind, label, eligible) in enumerate(FIELDS, 1) for alt, key in enumerate(alts) if kinds is None or kind in kinds]
    known = F.broadcast(spark.createDataFrame([*keys, ("", 0, 0, "", "", False)], "key string, pos int, alt int, kind string, label string, title_eligible boolean"))
    listed = F.map_entries(F.map_filter(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, v: k.isin([key for key, *_ in keys])))
    marked = F.array_append(listed, F.struct(F.lit("").alias("key"), F.lit("").alias("value")))  # one row a variant, to count them
    entries = variants.select(product, F.inline(marked)).select(product, "key", _value(F.col("value")).alias("value"))
    by_key = entries.groupBy(product, "key").agg(F.count("*").alias("n"), F.count("value").alias("found"), F.min("value").alias("lo"), F.max("value").alias("hi")).join(known, "key")
    seen = F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "alt", "key", "kind", "label", "title_eligible", "found", "lo", "hi"))))
    by_product = by_key.groupBy(product).agg(F.max(F.when(F.col("pos") == 0, F.col("n"))).alias("n_variants"), seen.alias("seen"))
    alike = by_product.select(product, "n_variants", F.filter("seen", lambda x: (x.found == F.col("n_variants")) & (x.lo == x.hi)).alias("alike"))
    first = F.filter("alike", lambda x: ~F.exists("alike", lambda y: (y.pos == x.pos) & (y.alt < x.alt)))
    return alike.select(product, "n_variants", F.transform(first, lambda x: F.struct(x.pos.alias("pos"), x.key.alias("key"), x.kind.alias("kind"), x.label.alias("label"), x.title_eligible.alias("title_eligible"), x.lo.alias("value"))).alias("agreed"))


def facts(products: DataFrame, variants: DataFrame, product: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """products(product, title), variants(product, payload) -> one row a fact: product, pos,
    evidence_id, kind, label, value, source_kind, source_ref, title_eligible.

    A fact whose kind and value (in NFKC, case ignored) came before is left out. Ids are
    hashes of where a value comes from and of the value, so they are the same each time.
    With ``kinds`` only facts of these are made; a kind's facts don't depend on another's."""
    found = products.select(product, "title").join(consensus(variants, product, kinds), product, "left")
    code, title = F.col(product).cast("string"), _value(F.col("title"))
    own = F.struct(
        F.lit(0).alias("pos"), F.lit("identity").alias("kind"), F.lit(TITLE_LABEL).alias("label"), title.alias("value"), F.lit("product_spu").alias("source_kind"),
        F.concat(F.lit("product_spus:"), code, F.lit(":title")).alias("source_ref"), F.concat(F.lit("product_spus."), code, F.lit(".title")).alias("id_ref"), F.lit(True).alias("title_eligible"),
    )
    reference = lambda x: F.concat(F.lit("product_variants.raw_payload:"), code, F.lit(":"), x.key, F.lit(":consensus-"), F.col("n_variants").cast("string"))
    agreed = F.transform("agreed", lambda x: F.struct(x.pos.alias("pos"), x.kind.alias("kind"), x.label.alias("label"), x.value.alias("value"), F.lit("variant_consensus").alias("source_kind"), reference(x).alias("source_ref"), reference(x).alias("id_ref"), x.title_eligible.alias("title_eligible")))
    titled = title.isNotNull() if kinds is None or "identity" in kinds else F.lit(False)
    every = F.concat(F.when(titled, F.array(own)).otherwise(F.array()), F.coalesce(agreed, F.array()))
    rows = found.select(product, F.inline(every)).withColumn("alike", F.lower(copy.in_nfkc(F.col("value"))))
    first = Window.partitionBy(product, "kind", "alike").orderBy("pos")
    kept = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select(product, "pos", evidence_id(F.col("kind"), F.col("id_ref"), F.col("value")).alias("evidence_id"), "kind", "label", "value", "source_kind", "source_ref", "title_eligible")


def term_index(found: DataFrame, product: str) -> DataFrame:
    """facts -> (term, evidence_id, product): which evidence has a term; terms compare in
    lower case. Rows, not lists: a term that half of all products share stays spread."""
    terms = F.transform(copy.evidence_terms(F.col("value")), F.lower)
    return found.select(F.explode(F.array_distinct(terms)).alias("term"), "evidence_id", product)


def profiles(found: DataFrame, product: str, benchmark_terms: DataFrame | None = None) -> DataFrame:
    """facts, benchmark_terms(product, term, pos) -> per product: identity, its terms, decision
    factors and differentiators (id, terms), and title terms (the product's own, then the
    benchmark's). A product has at most as many facts as the dictionary has fields."""
    row = F.struct("pos", "kind", "evidence_id", "value")
    one = found.groupBy(product).agg(F.array_sort(F.collect_list(row)).alias("f"))
    identity = F.coalesce(F.try_element_at(F.filter("f", lambda x: x.kind == "identity"), F.lit(1)).value, F.lit(NO_IDENTITY))
    one = one.select(product, "f", identity.alias("identity")).withColumn("identity_terms", copy.title_tokens(copy.nfkc(F.col("identity"))))
    if benchmark_terms is None:
        one = one.withColumn("benchmark_terms", F.array().cast("array<string>"))
    else:
        ordered = benchmark_terms.where(F.length(_value(F.col("term"))) >= 2).groupBy(product).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("b"))
        one = one.join(ordered, product, "left").withColumn("benchmark_terms", F.array_distinct(F.coalesce(F.col("b.term"), F.array())))
    factor = lambda id_, terms: F.struct(id_.alias("id"), terms.alias("terms"))
    of_facts = lambda keep, n: F.transform(F.slice(F.filter("f", keep), 1, n), lambda x: factor(x.evidence_id, copy.evidence_terms(x.value)))
    leading = F.slice("identity_terms", 1, LEADING_TERMS)
    decisions = F.concat(F.array(factor(F.lit("identity"), leading)), of_facts(lambda x: x.kind != "identity", DECISIONS))
    return one.select(
        product,
        "identity",
        "identity_terms",
        F.filter(decisions, lambda x: F.size(x.terms) > 0).alias("decision_factors"),
        of_facts(lambda x: x.kind.isin(*DIFFERENTIATORS), DIFFERENCES).alias("differentiators"),
        F.slice(F.concat("identity_terms", "benchmark_terms"), 1, TITLE_TERMS).alias("title_terms"),
    )


#: Weights of decision factors, title terms and differentiators, and what lengths of
#: title and description are fit (fixed values).
WEIGHTS = {"decision": 40, "title": 20, "differentiation": 20}
TITLE_FIT, TEXT_FIT = (28, 110), (120, 1400)


def commercial_scores(copies: DataFrame, profile: DataFrame, product: str) -> DataFrame:
    """copies(product, title, description) with the profiles of their products: decision,
    title_quality, differentiation, readability and total. Texts and terms are compared
    in NFKC, lower case and without white space; each text is brought there once."""
    whole = F.concat_ws("\n", "title", "description")
    x = copies.join(profile.select(product, "decision_factors", "differentiators", "title_terms", "identity_terms"), product)
    x = x.select(*copies.columns, copy.compact(copy.nfkc(F.col("title"))).alias("__t"), copy.compact(copy.nfkc(whole)).alias("__b"), *[
        F.transform(copy.nfkc_terms(c), lambda ts: F.transform(ts, copy.compact)).alias(name)
        for name, c in {"__decision": F.col("decision_factors.terms"), "__differ": F.col("differentiators.terms"), "__title": F.transform("title_terms", lambda w: F.array(w)), "__lead": F.array(F.slice("identity_terms", 1, LEADING_TERMS))}.items()
    ])
    share = lambda text, topics, weight: F.when(F.size(topics) == 0, 0).otherwise(F.floor(F.size(F.filter(topics, lambda ts: F.exists(ts, lambda w: F.contains(F.col(text), w)))) / F.size(topics) * weight + 0.5))
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    lead, title, text = F.col("__lead")[0], F.col("title"), F.col("description")
    early = F.exists(lead, lambda w: F.position(w, F.col("__t")).between(1, 9))
    often = F.exists(lead, lambda w: (F.length(w) > 0) & ((F.length("__b") - F.length(F.replace(F.col("__b"), w, F.lit("")))) / F.length(w) > 4))
    parts = F.size(F.filter(F.split(text, "[。\n]"), lambda p: F.trim(p) != ""))
    scores = {
        "decision": share("__b", F.col("__decision"), WEIGHTS["decision"]),
        "title_quality": share("__t", F.col("__title"), WEIGHTS["title"]) + flag(early, 3) + flag(F.length(title).between(*TITLE_FIT), 2),
        "differentiation": share("__b", F.col("__differ"), WEIGHTS["differentiation"]),
        "readability": flag(F.length(text).between(*TEXT_FIT), 5) + flag(text.rlike("【[^】]+】") | (parts >= 5), 4) + flag(text.rlike("[\n・●■]"), 3) + F.when(often, 0).otherwise(3),
    }
    scored = x.select(*copies.columns, *[c.cast("long").alias(k) for k, c in scores.items()])
    return scored.withColumn("total", F.col("decision") + F.col("title_quality") + F.col("differentiation") + F.col("readability"))


def validation_text(label: Column, value: Column) -> Column:
    """A fact as text to check claims against: its label and value with plain numbers and
    the unit that the label names, then a line for each number with a unit in the value."""
    unit = F.when(label.endswith("cm"), "cm").when(label.endswith("kg"), "kg").when(label == "入数", "個").otherwise("")
    whole = F.concat(label, F.lit(": "), copy.canonical_numbers(value), unit)
    return F.array_join(F.concat(F.array(whole), copy.number_aliases(value)), "\n")


def evidence_texts(found: DataFrame, product: str) -> DataFrame:
    """facts -> product, text: the validation text of all its facts in their order."""
    lines = F.array_sort(F.collect_list(F.struct("pos", validation_text(F.col("label"), F.col("value")).alias("line"))))
    return found.groupBy(product).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("text"))


def attribution_errors(claims: DataFrame, found: DataFrame, product: str, claim: Sequence[str]) -> DataFrame:
    """claims(claim ..., product, text, evidence_ids) -> claim ..., errors: a blank text, no
    evidence, and each cited id that isn't one of the product's facts, in their order."""
    cited = claims.select(*claim, product, "text", (F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0).alias("bare"), F.posexplode_outer("evidence_ids").alias("at", "evidence_id"))
    known = found.select(product, "evidence_id", F.lit(True).alias("known"))
    missing = F.when(F.col("evidence_id").isNotNull() & F.col("known").isNull(), F.struct("at", F.concat(F.lit("hard claim references unknown evidence ID: "), "evidence_id").alias("error")))
    errors = cited.join(known, [product, "evidence_id"], "left").groupBy(*claim).agg(F.first("text").alias("text"), F.bool_or("bare").alias("bare"), F.array_sort(F.collect_list(missing)).alias("missing"))
    own = F.array_compact(F.array(F.when(F.coalesce(_value(F.col("text")), F.lit("")) == "", "hard claim text must not be blank"), F.when(F.col("bare"), F.concat(F.lit("hard claim has no evidence: "), F.coalesce("text", F.lit(""))))))
    return errors.select(*claim, F.concat(own, F.transform("missing", lambda x: x.error)).alias("errors"))
