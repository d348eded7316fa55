"""Evidence facts: consensus of variants, stable ids, attribution, plain numbers."""

from pyspark.sql import functions as F

from stallwright.functions import listing_copy as copy
from stallwright.operators import evidence

PAYLOADS = [
    ("A", {"main_material": "スチール", "product_weight_kg": "12.5", "main_color": "黒", "product_features": "可動棚付き", "other": "x"}),
    ("A", {"main_material": " スチール\n", "product_weight_kg": "12.5", "main_color": "白", "product_features": "可動棚付き"}),
    ("B", {"representative_color_ja": "赤", "main_color": "青", "assembled_size-width_cm": "090.00", "features_from_images": "ＡＢＣ", "product_features": "abc"}),
    ("C", None),
    ("C", {"main_material": "木"}),
    ("E", {"main_material": "  "}),
]


def found(spark):
    products = spark.createDataFrame([("A", "収納キャビネット 可動棚付き"), ("B", None), ("C", "C"), ("D", "alone"), ("E", " ")], "spu string, title string")
    return evidence.facts(products, spark.createDataFrame(PAYLOADS, "spu string, payload map<string,string>"), "spu")


def test_only_what_all_variants_share_is_a_fact(spark):
    rows = found(spark).collect()
    values = {(r.spu, r.kind, r.value) for r in rows}
    assert values == {("A", "identity", "収納キャビネット 可動棚付き"), ("A", "material", "スチール"), ("A", "weight", "12.5"), ("A", "feature", "可動棚付き"), ("B", "variant", "赤"), ("B", "dimension", "090.00"), ("B", "feature", "ＡＢＣ"), ("C", "identity", "C"), ("D", "identity", "alone")}
    refs = {r.source_ref for r in rows}
    assert {"product_spus:A:title", "product_variants.raw_payload:A:main_material:consensus-2", "product_variants.raw_payload:B:representative_color_ja:consensus-1"} <= refs
    assert sorted(r.evidence_id for r in rows) == sorted(r.evidence_id for r in found(spark).repartition(3).collect())


def test_profiles_and_texts(spark):
    facts = found(spark)
    terms = spark.createDataFrame([("A", 0, "x"), ("A", 1, "棚板"), ("A", 2, "棚板"), ("D", 0, None)], "spu string, pos int, term string")
    p = {r.spu: r for r in evidence.profiles(facts, "spu", terms).collect()}
    assert p["A"].title_terms == ["収納キャビネット", "可動棚付き", "棚板"]
    assert [d.terms for d in p["A"].decision_factors] == [["収納キャビネット", "可動棚付き"], ["スチール"], ["12.5"], ["可動棚付き"]]
    assert p["B"].identity == "商品"
    texts = {r.spu: r.text for r in evidence.evidence_texts(facts, "spu").collect()}
    assert "組立時幅cm: 90cm" in texts["B"]
    assert "商品重量kg: 12.5kg" in texts["A"]


def test_claims_need_evidence_of_their_own_product(spark):
    facts = found(spark)
    known = {(r.spu, r.kind): r.evidence_id for r in facts.collect()}
    claims = spark.createDataFrame([(1, "A", "素材はスチール", [known["A", "material"]]), (2, "A", "防水仕様", []), (3, "A", " ", ["missing", known["B", "variant"]]), (4, "Z", None, None)], "id int, spu string, text string, evidence_ids array<string>")
    got = {r.id: r.errors for r in evidence.attribution_errors(claims, facts, "spu", ["id"]).collect()}
    unknown = "hard claim references unknown evidence ID: "
    assert got == {1: [], 2: ["hard claim has no evidence: 防水仕様"], 3: ["hard claim text must not be blank", f"{unknown}missing", f"{unknown}{known['B', 'variant']}"], 4: ["hard claim text must not be blank", "hard claim has no evidence: "]}


def test_numbers_are_rewritten_in_one_pass(spark):
    rows = [("007.50cm x 1.50.07", "7.5cm x 1.5.07".replace(".07", ".7"), ["7.5cm"]), ("10 MM, 5ml 0.0個", "10 MM, 5ml 0個", ["10MM", "5ml", "0個"]), ("none", "none", []), ("123456789012345678901.10kg", "123456789012345678901.1kg", ["123456789012345678901.1kg"]), ("100 3日", "100 3日", ["3日"])]
    for r in spark.createDataFrame(rows, "t string, want string, pairs array<string>").select("want", "pairs", copy.canonical_numbers(F.col("t")).alias("got"), copy.number_aliases(F.col("t")).alias("found")).collect():
        assert (r.got, r.found) == (r.want, r.pairs)


def test_facts_of_some_kinds_are_those_of_all(spark):
    every = found(spark)
    products = every.select("spu").distinct().withColumn("title", F.lit("t"))
    variants = spark.createDataFrame(PAYLOADS, "spu string, payload map<string,string>")
    for kinds in (["material"], ["feature", "dimension"], ["identity"]):
        some = evidence.facts(products, variants, "spu", kinds)
        want = evidence.facts(products, variants, "spu").where(F.col("kind").isin(kinds))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect()))


def test_attribution_does_not_carry_texts_of_documents(spark, tables):
    """What is cited are materials; the texts, once for each supplier of a part, aren't needed."""
    from stallwright.plans.evidence import claim_attribution_errors

    plan = claim_attribution_errors(tables)._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line]
    assert any("doc_id" in x for x in read)
    assert not any("text" in x for x in read)
