"""Claims that a listing's copy may make: rendered from evidence, selected by id, and
looked for in texts that have no evidence for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import listing_copy as copy

#: Product types that a title may name, and an assembly state that says nothing of them (fixed values).
PRODUCT_TYPES, UNASSEMBLED = ("スーツケース", "キャリーケース", "キャリーバッグ"), "要組立品"
#: Terms that need a claim with them, by group (fixed values).
CLEANUP_GROUPS = {
    "unverified_size_class": ("小型", "機内持込", "機内持ち込み"),
    "color": ("ベージュ", "ブラック", "ホワイト", "グレー", "シルバー", "レッド", "ブルー", "グリーン", "ピンク"),
    "surface": ("エンボス加工",),
    "caster": ("360度", "キャスター"),
    "interior": ("メッシュポケット",),
    "material": ("ABSPC", "ABS樹脂", "ABS", "樹脂"),
}
CLAIM = "struct<id:string,source:string,title:string,description:string>"
#: Facts of variants: name, field, whether a number, title and description (fixed values).
FACTS = (("weight_kg", "weight", "{}kg", "重量は{}kgです。"), ("package_quantity", "quantity", None, "内容数は{}個です。"), ("country_of_origin", "country", None, "原産国は{}です。"), ("assembly_status", "assembly", None, "組立区分は{}です。"))


def common(variants: DataFrame, product: str) -> DataFrame:
    """variants(product, weight, quantity, country, assembly) -> product and each field that
    all its variants have alike, as text; null otherwise."""
    alike = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(f"common_{c}")
    return variants.groupBy(product).agg(*[alike(c) for _, c, *_ in FACTS])


def _filled(pattern: str, value: Column) -> Column:
    return F.concat(*[F.lit(p) if p else F.lit("") for p in pattern.split("{}")[:1]], value, F.lit(pattern.split("{}")[1]))


def renderable(title: Column, sizes: Column, item_code: str) -> Column:
    """Claims of a product: its types, sizes, trip length and lock as the title has them,
    and each fact of the selected variant (columns weight, quantity, country, assembly; if
    it has a code), else of all variants alike (common_weight, ...)."""
    none = F.lit(None).cast(CLAIM)
    claim = lambda id_, source, t, d: F.struct(id_.alias("id"), source.alias("source"), (t if t is not None else F.lit(None).cast("string")).alias("title"), d.alias("description"))
    parent = F.lit("parent_spu")
    types = F.array_compact(F.array(*[F.when(F.contains(title, F.lit(p)), p) for p in PRODUCT_TYPES]))
    synonyms = F.slice(types, 2, len(PRODUCT_TYPES))
    said = F.concat(F.get(types, F.lit(0)), F.when(F.size(synonyms) > 0, F.concat(F.lit("（"), F.array_join(synonyms, "／"), F.lit("）"))).otherwise(""), F.lit("です。"))
    listed, trip = F.array_join(F.array_distinct(sizes), "／"), copy.trip_length(title)
    out = [
        F.when(F.size(types) > 0, claim(F.lit("parent.product_types"), parent, F.array_join(types, " "), said)),
        F.when(F.size(sizes) > 0, claim(F.lit("parent.sizes"), parent, F.concat(listed, F.lit("サイズ")), F.concat(F.lit("サイズは"), listed, F.lit("です。")))),
        F.when(trip.isNotNull(), claim(F.lit("parent.trip_duration"), parent, F.concat(trip, F.lit("旅行")), F.concat(F.lit("旅行目安は"), trip, F.lit("です。")))),
        F.when(title.rlike("(?i)TSA\\s*ロック"), claim(F.lit("parent.feature.tsa_lock"), parent, F.lit("TSAロック搭載"), F.lit("TSAロックを搭載しています。"))),
    ]
    for name, c, in_title, text in FACTS:
        own = F.when(F.col(item_code).isNotNull(), F.col(c))
        source = F.when(own.isNotNull(), "selected_variant").otherwise("common_across_children")
        value = F.coalesce(own, F.col(f"common_{c}"))
        found = F.when(value.isNotNull(), claim(F.concat(source, F.lit(f".{name}")), source, _filled(in_title, value) if in_title else None, _filled(text, value)))
        out.append(F.when((value == UNASSEMBLED) & (F.size(types) > 0), none).otherwise(found) if c == "assembly" else found)
    return F.array_compact(F.array(*out))


def materialised(claims: Column, title_ids: Column, description_ids: Column) -> tuple[Column, Column, Column]:
    """(title, description, errors) of a selection of claims by id: each once, in the order
    of the selection; unknown ids and those not allowed in a title are errors."""
    known = lambda id_: F.exists(claims, lambda c: c.id == id_)
    of = lambda id_: F.get(F.filter(claims, lambda c: c.id == id_), F.lit(0))
    t, d = F.array_distinct(title_ids), F.array_distinct(description_ids)
    repeated = [F.when(F.size(u) < F.size(ids), f"{n}_claim_ids must not contain duplicates") for u, ids, n in ((t, title_ids, "title"), (d, description_ids, "description"))]
    wrong_t = F.transform(t, lambda i: F.when(~known(i), F.concat(F.lit("Unknown or unavailable title claim ID: "), i)).when(of(i).title.isNull(), F.concat(F.lit("Claim is not allowed in the title: "), i)))
    wrong_d = F.transform(d, lambda i: F.when(~known(i), F.concat(F.lit("Unknown or unavailable description claim ID: "), i)))
    errors = F.array_compact(F.concat(F.array(*repeated), wrong_t, wrong_d))
    join = lambda texts, sep: F.when(F.size(texts) > 0, F.array_join(texts, sep))
    return join(F.array_compact(F.transform(t, lambda i: of(i).title)), " "), join(F.array_compact(F.transform(d, lambda i: of(i).description)), "\n"), errors


def unsupported_groups(text: Column, claims: Column) -> Column:
    """Groups of which a text (in NFKC) has a term that no claim has; case ignored."""
    said = F.lower(text)
    allowed = F.lower(F.array_join(F.transform(claims, lambda c: F.concat_ws(" ", c.title, c.description)), "\n"))
    bare = lambda t: F.contains(said, F.lit(t.lower())) & ~F.contains(allowed, F.lit(t.lower()))
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, map(bare, terms)), group) for group, terms in CLEANUP_GROUPS.items()]))
