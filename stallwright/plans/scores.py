"""Deterministic scores: listing audit, weighted quality, commercial copy, opportunity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Limits of the listing audit (fixed values).
TITLE_MIN, DESCRIPTION_MIN, PRICE_MIN, PRICE_MAX = 18, 80, 300, 500_000
#: Words that speak of shipping or condition, and of specifications (fixed values).
SHIPPING = ("送料", "配送", "発送", "shipping", "condition", "状態", "新品", "中古")
SPECIFICS = ("サイズ", "寸法", "素材", "カラー", "色", "重量", "sku", "spu", "material", "size", "color", "colour")


def weighted(kind: Column, scores: Sequence[str], weights: Mapping[str, Sequence[float]], other: Sequence[float]) -> Column:
    """Scores weighed by the weights of the row's kind, rounded half up."""
    def total(ws: Sequence[float]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(s) * w for s, w in zip(scores, ws, strict=True)])

    out = total(other)
    for name, ws in weights.items():
        out = F.when(kind == name, total(ws)).otherwise(out)
    return text.js_round(out).cast("long")


def grade(score: Column) -> Column:
    return F.when(score < 40, "critical").when(score < 60, "high").when(score < 80, "medium").otherwise("low")


def penalties(*ps: tuple[Column, int]) -> Column:
    """100 less the penalty of each condition that holds, within 0 and 100."""
    return text.clamp(reduce(lambda a, b: a - b, [F.when(c, n).otherwise(0) for c, n in ps], F.lit(100)))


def audit(df: DataFrame, title: str, description: str, category: str, price: str, images: str, stock: str, status: str, raw: Column | None = None) -> DataFrame:
    """Adds title_score, description_score, image_score, pricing_risk, overall_score,
    action and action_priority. ``images`` is a number of images; words on shipping and
    specifications are looked for in the description and in ``raw``, the row's other
    fields as text."""
    # Lowered once, in a projection of its own.
    said = F.col(description) if raw is None else F.concat_ws("\n", F.col(description), raw)
    df = df.withColumn("__said", F.lower(F.coalesce(said, F.lit(""))))
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    no_title, no_text = t == "", d == ""
    known = (F.coalesce(category, F.lit("")) != "") & F.contains(F.lower(t), F.lower(F.coalesce(category, F.lit(""))))
    ships, specs = (reduce(lambda x, y: x | y, [F.contains("__said", F.lit(w)) for w in words]) for words in (SHIPPING, SPECIFICS))
    ts = penalties((no_title, 80), (~no_title & (F.length(t) < TITLE_MIN), 25), (~no_title & ~known, 15), (~no_title & text.repeated_marks(t), 20))
    ds = penalties((no_text, 55), (~no_text & (F.length(d) < DESCRIPTION_MIN), 30), (~no_text & ~ships, 15), (~no_text & ~specs, 15))
    im = penalties((F.col(images) == 0, 35), (F.col(images) == 1, 20))
    p = F.col(price)
    risk = F.when(p.isNull() | F.isnan(p.cast("double")) | (p < PRICE_MIN), "high").when(p > PRICE_MAX, "medium").when((F.col(stock) <= 0) & (F.col(status) == "active"), "medium").otherwise("low")
    df = df.withColumns({"title_score": ts.cast("long"), "description_score": ds.cast("long"), "image_score": im.cast("long"), "pricing_risk": risk})
    level = F.when(F.col("pricing_risk") == "high", 35).when(F.col("pricing_risk") == "medium", 70).otherwise(100)
    df = df.withColumn("overall_score", text.clamp(text.js_round(F.col("title_score") * 0.3 + F.col("description_score") * 0.3 + F.col("image_score") * 0.2 + level * 0.2)).cast("long"))
    o, weak = F.col("overall_score"), (F.col("title_score") < 75) | (F.col("description_score") < 75)
    inactive = F.coalesce(F.col(status) != "active", F.lit(False))
    action = F.when(F.col("pricing_risk") != "low", "price_check").when(F.col("image_score") < 70, "image_fix").when(weak, "rewrite").when(inactive, "manual_review").otherwise("no_action")
    urgency = (
        F.when(F.col("pricing_risk") != "low", F.col("pricing_risk"))
        .when(F.col("image_score") < 70, F.when(o < 60, "high").otherwise("medium"))
        .when(weak, F.when(o < 65, "high").otherwise("medium"))
        .when(inactive, "medium")
        .otherwise("low")
    )
    return df.withColumns({"action": action, "action_priority": urgency}).drop("__said")


def commercial(title: Column, description: Column, decision: Sequence[Sequence[str]], title_topics: Sequence[Sequence[str]], differentiators: Sequence[Sequence[str]], product: Sequence[str], title_fit: tuple[int, int], text_fit: tuple[int, int], squeezed: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Shares of 40 (decision factors), 25 (title), 20 (differentiators), 15 (reading).
    ``squeezed``: title, and title and description, without white space, where they are
    columns already."""
    st, sb = squeezed or (text.squeeze(title), text.squeeze(F.concat_ws("\n", title, description)))

    def share(t: Column, topics: Sequence[Sequence[str]], weight: int) -> Column:
        if not topics:
            return F.lit(0)
        hit = [F.when(text.n_terms(t, ["".join(x.lower().split()) for x in xs]) > 0, 1).otherwise(0) for xs in topics]
        return text.js_round(reduce(lambda a, b: a + b, hit) / len(topics) * weight)

    flag = lambda p, n: F.when(p, n).otherwise(0)
    early = reduce(lambda a, b: a | b, [F.locate("".join(x.lower().split()), st).between(1, 9) for x in product])
    often = reduce(lambda a, b: a | b, [text.occurrences(sb, "".join(x.lower().split())) > 4 for x in product])
    parts = F.size(F.filter(F.split(description, "[。\n]"), lambda x: F.trim(x) != ""))
    reading = flag(F.length(description).between(*text_fit), 5) + flag(description.rlike("【[^】]+】") | (parts >= 5), 4) + flag(description.rlike("[\n・●■]"), 3) + F.when(often, 0).otherwise(3)
    out = {
        "decision": share(sb, decision, 40),
        "title_quality": share(st, title_topics, 20) + flag(early, 3) + flag(F.length(title).between(*title_fit), 2),
        "differentiation": share(sb, differentiators, 20),
        "readability": reading,
    }
    return {k: v.cast("long") for k, v in out.items()}


def opportunity(title: Column, visible: Column, score: Column) -> tuple[Column, Column]:
    """(how much a text could gain, why), from its commercial score and weak points."""
    n = F.length(visible)
    lines = F.size(F.filter(F.split(visible, "\n"), lambda x: x != ""))
    parts = F.size(F.array_distinct(F.filter(F.transform(F.split(visible, "[。\n]"), lambda x: F.trim(x)), lambda x: x != "")))
    tests = [(F.length(F.trim(title)) < 28, 10, "short_title"), (n < 120, 10, "short_description"), (~visible.rlike("【[^】]+】") & (lines < 3), 8, "weak_structure"), ((n > 0) & (parts <= 2), 5, "thin_information")]
    total = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, _ in tests], text.clamp(100 - score))
    why = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, _, w in tests])), ",")
    return text.clamp(total).cast("long"), F.when(why == "", "low_commercial_coverage").otherwise(why)
