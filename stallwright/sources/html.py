"""Records from HTML pages by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = '<a href="([^"]*)">([^<]*)</a>'


def link_cards(df: DataFrame, key: str, html: str, pattern: str = LINK) -> DataFrame:
    """(key, card, href, label) of every link, numbered in page order."""
    part = lambda i: F.regexp_extract_all(html, F.lit(pattern), F.lit(i))
    cards = df.select(key, F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("label"))).alias("pos", "c"))
    return cards.select(key, (F.col("pos") + 1).alias("card"), F.col("c.href").alias("href"), F.col("c.label").alias("label"))


def product_cards(df: DataFrame, key: str, html: str, block: str, fields: dict[str, str], sponsored: str, limit: int) -> DataFrame:
    """(key, rank, fields ...) of the first ``limit`` cards of each page: blocks that
    match ``block``, without sponsored ones, each field by a pattern's first group (null
    where it doesn't match), one for each distinct set of fields."""
    blocks = F.filter(F.regexp_extract_all(html, F.lit(block), F.lit(0)), lambda b: ~b.rlike(sponsored))
    fielded = F.transform(blocks, lambda b: F.struct(*[F.nullif(F.regexp_extract(b, p, 1), F.lit("")).alias(name) for name, p in fields.items()]))
    cards = df.select(key, F.posexplode(F.slice(F.array_distinct(fielded), 1, limit)).alias("at", "c"))
    return cards.select(key, (F.col("at") + 1).alias("rank"), "c.*")


def ranked_cards(df: DataFrame, key: str, html: str, block: str, fields: dict[str, str], identity: list[str], sponsored: str, rank: str, limit: int) -> DataFrame:
    """(key, rank, fields ...) of the first ``limit`` cards of each page that aren't
    sponsored and have their identity, one for each identity (the first). A card's rank is
    the number that ``rank`` finds in it, else its place among all cards of the page."""
    cards = F.transform(F.regexp_extract_all(html, F.lit(block), F.lit(0)), lambda b, i: F.struct(b.alias("b"), (i + 1).alias("place")))
    wanted = F.filter(cards, lambda c: ~c.b.rlike(sponsored))
    part = lambda b, p: F.nullif(F.regexp_extract(b, p, 1), F.lit(""))
    fielded = F.transform(wanted, lambda c: F.struct(F.coalesce(part(c.b, rank).try_cast("int"), c.place).alias("rank"), *[part(c.b, p).alias(n) for n, p in fields.items()], F.array(*[part(c.b, fields[n]) for n in identity]).alias("__id")))
    named = df.select(key, F.filter(fielded, lambda c: ~F.exists(c["__id"], lambda x: x.isNull())).alias("c"))
    first = F.filter("c", lambda c, i: F.array_position(F.transform("c", lambda d: d["__id"]), c["__id"]) == i + 1)
    return named.select(key, F.inline(F.slice(first, 1, limit))).drop("__id")
