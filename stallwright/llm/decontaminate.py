"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, names and units of texts and benchmark items become typed placeholders;
windows of template tokens meet in a hash join; and each value behind the item's
placeholders must have one value along an aligned occurrence, which also catches
questions that were only given new numbers or names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

#: White space of any script.
SPACES = "[\\x20\\x09-\\x0D\\x85\\p{Z}]+"
WINDOW = 8
#: A benchmark window needs so many words that are no placeholders; of a whole short
#: item fewer will do, if its placeholders make up for them.
MIN_LITERAL, MIN_SHORT_LITERAL, MIN_SHORT_TOKENS = 5, 3, 6
#: An item leaks if a document holds this share of its usable windows.
COVERAGE = 0.5
#: More distinct benchmark windows, or item tokens, than this are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_TOKENS = 1_000_000, 4_000_000
#: Units of measure and currency (fixed values).
UNITS = (
    "km cm mm m mi ft in kg g mg lb oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "km/h mph kb mb gb tb hz khz mhz ghz w kw kwh v a c f k usd eur gbp jpy dollars dollar euros euro cents cent percent pounds pound meters metres meter metre miles mile"
).split()
#: Numbers in words (fixed values); a unit after one has three letters or more.
NUMERALS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
_any = lambda xs: "|".join(sorted(xs, key=lambda u: (-len(u), u)))
_NAME = "(?<=[\\p{L}\\p{Nd},;:] )\\p{Lu}[\\p{L}'-]*"
_DIGITS, _WORDS = "[0-9]+(?:[.,][0-9]+)*", "[Tt](?:" + _any(x[1:] for x in NUMERALS if x[0] == "t") + ")|" + _any(f"[{x[0].upper()}{x[0]}]{x[1:]}" for x in NUMERALS if x[0] != "t")
_QUANTITY = f"(?:({_DIGITS})[ ]?({_any(UNITS)})|({_WORDS}) ({_any(u for u in UNITS if len(u) > 2 and u.isalpha())}))(?![\\p{{L}}0-9])"
_NUMBER = f"(?:{_DIGITS}|{_WORDS})(?![\\p{{L}}0-9])"
#: Points and commas inside numbers stay.
_PUNCTUATION = "[;:!?\"()\\[\\]{}]+|(?<![0-9])[.,]+|[.,]+(?![0-9])"
#: Marks a placeholder; its type follows, then its value where values are kept.
MARK = "\u0001"


def template(text: Column, values: bool = False) -> Column:
    """Array of template tokens: lower-case words without punctuation, with
    placeholders for numbers (digits or words), names (capitalised inside a sentence)
    and units. With ``values`` a placeholder also carries what it stands for; tokens
    stay aligned. White space of any kind and length counts as one space."""
    value = "$0" if values else ""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), MARK, "")
    t = F.regexp_replace(t, SPACES, " ")
    t = F.regexp_replace(t, _NAME, f"{MARK}n{value}")
    # Digits inside a kept name stay with it.
    alone = f"(?<![0-9][.,])(?<![{MARK}\\p{{L}}0-9])"
    t = F.regexp_replace(t, alone + _QUANTITY, f"{MARK}d{'$1$3' if values else ''} {MARK}u{'$2$4' if values else ''}")
    t = F.regexp_replace(t, alone + _NUMBER, f"{MARK}d{value}")
    t = F.regexp_replace(t, _PUNCTUATION, "")
    return F.split(F.lower(F.trim(t)), " +")


def _starts(words: Column, window: int | Column) -> Column:
    """Window starts (from 0); none in shorter texts."""
    return F.when(F.size(words) >= window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """benchmark(item_id, text) -> (item_id, item, w, v): template tokens, without and
    with values; repeated rows once. ``item`` tells equal item_ids apart; items
    without tokens go."""
    tokens = lambda values: F.filter(template(F.col("text"), values), lambda x: x != "")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(False).alias("w"), tokens(True).alias("v"))
    rows = rows.where(F.size("w") > 0).dropDuplicates(["item_id", "v"])
    return rows.select("item_id", F.xxhash64("item_id", "v").alias("item"), "w", "v")


def plain(tokens: Column) -> Column:
    """Tokens with values; names are words again, as a name is one by its place only."""
    return F.transform(tokens, lambda x: F.regexp_replace(x, f"{MARK}n", ""))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Items -> (item_id, item, way, width, ipos, h, n_windows), usable windows only;
    n_windows is their number in the item by that way.

    Way 0: template windows with enough plain words. Items without any have way 1,
    windows (the whole item, if shorter) with their values, and way 2, the whole
    template, if it has enough plain words, or some and enough tokens in all: its typed
    placeholders in their order then tell it apart."""
    literals = lambda t: F.size(F.filter(t, lambda x: ~x.startswith(MARK)))
    cut = lambda t, size: F.transform(_starts(t, size), lambda i: F.struct(i.alias("ipos"), F.slice(t, i + 1, size).alias("t")))
    hashed = lambda xs: F.transform(xs, lambda x: F.struct(x.ipos.alias("ipos"), F.xxhash64(x.t).alias("h")))
    way = lambda i, width, xs: F.struct(F.lit(i).alias("way"), width.cast("int").alias("width"), xs.alias("xs"))
    w, n = F.col("w"), F.size("w")
    usable, short = F.filter(cut(w, F.lit(window)), lambda x: literals(x.t) >= MIN_LITERAL), F.least(n, F.lit(window))
    # The first word may stand for a name in a running text.
    named = F.concat(F.array(F.lit(f"{MARK}n")), F.slice(w, 2, n))
    wholes = F.transform(F.array(w, named), lambda t: F.struct(F.lit(0).alias("ipos"), F.xxhash64(t).alias("h")))
    exact = way(1, short, hashed(cut(plain(F.col("v")), short)))
    whole = (literals(w) >= MIN_LITERAL) | ((literals(w) >= MIN_SHORT_LITERAL) & (n >= MIN_SHORT_TOKENS))
    others = F.when(whole, F.array(exact, way(2, n, wholes))).otherwise(F.array(exact))
    first = F.transform(F.filter(usable, lambda x: x.ipos == 0), lambda x: F.struct(x.ipos.alias("ipos"), F.slice(named, 1, window).alias("t")))
    ways = F.when(F.size(usable) > 0, F.array(way(0, F.lit(window), hashed(F.concat(usable, first))))).otherwise(others)
    rows = items.select("item_id", "item", F.inline(ways))
    return rows.select("item_id", "item", "way", "width", F.size(F.array_distinct(F.transform("xs", lambda x: x.ipos))).cast("long").alias("n_windows"), F.inline("xs"))


def _same_token(x: Column, y: Column) -> Column:
    """Equal words, or placeholders of one type."""
    word = lambda t: F.regexp_replace(t, f"^{MARK}n", "")
    return (word(x) == word(y)) | (x.startswith(MARK) & (F.substring(x, 1, 2) == F.substring(y, 1, 2)))


def clashes(b: Column, d: Column, width: Column) -> Column:
    """Positions (from 0) of an item's valued tokens b whose value has several values
    among the document's tokens d aligned with them. Only positions inside template
    windows that agree count."""
    agree = F.zip_with(b, d, lambda x, y: F.coalesce(_same_token(x, y), F.lit(False)))
    starts = F.filter(_starts(b, width), lambda i: F.forall(F.slice(agree, i + 1, width), lambda x: x))
    at = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + width - 1))))
    slots = F.transform(at, lambda i: F.struct(i.alias("i"), F.get(b, i).alias("b"), F.get(d, i).alias("d")))
    slots = F.filter(slots, lambda s: s.b.startswith(MARK))
    return F.transform(F.filter(slots, lambda s: F.exists(slots, lambda o: (o.b == s.b) & (o.d != s.d))), lambda s: s.i)


def _document_windows(tokens: Column, widths: list[int]) -> Column:
    """Array of (pos, h) of all windows of the widths."""
    one = lambda size: F.transform(_starts(tokens, size), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(tokens, i + 1, F.lit(size))).alias("h")))
    return F.flatten(F.array(*map(one, widths)))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text) -> (doc_id, text_hash,
    item_id, n_matched, n_windows, coverage), one row for each document and item of
    which it holds at least ``coverage`` of the usable windows with consistent slots:
    along an aligned occurrence a value of the item has one value in the document
    (several may have the same); windows at which it has more don't count.

    Items without usable windows (shorter than ``window``, or mostly placeholders) are
    matched by windows with their values, or by the whole template if its plain words,
    or these and its placeholders, tell it apart; the way with the largest coverage counts.

    Null and empty texts and items match nothing; repeated rows give one row; null ids
    are ids like any other; empty tables give an empty result; other columns are
    ignored. text_hash tells rows with the same doc_id and other texts apart."""
    items = written(benchmark_items(benchmark), "bench-items")
    bench = written(benchmark_windows(items, window), "bench-windows")
    widths = {k: sorted(r.width for r in bench.where(k).select("width").distinct().collect()) for k in ("way <> 1", "way = 1")}
    hashes = bench.select("h").distinct()
    if bench.count() <= BROADCAST_WINDOWS:
        hashes, bench = F.broadcast(hashes), F.broadcast(bench)
    if (items.agg(F.sum(F.size("v"))).first()[0] or 0) <= BROADCAST_TOKENS:
        items = F.broadcast(items)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    words = keyed.select("doc_id", "text_hash", template(F.col("text")).alias("w"))
    sizes = widths["way <> 1"]
    if sizes in ([], [window]):
        found = words.select("doc_id", "text_hash", F.posexplode(F.transform(_starts(F.col("w"), window), lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, F.lit(window))))).alias("pos", "h"))
    else:
        found = words.select("doc_id", "text_hash", F.inline(_document_windows(F.col("w"), sizes)))
    if widths["way = 1"]:
        valued = keyed.select("doc_id", "text_hash", plain(template(F.col("text"), True)).alias("v"))
        found = found.unionByName(valued.select("doc_id", "text_hash", F.inline(_document_windows(F.col("v"), widths["way = 1"]))))
    found = written(found.join(hashes, "h", "left_semi").distinct(), "window-hits")
    hits = found.join(bench, "h").select("doc_id", "text_hash", "item_id", "item", "way", "width", (F.col("pos") - F.col("ipos")).alias("offset"), "ipos", "n_windows")
    # Each aligned occurrence of an item with placeholders: only its documents are read
    # again, and windows whose values clash go.
    slots = items.where(F.exists("v", lambda x: x.startswith(MARK))).select("item", F.col("v").alias("b"))
    aligned = hits.where("way <> 1").select("doc_id", "text_hash", "item", "way", "width", "offset").distinct().join(slots, "item")
    x, y = keyed.alias("x"), aligned.select("doc_id", "text_hash").distinct().alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_hash") == F.col("y.text_hash"))
    valued = x.join(y, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", template(F.col("text"), True).alias("v"))
    x, y = aligned.alias("x"), valued.alias("y")
    # Tokens before the document's start stand as nulls, so that positions stay aligned.
    before = F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(0), -F.col("offset")))
    ours = F.slice(F.concat(before, F.slice("v", F.greatest(F.lit(1), 1 + F.col("offset")), F.size("b"))), 1, F.size("b")).alias("d")
    pairs = x.join(y, same).select("x.doc_id", "x.text_hash", "item", "way", "width", "offset", "b", ours)
    clash = pairs.select("doc_id", "text_hash", "item", "way", "offset", clashes(F.col("b"), F.col("d"), F.col("width")).alias("bad")).where(F.size("bad") > 0).alias("y")
    inside = F.exists("y.bad", lambda i: (i >= F.col("x.ipos")) & (i < F.col("x.ipos") + F.col("x.width")))
    ok = hits.alias("x").join(clash, same & (F.col("x.item") == F.col("y.item")) & (F.col("x.way") == F.col("y.way")) & (F.col("x.offset") == F.col("y.offset")) & inside, "left_anti")
    out = ok.groupBy("doc_id", "text_hash", "item_id", "item", "way").agg(F.count_distinct("ipos").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    out = out.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    best = out.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("coverage", "n_matched", "n_windows")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", "m.n_matched", "m.n_windows", "m.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no benchmark item, with all their columns."""
    bad = leaks(docs, benchmark).select("doc_id", "text_hash").distinct().alias("y")
    x = docs.alias("x")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.xxhash64(F.col("x.text")) == F.col("y.text_hash"))
    return x.join(bad, same, "left_anti")


def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), benchmark_table(spark, sf_dir))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", F.round("coverage", 6).alias("coverage"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
SQL: dict[str, str] = {}
