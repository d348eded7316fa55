"""String expressions: normalising, extracting, coverage, repeated terms, HTML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Half up, also for negative halves."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def money(c: Column) -> Column:
    """Number of a formatted amount (thousands marks and currency signs go), else null."""
    return F.regexp_replace(F.trim(c), "[,￥¥$]", "").try_cast("double")


def leading_int(c: Column) -> Column:
    """Integer at the start of a text, else null."""
    return F.regexp_extract(c, "^\\s*([+-]?\\d+)", 1).try_cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def squeeze(c: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", "")


def first_filled(*cs: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def split_list(c: Column) -> Column:
    """Items of a list parted by | or ;, trimmed, without blanks."""
    return F.filter(F.transform(F.split(c, "[|;]"), lambda x: F.trim(x)), lambda x: x != "")


#: Longest suggested title, in characters (fixed value).
LONGEST_TITLE = 80


def suggested_title(*parts: Column) -> Column:
    """The parts' words, each once, cut to the longest title."""
    return F.substring(unique_words(F.concat_ws(" ", *parts)), 1, LONGEST_TITLE)


def unique_words(c: Column) -> Column:
    """Words without later repeats (case ignored), joined by a space."""
    words = F.filter(F.split(c, "\\s+"), lambda w: w != "")
    keep = lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w)))
    return F.array_join(F.aggregate(words, F.array().cast("array<string>"), keep), " ")


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text, with a unit that follows directly."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("\\d+(?:\\.\\d+)?(?:cm|mm|kg|g|ml|l|%)?"), F.lit(0)))


def n_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text contains."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms], F.lit(0))


def coverage(text: Column, terms: Sequence[str]) -> Column:
    """Percentage of the distinct terms of two characters or more in a squeezed text."""
    usable = list(dict.fromkeys(t for t in ("".join(x.lower().split()) for x in terms) if len(t) >= 2))
    return js_round(n_terms(squeeze(text), usable) * 100 / F.lit(len(usable))).cast("long") if usable else F.lit(0).cast("long")


def topic_coverage(text: Column, topics: Sequence[Sequence[str]]) -> Column:
    """Percentage of the topics of which a squeezed text has a term."""
    topics = [t for t in topics if t]
    if not topics:
        return F.lit(0).cast("long")
    t = squeeze(text)
    return js_round(reduce(lambda a, b: a + b, [F.when(n_terms(t, ["".join(x.lower().split()) for x in xs]) > 0, 1).otherwise(0) for xs in topics]) * 100 / F.lit(len(topics))).cast("long")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; none of a shorter text. The text is split into
    characters once: a substring of UTF-8 would walk there from its start each time."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    grams = lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))
    return F.when(F.length(text) >= n, F.array_distinct(F.element_at(F.transform(F.array(chars), grams), 1))).otherwise(F.array().cast("array<string>"))


def gram_hashes(text: Column, n: int) -> Column:
    """Hash of the n characters at each place, as xxhash64 of their array; none of a
    shorter text. No string is built."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    hashes = lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.xxhash64(F.slice(cs, i, F.lit(n))))
    return F.when(F.length(text) >= n, F.element_at(F.transform(F.array(chars), hashes), 1)).otherwise(F.array().cast("array<long>"))


#: Entities of visible text and what they stand for (fixed values), in the order they
#: are replaced.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
#: Tags of visible text and what stands for them (fixed values), in order.
TAGS = {
    "(?is)<style.*?</style>": " ",
    "(?is)<script.*?</script>": " ",
    "(?i)<br\\s*/?\\s*>": "\n",
    "(?i)<li[^>]*>": "\n・",
    "(?i)</(?:p|div|li|h[1-6]|ul|ol|table)>": "\n",
    "(?i)</(?:td|th)>": " | ",
    "(?i)</tr>": "\n",
    "<[^>]+>": " ",
}


def visible_text(html: Column) -> Column:
    """Text that a reader sees: without scripts, styles and tags; blocks end lines, list
    items start with a dot, cells end with a bar; at most one blank line in a row."""
    t = html
    for tag, stands in TAGS.items():
        t = F.regexp_replace(t, tag, stands)
    for entity, stands in ENTITIES.items():
        t = F.regexp_replace(t, f"(?i){entity}", stands)
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def repeated_marks(c: Column) -> Column:
    """Two equal marks in a row, or three words of promotion."""
    return c.rlike("([!！★☆♪])\\1") | c.rlike("(送料無料|新品|セール).*(送料無料|新品|セール).*(送料無料|新品|セール)")


def canonical_hash(*pairs: tuple[str, Column]) -> Column:
    """SHA-256 of the JSON text of the named values, names in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(pairs, key=lambda x: x[0])]), {"ignoreNullFields": "false"}), 256)


def composite_key(*cs: Column) -> Column:
    """Parts joined by colons, nulls as empty."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])


def utf8_cap(c: Column, n: int) -> Column:
    """The longest start of a text of at most n UTF-8 bytes that ends with a whole
    character."""
    raw = F.encode(c, "UTF-8")
    cut = lambda k: F.substring(raw, 1, k)
    whole = [F.when(F.is_valid_utf8(cut(k).cast("string")), cut(k).cast("string")) for k in (n, n - 1, n - 2, n - 3) if k > 0]
    return F.when(F.octet_length(c) <= n, c).otherwise(F.coalesce(*whole, F.lit("")))


def real_date(c: Column) -> Column:
    """A yyyy-mm-dd date that the calendar has."""
    return F.coalesce(c.rlike("^\\d{4}-\\d{2}-\\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def zoned_timestamp(c: Column) -> Column:
    """An ISO timestamp that states its zone."""
    return F.coalesce(c.rlike("^\\d{4}-\\d{2}-\\d{2}T.*(Z|[+-]\\d{2}:\\d{2})$") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def lenient_timestamp(c: Column) -> Column:
    """An ISO date or timestamp, in UTC without a zone; null for anything else."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit(""))).cast("timestamp_ntz")
