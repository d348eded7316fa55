"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate that brings its characters to its target
share; a hash of the document is a uniform draw, the inverse Poisson distribution
function turns it into a count, the document is exploded by its count, and a hash of
document and copy places every copy, in whatever partition and order it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

SEED = "mix-1"
#: Without given weights a source weighs its size to this power.
TEMPERATURE = 0.5
#: A source table of at most so many rows is broadcast.
BROADCAST_SOURCES = 100_000
#: No further terms of the distribution function are tabulated beyond mean + so many
#: deviations + so many terms; what is left is below a draw's resolution (2^-52).
DEVIATIONS, TERMS = 12, 40


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5, as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(rate: Column) -> Column:
    """Distribution function at 0, 1, 2 ... of a Poisson variable with this mean (up
    to 600; a larger mean is a sum of several draws)."""
    last = F.ceil(rate + DEVIATIONS * F.sqrt(rate) + TERMS).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda acc, k: F.struct((acc.p * rate / k).alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc.cdf)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """(src, rate): rate x characters of a source = epochs x all characters x its
    share of the weights. Sources of no characters, or with no given weight, get 0."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src")).agg(F.sum(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow("size", F.lit(float(temperature)))).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "src string, weight double")
        weighed = sizes.join(given, "src", "left").withColumn("weight", F.when(F.col("size") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0))
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.lit(float(epochs)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    return weighed.join(F.broadcast(total)).select("src", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """All columns of docs for every copy, with copy_no (from 1) and shuffle_key, spread
    over partitions and sorted in them by shuffle_key: a global shuffle. The key is a
    hash, so its hash partitions are even and need no sampling pass.

    A draw depends on seed, doc_id and text alone, so repeated rows get the same
    count. A null source is the source ''; a null text has no characters; an empty
    table gives an empty result. Columns of docs named copy_no or shuffle_key are
    replaced; all others may have any name."""
    names = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    rates = written(source_rates(docs, weights, epochs, temperature).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / 600))), "mix-rates")
    rates = rates.select("src", "parts", F.when(F.col("rate") > 0, poisson_table(F.col("rate") / F.col("parts"))).alias("cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), key.alias("id")).join(rates, "src")
    draw = lambda part: F.size(F.filter("cdf", lambda c: c <= uniform(F.col("id"), part.cast("string"))))
    count = F.when(F.col("cdf").isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("parts").cast("int")), F.lit(0), lambda a, part: a + draw(part)))
    d = d.withColumn("n", count).where("n > 0").select("doc", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    d = d.select("doc.*", "copy_no", F.md5(F.concat_ws("|", "id", F.lit("copy"), F.col("copy_no").cast("string"))).alias("shuffle_key"))
    return d.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy_no")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", "copy_no", "shuffle_key")


OP1_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS src, sum(length(coalesce(text, ''))::DOUBLE) AS size FROM documents GROUP BY 1),
weighed AS (SELECT src, size, CASE WHEN size > 0 THEN pow(size, {TEMPERATURE}) ELSE 0.0 END AS weight FROM sizes),
total AS (SELECT sum(size) AS all_size, sum(weight) AS all_weight FROM weighed),
rates AS (
  SELECT src, CASE WHEN size > 0 AND all_weight > 0 THEN 1.0::DOUBLE * all_size * weight / all_weight / size ELSE 0.0::DOUBLE END AS rate
  FROM weighed, total),
terms AS (
  SELECT src, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rates WHERE rate > 0
  UNION ALL
  SELECT src, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + {DEVIATIONS} * sqrt(rate) + {TERMS})),
draws AS (
  SELECT d.*, coalesce(source, '') AS src, '{SEED}|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id FROM documents d),
counted AS (
  SELECT doc_id, source, lang, n_chars, text, id, (
    SELECT count(*) FROM terms t WHERE t.src = draws.src
      AND t.cdf <= (('0x' || substr(md5(id || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS n
  FROM draws)
SELECT doc_id, source, lang, n_chars, text, c.k::INTEGER AS copy_no, md5(id || '|copy|' || c.k::VARCHAR) AS shuffle_key
FROM counted, (SELECT unnest(range(1, 2000)) AS k) c WHERE c.k <= n
"""
QUERIES = {"op1_poisson_mix": op1_poisson_mix}
SQL = {"op1_poisson_mix": OP1_SQL}
