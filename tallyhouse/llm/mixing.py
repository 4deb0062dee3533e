"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source's repetition rate is its target share of the mixture over its present size. Each document
is repeated as often as a Poisson distribution with that mean says for a number that is drawn from
a hash of its id, so that the count is the same on every run, machine and retry. The repeated
documents are shuffled over all partitions by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import staged, table

#: Without given weights, a source's weight is its number of characters to this power.
TEMPERATURE = 0.7
#: A larger mean is the sum of several Poisson numbers of means up to this.
PART_MEAN = 16.0
#: Terms of the distribution that are summed; what lies beyond has a chance below 1e-13 at PART_MEAN.
TERMS = 80
#: Hexadecimal digits of the hash that make a number from 0 to 1.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts as text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, chars, weight, rate; the weights are shares of the mixture's characters.

    A given mapping names all sources that are wanted (others get rate 0). Without one, weights are
    chars ** temperature. `total` is the mixture's characters, those of the input unless given.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), F.length(F.col("text").cast("string")).alias("n"))
    sizes = sizes.groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("chars", F.lit(float(temperature))))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        sizes = sizes.withColumn("weight", F.coalesce(F.when(F.col("source").isNotNull(), F.element_at(given, F.col("source"))), F.lit(0.0)))
    sums = sizes.agg(F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("all_weight"), F.sum("chars").alias("all_chars"))
    sizes = sizes.crossJoin(F.broadcast(sums))  # one row
    wanted = F.lit(float(total)) if total is not None else F.col("all_chars")
    rate = F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * wanted / F.col("chars")).otherwise(0.0)
    return sizes.select("source", "chars", "weight", rate.alias("rate"))


def _cumulative(rate: Column) -> Column:
    """parts: how many Poisson numbers are summed; cdf: the distribution of one of them."""
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(PART_MEAN))).cast("int")
    mean = rate / parts
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["cdf"], F.array(a["sum"] + p)).alias("cdf"))

    return F.struct(parts.alias("parts"), F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step)["cdf"].alias("cdf"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """row (all columns of docs), rate, copy (from 0) and mix_key; rows lie in the order of mix_key inside partitions
    that mix_key is dealt over, which is a random order of the whole.

    A null id draws as an empty one; repeated rows draw the same number and are each repeated; rows of
    equal mix_key, which are those of one id and copy, lie beside each other in no particular order. A
    null source is a source of its own; a null text counts no characters; an empty table stays empty.
    """
    known = rates(docs, weights, total, temperature).select("source", "rate", _cumulative(F.col("rate")).alias("d"))
    # Written, so that the planner knows its size and broadcasts it only if it is small; a hot source is split by AQE.
    known = staged(known, "rates")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(known, F.col("row.source").cast("string").eqNullSafe(known.source))
    # Numbers are drawn once and then looked up, as a lambda's body is evaluated for every element.
    drawn = F.transform(F.sequence(F.lit(1), F.col("d.parts")), lambda j: uniform(F.col("row.doc_id"), F.lit(seed), j))
    count = F.aggregate(F.transform(drawn, lambda u: F.size(F.filter("d.cdf", lambda c: c <= u))), F.lit(0), lambda a, x: a + x)
    rows = rows.select("row", "rate", F.when(F.col("rate") > 0, count).otherwise(0).alias("n")).where("n > 0")
    rows = rows.select("row", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    rows = rows.withColumn("mix_key", F.xxhash64(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(seed), "copy", F.lit("order")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "mix_key").sortWithinPartitions("mix_key")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """All columns of docs, with rate, copy and mix_key as of replicated(); input columns of these names are replaced."""
    rows = replicated(docs.drop("rate", "copy", "mix_key"), weights, total, temperature, seed)
    return rows.select("row.*", "rate", "copy", "mix_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lang", "source", "n_chars", "copy", F.round("rate", 9).alias("rate"))


OP4_SQL = f"""
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source
), weighed AS (
  SELECT source, chars, pow(chars, {TEMPERATURE}::DOUBLE) AS weight FROM sizes
), rated AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) FILTER (chars > 0) OVER () * sum(chars) OVER () / chars ELSE 0 END AS rate FROM weighed
), parted AS (
  SELECT source, rate, greatest(1, ceil(rate / {PART_MEAN}::DOUBLE))::INT AS parts FROM rated
), terms AS (
  SELECT source, k, exp(-rate / parts) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: rate / parts / i)), 1) AS p
  FROM parted, range(0, {TERMS + 1}) r(k)
), cdf AS (
  SELECT source, list(s ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms) GROUP BY source
), drawn AS (
  SELECT d.*, p.rate, list_sum(list_transform(range(1, p.parts + 1), lambda j: len(list_filter(c.cdf, lambda s: s <=
    ('0x' || substr(md5(concat_ws(':', coalesce(d.doc_id::VARCHAR, ''), '0', j::VARCHAR)), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)}::DOUBLE))))::BIGINT AS n
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INT AS copy, round(rate, 9) AS rate FROM drawn WHERE rate > 0 AND n > 0
"""
