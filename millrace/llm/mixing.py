"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's mean repetition rate is its target mass over its own. Each document draws its count from the Poisson
distribution of that mean by inverting it at a uniform number that a hash of seed and doc_id gives, is exploded by the
count, and the copies are sorted globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, table

SEED, TEMPER, PART, TERMS, FEW, SALTS = 17, 0.7, 8, 64, 10_000, 64


def _uniform(*what: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *what)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, total: float | None = None) -> DataFrame:
    """source (null is a source), mass, rate, parts and cdf of each source; mass: bytes of text plus one a document.

    Target mass: `total` (the table's own mass by default) shared by weights, or in proportion to mass ** temper if none
    are given. Sources that weights leaves out get none.
    """
    text = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    by = docs.groupBy("source").agg(F.sum(text.cast("long")).alias("mass"))
    if weights is None:
        by = by.withColumn("w", F.pow(F.col("mass").cast("double"), F.lit(temper)))
    else:
        named = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        by = by.withColumn("w", F.coalesce(*named, F.lit(0.0)))
    by = keep(by, "sources")
    sums = by.agg(F.sum("w").alias("all_w"), F.sum("mass").cast("double").alias("all_mass"))
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * (F.lit(float(total)) if total is not None else F.col("all_mass")) / F.col("mass")).otherwise(F.lit(0.0))
    out = by.join(F.broadcast(sums)).withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    logs = F.lit(0.0)
    each = [F.lit(0.0)]
    for i in range(1, TERMS):
        logs = logs + F.log(F.lit(float(i)))
        each.append(logs)
    mean = F.col("rate") / F.col("parts")
    term = F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda i: F.when(mean > 0, F.exp(i * F.log(mean) - mean - F.col("logs")[i])).otherwise(F.when(i == 0, 1.0).otherwise(0.0)))
    sums_to = F.aggregate("terms", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.try_element_at(acc, F.lit(-1)) + x))))
    return keep(out.withColumn("logs", F.array(*each)).withColumn("terms", term).select("source", "mass", "rate", "parts", sums_to.alias("cdf")), "rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, temper: float = TEMPER, total: float | None = None) -> DataFrame:
    """docs' columns, each row as often as drawn, with copy (from 1) and shuffle_key, in the order of shuffle_key.

    A null source is a source of its own; a null doc_id draws as the text 'null' does; rows that repeat a doc_id draw
    alike; a null text has mass one. Rates above PART are drawn as a sum of equal parts. Columns named copy and
    shuffle_key are replaced. No rows give no rows. Sources are broadcast if no more than FEW, else joined by source and a
    salt, so that a hot source is spread over SALTS tasks either way.
    """
    by = rates(docs, weights, temper, total).select(F.col("source").alias("mix_source"), F.col("parts").alias("mix_parts"), F.col("cdf").alias("mix_cdf"))
    rows = docs.drop("copy", "shuffle_key")
    columns = rows.columns
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if by.count() <= FEW:
        met = rows.join(F.broadcast(by), same)
    else:
        by = by.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("mix_row_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(by, same & (F.col("mix_row_salt") == F.col("mix_salt")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda p: _uniform(F.lit(str(seed)), key, p.cast("string")))
    met = met.withColumn("mix_draws", draws)
    count = F.aggregate("mix_draws", F.lit(0), lambda n, u: n + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    met = met.withColumn("mix_count", count).where("mix_count > 0")
    out = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    return out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}s"), key, F.col("copy").cast("string")))).select(*columns, "copy", "shuffle_key").orderBy("shuffle_key", "doc_id")


def op4_poisson_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key")


ORACLE = f"""
with m as (select source, sum(strlen(coalesce(text, '')) + 1) mass from documents group by source),
r as (select source, power(mass::double, {TEMPER}) / (select sum(power(mass::double, {TEMPER})) from m) * (select sum(mass)::double from m) / mass rate from m),
p as (select source, rate, greatest(1, ceil(rate / {PART})::int) parts from r),
t as (select source, parts, i, exp(i * ln(rate / parts) - rate / parts - lgamma(i + 1.0)) term from p, range({TERMS}) g(i)),
c as (select source, parts, i, sum(term) over (partition by source order by i) c from t),
a as (select source, parts, list(c order by i) cdf from c group by source, parts),
d as (select doc_id, documents.source, a.cdf, unnest(range(1, a.parts + 1)) part from documents join a on documents.source is not distinct from a.source),
n as (select doc_id, source, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}|' || doc_id || '|' || part), 1, 13))::bigint / {float(1 << 52)})))::int n from d group by doc_id, source),
e as (select doc_id, source, unnest(range(1, n + 1))::int as copy from n)
select doc_id, source, copy, md5('{SEED}s|' || doc_id || '|' || copy) shuffle_key from e
"""
QUERIES: dict[str, Query] = {"op4_poisson_mix": op4_poisson_mix}
ORACLES = {"op4_poisson_mix": ORACLE}
