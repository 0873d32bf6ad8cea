"""Topics over time: quartiles of the years in which keywords are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import most_used
from folioscope.operators.production import keyword_rows


def quartiles(rows: DataFrame, key: str, n: int, min_documents: int) -> DataFrame:
    """Documents and year quartiles of the `n` most frequent keys, from rows (key, eid, year).

    Years are counted per key before percentiles are taken, so a very frequent key is a short list of years.
    """
    counted = rows.groupBy(key, "year").agg(F.count(F.lit(1)).alias("k"))
    sums = counted.groupBy(key).agg(F.sum("k").alias("documents"), *(F.rint(F.percentile("year", p, F.col("k"))).cast("long").alias(name) for p, name in ((0.25, "year_q1"), (0.5, "year_median"), (0.75, "year_q3"))))
    kept = sums.where(F.col("documents") >= min_documents).orderBy(F.desc("documents"), key).limit(n)
    return kept.orderBy("year_median", F.desc("documents"), key)


@operator
def trend_topics(c: Corpus, n: int = 25, min_documents: int = 2, kind: str = "author") -> DataFrame:
    """The years in which the most used keywords are used."""
    rows = keyword_rows(c, kind)
    years = c.documents.where("year is not null").groupBy("eid").agg(F.min("year").cast("long").alias("year"))
    dated = rows.select("norm", "eid").distinct().join(years, "eid")
    names = most_used(rows.withColumn("keyword", F.trim("keyword")), ["norm"], "keyword")
    out = quartiles(dated, "norm", n, min_documents).join(names, "norm")
    return out.select("keyword", "documents", "year_q1", "year_median", "year_q3").orderBy("year_median", F.desc("documents"), "keyword")
