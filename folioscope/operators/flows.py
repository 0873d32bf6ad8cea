"""Flows between three fields of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used
from folioscope.operators.production import keyword_rows

THREE = ("authors", "keywords", "sources", "countries", "institutions")


def _values(c: Corpus, name: str, n: int) -> DataFrame:
    """(eid, value) of a field's `n` most frequent values."""
    if name == "authors":
        rows = c.authors.where(filled("name")).select("eid", F.col("name").alias("value"))
    elif name == "keywords":
        words = keyword_rows(c, "author")
        rows = words.join(most_used(words.withColumn("value", F.trim("keyword")), ["norm"], "value"), "norm").select("eid", "value")
    elif name == "sources":
        rows = c.documents.where(filled("source")).select("eid", F.col("source").alias("value"))
    elif name == "countries":
        rows = c.affiliations.where(filled("country")).select("eid", F.col("country").alias("value"))
    elif name == "institutions":
        rows = c.organisations().select("eid", F.col("org").alias("value"))
    else:
        raise ValueError(f"field must be one of {', '.join(THREE)}, not {name!r}")
    rows = rows.distinct()
    best = F.broadcast(rows.groupBy("value").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "value").limit(n).select("value"))
    return rows.join(best, "value", "left_semi")


@operator
def three_fields(c: Corpus, left: str = "authors", middle: str = "keywords", right: str = "sources", n: int = 10, min_weight: int = 1) -> DataFrame:
    """Documents shared by the values of neighbouring fields; values of a field asked for twice are told apart by its place."""
    asked = (left, middle, right)
    parts = []
    for place, name in enumerate(asked):
        label = F.concat(F.lit(f"{place + 1}· "), F.col("value")) if asked.count(name) > 1 else F.col("value")
        parts.append(_values(c, name, n).select("eid", label.alias("value")))
    out = None
    for depth in (0, 1):
        a, b = parts[depth].withColumnRenamed("value", "source"), parts[depth + 1].withColumnRenamed("value", "target")
        links = a.join(b, "eid").groupBy("source", "target").agg(F.countDistinct("eid").alias("value")).where(F.col("value") >= min_weight).withColumn("depth", F.lit(depth).cast("long"))
        out = links if out is None else out.unionByName(links)
    return out.orderBy("depth", F.desc("value"), "source", "target")
