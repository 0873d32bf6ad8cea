"""How unevenly documents are spread over authors, institutions, countries, cities or sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, ratio, rounded
from folioscope.operators.geography import city_pairs

UNITS = ["authors", "institutions", "countries", "sources", "cities"]


def unit_documents(c: Corpus, unit: str) -> DataFrame:
    """(entity, d): documents of each entity of a unit."""
    if unit == "authors":
        pairs = c.author_rows().where("key is not null").select(F.col("key").alias("entity"), "eid")
    elif unit == "institutions":
        pairs = c.organisations().select(F.col("org").alias("entity"), "eid")
    elif unit == "countries":
        pairs = c.affiliations.where(filled("country")).select(F.col("country").alias("entity"), "eid")
    elif unit == "cities":
        pairs = city_pairs(c).select(F.col("city").alias("entity"), "eid")
    elif unit == "sources":
        pairs = c.documents.where(filled("source")).select(F.col("source").alias("entity"), "eid")
    else:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")
    return pairs.groupBy("entity").agg(F.countDistinct("eid").alias("d"))


def _levels(c: Corpus, unit: str) -> DataFrame:
    """(d, n, t, s) by rising d: entities with d documents, and the running totals of entities and of documents."""
    up = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = unit_documents(c, unit).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return levels.withColumns({"t": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("d")).over(up)})


@operator
def concentration(c: Corpus, unit: str = "authors") -> DataFrame:
    """Gini coefficient, shares of the 4 and 10 largest entities and of the top tenth, one row."""
    levels = _levels(c, unit)
    whole = levels.agg(F.sum("n").alias("entities"), F.sum(F.col("n") * F.col("d")).alias("documents"))
    run = levels.crossJoin(F.broadcast(whole))
    below = F.col("t") - F.col("n")
    # the sum of ranks of the entities of one level is that of below+1 .. t
    ranks = F.col("d") * (F.col("t") * (F.col("t") + 1) - below * (below + 1)) / 2.0
    above = F.col("entities") - F.col("t")
    share = lambda k: F.sum(F.col("d") * F.greatest(F.lit(0), F.least(F.col("n"), k - above)))
    tenth = F.greatest(F.lit(1), F.ceil(F.col("entities") / 10)).cast("long")
    out = run.groupBy("entities", "documents").agg(F.sum(ranks).alias("r"), share(F.lit(4)).alias("c4"), share(F.lit(10)).alias("c10"), share(tenth).alias("c10p"))
    gini = 2 * F.col("r") / (F.col("entities") * F.col("documents")).cast("double") - (F.col("entities") + 1) / F.col("entities").cast("double")
    part = lambda x: ratio(F.col(x), F.col("documents"), 1, 100)
    return out.where("documents > 0").select(F.lit(unit).alias("unit"), "entities", "documents", rounded(gini, 4).alias("gini"), part("c4").alias("cr4"), part("c10").alias("cr10"), part("c10p").alias("top_share_10pct"))


@operator
def concentration_summary(c: Corpus) -> DataFrame:
    rows = [concentration(c, u) for u in UNITS]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@operator
def lorenz(c: Corpus, unit: str = "authors", points: int = 40) -> DataFrame:
    """Cumulative share of documents against that of entities, at up to `points` even steps from nought to all."""
    levels = _levels(c, unit).crossJoin(F.broadcast(_levels(c, unit).agg(F.sum("n").alias("entities"), F.sum(F.col("n") * F.col("d")).alias("documents"))))
    below = F.col("t") - F.col("n")
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(k * F.col("entities") / F.lit(float(points - 1))).cast("long")))
    inside = levels.withColumn("at", F.explode(F.filter(steps, lambda k: (k > below) & (k <= F.col("t")))))
    value = F.col("s") - (F.col("t") - F.col("at")) * F.col("d")
    rows = inside.select(rounded(F.col("at") / F.col("entities").cast("double"), 4).alias("population_share"), rounded(value / F.col("documents").cast("double"), 4).alias("value_share"))
    start = levels.limit(1).select(F.lit(0.0).alias("population_share"), F.lit(0.0).alias("value_share"))
    return start.unionByName(rows).orderBy("population_share")
