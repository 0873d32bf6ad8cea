"""Countries and cities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, ratio, top
from folioscope.operators.impact import _unit_impact
from folioscope.operators.production import counts_over_time, documents_and_citations


@operator
def first_author_countries(c: Corpus, n: int | None = 20) -> DataFrame:
    """Documents by the country of their lead: the first author's affiliation, else the first one named."""
    places = c.affiliations.where(filled("country")).select("eid", "aff_pos", "country")
    several = places.groupBy("eid").agg(F.countDistinct("country").alias("countries"))
    own = c.author_affiliations.where("position = 1 and aff_pos is not null").select("eid", "aff_pos").distinct()
    lead = places.join(own, ["eid", "aff_pos"]).groupBy("eid").agg(F.min_by("country", F.struct("aff_pos", "country")).alias("country"))
    other = places.join(lead, "eid", "left_anti").groupBy("eid").agg(F.min_by("country", F.struct("aff_pos", "country")).alias("country"))
    rows = lead.unionByName(other).join(several, "eid").join(c.cited(), "eid", "left")
    counted = rows.groupBy("country").agg(
        F.countDistinct("eid").alias("documents"), F.countDistinct(F.when(F.col("countries") == 1, F.col("eid"))).alias("scp"),
        F.countDistinct(F.when(F.col("countries") > 1, F.col("eid"))).alias("mcp"), F.coalesce(F.sum("cited_by"), F.lit(0)).alias("citations"),
    )
    out = counted.select("country", "documents", "scp", "mcp", ratio(F.col("mcp"), F.col("documents"), 4).alias("mcp_ratio"), "citations", ratio(F.col("citations"), F.col("documents"), 2).alias("citations_per_document"))
    return top(out, n, F.desc("documents"), F.desc("citations"), F.asc("country"))


@operator
def corresponding_author_countries(c: Corpus, n: int | None = 20) -> DataFrame:
    return first_author_countries(c, n)


def city_pairs(c: Corpus) -> DataFrame:
    """(eid, city, country): each city of a document once, with the country of its first affiliation."""
    rows = c.affiliations.withColumn("city", F.trim("city")).where("city <> '' and lower(city) not in ('nan', 'none')")
    return rows.groupBy("eid", "city").agg(F.min_by("country", F.struct("aff_pos", "country")).alias("country"))


@operator
def top_cities(c: Corpus, n: int | None = 20) -> DataFrame:
    from folioscope.functions.columns import most_used

    pairs = city_pairs(c)
    counted = documents_and_citations(c, pairs, ["city"])
    inside = c.institution_rows().withColumn("city", F.trim("city")).groupBy("city").agg(F.countDistinct("institution").alias("institutions"))
    out = counted.join(most_used(pairs, ["city"], "country"), "city", "left").join(inside, "city", "left")
    out = out.select("city", "country", "documents", "citations", F.coalesce("institutions", F.lit(0)).alias("institutions"), ratio(F.col("citations"), F.col("documents"), 2).alias("citations_per_document"))
    return top(out, n, F.desc("documents"), F.desc("citations"), F.asc("city"))


@operator
def cities_impact(c: Corpus, n: int | None = 20, min_documents: int = 1) -> DataFrame:
    from folioscope.functions.columns import most_used

    pairs = city_pairs(c)
    scores = _unit_impact(c, pairs.select("eid", "city"), "city", n, min_documents).join(most_used(pairs, ["city"], "country"), "city", "left")
    return scores.select("city", "country", "documents", "citations", "h_index", "g_index", "m_index", "first_year", "last_year").orderBy(F.desc("h_index"), F.desc("citations"), F.desc("documents"), "city")


SCALES = ["Single affiliation", "Local (same city)", "National (same country)", "International"]


@operator
def collaboration_scale(c: Corpus) -> DataFrame:
    """Documents by the reach of their collaboration; a document stored several times counts once, with its most citations."""
    per = city_pairs(c).groupBy("eid").agg(F.countDistinct("city").alias("cities"), F.countDistinct("country").alias("countries"))
    orgs = c.affiliations.where("parent1 is not null").groupBy("eid").agg(F.countDistinct("parent1").alias("orgs"))
    cites = c.cited().groupBy("eid").agg(F.max("cited_by").alias("cites"))
    scale = F.when(F.col("countries") > 1, SCALES[3]).when(F.col("cities") > 1, SCALES[2]).when(F.coalesce("orgs", F.lit(1)) > 1, SCALES[1]).otherwise(SCALES[0])
    rows = per.join(orgs, "eid", "left").join(cites, "eid", "left").select(scale.alias("scale"), F.coalesce("cites", F.lit(0)).alias("cites"))
    return by_category(c, rows, "scale", SCALES, "share")


def by_category(c: Corpus, rows: DataFrame, key: str, categories: list[str], share: str) -> DataFrame:
    """Documents, share and citations of every category, also of empty ones, from rows (key, cites)."""
    spark = c.documents.sparkSession
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.sum("cites").alias("citations"))
    whole = F.broadcast(rows.agg(F.count(F.lit(1)).alias("whole")))
    every = F.broadcast(spark.createDataFrame(list(enumerate(categories)), f"place int, {key} string"))
    out = every.join(counted, key, "left").na.fill(0, ["documents", "citations"]).crossJoin(whole)
    part = F.coalesce(ratio(F.col("documents"), F.col("whole"), 1, 100), F.lit(0.0))
    each = F.coalesce(ratio(F.col("citations"), F.col("documents"), 2), F.lit(0.0))
    return out.orderBy("place").select(key, "documents", part.alias(share), "citations", each.alias("citations_per_document"))


@operator
def cities_over_time(c: Corpus, n: int = 8) -> DataFrame:
    return counts_over_time(c, city_pairs(c).select("eid", "city"), "city", n).select("year", "city", "documents", "cumulative").orderBy("city", "year")


@operator
def city_hierarchy(c: Corpus, n: int | None = 40) -> DataFrame:
    pairs = c.affiliations.withColumn("city", F.trim("city")).where("city <> '' and lower(city) not in ('nan', 'none')").where(filled("country")).select("eid", "country", "city").distinct()
    counted = pairs.groupBy("country", "city").agg(F.countDistinct("eid").alias("documents"))
    whole = pairs.groupBy("country").agg(F.countDistinct("eid").alias("country_documents"))
    inside = c.institution_rows().withColumn("city", F.trim("city")).groupBy("country", "city", "institution").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("eid").alias("d"))
    listed = inside.groupBy("country", "city").agg(
        F.count(F.lit(1)).alias("institutions"), F.min_by("institution", F.struct(-F.col("k"), "institution")).alias("top_institution"),
        F.array_sort(F.collect_list(F.struct(-F.col("k"), "institution", F.concat("institution", F.lit(" ("), F.col("k").cast("string"), F.lit(")")).alias("text")))).alias("all"),
    )
    out = counted.join(whole, "country").join(listed, ["country", "city"], "left")
    out = out.select(
        "country", "city", F.coalesce("institutions", F.lit(0)).alias("institutions"), "documents", "top_institution",
        ratio(F.col("documents"), F.col("country_documents"), 1, 100).alias("share_of_country"), F.coalesce(F.array_join("all.text", "; "), F.lit("")).alias("institution_affiliations"),
    )
    return top(out, n, F.asc("country"), F.desc("documents"), F.asc("city"))
