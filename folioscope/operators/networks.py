"""Networks as nodes and edges: co-occurrence in a document, co-citation, coupling; normalised weights.

Only the `top_n` keys of a network make pairs, and keys are reduced to those before documents are joined with themselves, so the
pairs of a document are at most top_n * (top_n - 1) / 2 whatever the document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used, ratio, rounded
from folioscope.functions.textual import plain_title
from folioscope.operators.geography import city_pairs
from folioscope.operators.production import documents_and_citations, keyword_rows
from folioscope.operators.text import document_terms
from folioscope.sources.places import place_key_of

Graph = tuple[DataFrame, DataFrame]


def co_occurrence(members: DataFrame, top_n: int, min_weight: int, labels: DataFrame | None = None) -> Graph:
    """Nodes (id, label, occurrences, degree) and edges (source < target, weight) from distinct (eid, key) rows."""
    kept = F.broadcast(members.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "key").limit(top_n))
    few = members.join(kept.select("key"), "key", "left_semi")
    edges = few.select("eid", F.col("key").alias("source")).join(few.select("eid", F.col("key").alias("target")), "eid").where("source < target")
    edges = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    return assemble(kept, edges, labels)


def assemble(kept: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> Graph:
    """Nodes that have an edge, with their weighted degree, in the usual order."""
    ends = edges.select(F.col("source").alias("key"), "weight").unionByName(edges.select(F.col("target").alias("key"), "weight"))
    nodes = kept.join(ends.groupBy("key").agg(F.sum("weight").alias("degree")), "key")
    if labels is not None:
        nodes = nodes.join(labels, "key", "left")
    else:
        nodes = nodes.withColumn("label", F.col("key"))
    nodes = nodes.select(F.col("key").alias("id"), F.coalesce("label", "key").alias("label"), "occurrences", "degree")
    return nodes.orderBy(F.desc("occurrences"), "id"), edges.select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target")


@operator
def co_word(c: Corpus, top_n: int = 50, min_weight: int = 2, kind: str = "author") -> Graph:
    rows = keyword_rows(c, kind)
    labels = most_used(rows.withColumn("keyword", F.trim("keyword")), ["norm"], "keyword").select(F.col("norm").alias("key"), F.col("keyword").alias("label"))
    return co_occurrence(rows.select("eid", F.col("norm").alias("key")).distinct(), top_n, min_weight, labels)


@operator
def co_authorship(c: Corpus, top_n: int = 50, min_weight: int = 1) -> Graph:
    rows = c.author_rows().where("key is not null")
    return co_occurrence(rows.select("eid", "key").distinct(), top_n, min_weight, most_used(rows, ["key"], "name").withColumnRenamed("name", "label"))


@operator
def co_institution(c: Corpus, top_n: int = 50, min_weight: int = 1, level: str = "parent") -> Graph:
    return co_occurrence(c.organisations(level).select("eid", F.col("org").alias("key")).distinct(), top_n, min_weight)


@operator
def co_country(c: Corpus, top_n: int = 50, min_weight: int = 1) -> Graph:
    return co_occurrence(c.affiliations.where(filled("country")).select("eid", F.col("country").alias("key")).distinct(), top_n, min_weight)


@operator
def co_city(c: Corpus, top_n: int = 50, min_weight: int = 1) -> Graph:
    """Cities of common documents; edges tell whether they cross a border, nodes the country of a city."""
    pairs = city_pairs(c)
    nodes, edges = co_occurrence(pairs.select("eid", F.col("city").alias("key")), top_n, min_weight)
    countries = F.broadcast(most_used(pairs, ["city"], "country").join(F.broadcast(nodes.select(F.col("id").alias("city"))), "city", "left_semi"))
    nodes = nodes.join(countries.withColumnRenamed("city", "id"), "id", "left")
    edges = edges.join(countries.select(F.col("city").alias("source"), F.col("country").alias("ca")), "source", "left").join(countries.select(F.col("city").alias("target"), F.col("country").alias("cb")), "target", "left")
    scope = F.when(F.col("ca") == F.col("cb"), "national").otherwise("international")
    return nodes.orderBy(F.desc("occurrences"), "id"), edges.select("source", "target", "weight", scope.alias("scope")).orderBy(F.desc("weight"), "source", "target")


def cited_works(c: Corpus) -> DataFrame:
    """References with the key of the work they cite: its DOI, or its title if that has 12 letters at least."""
    title = plain_title(F.col("ref_title"))
    key = F.when(filled("ref_doi"), F.concat(F.lit("doi:"), F.lower(F.trim("ref_doi")))).when(F.length(title) >= 12, F.concat(F.lit("t:"), title))
    return c.references.withColumn("key", key).where("key is not null")


def first_cited_author() -> Column:
    name = F.lower(F.trim(F.split_part(F.regexp_replace("ref_authors", ",", ";"), F.lit(";"), F.lit(1))))
    return F.when(F.length(name) >= 2, name)


@operator
def co_citation(c: Corpus, top_n: int = 50, min_weight: int = 2) -> Graph:
    """Works cited together; labels give the usual first author, year and title."""
    rows = cited_works(c)
    keys = F.broadcast(rows.select("eid", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top_n).select("key"))
    few = rows.join(keys, "key", "left_semi")
    author = most_used(few.withColumn("a", F.trim(F.split_part(F.regexp_replace("ref_authors", ",", ";"), F.lit(";"), F.lit(1)))).where("a <> ''"), ["key"], "a")
    labels = keys.join(author, "key", "left").join(most_used(few, ["key"], "ref_year"), "key", "left").join(most_used(few, ["key"], "ref_title"), "key", "left")
    who = F.concat(F.coalesce("a", F.lit("?")), F.coalesce(F.concat(F.lit(" ("), F.col("ref_year").cast("string"), F.lit(")")), F.lit("")))
    labels = labels.select("key", F.concat_ws(" · ", who, F.substring("ref_title", 1, 70)).alias("label"))
    return co_occurrence(rows.select("eid", "key").distinct(), top_n, min_weight, labels)


@operator
def co_citation_authors(c: Corpus, top_n: int = 50, min_weight: int = 2) -> Graph:
    rows = c.references.select("eid", first_cited_author().alias("key")).where("key is not null").distinct()
    return co_occurrence(rows, top_n, min_weight)


@operator
def bibliographic_coupling(c: Corpus, top_n: int = 50, min_weight: int = 2) -> Graph:
    """Documents that cite the same works: the `top_n` with most references, linked by how many they share."""
    rows = cited_works(c).select("eid", "key").distinct()
    kept = F.broadcast(rows.groupBy("eid").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "eid").limit(top_n))
    few = rows.join(kept.select("eid"), "eid", "left_semi")
    edges = few.select("key", F.col("eid").alias("source")).join(few.select("key", F.col("eid").alias("target")), "key").where("source < target")
    edges = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    labels = c.documents.groupBy("eid").agg(F.substring(F.min("title"), 1, 80).alias("label")).withColumnRenamed("eid", "key")
    return assemble(kept.withColumnRenamed("eid", "key"), edges, labels)


@operator
def text_co_occurrence(c: Corpus, field: str = "abstract", ngram: int = 2, top_n: int = 50, min_weight: int = 2, min_documents: int = 2, extra_stopwords: list[str] | None = None) -> Graph:
    rows = document_terms(c, field, ngram, extra_stopwords).withColumnRenamed("term", "key")
    often = F.broadcast(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).orderBy(F.desc("n"), "key").limit(top_n).select("key"))
    return co_occurrence(rows.join(often, "key", "left_semi"), top_n, min_weight)


@operator
def country_map(c: Corpus, places: DataFrame | None = None) -> DataFrame:
    """Countries with documents of one or several countries, and their place on the map.

    `places` has key, map_name, lon and lat of each country (see sources.places); without it no country has a place.
    """
    pairs = c.affiliations.where(filled("country")).select("eid", "country").distinct()
    several = pairs.groupBy("eid").agg(F.count(F.lit(1)).alias("k"))
    counted = documents_and_citations(c, pairs, ["country"])
    scope = pairs.join(several, "eid").groupBy("country").agg(F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("sca"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("mca"))
    out = counted.join(scope, "country")
    if places is None:
        out = out.select("*", F.lit(None).cast("string").alias("map_name"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    else:
        out = out.withColumn("key", place_key_of(F.col("country"))).join(places.select("key", "map_name", "lon", "lat"), "key", "left")
    return out.select("country", "documents", "citations", "sca", "mca", ratio(F.col("mca"), F.col("documents"), 4).alias("mca_ratio"), "map_name", "lon", "lat").orderBy(F.desc("documents"), "country")


NORMALIZATIONS = ("none", "association", "jaccard", "salton", "inclusion", "equivalence")


def normalize(graph: Graph, method: str = "association") -> Graph:
    """Edge weights set against the occurrences of their ends; the counted weight stays in `raw_weight`."""
    if method not in NORMALIZATIONS:
        raise ValueError(f"method must be one of {', '.join(NORMALIZATIONS)}, not {method!r}")
    nodes, edges = graph
    if method == "none":
        return nodes, edges
    sizes = F.broadcast(nodes.select("id", F.col("occurrences").cast("double").alias("s")))
    both = edges.join(sizes.select(F.col("id").alias("source"), F.col("s").alias("a")), "source").join(sizes.select(F.col("id").alias("target"), F.col("s").alias("b")), "target")
    w, a, b = F.col("weight").cast("double"), F.col("a"), F.col("b")
    value = {
        "association": F.try_divide(w, a * b), "jaccard": F.try_divide(w, a + b - w), "salton": F.try_divide(w, F.sqrt(a * b)),
        "inclusion": F.try_divide(w, F.least(a, b)), "equivalence": F.try_divide(w * w, a * b),
    }[method]
    out = both.select("source", "target", F.coalesce(rounded(value, 6), F.lit(0.0)).alias("weight"), F.col("weight").alias("raw_weight"))
    return nodes, out.orderBy(F.desc("weight"), "source", "target")


@operator
def overlay_years(c: Corpus, unit: str, level: str = "parent") -> DataFrame:
    """The mean year of each entity of a unit, (id, overlay_year)."""
    if unit == "authors":
        rows = c.author_rows().where("key is not null").select("eid", F.col("key").alias("id"))
    elif unit == "keywords":
        rows = keyword_rows(c, "all").select("eid", F.col("norm").alias("id"))
    elif unit == "institutions":
        rows = c.organisations(level).select("eid", F.col("org").alias("id"))
    elif unit == "countries":
        rows = c.affiliations.where(filled("country")).select("eid", F.col("country").alias("id"))
    elif unit == "cities":
        rows = city_pairs(c).select("eid", F.col("city").alias("id"))
    else:
        raise ValueError(f"no years for unit {unit!r}")
    years = c.cited().where("year is not null").select("eid", "year").distinct()
    return rows.distinct().join(years, "eid").groupBy("id").agg(rounded(F.avg("year"), 2).alias("overlay_year"))
