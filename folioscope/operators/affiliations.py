"""Affiliations per document and per author."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import author_key, filled, most_used, ratio, top
from folioscope.operators.collaboration import authors_per_document


@operator
def documents_by_affiliation_count(c: Corpus) -> DataFrame:
    """Documents by how many parent organisations they name; those naming none are counted under 0."""
    named = c.affiliations.where(filled("parent1")).groupBy("eid").agg(F.countDistinct(F.trim("parent1")).alias("affiliations"))
    eids = c.documents.select("eid").distinct().join(named, "eid", "left")
    counted = eids.groupBy(F.coalesce("affiliations", F.lit(0)).alias("affiliations")).agg(F.count(F.lit(1)).alias("documents"))
    return counted.select("affiliations", "documents", ratio(F.col("documents"), F.sum("documents").over(Window.partitionBy()), 1, 100).alias("share")).orderBy("affiliations")


def author_links(c: Corpus) -> DataFrame:
    """(key, name, eid, org): authors with the organisation of each affiliation they declare; an unnamed one is known by its place."""
    orgs = c.affiliations.groupBy("eid", "aff_pos").agg(F.min(F.when(filled("parent1"), F.trim("parent1"))).alias("org"))
    links = c.author_affiliations.select("eid", "position", "aff_pos").distinct()
    rows = c.author_rows().where("key is not null").join(links, ["eid", "position"]).join(orgs, ["eid", "aff_pos"], "left")
    place = F.concat(F.lit("aff#"), F.coalesce(F.col("aff_pos").cast("string"), F.lit("?")))
    return rows.select("key", "name", "eid", F.coalesce("org", place).alias("org"))


def _attached(c: Corpus) -> DataFrame:
    """Authors of two institutions or more: (key, documents, institutions, max_in_one_document)."""
    links = author_links(c)
    most = links.groupBy("key", "eid").agg(F.countDistinct("org").alias("k")).groupBy("key").agg(F.max("k").alias("max_in_one_document"))
    return links.groupBy("key").agg(F.countDistinct("eid").alias("documents"), F.countDistinct("org").alias("institutions")).where("institutions >= 2").join(most, "key")


@operator
def authors_by_affiliation_count(c: Corpus, n: int | None = 20) -> DataFrame:
    """Authors of two institutions or more, over the corpus and in one document; six of them are listed."""
    sixth = Window.partitionBy("key").orderBy("org")
    listed = author_links(c).select("key", "org").distinct().withColumn("r", F.row_number().over(sixth)).where("r <= 6").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("org")), "; ").alias("affiliations"))
    out = _attached(c).join(listed, "key").join(most_used(c.author_rows(), ["key"], "name"), "key")
    identifier = F.when(F.col("key").startswith("name:"), "").otherwise(F.col("key"))
    out = out.select(F.col("name").alias("author"), identifier.alias("scopus_id"), "documents", "institutions", "max_in_one_document", "affiliations", "key")
    return top(out, n, F.desc("max_in_one_document"), F.desc("institutions"), F.desc("documents"), F.asc("author"), F.asc("key")).drop("key")


@operator
def affiliation_profile(c: Corpus) -> DataFrame:
    """Key figures of affiliations, one row."""
    by_count = documents_by_affiliation_count(c)
    of = lambda test, name: F.coalesce(F.sum(F.when(test, F.col("documents"))), F.lit(0)).alias(name)
    k = F.col("affiliations")
    counted = by_count.agg(of(k == 1, "single_affiliation_documents"), of(k == 2, "two_affiliation_documents"), of(k >= 3, "many_affiliation_documents"))
    whole = c.documents.agg(F.count(F.lit(1)).alias("documents"))
    alone = authors_per_document(c).agg(F.count(F.when(F.col("j") == 1, 1)).alias("single_author_documents"))
    people = c.authors.agg(F.countDistinct(author_key()).alias("authors"))
    several = _attached(c).agg(F.count(F.lit(1)).alias("authors_with_several_affiliations"), F.count(F.when(F.col("max_in_one_document") >= 2, 1)).alias("authors_with_double_affiliation"))
    out = whole
    for part in (alone, counted, people, several):
        out = out.crossJoin(F.broadcast(part))
    share = lambda name: F.coalesce(ratio(F.col(f"{name}_documents"), F.col("documents"), 2, 100), F.lit(0.0)).alias(f"{name}_share")
    kinds = ("single_author", "single_affiliation", "two_affiliation", "many_affiliation")
    return out.select("documents", *(x for kind in kinds for x in (F.col(f"{kind}_documents"), share(kind))), "authors", "authors_with_several_affiliations", "authors_with_double_affiliation")
