"""Overview: the corpus in key figures, and lists of its documents and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import author_key, filled, most_used, ratio, rounded, top
from folioscope.operators.citations import first_authors, local_citations
from folioscope.operators.collaboration import authors_per_document
from folioscope.operators.growth import yearly
from folioscope.operators.impact import normalized_citations


def _one(c: Corpus, *parts: DataFrame) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(F.broadcast(more))
    return out


@operator
def summary(c: Corpus) -> DataFrame:
    d = c.documents.agg(F.count(F.lit(1)).alias("documents"), F.min("year").cast("long").alias("year_min"), F.max("year").cast("long").alias("year_max"), F.countDistinct(F.when(filled("source"), F.col("source"))).alias("sources"), F.coalesce(F.sum(F.col("cited_by").cast("long")), F.lit(0)).alias("citations"))
    without = c.documents.join(c.references.select("eid"), "eid", "left_anti").agg(F.count(F.lit(1)).alias("documents_without_references"))
    return _one(
        c, d, c.authors.agg(F.countDistinct(author_key()).alias("authors")), c.affiliations.agg(F.countDistinct("raw").alias("affiliations"), F.countDistinct(F.when(filled("country"), F.col("country"))).alias("countries")),
        c.institution_rows().agg(F.countDistinct("institution").alias("institutions")), c.keywords.where("kind = 'author'").agg(F.countDistinct("keyword").alias("keywords")), c.references.agg(F.count(F.lit(1)).alias("references")), without,
    )


@operator
def main_information(c: Corpus) -> DataFrame:
    """Key figures of the corpus, one row."""
    d = c.documents.agg(
        F.count(F.lit(1)).alias("documents"), F.min("year").cast("long").alias("year_min"), F.max("year").cast("long").alias("year_max"), rounded(F.max("year") - F.avg("year"), 2).alias("document_average_age"),
        F.countDistinct("source").alias("sources"), F.countDistinct("doc_type").alias("document_types"), F.coalesce(F.sum(F.col("cited_by").cast("long")), F.lit(0)).alias("total_citations"),
    )
    ends = yearly(c).agg(F.min_by("documents", "year").alias("first"), F.max_by("documents", "year").alias("last"), (F.max("year") - F.min("year")).alias("span"))
    growth = ends.select(F.when(F.col("span") > 0, rounded((F.pow(F.col("last") / F.col("first").cast("double"), F.try_divide(F.lit(1.0), F.col("span"))) - 1) * 100, 2)).alias("annual_growth_rate"))
    counted = authors_per_document(c).groupBy("j").agg(F.count(F.lit(1)).alias("f"))
    mean = lambda keep: F.coalesce(rounded(F.try_divide(F.sum(F.when(keep, F.col("j") * F.col("f"))).cast("double"), F.sum(F.when(keep, F.col("f")))), 2), F.lit(0.0))
    a = counted.agg(mean(F.lit(True)).alias("authors_per_document"), F.coalesce(F.sum(F.when(F.col("j") == 1, F.col("f"))), F.lit(0)).alias("single_authored_documents"), mean(F.col("j") > 1).alias("collaboration_index"))
    per = c.affiliations.where(filled("country")).groupBy("eid").agg(F.countDistinct("country").alias("k"))
    intl = per.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)), F.lit(0)).alias("international_documents"), F.coalesce(ratio(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)), F.count(F.lit(1)), 1, 100), F.lit(0.0)).alias("international_share"))
    words = c.keywords.agg(*(F.countDistinct(F.when(F.col("kind") == k, F.lower("keyword"))).alias(f"keywords_{k}") for k in ("author", "index")))
    refs = c.references.groupBy("eid").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("references"), F.coalesce(rounded(F.avg("k"), 1), F.lit(0.0)).alias("references_per_document"))
    out = _one(c, d, growth, a, intl, words, refs, c.authors.agg(F.countDistinct(author_key()).alias("authors")), c.affiliations.agg(F.countDistinct(F.when(filled("country"), F.col("country"))).alias("countries")))
    out = out.withColumn("timespan", F.concat(F.col("year_min").cast("string"), F.lit("-"), F.col("year_max").cast("string"))).withColumn("citations_per_document", F.coalesce(ratio(F.col("total_citations"), F.col("documents"), 2), F.lit(0.0)))
    return out.select(
        "documents", "year_min", "year_max", "timespan", "annual_growth_rate", "document_average_age", "sources", "document_types", "total_citations", "citations_per_document", "references", "references_per_document",
        "keywords_author", "keywords_index", "authors", "authors_per_document", "single_authored_documents", "collaboration_index", "countries", "international_documents", "international_share",
    )


@operator
def most_cited_documents(c: Corpus, n: int | None = 20) -> DataFrame:
    rows = c.documents.select("eid", "title", F.col("year").cast("long").alias("year"), "source", "doc_type", F.col("cited_by").cast("long").alias("citations"), "doi").crossJoin(c.last_year())
    best = top(rows, n, F.desc("citations"), F.asc("eid"), F.asc("title"))
    out = best.join(first_authors(c), "eid", "left")
    per_year = ratio(F.col("citations"), F.col("last_corpus_year") - F.col("year") + 1, 2)
    return out.orderBy(F.desc("citations"), "eid", "title").select("title", "first_author", "year", "source", "doc_type", "citations", per_year.alias("citations_per_year"), "doi")


@operator
def most_cited_references(c: Corpus, n: int | None = 20) -> DataFrame:
    """Works by how many documents of the corpus cite them, known by DOI or else by lower-case title."""
    key = F.coalesce(F.when(filled("ref_doi"), F.lower(F.trim("ref_doi"))), F.concat(F.lit("t:"), F.lower(F.trim(F.coalesce("ref_title", F.lit(""))))))
    rows = c.references.withColumn("key", key)
    counted = rows.groupBy("key").agg(F.countDistinct("eid").alias("local_citations"), F.min("ref_doi").alias("ref_doi"))
    best = top(counted, n, F.desc("local_citations"), F.asc("key"))
    few = rows.join(F.broadcast(best.select("key")), "key", "left_semi") if n is not None else rows
    out = best.join(most_used(few, ["key"], "ref_title"), "key", "left").join(most_used(few, ["key"], "ref_year"), "key", "left")
    return out.orderBy(F.desc("local_citations"), "key").select(F.col("ref_title").alias("reference"), F.col("ref_year").cast("long").alias("ref_year"), "ref_doi", "local_citations")


@operator
def document_list(c: Corpus, n: int | None = 100, sort: str = "citations") -> DataFrame:
    """Documents in a chosen order, equal ones by eid."""
    if sort not in ("citations", "year", "title"):
        raise ValueError(f"sort must be citations, year or title, not {sort!r}")
    rows = c.documents.select("eid", "title", F.col("year").cast("long").alias("year"), "source", "doc_type", F.col("cited_by").cast("long").alias("citations"), "doi")
    order = F.asc_nulls_last("title") if sort == "title" else F.desc_nulls_last(sort)
    rows = rows.join(first_authors(c), "eid", "left").join(local_citations(c), "eid", "left")
    return top(rows, n, order, F.asc("eid"), F.asc("doi")).select("title", "first_author", "year", "source", "doc_type", "citations", "local_citations", "doi")


@operator
def most_normalized_documents(c: Corpus, n: int | None = 25) -> DataFrame:
    scores = normalized_citations(c).groupBy("eid").agg(F.max("normalized_citations").alias("normalized_citations"), F.max("year_mean_citations").alias("year_mean_citations"))
    rows = c.documents.groupBy("eid").agg(F.min("title").alias("title"), F.min("year").cast("long").alias("year"), F.min("source").alias("source"), F.max("cited_by").cast("long").alias("citations"))
    out = rows.join(scores, "eid").join(first_authors(c), "eid", "left").select("eid", "title", "first_author", "year", "source", "citations", "year_mean_citations", "normalized_citations")
    return top(out, n, F.desc("normalized_citations"), F.asc("eid"))
