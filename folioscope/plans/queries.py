"""One query per indicator, over the whole bibliographic tables of a directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import folioscope.graph.measures
import folioscope.graph.themes
import folioscope.operators  # noqa: F401
from folioscope.corpus import Corpus
from folioscope.operators.journals import load_scimago, plain_issn
from folioscope.operators.networks import normalize
from folioscope.runtime import read_table, shared_dir
from folioscope.sources.places import country_places

Query = Callable[[SparkSession, str], DataFrame]

#: Query name to operator and its arguments; the result is a table.
TABLES: dict[str, tuple[str, dict]] = {
    "summary": ("summary", {}), "main_information": ("main_information", {}), "production_by_year": ("production_by_year", {}), "production_by_country": ("production_by_country", {}),
    "top_institutions": ("top_institutions", {}), "top_units": ("top_institutions", {"level": "subparent"}), "institutions_over_time": ("institutions_over_time", {}), "institutions_by_country": ("institutions_by_country", {}),
    "org_hierarchy": ("org_hierarchy", {}), "top_authors": ("top_authors", {}), "top_sources": ("top_sources", {}), "top_keywords": ("top_keywords", {}), "top_keywords_all": ("top_keywords", {"kind": "all", "n": None}),
    "document_types": ("document_types", {}), "impact": ("impact", {}), "authors_impact": ("authors_impact", {"n": None}), "institutions_impact": ("institutions_impact", {}), "sources_impact": ("sources_impact", {"n": None}),
    "countries_impact": ("countries_impact", {}), "normalized_citations": ("normalized_citations", {}), "first_author_countries": ("first_author_countries", {}), "top_cities": ("top_cities", {}), "cities_impact": ("cities_impact", {}),
    "collaboration_scale": ("collaboration_scale", {}), "cities_over_time": ("cities_over_time", {}), "city_hierarchy": ("city_hierarchy", {}), "most_cited_documents": ("most_cited_documents", {}), "most_cited_references": ("most_cited_references", {}),
    "document_list": ("document_list", {}), "most_normalized_documents": ("most_normalized_documents", {}), "field_completeness": ("field_completeness", {}), "table_completeness": ("table_completeness", {}), "duplicates": ("duplicates", {}),
    "anomalies": ("anomalies", {}), "indicator_readiness": ("indicator_readiness", {}), "quality_summary": ("quality_summary", {}), "cagr": ("cagr", {}), "agr": ("agr", {}), "rgr_doubling_time": ("rgr_doubling_time", {}), "growth_summary": ("growth_summary", {}),
    "cochran_sample_size": ("cochran_sample_size", {}), "collaboration_indicators": ("collaboration_indicators", {}), "authorship_pattern": ("authorship_pattern", {}), "cai": ("cai", {}), "price_law": ("price_law", {}), "authorship_groups": ("authorship_groups", {}),
    "documents_by_affiliation_count": ("documents_by_affiliation_count", {}), "authors_by_affiliation_count": ("authors_by_affiliation_count", {}), "affiliation_profile": ("affiliation_profile", {}), "lotka_table": ("lotka_table", {}), "lotka_fit": ("lotka_fit", {}),
    "bradford": ("bradford", {}), "bradford_zones": ("bradford_zones", {}), "zipf": ("zipf", {}), "zipf_fit": ("zipf_fit", {}), "concentration_summary": ("concentration_summary", {}), "lorenz": ("lorenz", {}), "price_index": ("price_index", {}),
    "price_index_by_year": ("price_index_by_year", {}), "reference_age_distribution": ("reference_age_distribution", {}), "reference_spectroscopy": ("reference_spectroscopy", {}), "citation_pairs": ("citation_pairs", {}), "local_citations": ("local_citations", {}),
    "most_local_cited_documents": ("most_local_cited_documents", {}), "most_local_cited_authors": ("most_local_cited_authors", {}), "most_local_cited_sources": ("most_local_cited_sources", {}), "self_citation_summary": ("self_citation_summary", {}),
    "authors_self_citation": ("authors_self_citation", {}), "citation_balance": ("citation_balance", {}), "trend_topics": ("trend_topics", {}), "three_fields": ("three_fields", {}), "authors_over_time": ("authors_over_time", {}),
    "word_dynamics": ("word_dynamics", {}), "sources_over_time": ("sources_over_time", {}), "average_citations_per_year": ("average_citations_per_year", {}), "top_terms": ("top_terms", {}), "top_bigrams": ("top_terms", {"ngram": 2}), "text_trend": ("text_trend", {}),
    "access_status": ("access_status", {}), "access_routes": ("access_routes", {}), "access_over_time": ("access_over_time", {}), "lotka_tests": ("lotka_tests", {}),
}

#: Query name to network operator and its arguments; the result is the network's edges or nodes.
EDGES: dict[str, tuple[str, dict]] = {
    "co_word": ("co_word", {}), "co_authorship": ("co_authorship", {}), "co_institution": ("co_institution", {}), "co_country": ("co_country", {}), "co_city": ("co_city", {}), "co_citation": ("co_citation", {}), "co_citation_authors": ("co_citation_authors", {}),
    "bibliographic_coupling": ("bibliographic_coupling", {}), "text_co_occurrence": ("text_co_occurrence", {}), "citation_network_sources": ("citation_network", {"unit": "sources"}), "citation_network_countries": ("citation_network", {"unit": "countries"}), "historiograph": ("historiograph", {}),
}
NODES = ("co_word", "co_authorship", "co_citation", "historiograph")
JOURNALS = ("access_summary", "scimago_sources", "quartile_distribution", "quartile_over_time", "scimago_coverage", "subject_areas", "subject_categories", "interdisciplinarity", "journal_open_access")


def _table(name: str, options: dict) -> Query:
    return lambda spark, directory: getattr(Corpus.read(spark, directory), name)(**options)


def _part(name: str, options: dict, part: int) -> Query:
    return lambda spark, directory: getattr(Corpus.read(spark, directory), name)(**options)[part]


def _normalized(method: str) -> Query:
    return lambda spark, directory: normalize(Corpus.read(spark, directory).co_word(), method)[1]


def journal_table(spark: SparkSession, directory: str) -> DataFrame:
    """A stand-in for a journal table, which none is shipped of: most sources of the corpus, with attributes that follow from the length of
    their names, so that journals are matched by ISSN, by title or not at all."""
    docs = read_table(spark, directory, "documents", "source", "issn").where("length(trim(source)) > 0")
    own = docs.groupBy(F.trim("source").alias("title")).agg(F.min(plain_issn(F.col("issn"))).alias("issn")).withColumn("n", F.length("title")).where("n % 7 <> 0")
    of = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), F.col("n") % by + 1)
    made = {
        "scimago_id": F.col("title"), "scimago_title": F.col("title"), "quartile": of(5, None, "Q1", "Q2", "Q3", "Q4"), "areas": of(3, "Engineering; Physics", "Medicine", "Physics"),
        "categories": of(3, "Alloys (Q1); Optics (Q3)", "Surgery", "Optics (Q2)"), "open_access": F.col("n") % 2 == 0, "issns": F.when(F.col("n") % 2 == 0, F.array_compact(F.array("issn"))),
    }
    empty = load_scimago(spark)
    return own.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields))


def _of_journals(name: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        found = getattr(Corpus.read(spark, directory), name)(journals=journal_table(spark, directory))
        return found.select("source", "documents", "citations", "matched_by", "scimago_id", "scimago_title", "quartile", "areas", "categories", "open_access") if name == "scimago_sources" else found

    return query


def _country_map(spark: SparkSession, directory: str) -> DataFrame:
    countries = read_table(spark, directory, "countries", "alpha2", "name", "common_name", "official_name", "atlas", "lon", "lat")
    return Corpus.read(spark, directory).country_map(country_places(countries))


def exported(spark: SparkSession, directory: str) -> DataFrame:
    """The tables as a wide export, one row for each row of the documents, cells packed as exports pack them."""
    table = lambda name: read_table(spark, directory, name)
    cell = lambda c: F.coalesce(F.translate(F.col(c).cast("string"), ";|", ",/"), F.lit(""))
    packed = lambda rows, order, text, name: rows.groupBy("eid").agg(F.array_sort(F.collect_list(order)).alias("x")).select("eid", F.array_join(F.transform("x", text), "; ").alias(name))
    names = table("authors").where("length(trim(name)) > 0")
    refs = table("references").withColumn("t", F.concat_ws(" | ", F.lit("ref1"), cell("ref_doi"), cell("ref_year"), cell("ref_authors"), cell("ref_title")))
    words = table("keywords")
    out = table("documents").select("eid", "title", "year", "source", "doi", "open_access", "cited_by")
    for part in (
        packed(names, F.struct("position", "name"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x["name"]), "Authors"),
        packed(refs, F.struct("ref_pos", "t"), lambda x: x["t"], "References"),
        packed(words.where("kind = 'author'"), F.col("keyword"), lambda x: x, "Author Keywords"), packed(words.where("kind = 'index'"), F.col("keyword"), lambda x: x, "Index Keywords"),
    ):
        out = out.join(part, "eid", "left")
    return out.withColumnsRenamed({"eid": "EID", "title": "Title", "year": "Year", "source": "Source title", "doi": "DOI", "open_access": "Open Access", "cited_by": "Cited by"})


def _from_csv(table: str, *columns: str) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        path = f"{shared_dir(spark)}/folioscope/export-{uuid.uuid4().hex}"
        exported(spark, directory).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
        return getattr(Corpus.from_csv(spark, path, unify=False), table).select(*columns)

    return query


def _summed(spark: SparkSession, directory: str) -> DataFrame:
    """Size and shape of the network of keywords, one row."""
    c = Corpus.read(spark, directory)
    kinds = {"nodes": "long", "edges": "long", "density": "double", "transitivity": "double", "components": "long", "mean_degree": "double"}
    found = c.network_summary(c.co_word())
    return spark.createDataFrame([tuple(found[k] for k in kinds)], ", ".join(f"{k} {t}" for k, t in kinds.items()))


def _measured(spark: SparkSession, directory: str) -> DataFrame:
    c = Corpus.read(spark, directory)
    return c.network_metrics(c.co_word())[0].select("id", "pagerank", "clustering")


def _filtered(spark: SparkSession, directory: str) -> DataFrame:
    """Production of the articles of two countries from 2015 on."""
    names = [r.country for r in Corpus.read(spark, directory).production_by_country(2).collect()]
    return Corpus.read(spark, directory).filter(years=(2015, 2025), doc_types=["Article"], countries=names).production_by_year()


def _unified(spark: SparkSession, directory: str) -> DataFrame:
    """Keywords in their most used spelling."""
    return Corpus.read(spark, directory, unify=True).keywords.groupBy("keyword", "kind").agg(F.count(F.lit(1)).alias("rows"))


def queries() -> dict[str, Query]:
    found = {name: _table(*spec) for name, spec in TABLES.items()}
    found |= {f"{name}_edges": _part(*spec, 1) for name, spec in EDGES.items()}
    found |= {f"{name}_nodes": _part(*EDGES[name], 0) for name in NODES}
    found |= {f"co_word_{m}": _normalized(m) for m in ("association", "jaccard", "salton", "inclusion", "equivalence")}
    found |= {name: _of_journals(name) for name in JOURNALS} | {"country_map": _country_map}
    found |= {"csv_documents": _from_csv("documents", "eid", "title", "year", "source", "doi", "open_access", "cited_by"), "csv_keywords": _from_csv("keywords", "eid", "keyword", "kind")}
    found |= {"csv_references": _from_csv("references", "eid", "ref_doi", "ref_year", "ref_authors", "ref_title"), "csv_authors": _from_csv("authors", "eid", "position", "name")}
    found |= {"network_summary": _summed, "network_measures": _measured, "term_network": _part("term_network", {}, 0), "density_map": _part("density_map", {}, 0)}
    found |= {f"overlay_years_{unit}": _table("overlay_years", {"unit": unit}) for unit in ("keywords", "countries")}
    found |= {"filtered_production": _filtered, "unified_keywords": _unified}
    found |= {"trend_forecast_table": _part("trend_forecast", {"this_year": 2026}, 0), "trend_forecast_fit": _part("trend_forecast", {"this_year": 2026}, 1)}
    found |= {"network_metrics": lambda spark, directory: (c := Corpus.read(spark, directory)).network_metrics(c.co_word(), "keywords")[0]}
    found |= {name: _part(name, {}, 0) for name in ("thematic_map", "conceptual_structure", "topic_dendrogram", "clustering_by_coupling")}
    found |= {"thematic_evolution": _part("thematic_evolution", {}, 1), "thematic_flows": _part("thematic_evolution", {}, 2)}
    return found
