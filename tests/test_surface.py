"""The methods a user of a corpus finds, and that nothing but the entry imports the corpus subpackage."""

import re
from pathlib import Path

from folioscope.api import Corpus

METHODS = """
from_csv from_dataframe from_tables tables n_institutions n_authors year_range summary filter production_by_year production_by_country top_sources top_authors top_institutions institutions_over_time institutions_by_country
three_fields org_hierarchy top_keywords document_types impact authors_impact institutions_impact lotka bradford zipf co_citation co_word co_citation_authors co_authorship co_institution co_country bibliographic_coupling main_information
most_cited_documents most_cited_references trend_topics thematic_map cagr agr rgr_doubling_time growth_summary trend_forecast cochran_sample_size collaboration_indicators affiliation_profile documents_by_affiliation_count
authors_by_affiliation_count authorship_pattern cai authorship_groups price_law country_map indicator_readiness field_completeness table_completeness duplicates anomalies quality_summary price_index price_index_by_year
reference_age_distribution concentration concentration_summary self_citation_summary authors_self_citation access_status access_routes access_over_time access_summary subject_areas subject_categories interdisciplinarity journal_open_access
scimago_sources quartile_distribution quartile_over_time scimago_coverage top_cities cities_impact collaboration_scale cities_over_time city_hierarchy co_city first_author_countries corresponding_author_countries citation_pairs
local_citations most_local_cited_documents most_local_cited_authors most_local_cited_sources historiograph sources_impact sources_over_time authors_over_time word_dynamics average_citations_per_year reference_spectroscopy
conceptual_structure thematic_evolution clustering_by_coupling network_metrics network_summary network_layout attach_layout network_density citation_network top_terms text_co_occurrence text_trend topic_dendrogram countries_impact
normalized_citations document_list most_normalized_documents network density_map term_network citation_graph citation_balance figure_catalog figure_spec figure
""".split()


def test_every_method_is_there():
    assert [m for m in METHODS if not callable(getattr(Corpus, m, None))] == []


def test_nothing_imports_the_corpus_subpackage():
    root = Path(__file__).parent.parent
    inside = [p for p in (root / "folioscope").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert [p for p in inside if re.search(r"folioscope\.llm|import llm", p.read_text(encoding="utf-8"))] == []
