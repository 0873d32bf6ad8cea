"""The indicators; importing this package makes each of them a method of Corpus."""

from folioscope.operators import access, affiliations, aging, citations, collaboration, concentration, flows, geography, growth, impact, journals, laws, networks, overview, production, quality, text, themes, timeline  # noqa: F401
