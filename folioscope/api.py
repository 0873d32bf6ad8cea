"""Everything a user needs: the corpus with all its methods, reports, and the error of uncleaned exports.

Kept apart from the package itself, which Python workers import for single functions.
"""

import folioscope.figures.catalog
import folioscope.graph.measures
import folioscope.graph.themes
import folioscope.operators  # noqa: F401
from folioscope.corpus import Corpus
from folioscope.report import Report
from folioscope.sources.wide import NotCleanedError

__all__ = ["Corpus", "NotCleanedError", "Report"]
