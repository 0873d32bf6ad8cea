"""Terms of titles and abstracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import ratio, top
from folioscope.functions.textual import ngrams, tokens, without_copyright
from folioscope.operators.themes import quartiles

FIELDS = ("abstract", "title", "both")


def document_terms(c: Corpus, field: str, ngram: int, extra: Iterable[str] | None) -> DataFrame:
    """(eid, term): each n-gram of a document's text once."""
    if field not in FIELDS:
        raise ValueError(f"field must be one of {', '.join(FIELDS)}, not {field!r}")
    abstract, title = without_copyright(F.coalesce("abstract", F.lit(""))), F.coalesce("title", F.lit(""))
    text = {"abstract": abstract, "title": title, "both": F.concat(title, F.lit(". "), abstract)}[field]
    words = c.documents.select("eid", tokens(text).alias("w"))
    listed = words.select("eid", F.explode(F.array_distinct(ngrams(F.col("w"), ngram, sorted({w.lower() for w in extra or ()})))).alias("term"))
    return listed.distinct()


@operator
def top_terms(c: Corpus, field: str = "abstract", ngram: int = 1, n: int | None = 50, min_documents: int = 2, extra_stopwords: Iterable[str] | None = None) -> DataFrame:
    """Terms by number of documents; shares are of all documents."""
    counts = document_terms(c, field, ngram, extra_stopwords).groupBy("term").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= min_documents)
    whole = F.broadcast(c.documents.agg(F.count(F.lit(1)).alias("whole")))
    return top(counts.crossJoin(whole).select("term", "documents", ratio(F.col("documents"), F.col("whole"), 1, 100).alias("share")), n, F.desc("documents"), F.asc("term"))


@operator
def text_trend(c: Corpus, field: str = "abstract", ngram: int = 2, n: int = 20, min_documents: int = 2, extra_stopwords: Iterable[str] | None = None) -> DataFrame:
    """The years in which the most frequent terms are used: quartiles over their dated documents."""
    years = c.documents.where("year is not null").groupBy("eid").agg(F.min("year").cast("long").alias("year"))
    rows = document_terms(c, field, ngram, extra_stopwords).join(years, "eid")
    return quartiles(rows, "term", n, min_documents)
