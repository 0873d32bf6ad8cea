"""Data quality: completeness, duplicates, anomalies, and which analyses the corpus can bear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import ratio, rounded
from folioscope.functions.textual import plain_title
from folioscope.operators.citations import citation_pairs

# Cells that mean nothing, the fields looked at with what they serve, the checks of the linked tables.
_EMPTY = ("", "nan", "none", "na", "null", "<na>", "nat", "-")
_FIELDS = [
    ("title", "Title", "Document lists, local citation matching by title"), ("year", "Year", "Everything time-based: production, growth, trends"), ("source", "Source", "Sources, Bradford, SCImago"),
    ("doc_type", "Document type", "Type filter and breakdown"), ("cited_by", "Citations", "All impact indices: h, g, i10, e, m"), ("doi", "DOI", "Local citation matching, deduplication"),
    ("issn", "ISSN", "SCImago matching, hence quartiles and SJR"), ("abstract", "Abstract", "Text mining on abstracts"), ("open_access", "Open access", "Open access status and routes"),
    ("publisher", "Publisher", "Publisher breakdown"), ("language", "Language", "Language breakdown"),
]
_CHECKS = [
    ("authors", "name"), ("authors", "scopus_id"), ("affiliations", "parent1"), ("affiliations", "subparent"), ("affiliations", "city"), ("affiliations", "country"),
    ("keywords", "keyword"), ("references", "ref_doi"), ("references", "ref_year"), ("references", "ref_title"),
]
READY, PARTIAL, LIMITED = "ready", "partial", "limited"
_VIRTUAL = "virtual"


def is_filled(column: Column) -> Column:
    text = F.lower(F.trim(column.cast("string")))
    return F.coalesce(~text.isin(*_EMPTY), F.lit(False))


def status(share: Column) -> Column:
    return F.when(share >= 90, READY).when(share >= 50, PARTIAL).otherwise(LIMITED)


def _shares(frame: DataFrame, fields: list[str], where: dict[str, Column] | None = None) -> DataFrame:
    """(field, filled, total) of several columns in one pass over their table."""
    where = where or {}
    counted = [F.struct(F.lit(f).alias("field"), F.count(F.when(is_filled(F.col(f)) & where.get(f, F.lit(True)), 1)).alias("filled"), F.count(F.when(where.get(f, F.lit(True)), 1)).alias("total")) for f in fields]
    return frame.agg(F.array(*counted).alias("a")).select(F.inline("a"))


def _share() -> Column:
    return F.coalesce(ratio(F.col("filled"), F.col("total"), 1, 100), F.lit(0.0))


@operator
def field_completeness(c: Corpus) -> DataFrame:
    spark = c.documents.sparkSession
    names = F.broadcast(spark.createDataFrame([(i, *f) for i, f in enumerate(_FIELDS)], "place int, field string, label string, unlocks string"))
    out = _shares(c.documents, [f for f, _, _ in _FIELDS]).join(names, "field").withColumn("share", _share())
    return out.orderBy("place").select("field", "label", "filled", "total", "share", status(F.col("share")).alias("status"), "unlocks")


@operator
def table_completeness(c: Corpus) -> DataFrame:
    """Filled cells of the linked tables; places declared virtual need no city."""
    parts = []
    for table in ("authors", "affiliations", "keywords", "references"):
        fields = [f for t, f in _CHECKS if t == table]
        real = F.lower(F.trim(F.coalesce("site", F.lit("")))) != _VIRTUAL if table == "affiliations" else None
        parts.append(_shares(getattr(c, table), fields, {"city": real} if real is not None else None).select(F.lit(table).alias("table"), "*"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = out.withColumn("share", _share()).withColumn("status", status(F.col("share")))
    place = F.element_at(F.map_from_arrays(F.array(*(F.lit(f"{t}.{f}") for t, f in _CHECKS)), F.array(*(F.lit(i) for i in range(len(_CHECKS))))), F.concat_ws(".", "table", "field"))
    return out.orderBy(place).select("table", "field", "filled", "total", "share", "status")


@operator
def duplicates(c: Corpus) -> DataFrame:
    """Groups of documents with one DOI, and of those with one long title, whether or not they share a DOI; all different titles of a group are shown, shortened."""
    docs = c.documents.select("eid", "title", F.when(is_filled(F.col("doi")), F.lower(F.trim("doi"))).alias("doi"), plain_title(F.col("title")).alias("key"))
    by_doi = docs.where("doi is not null").groupBy("doi").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    rest = docs.where(F.length("key") >= 25).join(by_doi.select(F.col("doi").alias("key")), "key", "left_anti")
    by_title = rest.groupBy("key").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    first = by_doi.join(_titles(docs.where("doi is not null").join(by_doi.select("doi"), "doi", "left_semi"), "doi"), "doi").select(F.lit("DOI").alias("kind"), F.col("doi").alias("key"), "documents", "titles")
    second = by_title.join(_titles(rest.join(by_title.select("key"), "key", "left_semi"), "key"), "key").select(F.lit("Title").alias("kind"), F.substring("key", 1, 80).alias("key"), "documents", "titles")
    return first.unionByName(second).orderBy(F.desc("documents"), "kind", "key")


def _titles(rows: DataFrame, key: str) -> DataFrame:
    each = rows.select(key, F.substring(F.coalesce("title", F.lit("")), 1, 60).alias("t")).distinct()
    return each.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("t")), " | ").alias("titles"))


@operator
def anomalies(c: Corpus) -> DataFrame:
    last = F.broadcast(c.documents.agg(F.max("year").alias("last")))
    own = c.documents.crossJoin(last).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("year").isNull(), 1)).alias("no_year"), F.count(F.when(F.col("year") > F.col("last") + 1, 1)).alias("future"), F.count(F.when(F.col("cited_by") < 0, 1)).alias("negative"))
    eids = c.documents.select("eid").distinct()
    out = own
    for name, table in (("authors", c.authors), ("affiliations", c.affiliations), ("refs", c.references), ("words", c.keywords)):
        out = out.crossJoin(F.broadcast(eids.join(table.select("eid"), "eid", "left_anti").agg(F.count(F.lit(1)).alias(name))))
    # The checks, how grave they are and what they mean.
    checks = [
        ("Missing year", "no_year", "high", "Excluded from every time-based indicator."), ("Year in the future", "future", "low", "Usually an 'in press' record; harmless but it stretches the axis."),
        ("Negative or unreadable citations", "negative", "high", "Impact indices would be wrong."), ("No author", "authors", "high", "Absent from author rankings and from co-authorship."),
        ("No affiliation", "affiliations", "medium", "Absent from institutions, cities and countries."), ("No reference", "refs", "medium", "Cannot cite locally, nor take part in coupling."),
        ("No keyword", "words", "medium", "Absent from co-word, thematic map and evolution."),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("check"), F.col(b).alias("documents"), F.lit(s).alias("severity"), F.lit(d).alias("detail")) for i, (a, b, s, d) in enumerate(checks)))
    listed = out.where("total > 0").select("total", F.inline(rows))
    return listed.orderBy("place").select("check", "documents", ratio(F.col("documents"), F.col("total"), 1, 100).alias("share"), "severity", "detail")


@operator
def indicator_readiness(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    """Ten families of analyses with the coverage of the field each depends on. `journals` is a journal table, if there is one."""
    from folioscope.operators.journals import scimago_coverage

    fields = field_completeness(c).select(F.lit("documents").alias("table"), "field", "share", F.col("filled").alias("n"))
    tables = table_completeness(c).select("table", "field", "share", F.col("filled").alias("n"))
    wide = fields.unionByName(tables).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "table", "field"), "share"))).alias("s"))
    pairs = citation_pairs(c).agg(F.count(F.lit(1)).alias("pairs"))
    found = scimago_coverage(c, journals).select("document_share", "matched_sources", F.col("sources").alias("known_sources"))
    one = wide.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(found)).crossJoin(F.broadcast(c.documents.agg(F.count(F.lit(1)).alias("total")))).where("total > 0")
    s = lambda k: F.element_at("s", F.lit(k))
    percent = lambda k: F.rint(s(k)).cast("long").cast("string")
    # The analyses, the field each rests on and a note.
    rows = [
        ("Production and growth", s("documents.year"), "Publication year", F.lit("Documents without a year are excluded from every time series.")),
        ("Impact indices (h, g, i10, e, m)", s("documents.cited_by"), "Citation count", F.lit("Computed on THIS corpus, not on each person's whole body of work.")),
        ("Author analysis", s("authors.name"), "Author names", F.concat(F.lit("Scopus identifier present on "), percent("authors.scopus_id"), F.lit(" % of rows, homonyms are only separable where it is."))),
        ("Institutions", s("affiliations.parent1"), "Parent organisation", F.concat(F.lit("Internal units filled on "), percent("affiliations.subparent"), F.lit(" % of affiliations."))),
        ("Cities and geography", s("affiliations.city"), "City", F.lit("Drives the local / national / international collaboration scale.")),
        ("Keywords and thematic map", s("keywords.keyword"), "Keywords", F.lit("Co-word, thematic map and evolution all rest on this field.")),
        ("Text mining", s("documents.abstract"), "Abstract", F.lit("Terms are extracted from titles and abstracts.")),
        ("Local citations and historiograph", s("references.ref_doi"), "Reference DOIs", F.concat(F.col("pairs").cast("string"), F.lit(" internal citation links actually matched."))),
        ("SCImago quartiles and SJR", F.coalesce("document_share", F.lit(0.0)), "ISSN matching", F.concat(F.col("matched_sources").cast("string"), F.lit(" of "), F.col("known_sources").cast("string"), F.lit(" sources matched."))),
        ("Open access", s("documents.open_access"), "Open access flag", F.lit("Scopus only flags OPEN articles; a blank is not a closed article.")),
    ]
    every = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("analysis"), v.alias("coverage"), F.lit(b).alias("basis"), note.alias("note")) for i, (a, v, b, note) in enumerate(rows)))
    out = one.select(F.inline(every))
    return out.orderBy("place").select("analysis", status(F.col("coverage")).alias("status"), "coverage", "basis", "note")


@operator
def quality_summary(c: Corpus, journals: DataFrame | None = None) -> DataFrame:
    count = lambda k: F.count(F.when(F.col("status") == k, 1)).alias(k)
    ready = indicator_readiness(c, journals).agg(F.count(F.lit(1)).alias("analyses"), count(READY), count(PARTIAL), count(LIMITED), F.coalesce(rounded(F.avg("coverage"), 1), F.lit(0.0)).alias("mean_coverage"))
    groups = duplicates(c).agg(F.count(F.lit(1)).alias("duplicate_groups"))
    high = anomalies(c).where("severity = 'high' and documents > 0").agg(F.count(F.lit(1)).alias("high_severity_issues"))
    out = c.documents.agg(F.count(F.lit(1)).alias("documents"))
    for part in (ready, groups, high):
        out = out.crossJoin(F.broadcast(part))
    return out.select("documents", "analyses", READY, PARTIAL, LIMITED, "duplicate_groups", "high_severity_issues", "mean_coverage")
