"""Citations inside the corpus: pairs, local citations, self-citation, citation networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.functions.columns import filled, most_used, ratio, top
from folioscope.functions.ranking import numbered
from folioscope.functions.skew import join_counted
from folioscope.functions.textual import plain_doi, plain_title
from folioscope.runtime import durable

_LONG_TITLE = 25


@operator
def citation_pairs(c: Corpus) -> DataFrame:
    """(citing, cited, via): references that are documents of the corpus, by DOI or else by a long title.

    Of several documents with one DOI or title the one of least eid owns it. The pairs are written once for a corpus, since most of
    what follows starts from them.
    """
    if "citation_pairs" in c.kept:
        return c.kept["citation_pairs"]
    docs = c.documents.select("eid", plain_doi(F.col("doi")).alias("doi"), plain_title(F.col("title")).alias("title"))
    by_doi = docs.where("doi is not null").groupBy("doi").agg(F.min("eid").alias("cited"))
    by_title = docs.where(F.length("title") >= _LONG_TITLE).groupBy("title").agg(F.min("eid").alias("cited"))
    refs = c.references.select(F.col("eid").alias("citing"), plain_doi(F.col("ref_doi")).alias("doi"), plain_title(F.col("ref_title")).alias("title"))
    # one pass over the references: looked up by DOI, and where that names no document here, by title; missing keys are spread
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("citing", "title"), F.lit(997)).cast("string"))
    found = refs.withColumn("k", F.coalesce("doi", spread)).join(by_doi.select(F.col("doi").alias("k"), F.col("cited").alias("d")), "k", "left")
    found = found.withColumn("k", F.coalesce(F.when(F.col("d").isNull() & (F.length("title") >= _LONG_TITLE), F.col("title")), spread))
    found = found.join(by_title.select(F.col("title").alias("k"), F.col("cited").alias("t")), "k", "left").where("d is not null or t is not null")
    found = found.select("citing", F.coalesce("d", "t").alias("cited"), F.when(F.col("d").isNotNull(), "doi").otherwise("title").alias("via"))
    pairs = found.where("citing <> cited").groupBy("citing", "cited").agg(F.min("via").alias("via"))
    c.kept["citation_pairs"] = durable(pairs, "citation-pairs")
    return c.kept["citation_pairs"]


@operator
def local_citations(c: Corpus) -> DataFrame:
    received = citation_pairs(c).groupBy(F.col("cited").alias("eid")).agg(F.count(F.lit(1)).alias("local_citations"))
    return c.documents.select("eid").distinct().join(received, "eid", "left").na.fill(0, ["local_citations"])


def first_authors(c: Corpus) -> DataFrame:
    return c.authors.where(filled("name")).groupBy("eid").agg(F.min_by("name", F.struct("position", "name")).alias("first_author"))


def document_cards(c: Corpus) -> DataFrame:
    """One row per eid with title, first author, year, source, type, DOI and citations; of repeated rows the one with most citations, then
    the one of least title and so on."""
    each = ("title", "year", "source", "doc_type", "doi")
    order = F.struct(-F.coalesce("cited_by", F.lit(0)), *(x for name in each for x in (F.col(name).isNull(), F.col(name))))
    cards = c.documents.groupBy("eid").agg(F.min_by(F.struct(*each, F.col("cited_by").cast("long").alias("citations")), order).alias("card"))
    return cards.select("eid", "card.*").withColumn("year", F.col("year").cast("long")).join(first_authors(c), "eid", "left")


@operator
def most_local_cited_documents(c: Corpus, n: int | None = 20) -> DataFrame:
    """Documents by citations from inside the corpus, labelled by first author and year; equal labels get -b, -c and so on."""
    rows = document_cards(c).join(local_citations(c).where("local_citations > 0"), "eid").crossJoin(c.last_year())
    name = F.concat_ws(", ", F.upper(F.coalesce("first_author", F.lit("?"))), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")))
    rows = numbered(rows.withColumn("base", name), "base", "title", "eid").withColumnRenamed("number", "k")
    label = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.when(F.col("k") <= 26, F.char(F.col("k") + 96)).otherwise(F.col("k").cast("string"))))
    age = F.col("last_corpus_year") - F.col("year") + 1
    out = rows.select(
        label.alias("label"), "title", "first_author", "year", "source", "local_citations", F.col("citations").alias("global_citations"),
        ratio(F.col("local_citations"), F.col("citations"), 2, 100).alias("lc_gc_ratio"), ratio(F.col("local_citations"), age, 2).alias("local_citations_per_year"), "eid",
    )
    return top(out, n, F.desc("local_citations"), F.desc("global_citations"), F.asc("eid")).drop("eid")


@operator
def most_local_cited_authors(c: Corpus, n: int | None = 20) -> DataFrame:
    rows = c.authors.where(filled("name")).select(F.col("name").alias("author"), "eid").distinct().join(local_citations(c), "eid")
    counted = rows.groupBy("author").agg(F.sum("local_citations").alias("local_citations"), F.count(F.lit(1)).alias("documents")).where("local_citations > 0")
    return top(counted, n, F.desc("local_citations"), F.desc("documents"), F.asc("author"))


@operator
def most_local_cited_sources(c: Corpus, n: int | None = 20) -> DataFrame:
    rows = c.documents.where(filled("source")).select("source", "eid").distinct().join(local_citations(c), "eid")
    counted = rows.groupBy("source").agg(F.sum("local_citations").alias("local_citations"), F.count(F.lit(1)).alias("documents")).where("local_citations > 0")
    return top(counted, n, F.desc("local_citations"), F.desc("documents"), F.asc("source"))


@operator
def historiograph(c: Corpus, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """The most cited documents and the citations among them, as nodes and edges (source cites target)."""
    best = local_citations(c).where("local_citations > 0").orderBy(F.desc("local_citations"), "eid").limit(n)
    nodes = document_cards(c).join(F.broadcast(best), "eid").select(F.col("eid").alias("id"), "title", "first_author", "year", "source", "local_citations", "citations")
    ids = F.broadcast(best.select("eid"))
    edges = citation_pairs(c).join(ids.withColumnRenamed("eid", "citing"), "citing", "left_semi").join(ids.withColumnRenamed("eid", "cited"), "cited", "left_semi")
    return nodes.orderBy("year", F.desc("local_citations"), "id"), edges.select(F.col("citing").alias("source"), F.col("cited").alias("target")).orderBy("source", "target")


def members(c: Corpus, unit: str, level: str = "parent") -> DataFrame:
    """(eid, key): the entities of a unit that each document has, once."""
    if unit == "documents":
        rows = c.documents.where(filled("title")).select("eid", F.substring("title", 1, 70).alias("key"))
    elif unit == "authors":
        rows = c.authors.where(filled("name")).select("eid", F.col("name").alias("key"))
    elif unit == "sources":
        rows = c.documents.where(filled("source")).select("eid", F.col("source").alias("key"))
    elif unit == "countries":
        rows = c.affiliations.where(filled("country")).select("eid", F.col("country").alias("key"))
    elif unit == "institutions":
        rows = c.organisations(level).select("eid", F.col("org").alias("key"))
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return rows.distinct()


def _with_entities(c: Corpus, own: DataFrame) -> DataFrame:
    """Citation pairs whose two documents have entities, with those of either as arrays.

    Entities are one row per document here, so that a document cited by a large share of all is joined by broadcast.
    """
    pairs = citation_pairs(c).select("citing", "cited")
    total = pairs.count()
    lists = own.groupBy("eid").agg(F.collect_list("key").alias("keys"))
    for end in ("citing", "cited"):
        counted = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).join(lists.select(F.col("eid").alias(end), F.col("keys").alias(f"{end}_keys")), end)
        pairs = join_counted(pairs, counted, [end], "n", total).drop("n")
    return pairs


@operator
def citation_network(c: Corpus, unit: str = "sources", top_n: int = 40, min_weight: int = 1, level: str = "parent") -> tuple[DataFrame, DataFrame]:
    """Who cites whom: nodes and directed edges (source cites target) of the `top_n` entities with most citations in and out."""
    own = members(c, unit, level)
    flows = _with_entities(c, own).select(F.explode("citing_keys").alias("source"), "cited_keys").select("source", F.explode("cited_keys").alias("target"))
    # read several times below: for the sums of both ends, and for what is kept
    edges = durable(flows.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")), "citation-edges")
    ends = edges.select(F.col("source").alias("id"), "weight").unionByName(edges.select(F.col("target").alias("id"), "weight"))
    best = F.broadcast(ends.groupBy("id").agg(F.sum("weight").alias("occurrences")).orderBy(F.desc("occurrences"), "id").limit(top_n))
    kept = edges.where(F.col("weight") >= min_weight)
    for end in ("source", "target"):
        kept = kept.join(best.select(F.col("id").alias(end)), end, "left_semi")
    sums = kept.select(F.col("source").alias("id"), "weight").unionByName(kept.select(F.col("target").alias("id"), "weight")).groupBy("id").agg(F.sum("weight").alias("degree"))
    nodes = best.join(sums, "id").select("id", F.col("id").alias("label"), "occurrences", "degree")
    return nodes.orderBy(F.desc("occurrences"), "id"), kept.select("source", "target", "weight").orderBy(F.desc("weight"), "source", "target")


@operator
def citation_balance(c: Corpus, unit: str = "sources", top_n: int = 40, min_weight: int = 1, level: str = "parent") -> DataFrame:
    """Citations received and given over the edges of a citation network."""
    _, edges = citation_network(c, unit, top_n, min_weight, level)
    rows = edges.select(F.col("target").alias("label"), F.col("weight").alias("received"), F.lit(0).alias("emitted")).unionByName(edges.select(F.col("source").alias("label"), F.lit(0).cast("long").alias("received"), F.col("weight").alias("emitted")))
    sums = rows.groupBy("label").agg(F.sum("received").alias("received"), F.sum("emitted").alias("emitted"))
    return sums.withColumn("balance", F.col("received") - F.col("emitted")).orderBy(F.desc("balance"), F.desc("received"), "label")


def _shared(c: Corpus, level: str) -> DataFrame:
    """Citation pairs whose two documents share an entity of a level."""
    own = _author_documents(c) if level == "authors" else members(c, level)
    return _with_entities(c, own).where(F.arrays_overlap("citing_keys", "cited_keys")).select("citing", "cited")


def _author_documents(c: Corpus) -> DataFrame:
    return c.author_rows().where("key is not null").select("eid", "key").distinct()


@operator
def self_citation_rate(c: Corpus, level: str = "authors") -> DataFrame:
    """Citations inside the corpus whose two documents share an author, an institution or a country, one row."""
    if level not in ("authors", "institutions", "countries"):
        raise ValueError(f"level must be authors, institutions or countries, not {level!r}")
    whole = citation_pairs(c).agg(F.count(F.lit(1)).alias("citations"))
    own = _shared(c, level).agg(F.count(F.lit(1)).alias("self_citations"))
    out = whole.crossJoin(own)
    return out.select(F.lit(level).alias("level"), "citations", "self_citations", (F.col("citations") - F.col("self_citations")).alias("external"), ratio(F.col("self_citations"), F.col("citations"), 1, 100).alias("self_rate"))


@operator
def self_citation_summary(c: Corpus) -> DataFrame:
    rates = [self_citation_rate(c, level) for level in ("authors", "institutions", "countries")]
    return rates[0].unionByName(rates[1]).unionByName(rates[2])


@operator
def authors_self_citation(c: Corpus, n: int | None = 20, min_citations: int = 1) -> DataFrame:
    """For each author the local citations of their documents, and how many of these come from documents of their own."""
    own = _author_documents(c)
    # a citation from a document without authors is one from others
    nobody = c.references.select("eid").distinct().join(own.select("eid"), "eid", "left_anti").select("eid", F.lit("").alias("key"))
    received = _with_entities(c, own.unionByName(nobody)).select("citing_keys", F.explode("cited_keys").alias("key")).where("key <> ''")
    same = F.array_contains("citing_keys", F.col("key")).cast("long")
    counted = received.groupBy("key").agg(F.count(F.lit(1)).alias("local_citations"), F.sum(same).alias("self_citations"))
    docs = own.groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    out = counted.where(F.col("local_citations") >= min_citations).join(docs, "key").join(most_used(c.author_rows(), ["key"], "name"), "key")
    out = out.select(F.col("name").alias("author"), "documents", "local_citations", "self_citations", (F.col("local_citations") - F.col("self_citations")).alias("external_citations"), ratio(F.col("self_citations"), F.col("local_citations"), 1, 100).alias("self_rate"), "key")
    return top(out, n, F.desc("self_citations"), F.desc("local_citations"), F.asc("key")).drop("key")
