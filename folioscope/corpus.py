"""The corpus: six tables linked by `eid`, with the indicators as its methods."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.columns import INDEPENDENT, author_key, filled
from folioscope.runtime import read_table

SCHEMAS = {
    "documents": "eid string, title string, year int, source string, source_abbr string, doc_type string, language string, cited_by int, doi string, link string, abstract string, open_access string, issn string, publisher string",
    "authors": "eid string, position int, name string, full_name string, scopus_id string",
    "affiliations": "eid string, aff_pos int, raw string, labelled boolean, subparent string, parent1 string, parent2 string, city string, site string, region string, country string",
    "author_affiliations": "eid string, position int, aff_pos int, raw string",
    "keywords": "eid string, keyword string, kind string",
    "references": "eid string, ref_pos int, ref_doi string, ref_year int, ref_authors string, ref_title string, ref_raw string",
}


def _conform(spark: SparkSession, frame: DataFrame | None, name: str) -> DataFrame:
    """A table with exactly the columns of its schema; what is missing is null."""
    wanted = [c.split() for c in SCHEMAS[name].split(", ")]
    if frame is None:
        return spark.createDataFrame([], SCHEMAS[name])
    out = frame.select(*((F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted))
    return out.withColumn("cited_by", F.coalesce("cited_by", F.lit(0))) if name == "documents" else out


@dataclass(frozen=True)
class Corpus:
    """Six lazy tables. Every method returns a DataFrame (or, for graphs, a pair of them); nothing is computed before it is asked for."""

    documents: DataFrame
    authors: DataFrame
    affiliations: DataFrame
    author_affiliations: DataFrame
    keywords: DataFrame
    references: DataFrame
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame], unify: bool = True) -> Corpus:
        """A corpus of prebuilt tables; missing tables are empty. `unify` brings names to their most used spelling."""
        spark = next(iter(tables.values())).sparkSession
        made = {name: _conform(spark, tables.get(name), name) for name in SCHEMAS}
        if unify:
            from folioscope.sources.unify import unify_spellings

            made = unify_spellings(made)
        return cls(**made)

    @classmethod
    def from_dataframe(cls, wide: DataFrame, countries: DataFrame | list[str] | None = None, unify: bool = True) -> Corpus:
        """A corpus of a wide export, one row per document, every column a string. `countries` is a list to know countries by (see sources.places)."""
        from folioscope.sources.wide import build_tables

        return cls.from_tables(build_tables(wide, countries), unify)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, countries: DataFrame | list[str] | None = None, unify: bool = True) -> Corpus:
        """A corpus of a cleaned export file; NotCleanedError where author lists aren't numbered."""
        from folioscope.sources.wide import check_cleaned, read_csv

        wide = read_csv(spark, path)
        check_cleaned(wide)
        return cls.from_dataframe(wide, countries, unify)

    @classmethod
    def read(cls, spark: SparkSession, directory: str, unify: bool = False) -> Corpus:
        """A corpus of parquet tables, as `write` leaves them."""
        return cls.from_tables({name: read_table(spark, directory, name) for name in SCHEMAS}, unify)

    def write(self, directory: str) -> None:
        """Each table as parquet below `directory`."""
        for name, table in self.tables().items():
            stored = "doc_references" if name == "references" else name
            table.write.mode("overwrite").parquet(f"{directory}/{stored}.parquet")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    def filter(self, years: Sequence[int] | None = None, doc_types: Iterable[str] | None = None, countries: Iterable[str] | None = None, sources: Iterable[str] | None = None) -> Corpus:
        """The documents that meet all given conditions, with their rows of the other tables.

        Two years are a range, any other number of years a list; an empty condition is none.
        """
        kept = self.documents
        if years:
            kept = kept.where(F.col("year").between(*years) if len(years) == 2 else F.col("year").isin(*years))
        if doc_types and (wanted := list(doc_types)):
            kept = kept.where(F.col("doc_type").isin(*wanted))
        if sources and (wanted := list(sources)):
            kept = kept.where(F.col("source").isin(*wanted))
        if countries and (wanted := list(countries)):
            kept = kept.join(self.affiliations.where(F.col("country").isin(*wanted)).select("eid"), "eid", "left_semi")
        eids = kept.select("eid")
        rest = {name: table.join(eids, "eid", "left_semi") for name, table in self.tables().items() if name != "documents"}
        return Corpus(documents=kept, **rest)

    def __len__(self) -> int:
        return self.documents.count()

    def n_institutions(self) -> int:
        return self.institution_rows().select("institution").distinct().count()

    def n_authors(self) -> int:
        return self.authors.select(author_key().alias("k")).where("k is not null").distinct().count()

    def year_range(self) -> tuple[int, int] | None:
        lo, hi = self.documents.agg(F.min("year"), F.max("year")).first()
        return None if lo is None else (lo, hi)

    def last_year(self) -> DataFrame:
        """The corpus's last year, one row, to be joined as a broadcast scalar."""
        return F.broadcast(self.documents.agg(F.max("year").cast("long").alias("last_corpus_year")))

    def cited(self) -> DataFrame:
        """(eid, year, cited_by) of every document row."""
        return self.documents.select("eid", F.col("year").cast("long").alias("year"), F.col("cited_by").cast("long").alias("cited_by"))

    def author_rows(self) -> DataFrame:
        return self.authors.where(filled("name")).withColumn("key", author_key())

    def institution_rows(self) -> DataFrame:
        """Institutions of affiliations: parent1 and parent2 exploded, once per affiliation."""
        both = F.array_distinct(F.array_compact(F.array(F.when(filled("parent1"), F.trim("parent1")), F.when(filled("parent2"), F.trim("parent2")))))
        rows = self.affiliations.select("eid", "aff_pos", "subparent", "city", "country", F.explode(both).alias("institution"))
        return rows.groupBy("eid", "aff_pos", "institution").agg(*(F.min(c).alias(c) for c in ("subparent", "city", "country")))

    def organisations(self, level: str = "parent") -> DataFrame:
        """(eid, org, country, aff_pos, parent1) at a level, independent researchers left out."""
        if level == "parent":
            rows = self.institution_rows().withColumnRenamed("institution", "org").withColumn("parent1", F.col("org"))
        elif level == "subparent":
            rows = self.affiliations.where(filled("subparent")).select("eid", "aff_pos", "city", "country", F.trim("subparent").alias("org"), "parent1")
        else:
            raise ValueError(f"level must be 'parent' or 'subparent', not {level!r}")
        return rows.where(F.col("org") != INDEPENDENT)


def operator(function: Callable) -> Callable:
    """Make a function of a corpus one of its methods, too."""
    setattr(Corpus, function.__name__, function)
    return function
