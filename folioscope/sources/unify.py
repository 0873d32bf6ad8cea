"""One spelling for each author, organisation and keyword: the one used most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.columns import filled, most_used
from folioscope.functions.textual import unaccented


def _loose(column: Column) -> Column:
    """Letters and digits of an unaccented lower-case text."""
    return F.regexp_replace(F.lower(unaccented(column)), "[^a-z0-9]", "")


def _respell(rows: DataFrame, keys: dict[str, Column], value: str, usable: Column) -> DataFrame:
    """`rows` with `value` replaced by its key's most used spelling, where the row is usable."""
    kept = rows.columns
    named = rows.select("*", *(F.when(usable, k).alias(f"_k_{n}") for n, k in keys.items()))
    names = [f"_k_{n}" for n in keys]
    best = most_used(named.where(F.col(names[0]).isNotNull()), names, value).withColumnRenamed(value, "_best")
    return named.join(best, names, "left").select(*(F.coalesce("_best", value).alias(value) if c == value else c for c in kept))


def unify_spellings(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Author names per id, organisations per loose spelling (each column for itself), keywords per kind and letter case."""
    out = dict(tables)
    out["authors"] = _respell(tables["authors"], {"id": F.col("scopus_id")}, "name", filled("scopus_id") & filled("name"))
    places = tables["affiliations"]
    for column in ("subparent", "parent1", "parent2"):
        places = _respell(places, {"loose": F.nullif(_loose(F.col(column)), F.lit(""))}, column, filled(column))
    out["affiliations"] = places
    out["keywords"] = _respell(tables["keywords"], {"kind": F.col("kind"), "word": F.lower("keyword")}, "keyword", F.col("keyword").isNotNull() & F.col("kind").isNotNull())
    return out
