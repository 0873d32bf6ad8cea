"""Countries: recognition, name on the map and position, after a reference list or the names that Java knows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.columns import filled
from folioscope.functions.textual import unaccented

# Official and older names, beside those of the Java runtime, under which exports write countries.
_ALSO = """
United States of America; USA; US; UK; Great Britain; Russian Federation; Viet Nam; Czech Republic; Korea; Republic of Korea; Korea, Republic of; Korea, Democratic People's Republic of;
Democratic People's Republic of Korea; Iran, Islamic Republic of; Islamic Republic of Iran; Syrian Arab Republic; Lao People's Democratic Republic; Democratic Republic of the Congo; Democratic Republic of Congo;
DR Congo; Congo, The Democratic Republic of the; Republic of the Congo; Republic of Congo; Congo; Ivory Coast; Cote d'Ivoire; Macedonia; Tanzania, United Republic of; United Republic of Tanzania;
Taiwan, Province of China; State of Palestine; Palestine, State of; Palestine; Palestinian Territory; Falkland Islands (Malvinas); Timor Leste; East Timor; Swaziland; Brunei Darussalam; Moldova, Republic of;
Republic of Moldova; Libyan Arab Jamahiriya; Turkey; Turkiye; The Netherlands; The Bahamas; The Gambia; Bolivia, Plurinational State of; Venezuela, Bolivarian Republic of; Hong Kong; Macao; Macau; Myanmar; Burma;
Bosnia and Herzegovina; Antigua and Barbuda; Trinidad and Tobago; Saint Kitts and Nevis; Saint Vincent and the Grenadines; Sao Tome and Principe; Micronesia, Federated States of; Cape Verde; Vatican City; Holy See; Kosovo
"""


def place_key(name: str) -> str:
    """A name without accents, in lower case, one space between its words."""
    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(text.lower().replace("\u2019", "'").split())


def place_key_of(column: Column) -> Column:
    """`place_key` of a column."""
    return F.trim(F.regexp_replace(F.translate(F.lower(unaccented(column)), "\u2019", "'"), r"\s+", " "))


def known_countries(spark: SparkSession, countries: DataFrame | list[str] | None = None) -> list[str]:
    """The names of a reference list (alpha2, name, common_name, official_name), those given, or else those that Java and `_ALSO` hold."""
    if isinstance(countries, DataFrame):
        spellings = F.explode(F.array("name", "common_name", "official_name")).alias("name")
        return [r.name for r in countries.select(spellings).where(filled("name")).distinct().collect()]
    if countries is not None:
        return list(countries)
    locale = spark._jvm.java.util.Locale
    names = [locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()]
    plain = [n.replace("&", "and").replace("St.", "Saint") for n in names]
    return [*names, *plain, *(n.split(" (")[0] for n in plain), *(x.strip() for x in _ALSO.split(";"))]


def country_places(countries: DataFrame) -> DataFrame:
    """(key, map_name, lon, lat) for every name, common name and official name of a reference list, by `place_key`.

    The list has alpha2, name, common_name, official_name, atlas, lon and lat; a country without a map name is drawn under its own.
    A spelling that two countries share is left out.
    """
    spellings = F.array_compact(F.array("name", "common_name", "official_name"))
    rows = countries.select("alpha2", F.coalesce("atlas", "common_name", "name").alias("map_name"), "lon", "lat", F.explode(spellings).alias("name")).where(filled("name"))
    rows = rows.withColumn("key", place_key_of(F.col("name")))
    clean = lambda x: F.min(F.when(~F.isnan(x), F.col(x))).alias(x)
    return rows.groupBy("key").agg(F.countDistinct("alpha2").alias("k"), F.min("map_name").alias("map_name"), clean("lon"), clean("lat")).where("k = 1").drop("k")


def is_country(value: Column, names: list[str]) -> Column:
    """Whether a value is, but for case, accents and spaces, one of a reference list's names."""
    return place_key_of(value).isin(sorted({place_key(n) for n in names}))
