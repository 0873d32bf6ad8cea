"""The queries of the corpus operators, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import canonical_values, cooccurrence, distinctiveness, entity_match, format_duplicates, leakage, lookalikes, packing, set_similarity
from folioscope.llm.canonical import NO_TITLE
from folioscope.runtime import durable, read_table


#: White space that plain values don't have outside.
_OUTER = " \t\n\r\x0b\x0c\x85\xa0\u3000"


def _plain(column: str) -> Column:
    return F.lower(F.btrim(F.col(column), F.lit(_OUTER)))


def _field_items(spark: SparkSession, directory: str) -> DataFrame:
    fields = (("keyword", "keywords", "keyword"), ("author", "authors", "name"), ("country", "affiliations", "country"))
    parts = [read_table(spark, directory, table, "eid", column).select(F.lit(field).alias("field"), "eid", _plain(column).alias("item")) for field, table, column in fields]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("item <> ''")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Keywords, author names and countries that share documents far more often than chance."""
    return cooccurrence.count_pairs(_field_items(spark, directory), "field", "eid", "item").select("field", "item_a", "item_b")


def p1_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair that shares five documents, with how many, and how many times more often than chance."""
    return cooccurrence.count_pairs(_field_items(spark, directory), "field", "eid", "item", min_lift=0.0)


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """References and the documents of this corpus that they cite."""
    references = read_table(spark, directory, "references", "eid", "ref_pos", "ref_doi", "ref_title", "ref_year", "ref_authors", "ref_raw")
    documents = read_table(spark, directory, "documents", "doc_id", "eid", "doi", "title", "year")
    authors = read_table(spark, directory, "authors", "eid", "position", "name")
    left = entity_match.reference_side(references, ["eid", "ref_pos"], "ref_doi", "ref_title", "ref_year", "ref_authors", "ref_raw")
    right = entity_match.document_side(documents, authors, "doc_id", "eid", "doi", "title", "year", "position", "name")
    return entity_match.match(left, right).select("eid", "ref_pos", F.col("doc").alias("doc_id")).distinct()


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """The country that each freely typed affiliation country means, '--' for none of the list."""
    countries = read_table(spark, directory, "countries", "alpha2", "name", "common_name", "official_name")
    names = ["name", "common_name", "official_name"]
    listed = countries.select(F.explode(F.array(*names)).alias("country")).where("country is not null").distinct()
    typed = read_table(spark, directory, "affiliations", "eid", "aff_pos", "country")
    typed = typed.where("country rlike '\\\\S' and lower(trim(country)) not in ('-', 'nan', 'none', 'null')").join(listed, "country", "left_anti")
    mapped = canonical_values.map_rows(typed, "country", countries, "alpha2", names)
    return mapped.select("eid", "aff_pos", F.coalesce("key", F.lit("--")).alias("alpha2")).distinct()


def p4_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Each document of at least five works with the class of documents that cite the same works, the class's documents, and the
    number of other classes that cite nearly the same: the result's form at scale, since a class of k documents is k rows and not k (k - 1) / 2."""
    members, pairs = set_similarity.similar_classes(_cited_works(spark, directory))
    return set_similarity.linked(members, pairs).select(F.col("rec").alias("eid"), "class", "copies", "links")


def _cited_works(spark: SparkSession, directory: str) -> DataFrame:
    cited = read_table(spark, directory, "references", "eid", "ref_doi", "ref_title")
    doi = F.regexp_replace(F.regexp_extract(F.lower("ref_doi"), "10\\.\\d{3,9}\\s*/\\s*[^\\s?#]+", 0), "[^a-z0-9]", "")
    title = F.regexp_replace(F.lower("ref_title"), "[^\\p{L}\\p{N}\\p{M}]+", "")
    title = F.when(~title.isin(*NO_TITLE), title)  # a placeholder would make one work of all that lack a title
    works = set_similarity.same_values(cited.select("eid", doi.alias("doi"), title.alias("title")), "eid", ["doi", "title"])
    return durable(works, "cited-works")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of documents that cite nearly the same works."""
    members, pairs = set_similarity.similar_classes(_cited_works(spark, directory))
    return set_similarity.expand(members, pairs).select(F.col("rec_a").alias("eid_a"), F.col("rec_b").alias("eid_b"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Copies of one record under different formatting."""
    documents = read_table(spark, directory, "documents", "doc_id", "title", "doi")
    return format_duplicates.collapse(documents, "doc_id", "title", "doi").where("copies > 1 and first_id < doc_id").select("first_id", "doc_id").distinct()


def p5_copies(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each record, under the least id of its copies, with their number."""
    documents = read_table(spark, directory, "documents", "doc_id", "title", "doi")
    return format_duplicates.collapse(documents, "doc_id", "title", "doi").where("first_id = doc_id").select("first_id", "copies")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Keywords that are characteristic of their document's abstract."""
    keywords = read_table(spark, directory, "keywords", "eid", "keyword")
    documents = read_table(spark, directory, "documents", "eid", "abstract")
    scored = distinctiveness.score_terms(keywords, documents, "eid", "keyword", "abstract", min_occurrences=3)
    return scored.where("records >= 2 and records * 20 < of").select("eid", "keyword").distinct()


def p6_scores(spark: SparkSession, directory: str) -> DataFrame:
    """How characteristic each keyword is of its document's abstract, for those that stand in it."""
    keywords = read_table(spark, directory, "keywords", "eid", "keyword")
    documents = read_table(spark, directory, "documents", "eid", "abstract")
    scored = distinctiveness.score_terms(keywords, documents, "eid", "keyword", "abstract", min_occurrences=1)
    return scored.select("eid", "keyword", "occurrences", "degree", "records", F.round("rarity", 6).alias("rarity"), F.round("score", 6).alias("score"))


def p7_containers(spark: SparkSession, directory: str) -> DataFrame:
    """The container of 1,024 tokens that each text, or piece of a longer one, is put into."""
    documents = read_table(spark, directory, "documents", "doc_id", "text")
    return packing.pack_texts(documents, "doc_id", "text", os.environ.get("FOLIOSCOPE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken"))


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold at least half of a test item."""
    documents = read_table(spark, directory, "documents", "doc_id", "text")
    items = read_table(spark, directory, "eval_items", "item_id", "text")
    return leakage.find(documents, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents whose text holds stand-in characters."""
    documents = read_table(spark, directory, "documents", "doc_id", "text")
    found = sum((F.col(c) for c in ("wide", "joined", "accents", "invisible", "spaces", "repaired", "unresolved")), F.lit(0))
    return lookalikes.repair(documents, "doc_id", "text").where(found > 0).select("doc_id").distinct()


def p9_clean(spark: SparkSession, directory: str) -> DataFrame:
    """The consistent form of each text that isn't in it, with what was found."""
    documents = read_table(spark, directory, "documents", "doc_id", "text")
    return lookalikes.repair(documents, "doc_id", "text")


_P1_PAIRS = """
with rows as (
  select distinct 'keyword' field, eid, lower(trim(keyword)) item from keywords where trim(keyword) <> ''
  union select distinct 'author', eid, lower(trim(name)) from authors where trim(name) <> ''
  union select distinct 'country', eid, lower(trim(country)) from affiliations where trim(country) <> ''
), sizes as (select field, count(distinct eid) baskets from rows group by 1),
single as (select field, item, count(*) n from rows group by 1, 2),
pairs as (
  select a.field, a.item item_a, b.item item_b, count(*) together from rows a
  join rows b on a.field = b.field and a.eid = b.eid and a.item < b.item group by 1, 2, 3 having count(*) >= 5
), scored as (
  select p.field, p.item_a, p.item_b, p.together, x.n n_a, y.n n_b, s.baskets, p.together * s.baskets / (x.n * y.n)::double lift from pairs p join sizes s on s.field = p.field
  join single x on x.field = p.field and x.item = p.item_a join single y on y.field = p.field and y.item = p.item_b
)
"""
P1_SQL = _P1_PAIRS + " select field, item_a, item_b from scored where together * baskets >= 4 * n_a * n_b"
P1_PAIRS = _P1_PAIRS + " select * from scored"


#: Letters of a record's title by part, and groups of records whose letters are one another's with the parts in some order.
_P5_GROUPS = r"""
with recursive k as (
  select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')) || ' ', '[:;.?!|/]+\s', chr(31), 'g'), '\s[:;|/~\-‐-―−]+\s', chr(31), 'g'), '[—―…：；。]', chr(31), 'g'), chr(31)) raw,
    regexp_replace(coalesce(nullif(regexp_extract(lower(doi), '10\.\d{3,9}\s*/\s*[^\s?#]+'), ''), lower(doi), ''), '[^\p{L}\p{N}]+', '', 'g') d from documents
), r as (select doc_id, d, list_filter(list_transform(raw, lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}]+', '', 'g')), lambda x: x <> '') p from k),
s as (select doc_id, d, p, array_to_string(p, '') t, list_sort(string_split(array_to_string(p, ''), '')) c from r where len(p) > 0),
m as (select d, c from s group by 1, 2 having count(distinct t) > 1),
o as (select distinct d, p, ''::varchar t, []::bigint[] used from s join m using (d, c) where len(p) between 2 and 5
  union all select d, p, t || p[i], list_append(used, i) from o, unnest(range(1, len(p) + 1)) as u(i) where not list_contains(used, i)),
e as (select distinct d, array_to_string(p, '') a, t b from o where len(used) = len(p)), both_ways as (select d, a, b from e union select d, b, a from e),
reach as (select distinct s.d, s.t, s.t u from s join m using (d, c) union select h.d, h.t, x.b from reach h join both_ways x on x.d = h.d and x.a = h.u),
g as (select d, t, min(u) least from reach group by 1, 2), named as (select doc_id, s.d, coalesce(g.least, s.t) least from s left join g on g.d = s.d and g.t = s.t),
f as (select d, least, min(doc_id) first_id, count(distinct doc_id) copies from named group by 1, 2)
"""
P5_SQL = _P5_GROUPS + " select distinct first_id, doc_id from named join f using (d, least) where first_id < doc_id"
P5_COPIES = _P5_GROUPS + " select first_id, copies from f union all select doc_id, 1 from r where len(p) = 0"

P6_SQL = r"""
with kw as (select distinct eid, lower(trim(keyword)) keyword from keywords where trim(keyword) <> ''), df as (select keyword, count(*) n from kw group by 1),
d as (select eid, '  ' || regexp_replace(lower(abstract), '([^a-z0-9])', '\1\1', 'g') || '  ' t, lower(abstract) a from documents where abstract is not null)
select distinct kw.eid, kw.keyword from kw join df using (keyword) join d using (eid)
where n >= 2 and n * 20 < (select count(distinct eid) from documents) and contains(a, kw.keyword)
  and len(regexp_extract_all(t, '[^a-z0-9]' || regexp_escape(regexp_replace(kw.keyword, '([^a-z0-9])', '\1\1', 'g')) || '[^a-z0-9]')) >= 3
"""

#: Each occurrence of a keyword is put between marks; its neighbours are the words counted from them.
P6_SCORES = r"""
with kw as (select distinct eid, lower(trim(keyword)) keyword from keywords where trim(keyword) <> ''), df as (select keyword, count(*) n from kw group by 1),
d as (select row_number() over () as doc, eid, '  ' || regexp_replace(lower(abstract), '([^a-z0-9])', '\1\1', 'g') || '  ' t, lower(abstract) a from documents where abstract is not null),
p as (select kw.eid, kw.keyword, doc, t, regexp_escape(regexp_replace(kw.keyword, '([^a-z0-9])', '\1\1', 'g')) x from kw join d using (eid) where contains(a, kw.keyword)),
m as (select eid, keyword, doc, regexp_extract_all(regexp_replace(t, '([^a-z0-9])(' || x || ')([^a-z0-9])', '\1' || chr(2) || '\2' || chr(3) || '\3', 'g'), chr(2) || '|' || chr(3) || '|[\p{L}\p{N}_]+') w from p),
u as (select eid, keyword, doc, unnest(w) word, unnest(range(1, len(w) + 1)) i from m where list_contains(w, chr(2))),
c as (select *, count(*) filter (word not in (chr(2), chr(3))) over (partition by eid, keyword, doc order by i) k from u),
words as (select * from c where word not in (chr(2), chr(3))), marks as (select *, case when word = chr(2) then k - 3 else k + 1 end low from c where word in (chr(2), chr(3))),
n as (select m.eid, m.keyword, m.doc, count(distinct w.word) degree from marks m join words w on w.eid = m.eid and w.keyword = m.keyword and w.doc = m.doc and w.k between m.low and m.low + 3 group by 1, 2, 3),
o as (select eid, keyword, doc, count(*) filter (word = chr(2)) occurrences from c group by 1, 2, 3),
b as (select eid, keyword, max((occurrences, coalesce(degree, 0))) best from o left join n using (eid, keyword, doc) group by 1, 2),
z as (select eid, keyword, best[1] occurrences, best[2] degree, n as records, ln((select count(distinct eid) from documents) / n::double) r from b join df using (keyword))
select eid, keyword, occurrences, degree, records, round(r, 6) rarity, round(degree * r, 6) score from z
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_pairs": P1_PAIRS, "p6_scores": P6_SCORES, "p5_found": P5_SQL, "p5_copies": P5_COPIES, "p6_found": P6_SQL}
