"""SQL with the results of the registered queries, written against the tables and not after the plans.

`{name}` stands for a shared table expression of PARTS, put before the statement with whatever it needs itself.
"""

from __future__ import annotations

import re

from folioscope.functions.textual import STOPWORDS

# Rounding as the operators do it: half-even on the scaled value.
_R = re.compile(r"\br(\d)\(")


def _rounding(sql: str) -> str:
    """Spell out r2(x) and the like as round_even(x * 100, 0) / 100."""
    while m := _R.search(sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        scale = 10 ** int(m.group(1))
        sql = f"{sql[: m.start()]}(round_even(({sql[m.end() : end - 1]})::double * {scale}.0, 0) / {scale}.0){sql[end:]}"
    return sql


PARTS = {
    "docs": "select eid, year::bigint as year, coalesce(cited_by, 0)::bigint as c, title, source, doc_type, doi, issn, open_access, abstract, publisher, language, link, source_abbr from documents",
    "last": "select max(year)::bigint as y1 from documents",
    "grid": "select unnest(range(min(year)::bigint, max(year)::bigint + 1)) as year from documents",
    "yearly": "select g.year, count(d.eid) as documents from {grid} g left join {docs} d on d.year = g.year group by 1",
    "au": "select *, coalesce(scopus_id, 'name:' || name) as key from authors where length(trim(name)) > 0",
    "auname": "select key, name from (select key, name, row_number() over (partition by key order by count(*) desc, name) as k from {au} group by 1, 2) where k = 1",
    "inst": "select eid, aff_pos, org, min(country) as country, min(city) as city, min(subparent) as subparent from (select eid, aff_pos, subparent, city, country, trim(parent1) as org from affiliations where length(trim(parent1)) > 0 union all select eid, aff_pos, subparent, city, country, trim(parent2) from affiliations where length(trim(parent2)) > 0) group by 1, 2, 3",
    "org": "select * from {inst} where org <> 'Independent researcher'",
    "orgpair": "select eid, org, arg_min(country, (aff_pos, country)) as country from {org} group by 1, 2",
    "unitpair": "select eid, trim(subparent) as org, arg_min(country, (aff_pos, country)) as country from affiliations where length(trim(subparent)) > 0 and trim(subparent) <> 'Independent researcher' group by 1, 2",
    "cc": "select distinct eid, country from affiliations where length(trim(country)) > 0",
    "kw": "select eid, keyword, kind, lower(trim(keyword)) as norm from keywords where length(trim(keyword)) > 0",
    "kwa": "select * from {kw} where kind = 'author'",
    "kwname": "select norm, name from (select norm, trim(keyword) as name, row_number() over (partition by norm order by count(*) desc, trim(keyword)) as k from {kwa} group by 1, 2) where k = 1",
    "city": "select eid, trim(city) as city, arg_min(country, (aff_pos, country)) as country from affiliations where trim(city) <> '' and lower(trim(city)) not in ('nan', 'none') group by 1, 2",
    "cityname": "select city, country from (select city, country, row_number() over (partition by city order by count(*) desc, country) as k from {city} where country is not null group by 1, 2) where k = 1",
    "perdoc": "select eid, count(distinct name) as j from authors where length(trim(name)) > 0 group by 1",
    "srcpair": "select distinct eid, source from {docs} where length(trim(source)) > 0",
    "firstau": "select eid, arg_min(name, (position, name)) as first_author from authors where length(trim(name)) > 0 group by 1",
    "doi_of": "select eid, nullif(rtrim(lower(regexp_extract(doi, '(10\\.\\d{4,9}/\\S+)', 1)), '.,;)'), '') as doi, nullif(trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') as t from documents",
    "ref_of": "select eid, nullif(rtrim(lower(regexp_extract(ref_doi, '(10\\.\\d{4,9}/\\S+)', 1)), '.,;)'), '') as doi, nullif(trim(regexp_replace(regexp_replace(lower(strip_accents(ref_title)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') as t from doc_references",
    "bydoi": "select doi, min(eid) as cited from {doi_of} where doi is not null group by 1",
    "bytitle": "select t, min(eid) as cited from {doi_of} where length(t) >= 25 group by 1",
    "cites": "select citing, cited, min(via) as via from (select r.eid as citing, b.cited, 'doi' as via from {ref_of} r join {bydoi} b on b.doi = r.doi union all select r.eid, b.cited, 'title' from {ref_of} r join {bytitle} b on b.t = r.t where r.doi is null or r.doi not in (select doi from {bydoi})) where citing <> cited group by 1, 2",
    "local": "select d.eid, coalesce(x.n, 0) as n from (select distinct eid from documents) d left join (select cited, count(*) as n from {cites} group by 1) x on x.cited = d.eid",
    "ages": "select d.eid, d.year, greatest(d.year - r.ref_year, 0) as age from doc_references r join {docs} d on d.eid = r.eid where r.ref_year is not null and d.year is not null and d.year - r.ref_year between -2 and 200",
    "card": "select * exclude k from (select *, row_number() over (partition by eid order by c desc, title, year, source, doc_type, doi) as k from {docs}) where k = 1",
    "journal": "select title as id, title, min(issn) as issn, case length(title) % 5 when 0 then null else 'Q' || length(title) % 5 end as quartile, case length(title) % 3 when 0 then 'Engineering; Physics' when 1 then 'Medicine' else 'Physics' end as areas, case length(title) % 3 when 0 then 'Alloys (Q1); Optics (Q3)' when 1 then 'Surgery' else 'Optics (Q2)' end as categories, length(title) % 2 = 0 as open_access from (select trim(source) as title, case when length(regexp_replace(upper(issn), '[^0-9X]', '', 'g')) = 8 then regexp_replace(upper(issn), '[^0-9X]', '', 'g') end as issn from documents where length(trim(source)) > 0) where length(title) % 7 <> 0 group by title",
    "issn_of": "select source, issn from (select trim(source) as source, regexp_replace(upper(issn), '[^0-9X]', '', 'g') as issn, row_number() over (partition by trim(source) order by count(*) desc, regexp_replace(upper(issn), '[^0-9X]', '', 'g')) as k from documents where length(trim(source)) > 0 and length(regexp_replace(upper(issn), '[^0-9X]', '', 'g')) = 8 group by 1, 2) where k = 1",
    "plain_journal": "select *, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) as plain from {journal}",
    "js": "select s.source, s.documents, s.citations, case when a.id is not null then 'issn' when b.id is not null then 'title' else '' end as matched_by, coalesce(a.id, b.id) as id, case when a.id is not null then a.quartile else b.quartile end as quartile, case when a.id is not null then a.areas else b.areas end as areas, case when a.id is not null then a.categories else b.categories end as categories, case when a.id is not null then a.open_access else b.open_access end as open_access from (select trim(source) as source, count(distinct eid) as documents, sum(c)::bigint as citations from {docs} where length(trim(source)) > 0 group by 1) s left join {issn_of} i on i.source = s.source left join (select issn, min(id) as k from {journal} where length(title) % 2 = 0 group by 1) x on x.issn = i.issn left join {journal} a on a.id = x.k left join (select plain, min(id) as k from {plain_journal} where length(plain) >= 8 group by 1) y on y.plain = trim(regexp_replace(lower(strip_accents(s.source)), '[^a-z0-9]+', ' ', 'g')) left join {journal} b on b.id = y.k",
    "place": "select key, min(coalesce(atlas, common_name, first)) as map_name, min(case when not isnan(lon) then lon end) as lon, min(case when not isnan(lat) then lat end) as lat from (select *, trim(regexp_replace(lower(strip_accents(name)), '\\s+', ' ', 'g')) as key from (select distinct alpha2, atlas, common_name, name as first, lon, lat, unnest([name, common_name, official_name]) as name from countries) where length(trim(name)) > 0) group by 1 having count(distinct alpha2) = 1",
    "works": "select eid, ref_authors, ref_year, ref_title, case when length(trim(ref_doi)) > 0 then 'doi:' || lower(trim(ref_doi)) when length(t) >= 12 then 't:' || t end as key from (select *, nullif(trim(regexp_replace(regexp_replace(lower(strip_accents(ref_title)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), '') as t from doc_references)",
}


def _impact(pairs: str, key: str, having: str = "") -> str:
    """Counts and indices of `key` over distinct pairs, by ranking every row."""
    return f"""select p.{key} as k, count(distinct p.eid) as documents, sum(c)::bigint as citations, min(year) as first_year, max(year) as last_year,
  sum(case when c >= rn then 1 else 0 end)::bigint as h, sum(case when cum >= rn * rn then 1 else 0 end)::bigint as g, sum(case when c >= 10 then 1 else 0 end)::bigint as i10,
  r2(sqrt(sum(case when c >= rn then c else 0 end) - sum(case when c >= rn then 1 else 0 end) ** 2)) as e
from (select x.{key}, x.eid, d.year, coalesce(d.c, 0) as c, row_number() over w as rn, sum(coalesce(d.c, 0)) over (w rows between unbounded preceding and current row) as cum
  from {pairs} x left join {{docs}} d on d.eid = x.eid window w as (partition by x.{key} order by coalesce(d.c, 0) desc, x.eid, d.title, d.doi)) p group by 1 {having}"""


_M = "case when y1 - first_year + 1 > 0 then r2(h * 1.0 / (y1 - first_year + 1)) end"


def _over_time(pairs: str, key: str, n: int, value: str = "documents") -> str:
    return f"""with d as (select distinct x.{key}, x.eid, y.year from {pairs} x join {{docs}} y on y.eid = x.eid where y.year is not null),
top as (select {key} from d group by 1 order by count(distinct eid) desc, {key} limit {n}),
k as (select d.* from d join top using ({key})),
years as (select unnest(range(min(year), max(year) + 1)) as year from k),
n as (select {key}, year, count(distinct eid) as c from k group by 1, 2)
select {key}, year, coalesce(n.c, 0) as {value}, sum(coalesce(n.c, 0)) over (partition by {key} order by year)::bigint as cumulative from top cross join years left join n using ({key}, year)"""


def _pairs(members: str, n: int, least: int) -> str:
    """Edges of the `n` most frequent keys of (eid, key)."""
    return f"""with m as ({members}), top as (select key, count(*) as occurrences from m group by 1 order by 2 desc, 1 limit {n}), f as (select * from m join top using (key)),
edges as (select a.key as source, b.key as target, count(*) as weight from f a join f b on a.eid = b.eid and a.key < b.key group by 1, 2 having count(*) >= {least})"""


def _nodes(label: str, joins: str = "") -> str:
    return f"""select t.key as id, {label} as label, t.occurrences, s.degree from top t join (select key, sum(weight)::bigint as degree from (select source as key, weight from edges union all select target, weight from edges) group by 1) s using (key) {joins}"""


_CAT = "select x.place, x.name, count(y.k) as documents, coalesce(sum(y.c), 0)::bigint as citations from cat x left join rows y on y.k = x.name group by 1, 2"
_SHARES = "r1(100.0 * documents / (select count(*) from rows)) as share, citations, case when documents > 0 then r2(citations * 1.0 / documents) else 0.0 end as citations_per_document"
_FILLED = "coalesce(lower(trim({f}::varchar)) not in ('', 'nan', 'none', 'na', 'null', '<na>', 'nat', '-'), false)"
_STATUS = "case when share >= 90 then 'ready' when share >= 50 then 'partial' else 'limited' end as status"
_WORDS = "select distinct eid, norm as key from {kwa}"


def _completeness(table: str, fields: list[str], where: dict[str, str] | None = None) -> str:
    one = lambda f: f"select '{f}' as field, count(*) filter ({_FILLED.format(f=f)}) as filled, count(*) as total from {table}" + (f" where {where[f]}" if where and f in where else "")
    return " union all ".join(map(one, fields))


def _levels(unit: str) -> str:
    return {
        "authors": "select key as e, count(distinct eid) as d from {au} where key is not null group by 1", "institutions": "select org as e, count(distinct eid) as d from {org} group by 1", "countries": "select country as e, count(distinct eid) as d from {cc} group by 1",
        "sources": "select source as e, count(distinct eid) as d from {srcpair} group by 1", "cities": "select city as e, count(distinct eid) as d from {city} group by 1",
    }[unit]


def _concentration(unit: str) -> str:
    return f"""select '{unit}' as unit, count(*) as entities, sum(d)::bigint as documents, r4(2.0 * sum(d * i) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*)) as gini,
  r1(100.0 * sum(case when j <= 4 then d else 0 end) / sum(d)) as cr4, r1(100.0 * sum(case when j <= 10 then d else 0 end) / sum(d)) as cr10, r1(100.0 * sum(case when j <= greatest(1, ceil(n / 10.0)) then d else 0 end) / sum(d)) as top_share_10pct
from (select d, row_number() over (order by d, e) as i, row_number() over (order by d desc, e) as j, count(*) over () as n from ({_levels(unit)}))"""


#: Levels of productivity (d, n) and the likeliest exponent a, by halving an interval 60 times, with zeta z(a).
_LOTKA = """with recursive l as materialized (select d, count(*) as n from (select count(distinct eid) as d from {au} where key is not null group by key) group by 1), m as (select sum(n * ln(d)) / sum(n) as v from l),
t as materialized (select ln(i::double) as i from (select unnest(range(1, 200001)) as i)), b as (select 1.01::double as lo, 6.0::double as hi, 0 as k
  union all select case when up then (lo + hi) / 2 else lo end, case when up then hi else (lo + hi) / 2 end, k + 1 from (select lo, hi, k, sum(i * exp(-(lo + hi) / 2 * i)) / sum(exp(-(lo + hi) / 2 * i)) > (select v from m) as up from b, t where k < 60 group by 1, 2, 3)),
e as (select (lo + hi) / 2 as a from b where k = 60), f as (select a, (select sum(exp(-a * ln(n::double))) from (select unnest(range(1, 100001)) as n)) + pow(100000.5, 1 - a) / (a - 1) as z from e)"""

SQL = {
    "summary": "select (select count(*) from documents) as documents, (select min(year) from {docs}) as year_min, (select max(year) from {docs}) as year_max, (select count(distinct source) from {srcpair}) as sources, (select sum(c)::bigint from {docs}) as citations, (select count(distinct coalesce(scopus_id, 'name:' || name)) from authors) as authors, (select count(distinct raw) from affiliations) as affiliations, (select count(distinct country) from {cc}) as countries, (select count(distinct org) from {inst}) as institutions, (select count(distinct keyword) from keywords where kind = 'author') as keywords, (select count(*) from doc_references) as references, (select count(*) from documents where eid not in (select eid from doc_references)) as documents_without_references",
    "main_information": """with y as (select * from {yearly}), e as (select arg_min(documents, year) as first, arg_max(documents, year) as last, max(year) - min(year) as span from y)
select (select count(*) from documents) as documents, (select min(year) from {docs}) as year_min, (select max(year) from {docs}) as year_max, (select min(year)::varchar || '-' || max(year)::varchar from {docs}) as timespan,
  (select r2((pow(last * 1.0 / first, 1.0 / span) - 1) * 100) from e) as annual_growth_rate, (select r2(max(year) - avg(year)) from {docs}) as document_average_age, (select count(distinct source) from documents) as sources, (select count(distinct doc_type) from documents) as document_types,
  (select sum(c)::bigint from {docs}) as total_citations, (select r2(sum(c) * 1.0 / count(*)) from {docs}) as citations_per_document, (select count(*) from doc_references) as references, (select r1(avg(k)) from (select count(*) as k from doc_references group by eid)) as references_per_document,
  (select count(distinct lower(keyword)) from keywords where kind = 'author') as keywords_author, (select count(distinct lower(keyword)) from keywords where kind = 'index') as keywords_index, (select count(distinct coalesce(scopus_id, 'name:' || name)) from authors) as authors,
  (select r2(sum(j) * 1.0 / count(*)) from {perdoc}) as authors_per_document, (select count(*) from {perdoc} where j = 1) as single_authored_documents, (select r2(sum(j) * 1.0 / count(*)) from {perdoc} where j > 1) as collaboration_index, (select count(distinct country) from {cc}) as countries,
  (select count(*) from (select eid from {cc} group by 1 having count(*) > 1)) as international_documents, (select r1(100.0 * sum(case when k > 1 then 1 else 0 end) / count(*)) from (select count(*) as k from {cc} group by eid)) as international_share""",
    "production_by_year": "select g.year, count(distinct d.eid) as documents, coalesce(sum(d.c), 0)::bigint as citations, case when count(distinct d.eid) > 0 then r2(coalesce(sum(d.c), 0) * 1.0 / count(distinct d.eid)) end as citations_per_doc, sum(count(distinct d.eid)) over (order by g.year)::bigint as cumulative from {grid} g left join {docs} d on d.year = g.year group by g.year",
    "production_by_country": "select country, count(distinct p.eid) as documents, coalesce(sum(c), 0)::bigint as citations from {cc} p left join {docs} d on d.eid = p.eid group by 1",
    "institutions_over_time": "select institution, year, documents, cumulative from (" + _over_time("(select distinct eid, org as institution from {org})", "institution", 10) + ")",
    "cities_over_time": _over_time("{city}", "city", 8), "sources_over_time": _over_time("{srcpair}", "source", 8),
    "word_dynamics": "select year, n.name as keyword, occurrences, cumulative from (" + _over_time("(select distinct eid, norm from {kwa})", "norm", 10, "occurrences") + ") x join {kwname} n using (norm)",
    "institutions_by_country": """with p as (select distinct eid, org, country from {org} where length(trim(country)) > 0), e as (select country, org, count(distinct eid) as d from p group by 1, 2)
select country, count(*) as institutions, any_value(w.documents) as documents, arg_min(org, (-d, org)) as top_institution from e join (select country, count(distinct eid) as documents from p group by 1) w using (country) group by 1 order by 3 desc, 2 desc, 1 limit 20""",
    "org_hierarchy": """with b as (select eid, org as parent, subparent from {org}), p as (select distinct eid, parent, subparent from b where length(trim(subparent)) > 0)
select parent, subparent, count(distinct p.eid) as documents, coalesce(sum(c), 0)::bigint as citations, any_value(t.n) as parent_documents, r1(100.0 * count(distinct p.eid) / any_value(t.n)) as share from p left join {docs} d on d.eid = p.eid join (select parent, count(distinct eid) as n from b group by 1) t using (parent) group by 1, 2 order by 5 desc, 1, 3 desc, 2 limit 20""",
    "top_authors": "select n.name as author, min(a.scopus_id) as scopus_id, count(distinct a.eid) as documents, coalesce(sum(c), 0)::bigint as citations, count(*) filter (false) + sum(case when position = 1 then 1 else 0 end)::bigint as first_author from {au} a join {auname} n using (key) left join {docs} d on d.eid = a.eid group by key, n.name order by 3 desc, 4 desc, key limit 20",
    "top_sources": "select source, count(distinct eid) as documents, sum(c)::bigint as citations from {docs} where length(trim(source)) > 0 group by 1 order by 2 desc, 3 desc, 1 limit 20",
    "top_keywords": "select n.name as keyword, count(distinct eid) as documents from {kwa} join {kwname} n using (norm) group by norm, n.name order by 2 desc, norm limit 30",
    "top_keywords_all": "with n as (select norm, name from (select norm, trim(keyword) as name, row_number() over (partition by norm order by count(*) desc, trim(keyword)) as k from {kw} group by 1, 2) where k = 1) select n.name as keyword, count(distinct eid) as documents from {kw} join n using (norm) group by norm, n.name",
    "document_types": "select doc_type, count(distinct eid) as documents, r1(100.0 * count(distinct eid) / sum(count(distinct eid)) over ()) as share from documents where length(trim(doc_type)) > 0 group by 1",
    "impact": "select documents_ as documents, citations, r2(citations * 1.0 / documents_) as citations_per_doc, h as h_index, g as g_index, i10 as i10_index, e as e_index, uncited from (" + _impact("(select 1 as one, eid from (select distinct eid from documents))", "one") + ") cross join (select count(*) as documents_, sum(case when c = 0 then 1 else 0 end)::bigint as uncited from {docs})",
    "authors_impact": """with s as (""" + _impact("(select distinct key, eid from {au} where key is not null)", "key") + """), pl as (select key, count(*) filter (p = 1) as p1, count(*) filter (p = 2) as p2, count(*) filter (p = 3) as p3, count(*) as n from (select key, eid, min(position) as p from {au} group by 1, 2) group by 1)
select """ + _M + """ as m_index, n.name as author, (select min(scopus_id) from {au} a where a.key = s.k) as scopus_id, documents, citations::bigint as citations, h as h_index, g as g_index, i10 as i10_index, e as e_index, p1 as first_author, p2 as second_author, p3 as third_author, pl.n - p1 - p2 - p3 as later_author, first_year, last_year
from s join pl on pl.key = s.k join {auname} n on n.key = s.k cross join {last}""",
    "sources_impact": "select k as source, documents, citations::bigint as citations, h as h_index, g as g_index, " + _M + " as m_index, first_year, last_year from (" + _impact("{srcpair}", "source") + ") cross join {last}",
    "countries_impact": "select k as country, documents, citations::bigint as citations, h as h_index, g as g_index, " + _M + " as m_index, first_year, last_year from (" + _impact("{cc}", "country") + ") cross join {last} order by 4 desc, 3 desc, 2 desc, 1 limit 20",
    "cities_impact": "select k as city, n.country, documents, citations::bigint as citations, h as h_index, g as g_index, " + _M + " as m_index, first_year, last_year from (" + _impact("{city}", "city") + ") s left join {cityname} n on n.city = s.k cross join {last} order by 5 desc, 4 desc, 3 desc, 1 limit 20",
    "normalized_citations": "select d.eid, d.c as citations, coalesce(r2(m.v), 0) as year_mean_citations, case when m.v > 0 then r3(d.c / m.v) else 0 end as normalized_citations from {docs} d left join (select year, avg(c) as v from {docs} where year is not null group by 1) m on m.year = d.year",
    "first_author_countries": """with p as (select eid, aff_pos, country from affiliations where length(trim(country)) > 0), own as (select distinct eid, aff_pos from author_affiliations where position = 1 and aff_pos is not null),
a as (select eid, arg_min(country, (aff_pos, country)) as country from p join own using (eid, aff_pos) group by 1), b as (select eid, arg_min(country, (aff_pos, country)) as country from p where eid not in (select eid from a) group by 1),
k as (select eid, count(distinct country) as k from p group by 1), r as (select * from (select * from a union all select * from b) join k using (eid) left join {docs} d using (eid))
select country, count(distinct eid) as documents, count(distinct case when k = 1 then eid end) as scp, count(distinct case when k > 1 then eid end) as mcp, r4(count(distinct case when k > 1 then eid end) * 1.0 / count(distinct eid)) as mcp_ratio, coalesce(sum(c), 0)::bigint as citations, r2(coalesce(sum(c), 0) * 1.0 / count(distinct eid)) as citations_per_document from r group by 1 order by 2 desc, 6 desc, 1 limit 20""",
    "top_cities": "select p.city, any_value(n.country) as country, count(distinct p.eid) as documents, coalesce(sum(c), 0)::bigint as citations, coalesce(any_value(i.n), 0) as institutions, r2(coalesce(sum(c), 0) * 1.0 / count(distinct p.eid)) as citations_per_document from {city} p left join {docs} d on d.eid = p.eid left join {cityname} n on n.city = p.city left join (select trim(city) as city, count(distinct org) as n from {inst} group by 1) i on i.city = p.city group by 1 order by 3 desc, 4 desc, 1 limit 20",
    "collaboration_scale": """with p as (select eid, count(distinct city) as ci, count(distinct country) as co from {city} group by 1), o as (select eid, count(distinct parent1) as n from affiliations where parent1 is not null group by 1), m as (select eid, max(c) as c from {docs} group by 1),
rows as (select case when co > 1 then 'International' when ci > 1 then 'National (same country)' when coalesce(o.n, 1) > 1 then 'Local (same city)' else 'Single affiliation' end as k, coalesce(m.c, 0) as c from p left join o using (eid) left join m using (eid)),
cat as (select * from (values (0, 'Single affiliation'), (1, 'Local (same city)'), (2, 'National (same country)'), (3, 'International')) t(place, name)) select name as scale, documents, """ + _SHARES + f" from ({_CAT})",
    "city_hierarchy": """with p as (select distinct eid, country, trim(city) as city from affiliations where trim(city) <> '' and lower(trim(city)) not in ('nan', 'none') and length(trim(country)) > 0), w as (select country, count(distinct eid) as n from p group by 1),
i as (select country, trim(city) as city, org, count(*) as k from {inst} group by 1, 2, 3), l as (select country, city, count(*) as institutions, arg_min(org, (-k, org)) as top_institution, string_agg(org || ' (' || k || ')', '; ' order by k desc, org) as institution_affiliations from i group by 1, 2)
select p.country, p.city, coalesce(any_value(l.institutions), 0) as institutions, count(distinct p.eid) as documents, any_value(l.top_institution) as top_institution, r1(100.0 * count(distinct p.eid) / any_value(w.n)) as share_of_country, coalesce(any_value(l.institution_affiliations), '') as institution_affiliations
from p join w using (country) left join l on l.country = p.country and l.city = p.city group by 1, 2 order by 1, 4 desc, 2 limit 40""",
    "most_cited_documents": "select title, first_author, year, source, doc_type, c as citations, r2(c * 1.0 / (y1 - year + 1)) as citations_per_year, doi from {docs} d left join {firstau} f using (eid) cross join {last} order by c desc, d.eid, title limit 20",
    "most_normalized_documents": "with m as (select year, avg(c) as v from {docs} where year is not null group by 1), s as (select d.eid, max(case when m.v > 0 then r3(d.c / m.v) else 0 end) as n, max(coalesce(r2(m.v), 0)) as y from {docs} d left join m on m.year = d.year group by 1) select d.eid, title, first_author, year, source, c as citations, s.y as year_mean_citations, s.n as normalized_citations from {card} d join s using (eid) left join {firstau} f using (eid) order by 8 desc, 1 limit 25",
    "document_list": "select title, first_author, year, source, doc_type, c as citations, n as local_citations, doi from {docs} d left join {firstau} f using (eid) left join {local} l using (eid) order by c desc nulls last, d.eid, doi nulls first limit 100",
    "most_cited_references": """with r as (select *, coalesce(case when length(trim(ref_doi)) > 0 then lower(trim(ref_doi)) end, 't:' || lower(trim(coalesce(ref_title, '')))) as key from doc_references), b as (select key, count(distinct eid) as n, min(ref_doi) as ref_doi from r group by 1 order by 2 desc, 1 limit 20),
t as (select key, ref_title from (select key, ref_title, row_number() over (partition by key order by count(*) desc, ref_title) as k from r where ref_title is not null group by 1, 2) where k = 1), y as (select key, ref_year from (select key, ref_year, row_number() over (partition by key order by count(*) desc, ref_year) as k from r where ref_year is not null group by 1, 2) where k = 1)
select ref_title as reference, ref_year::bigint as ref_year, ref_doi, n as local_citations from b left join t using (key) left join y using (key)""",
    "field_completeness": "select field, l.label, filled, total, share, " + _STATUS + ", l.unlocks from (select *, r1(100.0 * filled / total) as share from (" + _completeness("{docs_}", ["title", "year", "source", "doc_type", "cited_by", "doi", "issn", "abstract", "open_access", "publisher", "language"]) + ")) join (values ('title', 'Title', 'Document lists, local citation matching by title'), ('year', 'Year', 'Everything time-based: production, growth, trends'), ('source', 'Source', 'Sources, Bradford, SCImago'), ('doc_type', 'Document type', 'Type filter and breakdown'), ('cited_by', 'Citations', 'All impact indices: h, g, i10, e, m'), ('doi', 'DOI', 'Local citation matching, deduplication'), ('issn', 'ISSN', 'SCImago matching, hence quartiles and SJR'), ('abstract', 'Abstract', 'Text mining on abstracts'), ('open_access', 'Open access', 'Open access status and routes'), ('publisher', 'Publisher', 'Publisher breakdown'), ('language', 'Language', 'Language breakdown')) l(field, label, unlocks) using (field)",
    "table_completeness": "select \"table\", field, filled, total, share, " + _STATUS + " from (select *, coalesce(r1(100.0 * filled / total), 0) as share from (select 'authors' as \"table\", * from (" + _completeness("authors", ["name", "scopus_id"]) + ") union all select 'affiliations', * from (" + _completeness("affiliations", ["parent1", "subparent", "city", "country"], {"city": "lower(trim(coalesce(site, ''))) <> 'virtual'"}) + ") union all select 'keywords', * from (" + _completeness("keywords", ["keyword"]) + ") union all select 'references', * from (" + _completeness("doc_references", ["ref_doi", "ref_year", "ref_title"]) + ")))",
    "anomalies": """with t as (select count(*) as n, max(year) as y from documents), e as (select distinct eid from documents)
select c as "check", k as documents, r1(100.0 * k / n) as share, s as severity, d as detail from t cross join (
select 'Missing year' as c, (select count(*) from documents where year is null) as k, 'high' as s, 'Excluded from every time-based indicator.' as d
union all select 'Year in the future', (select count(*) from documents, t where year > t.y + 1), 'low', 'Usually an ''in press'' record; harmless but it stretches the axis.'
union all select 'Negative or unreadable citations', (select count(*) from documents where cited_by < 0), 'high', 'Impact indices would be wrong.'
union all select 'No author', (select count(*) from e where eid not in (select eid from authors)), 'high', 'Absent from author rankings and from co-authorship.'
union all select 'No affiliation', (select count(*) from e where eid not in (select eid from affiliations)), 'medium', 'Absent from institutions, cities and countries.'
union all select 'No reference', (select count(*) from e where eid not in (select eid from doc_references)), 'medium', 'Cannot cite locally, nor take part in coupling.'
union all select 'No keyword', (select count(*) from e where eid not in (select eid from keywords)), 'medium', 'Absent from co-word, thematic map and evolution.')""",
    "duplicates": """with d as (select o.eid, case when lower(trim(x.doi)) not in ('', 'nan', 'none', 'na', 'null', '<na>', 'nat', '-') then lower(trim(x.doi)) end as doi, o.t, left(coalesce(x.title, ''), 60) as s from (select row_number() over () as i, * from {doi_of}) o join (select row_number() over () as i, title, doi from documents) x using (i)),
g as (select doi, count(*) as n from d where doi is not null group by 1 having count(*) > 1), h as (select t, count(*) as n from d where length(t) >= 25 and t not in (select doi from g) group by 1 having count(*) > 1)
select 'DOI' as kind, doi as key, any_value(g.n) as documents, string_agg(distinct s, ' | ' order by s) as titles from d join g using (doi) group by 2
union all select 'Title', left(t, 80), any_value(h.n), string_agg(distinct s, ' | ' order by s) from d join h using (t) group by t""",
    "cagr": "with e as (select arg_min(documents, year) as a, arg_max(documents, year) as b, max(year) - min(year) as n from {yearly}) select case when n > 0 and a > 0 then r2((pow(b * 1.0 / a, 1.0 / n) - 1) * 100) end as cagr from e",
    "agr": "select year, documents, case when lag(documents) over (order by year) > 0 then r2(100.0 * (documents - lag(documents) over (order by year)) / lag(documents) over (order by year)) end as agr, sum(documents) over (order by year)::bigint as cumulative from {yearly}",
    "rgr_doubling_time": "with a as (select year, documents, sum(documents) over (order by year)::bigint as cumulative from {yearly}), b as (select *, ln(cumulative) as l, ln(cumulative) - lag(ln(cumulative)) over (order by year) as q from a) select year, documents, cumulative, r4(l) as ln_cumulative, r4(q) as rgr, case when q > 0 then r2(ln(2) / q) end as doubling_time from b",
    "collaboration_indicators": """with s as (select count(*) as n, sum(case when j = 1 then 1 else 0 end) as one, sum(j) as signed, sum(1.0::double / j) as parts, max(j) as most from {perdoc}), a as (select count(distinct coalesce(scopus_id, 'name:' || name)) as a from authors)
select n as documents, one::bigint as single_authored, (n - one)::bigint as multi_authored, r4((n - one) * 1.0 / n) as degree_of_collaboration, r4(signed * 1.0 / n) as collaboration_index, r4(1 - parts / n) as collaborative_coefficient, r4((1 - parts / n) * a / (a - 1)) as modified_collaborative_coefficient, a as authors, r4(n * 1.0 / a) as aapp, most as max_authors from s, a""",
    "authorship_pattern": "select j as authors, count(*) as documents, r2(100.0 * count(*) / sum(count(*)) over ()) as share from {perdoc} group by 1",
    "authorship_groups": "with rows as (select case when j >= 4 then '4+ authors' when j = 1 then '1 author' else j || ' authors' end as k, c from {docs} join {perdoc} using (eid)), cat as (select * from (values (1, '1 author'), (2, '2 authors'), (3, '3 authors'), (4, '4+ authors')) t(place, name)) select name as \"group\", place::bigint as min_authors, documents, " + _SHARES + f" from ({_CAT})",
    "cai": """with y as (select eid, min(year) as year from {docs} where year is not null group by 1), p as (select least(j, 4) as band, year from {perdoc} join y using (eid)), b as (select min(year) as y0, max(year) as y1 from p), q as (select (year - y0) // 5 as block, band, y0, y1 from p, b),
t as (select band, count(*) as n from q group by 1), s as (select block, any_value(y0) + block * 5 as a, least(any_value(y0) + block * 5 + 4, any_value(y1)) as z, count(*) as n, count(*) filter (band = 1) as b1, count(*) filter (band = 2) as b2, count(*) filter (band = 3) as b3, count(*) filter (band = 4) as b4 from q group by 1)
select case when z > a then a || '-' || z else a::varchar end as period, n as documents, b1 as single, b2 as two, b3 as three, b4 as multi, """ + ", ".join(f"r1((b{i}::double / n) / (((select n from t where band = {i})::double) / (select sum(n) from t)) * 100) as cai_{name}" for i, name in enumerate(("single", "two", "three", "multi"), 1)) + " from s",
    "price_law": """with a as (select key, count(distinct eid) as d from {au} where key is not null group by 1), r as (select d, row_number() over (order by d desc, key) as i, sum(d) over (order by d desc, key rows unbounded preceding) as s from a), w as (select count(*) as n, sum(d)::bigint as t, round_even(sqrt(count(*)), 0)::bigint as core from a)
select n as authors, coalesce(t, 0) as signatures, core as expected_core, r1(100.0 * (select sum(d) from r where i <= core) / t) as observed_share, (select min(i) from r where s >= t / 2.0) as half_reached_with from w""",
    "documents_by_affiliation_count": "select coalesce(k, 0) as affiliations, count(*) as documents, r1(100.0 * count(*) / sum(count(*)) over ()) as share from (select distinct eid from documents) left join (select eid, count(distinct trim(parent1)) as k from affiliations where length(trim(parent1)) > 0 group by 1) using (eid) group by 1",
    "lotka_table": _LOTKA + " select d as documents_written, n as n_authors, r4(n * 1.0 / (select sum(n) from l)) as share_observed, r4(pow(d, -a) / z) as share_fitted, r4(6 / (pi() * pi()) / (d * d)) as share_lotka from l, f",
    "lotka_fit": _LOTKA + " select any_value(r6(a)) as exponent, any_value(r6(1 / z)) as constant, r6(regr_r2(log10(n), log10(d))) as r2, r6(-regr_slope(log10(n), log10(d))) as exponent_ols from l, f",
    "lotka_tests": _LOTKA + """, g as (select unnest(range(1, (select max(d) from l) + 1)) as x), c as (select law, x, sum(coalesce(n, 0)) over w / (select sum(n) from l) as o, sum(pow(x, -e) / s) over w as t from g left join l on l.d = g.x cross join (select 'fitted' as law, a as e, z as s from f union all select 'strict', 2.0, pi() * pi() / 6) window w as (partition by law order by x)),
k as (select law, max(abs(o - t)) as d, (select sum(n) from l) as n from c group by 1)
select law, r4(d) as d, r4(least(1, greatest(0, 2 * (select sum(case when i % 2 = 1 then 1 else -1 end * exp(-2 * i * i * n * d * d)) from (select unnest(range(1, 101)) as i))))) as p_value, r4(1.36 / sqrt(n)) as critical_5pct, d <= 1.36 / sqrt(n) as follows_lotka from k""",
    "bradford": "with s as (select source, count(distinct eid) as d from {srcpair} group by 1), q as (select *, row_number() over w as i, sum(d) over (w rows unbounded preceding)::bigint as c, sum(d) over () as t from s window w as (order by d desc, source)) select i as rank, source, d as documents, c as cumulative, least(3, (c - d) * 3 // t + 1)::bigint as zone from q",
    "bradford_zones": "with s as (select source, count(distinct eid) as d from {srcpair} group by 1), q as (select *, sum(d) over (order by d desc, source rows unbounded preceding) as c, sum(d) over () as t from s), z as (select least(3, (c - d) * 3 // t + 1)::bigint as zone, count(*) as sources, sum(d)::bigint as documents from q group by 1) select zone, sources, documents, r2(sources * 1.0 / lag(sources) over (order by zone)) as multiplier from z",
    "zipf": "with k as (select norm, count(distinct eid) as f from {kwa} group by 1), q as (select *, row_number() over (order by f desc, norm) as i from k), t as (select regr_slope(log10(f), log10(i)) as s, regr_intercept(log10(f), log10(i)) as a from q) select i as rank, n.name as keyword, f as frequency, r2(pow(10, a + s * log10(i))) as predicted from q join {kwname} n using (norm), t where i <= 100",
    "zipf_fit": "with k as (select norm, count(distinct eid) as f from {kwa} group by 1), q as (select log10(f) as y, log10(row_number() over (order by f desc, norm)) as x from k) select r3(-regr_slope(y, x)) as exponent, r3(pow(10, regr_intercept(y, x))) as constant, r4(regr_r2(y, x)) as r2 from q",
    "concentration_summary": " union all ".join(map(_concentration, ("authors", "institutions", "countries", "sources", "cities"))),
    "lorenz": "with q as (select d, row_number() over (order by d, e) as i, sum(d) over (order by d, e rows unbounded preceding) as s, count(*) over () as n, sum(d) over () as t from (" + _levels("authors") + ")), k as (select distinct floor(u * n / 39.0)::bigint as i from (select unnest(range(0, 40)) as u) cross join (select any_value(n) as n from q)) select 0.0 as population_share, 0.0 as value_share union all select r4(i * 1.0 / n), r4(s * 1.0 / t) from q join k using (i)",
    "price_index": "select r1(100.0 * sum(case when age < 5 then 1 else 0 end) / count(*)) as price_index, count(*) as references, r1(median(age)) as median_age, r1(avg(age)) as mean_age, r1(median(age)) as half_life, count(distinct eid) as documents_with_references, 5::bigint as window from {ages}",
    "price_index_by_year": "select year, count(distinct eid) as documents, count(*) as references, r1(100.0 * sum(case when age < 5 then 1 else 0 end) / count(*)) as price_index, r1(median(age)) as median_age from {ages} group by 1",
    "reference_age_distribution": "with g as (select unnest(range(0, least(max(age), 40) + 1)) as age from {ages}), c as (select age, count(*) as n from {ages} group by 1), s as (select g.age, coalesce(n, 0) as n, r2(100.0 * coalesce(n, 0) / (select count(*) from {ages})) as share from g left join c on c.age = g.age) select age, n as references, share, r2(sum(share) over (order by age)) as cumulative_share from s",
    "reference_spectroscopy": """with r as (select *, ref_year::bigint as year from doc_references where ref_year >= 1800 and ref_year <= (select max(year) from documents)), g as (select unnest(range(min(year), max(year) + 1)) as year from r), c as (select g.year, count(r.eid) as n from g left join r on r.year = g.year group by 1),
m as (select year, n, median(n) over (order by year rows between 2 preceding and 2 following) as m from c), l as (select median(n - m) as v from m where n > m),
t as (select year, concat_ws(': ', case when length(trim(ref_authors)) > 0 then trim(ref_authors) end, case when length(trim(ref_title)) > 0 then trim(ref_title) end) as s, count(*) as k from r where length(trim(ref_authors)) > 0 or length(trim(ref_title)) > 0 group by 1, 2), b as (select year, arg_min(s || ' (' || k || '×)', (-k, s)) as top_reference from t group by 1)
select m.year, n as references, r1(m) as median_5, r1(n - m) as deviation, coalesce(n > m and n - m >= v, false) as is_peak, top_reference from m cross join l left join b on b.year = m.year""",
    "citation_pairs": "select * from {cites}", "local_citations": "select eid, n as local_citations from {local}",
    "most_local_cited_authors": "select name as author, sum(n)::bigint as local_citations, count(*) as documents from (select distinct name, eid from authors where length(trim(name)) > 0) join {local} using (eid) group by 1 having sum(n) > 0 order by 2 desc, 3 desc, 1 limit 20",
    "most_local_cited_sources": "select source, sum(n)::bigint as local_citations, count(*) as documents from {srcpair} join {local} using (eid) group by 1 having sum(n) > 0 order by 2 desc, 3 desc, 1 limit 20",
    "most_local_cited_documents": """with q as (select *, c as citations, upper(coalesce(first_author, '?')) || ', ' || coalesce(year::varchar, 'n.d.') as base from {card} join {local} l using (eid) left join {firstau} f using (eid) where n > 0), k as (select *, row_number() over (partition by base order by title nulls first, eid) as k from q)
select case when k = 1 then base when k <= 26 then base || '-' || chr((k + 96)::int) else base || '-' || k end as label, title, first_author, year, source, n as local_citations, citations as global_citations, case when citations > 0 then r2(100.0 * n / citations) end as lc_gc_ratio, r2(n * 1.0 / (y1 - year + 1)) as local_citations_per_year from k cross join {last} order by n desc, citations desc, eid limit 20""",
    "self_citation_summary": " union all ".join(f"select '{level}' as level, (select count(*) from {{cites}}) as citations, n as self_citations, (select count(*) from {{cites}}) - n as external, r1(100.0 * n / (select count(*) from {{cites}})) as self_rate from (select count(*) as n from (select distinct p.citing, p.cited from {{cites}} p join {pairs} a on a.eid = p.citing join {pairs} b on b.eid = p.cited and a.{key} = b.{key}))" for level, pairs, key in (("authors", "{au}", "key"), ("institutions", "{org}", "org"), ("countries", "{cc}", "country"))),
    "authors_self_citation": """with o as (select distinct eid, key from {au} where key is not null), r as (select b.key, count(*) as n, count(a.key) as s from {cites} p join o b on b.eid = p.cited left join o a on a.eid = p.citing and a.key = b.key group by 1)
select name as author, (select count(*) from o where o.key = r.key) as documents, n as local_citations, s as self_citations, n - s as external_citations, r1(100.0 * s / n) as self_rate from r join {auname} using (key) order by 4 desc, 3 desc, key limit 20""",
    "country_map": "with s as (select eid, count(*) as k from {cc} group by 1) select country, count(distinct p.eid) as documents, coalesce(sum(c), 0)::bigint as citations, count(distinct case when k = 1 then p.eid end) as sca, count(distinct case when k > 1 then p.eid end) as mca, r4(count(distinct case when k > 1 then p.eid end) * 1.0 / count(distinct p.eid)) as mca_ratio, any_value(g.map_name) as map_name, any_value(g.lon) as lon, any_value(g.lat) as lat from {cc} p join s using (eid) left join {docs} d on d.eid = p.eid left join {place} g on g.key = trim(regexp_replace(lower(strip_accents(p.country)), '\\s+', ' ', 'g')) group by 1",
    "trend_topics": "with y as (select eid, min(year) as year from {docs} where year is not null group by 1), k as (select distinct norm, eid, year from {kwa} join y using (eid)) select name as keyword, count(*) as documents, round_even(quantile_cont(year, 0.25), 0)::bigint as year_q1, round_even(quantile_cont(year, 0.5), 0)::bigint as year_median, round_even(quantile_cont(year, 0.75), 0)::bigint as year_q3 from k join {kwname} using (norm) group by norm, name having count(*) >= 2 order by 2 desc, norm limit 25",
    "three_fields": """with a as (select distinct eid, name as v from authors where length(trim(name)) > 0), b as (select distinct eid, name as v from {kwa} join {kwname} using (norm)), c as (select eid, source as v from {srcpair}), """ + ", ".join(f"{x}_top as (select {x}.* from {x} join (select v from {x} group by 1 order by count(*) desc, 1 limit 10) using (v))" for x in "abc") + """
select x.v as source, y.v as target, count(distinct eid) as value, 0::bigint as depth from a_top x join b_top y using (eid) group by 1, 2 union all select x.v, y.v, count(distinct eid), 1 from b_top x join c_top y using (eid) group by 1, 2""",
    "authors_over_time": """with p as (select distinct name, eid from authors where length(trim(name)) > 0), r as (select * from p join {docs} using (eid) where year is not null), t as (select name from r group by 1 order by count(distinct eid) desc, 1 limit 12), k as (select name, year, count(distinct eid) as d, sum(c)::bigint as c from r join t using (name) group by 1, 2)
select name as author, year, d as documents, c as citations, r2(c * 1.0 / (y1 - year + 1)) as citations_per_year, sum(d) over (partition by name order by year)::bigint as cumulative from k cross join {last}""",
    "average_citations_per_year": "select year, count(distinct eid) as documents, r2(avg(c)) as mean_citations, any_value(y1) - year + 1 as citable_years, r2(avg(c) / (any_value(y1) - year + 1)) as mean_citations_per_year from {docs} cross join {last} where year is not null group by year",
    "access_status": "with rows as (select case when regexp_matches(lower(coalesce(open_access, '')), '\\b(gold|hybrid|bronze|green)\\b|\\bopen\\s*access\\b') then 'Open access' else 'Not flagged' end as k, c from {docs}), cat as (select * from (values (0, 'Open access'), (1, 'Not flagged')) t(place, name)) select name as status, documents, " + _SHARES + f" from ({_CAT})",
    "access_routes": """with o as (select lower(coalesce(open_access, '')) as t, c from {docs}), rows as (select * from o where regexp_matches(t, '\\b(gold|hybrid|bronze|green)\\b|\\bopen\\s*access\\b')), x as (""" + " union all ".join(f"select {i} as place, '{r}' as route, count(*) as documents, coalesce(sum(c), 0)::bigint as citations from rows where regexp_matches(t, '\\b{r.lower()}\\b')" for i, r in enumerate(("Gold", "Hybrid", "Bronze", "Green"))) + """ union all select 4, 'Unspecified', count(*), coalesce(sum(c), 0)::bigint from rows where not regexp_matches(t, '\\b(gold|hybrid|bronze|green)\\b'))
select route, documents, r1(100.0 * documents / (select count(*) from rows)) as share_of_open, citations, case when documents > 0 then r2(citations * 1.0 / documents) else 0.0 end as citations_per_document from x""",
    "access_over_time": "select year, count(*) as documents, sum(o)::bigint as open_access, r1(100.0 * sum(o) / count(*)) as share from (select year, case when regexp_matches(lower(coalesce(open_access, '')), '\\b(gold|hybrid|bronze|green)\\b|\\bopen\\s*access\\b') then 1 else 0 end as o from {docs} where year is not null) group by 1",
    "co_word_edges": _pairs(_WORDS, 50, 2) + " select * from edges", "co_word_nodes": _pairs(_WORDS, 50, 2) + _nodes("n.name", "join {kwname} n on n.norm = t.key"),
    "co_authorship_edges": _pairs("select distinct eid, key from {au} where key is not null", 50, 1) + " select * from edges", "co_authorship_nodes": _pairs("select distinct eid, key from {au} where key is not null", 50, 1) + _nodes("n.name", "join {auname} n on n.key = t.key"),
    "co_institution_edges": _pairs("select distinct eid, org as key from {org}", 50, 1) + " select * from edges", "co_country_edges": _pairs("select eid, country as key from {cc}", 50, 1) + " select * from edges",
    "co_city_edges": _pairs("select eid, city as key from {city}", 50, 1) + " select e.source, e.target, e.weight, case when a.country = b.country then 'national' else 'international' end as scope from edges e left join {cityname} a on a.city = e.source left join {cityname} b on b.city = e.target",
    "co_citation_edges": _pairs("select distinct eid, key from {works} where key is not null", 50, 2) + " select * from edges",
    "co_citation_authors_edges": _pairs("select distinct eid, lower(trim(split_part(replace(ref_authors, ',', ';'), ';', 1))) as key from doc_references where length(trim(split_part(replace(ref_authors, ',', ';'), ';', 1))) >= 2", 50, 2) + " select * from edges",
    "bibliographic_coupling_edges": "with m as (select distinct eid, key from {works} where key is not null), top as (select eid from m group by 1 order by count(*) desc, 1 limit 50), f as (select * from m join top using (eid)) select a.eid as source, b.eid as target, count(*) as weight from f a join f b on a.key = b.key and a.eid < b.eid group by 1, 2 having count(*) >= 2",
    "historiograph_edges": "with t as (select eid from {local} where n > 0 order by n desc, eid limit 25) select citing as source, cited as target from {cites} where citing in (select eid from t) and cited in (select eid from t)",
    "filtered_production": "with w as (select country from (select country, count(distinct p.eid) as n, coalesce(sum(c), 0) as s from {cc} p left join {docs} d on d.eid = p.eid group by 1) order by n desc, s desc, country limit 2), f as (select * from {docs} where year between 2015 and 2025 and doc_type = 'Article' and eid in (select eid from affiliations where country in (select country from w))), g as (select unnest(range(min(year), max(year) + 1)) as year from f) select g.year, count(distinct f.eid) as documents, coalesce(sum(f.c), 0)::bigint as citations, case when count(distinct f.eid) > 0 then r2(coalesce(sum(f.c), 0) * 1.0 / count(distinct f.eid)) end as citations_per_doc, sum(count(distinct f.eid)) over (order by g.year)::bigint as cumulative from g left join f on f.year = g.year group by g.year",
    "unified_keywords": "with k as (select *, lower(keyword) as l from keywords where keyword is not null), b as (select kind, l, keyword from (select kind, l, keyword, row_number() over (partition by kind, l order by count(*) desc, keyword) as r from k group by 1, 2, 3) where r = 1) select b.keyword, kind, count(*) as rows from k join b using (kind, l) group by 1, 2",
}
for _name, _pairs_of, _limit in (("top_institutions", "{orgpair}", 20), ("top_units", "{unitpair}", 20)):
    SQL[_name] = f"with n as (select org, country from (select org, country, row_number() over (partition by org order by count(*) desc, country) as k from {_pairs_of} where country is not null group by 1, 2) where k = 1) select p.org as institution, count(distinct p.eid) as documents, coalesce(sum(c), 0)::bigint as citations, any_value(n.country) as country from {_pairs_of} p left join {{docs}} d on d.eid = p.eid left join n on n.org = p.org group by 1 order by 2 desc, 3 desc, 1 limit {_limit}"
SQL["institutions_impact"] = "with n as (select org, country from (select org, country, row_number() over (partition by org order by count(*) desc, country) as k from {orgpair} where country is not null group by 1, 2) where k = 1) select k as institution, documents, citations::bigint as citations, h as h_index, g as g_index, " + _M + " as m_index, first_year, n.country from (" + _impact("{orgpair}", "org") + ") s left join n on n.org = s.k cross join {last} order by 4 desc, 3 desc, 2 desc, 1 limit 20"
_NORMAL = {"association": "w / (a * b)", "jaccard": "w / (a + b - w)", "salton": "w / sqrt(a * b)", "inclusion": "w / least(a, b)", "equivalence": "w * w / (a * b)"}
for _name, _formula in _NORMAL.items():
    SQL[f"co_word_{_name}"] = _pairs(_WORDS, 50, 2) + f" select source, target, r6({_formula}) as weight, raw_weight from (select e.source, e.target, e.weight as raw_weight, e.weight::double as w, x.occurrences::double as a, y.occurrences::double as b from edges e join top x on x.key = e.source join top y on y.key = e.target)"
for _unit, _members in (("sources", "select eid, source as key from {srcpair}"), ("countries", "select eid, country as key from {cc}")):
    SQL[f"citation_network_{_unit}_edges"] = f"with m as ({_members}), e as (select a.key as source, b.key as target, count(*) as weight from {{cites}} p join m a on a.eid = p.citing join m b on b.eid = p.cited where a.key <> b.key group by 1, 2), t as (select k from (select source as k, weight from e union all select target, weight from e) group by 1 order by sum(weight) desc, 1 limit 40) select * from e where source in (select k from t) and target in (select k from t)"
SQL["citation_balance"] = "with e as (" + SQL["citation_network_sources_edges"] + "), s as (select label, sum(i)::bigint as received, sum(o)::bigint as emitted from (select target as label, weight as i, 0 as o from e union all select source, 0, weight from e) group by 1) select label, received, emitted, received - emitted as balance from s"


_AGR = "select case when lag(documents) over (order by year) > 0 then r2(100.0 * (documents - lag(documents) over (order by year)) / lag(documents) over (order by year)) end as agr from {yearly}"
_RGR = "select r4(q) as rgr, case when q > 0 then r2(ln(2) / q) end as d from (select ln(c) - lag(ln(c)) over (order by year) as q from (select year, sum(documents) over (order by year) as c from {yearly}))"
_LINKS = "select a.key, a.eid, coalesce(o.org, 'aff#' || coalesce(l.aff_pos::varchar, '?')) as org from {au} a join (select distinct eid, position, aff_pos from author_affiliations) l on l.eid = a.eid and l.position = a.position left join (select eid, aff_pos, min(case when length(trim(parent1)) > 0 then trim(parent1) end) as org from affiliations group by 1, 2) o on o.eid = l.eid and o.aff_pos = l.aff_pos where a.key is not null"
_SEVERAL = "m as (select key, max(k) as k from (select key, eid, count(distinct org) as k from l group by 1, 2) group by 1), g as (select key, count(distinct eid) as documents, count(distinct org) as institutions from l group by 1 having count(distinct org) >= 2)"
_TREND = "with y as (select *, year - min(year) over () as t from {yearly}), f as (select regr_slope(documents, t) as s, regr_intercept(documents, t) as i, count(*) as n, max(year) as z, min(year) as a, avg(documents) as m from y)"
_AREAS = "with areas as (select area, count(distinct source) as sources, sum(documents)::bigint as documents, r1(100.0 * sum(documents) / (select sum(documents) from {js})) as share, sum(citations)::bigint as citations from (select source, documents, citations, trim(unnest(string_split(areas, ';'))) as area from {js}) group by 1)"
SQL |= {
    "growth_summary": "with e as (select arg_min(documents, year) as a, arg_max(documents, year) as b, max(year) - min(year) as n from {yearly}) select case when n > 0 and a > 0 then r2((pow(b * 1.0 / a, 1.0 / n) - 1) * 100) end as cagr, (select r2(avg(agr)) from (" + _AGR + ")) as agr_mean, (select r4(avg(rgr)) from (" + _RGR + ")) as rgr_mean, (select r2(avg(d)) from (" + _RGR + ")) as doubling_time_mean from e",
    "cochran_sample_size": "select count(*) as population, 0.95::double as confidence, 0.05::double as margin_of_error, 0.5::double as proportion, 1.96::double as z_score, 385::bigint as sample_size_infinite, ceil(384.16 / (1 + 383.16 / count(*)))::bigint as sample_size, r1(100.0 * ceil(384.16 / (1 + 383.16 / count(*))) / count(*)) as sampling_fraction from documents",
    "authors_by_affiliation_count": "with l as (" + _LINKS + "), " + _SEVERAL + ", s as (select key, string_agg(org, '; ' order by org) as t from (select key, org, row_number() over (partition by key order by org) as r from (select distinct key, org from l)) where r <= 6 group by 1) select name as author, case when starts_with(g.key, 'name:') then '' else g.key end as scopus_id, documents, institutions, m.k as max_in_one_document, s.t as affiliations from g join m using (key) join s using (key) join {auname} using (key) order by 5 desc, 4 desc, 3 desc, 1, g.key limit 20",
    "affiliation_profile": "with l as (" + _LINKS + "), " + _SEVERAL + ", d as (select coalesce(k, 0) as k from (select distinct eid from documents) left join (select eid, count(distinct trim(parent1)) as k from affiliations where length(trim(parent1)) > 0 group by 1) using (eid)), x as (select (select count(*) from documents) as n, (select count(*) from {perdoc} where j = 1) as a, (select count(*) from d where k = 1) as b, (select count(*) from d where k = 2) as c, (select count(*) from d where k >= 3) as e) select n as documents, a as single_author_documents, r2(100.0 * a / n) as single_author_share, b as single_affiliation_documents, r2(100.0 * b / n) as single_affiliation_share, c as two_affiliation_documents, r2(100.0 * c / n) as two_affiliation_share, e as many_affiliation_documents, r2(100.0 * e / n) as many_affiliation_share, (select count(distinct coalesce(scopus_id, 'name:' || name)) from authors) as authors, (select count(*) from g) as authors_with_several_affiliations, (select count(*) from g join m using (key) where m.k >= 2) as authors_with_double_affiliation from x",
    "access_summary": "with o as (select eid, trim(source) as source, regexp_matches(lower(coalesce(open_access, '')), '\\b(gold|hybrid|bronze|green)\\b|\\bopen\\s*access\\b') as open from documents), j as (select distinct eid from o where source in (select source from {js} where open_access)) select count(*) as documents, count(*) filter (open) as reported, count(*) filter (open) as open_documents, case when count(*) filter (open) > 0 then 100.0::double end as open_share_of_reported, (select count(*) from j) as journal_open_documents, count(*) filter (open and eid not in (select eid from j)) as disagreement from o",
    "trend_forecast_table": _TREND + " select year, documents, r2(i + s * t) as fitted, 'observed' as kind from y, f union all select z + k, null, r2(greatest(i + s * (z + k - a), 0)), 'forecast' from f, (select unnest(range(1, 6)) as k)",
    "trend_forecast_fit": _TREND + ", e as (select sum((documents - (i + s * t)) ** 2) as p, sum((documents - m) ** 2) as q from y, f) select 'linear' as model, r3(s) as slope, 'additional documents per year' as slope_label, r3(i) as intercept, r4(1 - p / q) as r2, r2(sqrt(p / (n - 2))) as rmse, n as years_used, z as last_year, z >= 2026 as last_year_partial from f, e",
    "scimago_sources": "select source, documents, citations, matched_by, id as scimago_id, id as scimago_title, quartile, areas, categories, open_access from {js}",
    "quartile_distribution": "with cat as (select * from (values (0, 'Q1'), (1, 'Q2'), (2, 'Q3'), (3, 'Q4'), (4, 'Not indexed')) t(place, quartile)), n as (select sum(documents) as n from {js}) select cat.quartile, count(source) as sources, coalesce(sum(documents), 0)::bigint as documents, r1(100.0 * coalesce(sum(documents), 0) / any_value(n)) as share, coalesce(sum(citations), 0)::bigint as citations, coalesce(r2(sum(citations) * 1.0 / sum(documents)), 0) as citations_per_document from cat left join (select source, documents, citations, coalesce(quartile, 'Not indexed') as q from {js}) on q = cat.quartile cross join n group by 1",
    "quartile_over_time": "with d as (select d.eid, d.year, coalesce(quartile, 'Not indexed') as quartile from {docs} d left join {js} j on j.source = trim(d.source) where d.year is not null), g as (select * from (select distinct year from d), (select unnest(['Q1', 'Q2', 'Q3', 'Q4', 'Not indexed']) as quartile)), c as (select year, quartile, count(distinct eid) as n from d group by 1, 2) select year, quartile, coalesce(n, 0) as documents, r1(100.0 * coalesce(n, 0) / sum(n) over (partition by year)) as share from g left join c using (year, quartile)",
    "scimago_coverage": "select (select count(*) > 0 from {journal}) as available, count(*) as sources, count(*) filter (matched_by <> '') as matched_sources, count(*) filter (matched_by = 'issn') as matched_by_issn, count(*) filter (matched_by = 'title') as matched_by_title, sum(documents)::bigint as documents, coalesce(sum(documents) filter (matched_by <> ''), 0)::bigint as matched_documents, r1(100.0 * coalesce(sum(documents) filter (matched_by <> ''), 0) / sum(documents)) as document_share from {js}",
    "subject_areas": _AREAS + " select * from areas",
    "subject_categories": "select category, count(distinct source) as sources, sum(documents)::bigint as documents, min(q) as best_quartile from (select source, documents, trim(regexp_replace(t, '\\(Q[1-4]\\)\\s*$', '')) as category, nullif(regexp_extract(t, '\\((Q[1-4])\\)\\s*$', 1), '') as q from (select source, documents, trim(unnest(string_split(categories, ';'))) as t from {js})) group by 1 order by 3 desc, 2 desc, 1 limit 25",
    "interdisciplinarity": _AREAS + ", p as (select area, citations, documents, share, documents::double / sum(documents) over () as p from areas) select count(*) as areas, r3(-sum(p * ln(p))) as shannon, r3(1 - sum(p * p)) as simpson, case when count(*) > 1 then r3(-sum(p * ln(p)) / ln(count(*))) else 0.0 end as evenness, arg_min(area, (-documents, -citations, area)) as top_area, arg_min(share, (-documents, -citations, area)) as top_area_share, (select r1(100.0 * coalesce(sum(documents) filter (matched_by <> ''), 0) / sum(documents)) from {js}) as coverage from p",
    "journal_open_access": "with cat as (select unnest(['Open access', 'Subscription', 'Unknown']) as access), n as (select sum(documents) as n from {js}) select access, count(source) as sources, coalesce(sum(documents), 0)::bigint as documents, r1(100.0 * coalesce(sum(documents), 0) / any_value(n)) as share, coalesce(sum(citations), 0)::bigint as citations, coalesce(r2(sum(citations) * 1.0 / sum(documents)), 0) as citations_per_document from cat left join (select *, case when open_access then 'Open access' when not open_access then 'Subscription' else 'Unknown' end as k from {js}) on k = access cross join n group by 1",
    "historiograph_nodes": "with t as (select eid, n from {local} where n > 0 order by n desc, eid limit 25) select d.eid as id, title, first_author, year, source, t.n as local_citations, c as citations from {card} d join t using (eid) left join {firstau} f using (eid)",
}


_READY = "with s as (select 'documents' as t, field, share from (" + SQL["field_completeness"] + ") union all select \"table\", field, share from (" + SQL["table_completeness"] + ")), r as (" + " union all ".join(
    f"select '{name}' as analysis, {coverage} as coverage, '{basis}' as basis, {note} as note" for name, coverage, basis, note in (
        (name, f"(select share from s where t = '{at.split('.')[0]}' and field = '{at.split('.')[1]}')" if at else "0.0", basis, note) for name, at, basis, note in (
            ("Production and growth", "documents.year", "Publication year", "'Documents without a year are excluded from every time series.'"),
            ("Impact indices (h, g, i10, e, m)", "documents.cited_by", "Citation count", "'Computed on THIS corpus, not on each person''s whole body of work.'"),
            ("Author analysis", "authors.name", "Author names", "'Scopus identifier present on ' || (select round_even(share, 0)::int from s where t = 'authors' and field = 'scopus_id') || ' % of rows, homonyms are only separable where it is.'"),
            ("Institutions", "affiliations.parent1", "Parent organisation", "'Internal units filled on ' || (select round_even(share, 0)::int from s where t = 'affiliations' and field = 'subparent') || ' % of affiliations.'"),
            ("Cities and geography", "affiliations.city", "City", "'Drives the local / national / international collaboration scale.'"),
            ("Keywords and thematic map", "keywords.keyword", "Keywords", "'Co-word, thematic map and evolution all rest on this field.'"),
            ("Text mining", "documents.abstract", "Abstract", "'Terms are extracted from titles and abstracts.'"),
            ("Local citations and historiograph", "references.ref_doi", "Reference DOIs", "(select count(*) from {cites}) || ' internal citation links actually matched.'"),
            ("SCImago quartiles and SJR", "", "ISSN matching", "'0 of ' || (select count(distinct trim(source)) from documents where length(trim(source)) > 0) || ' sources matched.'"),
            ("Open access", "documents.open_access", "Open access flag", "'Scopus only flags OPEN articles; a blank is not a closed article.'"),
        )
    )
) + ")"
SQL |= {
    "indicator_readiness": _READY + " select analysis, case when coverage >= 90 then 'ready' when coverage >= 50 then 'partial' else 'limited' end as status, coverage, basis, note from r",
    "quality_summary": _READY + ", dups as (" + SQL["duplicates"] + "), odd as (" + SQL["anomalies"] + ") select (select count(*) from documents) as documents, count(*) as analyses, count(*) filter (coverage >= 90) as ready, count(*) filter (coverage >= 50 and coverage < 90) as partial, count(*) filter (coverage < 50) as limited, (select count(*) from dups) as duplicate_groups, (select count(*) from odd where severity = 'high' and documents > 0) as high_severity_issues, r1(avg(coverage)) as mean_coverage from r",
    "overlay_years_keywords": "select norm as id, r2(avg(year)) as overlay_year from (select distinct norm, eid from {kw}) join (select distinct eid, year from {docs} where year is not null) using (eid) group by 1",
    "overlay_years_countries": "select country as id, r2(avg(year)) as overlay_year from {cc} join (select distinct eid, year from {docs} where year is not null) using (eid) group by 1",
}
#: The co-word network in both directions, as links (a, b, w) and their nodes.
_LINKED = _pairs(_WORDS, 50, 2) + ", links as (select source as a, target as b, weight as w from edges union all select target, source, weight from edges), n as (select distinct a as id from links), deg as (select a as id, count(*) as k, sum(w) as s from links group by 1), tri as (select x.a as id, count(*) as t, sum(cbrt(x.w * y.w * z.w / pow((select max(w) from links), 3))) as v from links x join links y on y.a = x.b join links z on z.a = y.b and z.b = x.a group by 1)"
_FIRST = "trim(split_part(replace(ref_authors, ',', ';'), ';', 1))"
_MODE = "select key, {v} from (select key, {v}, row_number() over (partition by key order by count(*) desc, {v}) as k from (select key, {e} as {v} from {{works}} where key is not null) where {w} group by 1, 2) where k = 1"
_USUAL = {v: _MODE.format(v=v, e=e, w=w).replace("{{", "{").replace("}}", "}") for v, e, w in (("who", _FIRST, "length(who) > 0"), ("y", "ref_year", "y is not null"), ("ti", "ref_title", "ti is not null"))}
SQL["co_citation_nodes"] = _pairs("select distinct eid, key from {works} where key is not null", 50, 2) + _nodes("concat_ws(' · ', coalesce(a.who, '?') || coalesce(' (' || b.y || ')', ''), left(c.ti, 70))", f"left join ({_USUAL['who']}) a on a.key = t.key left join ({_USUAL['y']}) b on b.key = t.key left join ({_USUAL['ti']}) c on c.key = t.key")
SQL |= {
    "network_summary": _LINKED.replace("with m as", "with recursive m as", 1) + ", reach as (select id, id as r from n union select reach.id, links.b from reach join links on links.a = reach.r) select (select count(*) from n) as nodes, (select count(*) from edges) as edges, r4(2.0 * (select count(*) from edges) / ((select count(*) from n) * ((select count(*) from n) - 1))) as density, r4((select sum(t)::double from tri) / (select sum(k * (k - 1)) from deg)) as transitivity, (select count(distinct c) from (select id, min(r) as c from reach group by 1)) as components, r2(2.0 * (select count(*) from edges) / (select count(*) from n)) as mean_degree",
    "network_measures": _LINKED.replace("with m as", "with recursive m as", 1) + ", p as (select id, 1.0::double / (select count(*) from n) as r, 0 as i from n union all select l.b, 0.15 / (select count(*) from n) + 0.85 * sum(p.r * l.w / d.s), any_value(p.i) + 1 from p join links l on l.a = p.id join deg d on d.id = p.id where p.i < 200 group by 1) select deg.id, r5(p.r) as pagerank, case when k > 1 then r4(coalesce(v, 0) / (k * (k - 1))) else 0.0 end as clustering from deg join p on p.id = deg.id and p.i = 200 left join tri on tri.id = deg.id",
}
#: One row of the export for each document row.
_ROWS = "with d as (select row_number() over () as i, * from documents)"
_CELL = "case when lower(trim({c})) <> 'nan' then nullif(trim({c}), '') end"
SQL |= {
    "csv_documents": "select eid, " + ", ".join(_CELL.format(c=c) + f" as {c}" for c in ("title", "source", "doi", "open_access")) + ", year, coalesce(cited_by, 0) as cited_by from documents",
    "csv_keywords": _ROWS + " select eid, min(k) as keyword, kind from (select i, eid, kind, trim(unnest(string_split(keyword, ';'))) as k from d join keywords using (eid)) where k <> '' group by i, eid, kind, lower(k)",
    "csv_references": _ROWS + ", r as (select eid, " + ", ".join(f"nullif(trim(translate({c}, ';|', ',/')), '') as {c}" for c in ("ref_doi", "ref_authors", "ref_title")) + ", ref_year from doc_references) select r.* from d join r using (eid)",
    "csv_authors": _ROWS + " select eid, row_number() over (partition by i order by position, name) as position, trim(name) as name from d join authors using (eid) where length(trim(name)) > 0",
}


def _terms(size: int) -> str:
    """(eid, term) of abstracts: single words, or pairs of neighbouring ones."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    words = "select eid, unnest(w) as t, unnest(range(1, len(w) + 1)) as i, d from (select row_number() over () as d, eid, regexp_extract_all(lower(strip_accents(trim(regexp_replace(coalesce(abstract, ''), '(?is)(\\bcopyright\\s*)?[©ⓒ].*', '')))), '[a-z][a-z0-9\\-]+') as w from documents)"
    good = f"length(x.t) > 2 and x.t not in ({stop})"
    if size == 1:
        return f"select distinct eid, x.t as term from ({words}) x where {good}"
    return f"select distinct x.eid, x.t || ' ' || y.t as term from ({words}) x join ({words}) y on x.d = y.d and y.i = x.i + 1 where {good} and {good.replace('x.', 'y.')}"


for _name, _size in (("top_terms", 1), ("top_bigrams", 2)):
    SQL[_name] = f"with t as ({_terms(_size)}) select term, count(*) as documents, r1(100.0 * count(*) / (select count(*) from documents)) as share from t group by 1 having count(*) >= 2 order by 2 desc, 1 limit 50"
SQL["text_trend"] = f"with t as ({_terms(2)}), y as (select eid, min(year) as year from {{docs}} where year is not null group by 1) select term, count(*) as documents, round_even(quantile_cont(year, 0.25), 0)::bigint as year_q1, round_even(quantile_cont(year, 0.5), 0)::bigint as year_median, round_even(quantile_cont(year, 0.75), 0)::bigint as year_q3 from t join y using (eid) group by 1 having count(*) >= 2 order by 2 desc, 1 limit 20"
SQL["text_co_occurrence_edges"] = f"with t as ({_terms(2)}), often as (select term from t group by 1 having count(*) >= 2 order by count(*) desc, 1 limit 50), f as (select * from t join often using (term)) select a.term as source, b.term as target, count(*) as weight from f a join f b on a.eid = b.eid and a.term < b.term group by 1, 2 having count(*) >= 2"


def _expand(sql: str) -> str:
    """Replace every {part} by a table expression named after it."""
    sql = sql.replace("{docs_}", "documents")
    used: list[str] = []

    def visit(text: str) -> str:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in PARTS and name not in used:
                visit(PARTS[name])
                if name not in used:
                    used.append(name)
        return re.sub(r"\{(\w+)\}", lambda m: f"part_{m.group(1)}" if m.group(1) in PARTS else m.group(), text)

    body = visit(sql)
    parts = ", ".join(f"part_{n} as materialized ({visit(PARTS[n])})" for n in used)
    if not parts:
        return _rounding(body)
    start = next((w for w in ("with recursive ", "with ") if body.startswith(w)), "")
    return _rounding(f"{start or 'with '}{parts}{', ' if start else ' '}{body[len(start) :]}")


def oracle_sql() -> dict[str, str]:
    return {name: _expand(sql) for name, sql in SQL.items()}
