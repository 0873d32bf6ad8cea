"""Themes of a corpus: clusters of keywords, their evolution, factorial maps, clusters by coupling."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.graph import kernels
from folioscope.graph.measures import collected
from folioscope.operators.citations import local_citations
from folioscope.operators.networks import normalize
from folioscope.operators.production import keyword_rows

QUADRANTS = ("Motor themes", "Niche themes", "Emerging or declining themes", "Basic themes")


def _quadrant(centrality: float, density: float, middle: tuple[float, float]) -> str:
    if centrality >= middle[0]:
        return QUADRANTS[0] if density >= middle[1] else QUADRANTS[3]
    return QUADRANTS[1] if density >= middle[1] else QUADRANTS[2]


@operator
def thematic_map(c: Corpus, top_n: int = 100, min_weight: int = 2, kind: str = "author") -> tuple[DataFrame, dict[str, float]]:
    """Clusters of the co-word network with Callon's centrality and density, and the medians that part the quadrants.

    Clusters are those of the equivalence network at `min_weight`; both measures are taken on the network of all co-occurrences.
    """
    spark = c.documents.sparkSession
    rows, strong = collected(normalize(c.co_word(top_n, min_weight, kind), "equivalence"))
    schema = "cluster int, label string, terms string, n_terms int, occurrences long, centrality double, density double, quadrant string"
    if not rows:
        return spark.createDataFrame([], schema), {"centrality": 0.0, "density": 0.0}
    every, weak = collected(normalize(c.co_word(top_n, 1, kind), "equivalence"))
    place = {r.id: i for i, r in enumerate(every)}
    at = np.array([place[r.id] for r in rows])
    full = weak[np.ix_(at, at)]
    groups = kernels.greedy_modularity(strong)
    found = []
    for g in range(1, groups.max() + 1):
        inside = groups == g
        own = sorted((r for r, i in zip(rows, inside, strict=True) if i), key=lambda r: (-r.occurrences, r.id))
        central, dense = 10 * full[inside][:, ~inside].sum(), 100 * full[np.ix_(inside, inside)].sum() / 2 / len(own)
        found.append((g, own[0].label, "; ".join(r.label for r in own), len(own), int(sum(r.occurrences for r in own)), round(float(central), 3), round(float(dense), 3)))
    middle = (float(np.median([f[5] for f in found])), float(np.median([f[6] for f in found])))
    table = spark.createDataFrame([(*f, _quadrant(f[5], f[6], middle)) for f in found], schema)
    return table, {"centrality": round(middle[0], 3), "density": round(middle[1], 3)}


@operator
def thematic_evolution(c: Corpus, cuts: list[int] | None = None, n_periods: int = 3, top_n: int = 60, min_weight: int = 2, kind: str = "author") -> tuple[list[tuple[int, int]], DataFrame, DataFrame]:
    """Periods, the clusters of keywords in each, and the flows between clusters of neighbouring periods.

    Periods are cut after the given years, or so that each holds about as many documents. A flow is the share that the common
    keywords have of the smaller cluster; flows under 0.05, and clusters without one, are left out.
    """
    spark = c.documents.sparkSession
    nodes_schema, flows_schema = "id string, period int, label string, terms string, occurrences long", "source string, target string, value double"
    years = c.documents.where("year is not null")
    lo, hi = years.agg(F.min("year"), F.max("year")).first()
    if lo is None:
        return [], spark.createDataFrame([], nodes_schema), spark.createDataFrame([], flows_schema)
    if cuts is None:
        points = years.agg(F.percentile("year", [i / n_periods for i in range(1, n_periods)])).first()[0] if n_periods > 1 else []
        cuts = [int(np.floor(p)) for p in points]
    ends = [*sorted({y for y in cuts if lo <= y < hi}), hi]
    periods = list(zip([lo, *(e + 1 for e in ends[:-1])], ends, strict=True))
    clusters: list[list[dict[str, int]]] = []
    labels: dict[str, str] = {}
    for a, b in periods:
        part = c.filter(years=(a, b))
        rows, w = collected(part.co_word(top_n, min_weight, kind))
        labels |= {r.id: r.label for r in rows}
        groups = kernels.greedy_modularity(w)
        clusters.append([{r.id: int(r.occurrences) for r, k in zip(rows, groups, strict=True) if k == g} for g in range(1, (groups.max() if len(groups) else 0) + 1)])
    flows, linked = [], set()
    for p, (first, second) in enumerate(itertools.pairwise(clusters)):
        for (i, x), (j, y) in itertools.product(enumerate(first), enumerate(second)):
            shared = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            value = shared / min(sum(x.values()), sum(y.values()))
            if value >= 0.05:
                flows.append((f"{p}:{i}", f"{p + 1}:{j}", round(value, 4)))
                linked |= {f"{p}:{i}", f"{p + 1}:{j}"}
    nodes = []
    for p, found in enumerate(clusters):
        for i, x in enumerate(found):
            if f"{p}:{i}" in linked:
                order = sorted(x, key=lambda k: (-x[k], k))
                nodes.append((f"{p}:{i}", p, labels[order[0]], "; ".join(labels[k] for k in order), sum(x.values())))
    return periods, spark.createDataFrame(nodes, nodes_schema), spark.createDataFrame(flows, flows_schema)


def incidence(c: Corpus, kind: str, top_n: int, min_documents: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Keywords, their co-document counts, the same with each document weighing one over its keywords, and the number of documents.

    The two matrices, top_n by top_n, are all that comes to the driver; documents stay where they are.
    """
    rows = keyword_rows(c, kind).select("eid", F.col("norm").alias("key")).distinct()
    often = F.broadcast(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).orderBy(F.desc("n"), "key").limit(top_n).select("key"))
    few = rows.join(often, "key", "left_semi")
    # documents with the same keywords are alike here, so the pairs are those of distinct sets; a set has top_n keywords at most
    sets = few.groupBy("eid").agg(F.array_sort(F.collect_list("key")).alias("keys")).groupBy("keys").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select("n", F.size("keys").alias("k"), F.explode("keys").alias("a"), "keys").select("n", "k", "a", F.explode("keys").alias("b"))
    cells = each.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("k")).alias("w")).collect()
    ids = sorted({r.a for r in cells})
    place = {k: i for i, k in enumerate(ids)}
    both, weighted = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ids)))
    for r in cells:
        both[place[r.a], place[r.b]], weighted[place[r.a], place[r.b]] = r.n, r.w
    return ids, both, weighted, sum(r.n for r in sets.select(F.sum("n").alias("n")).collect() if r.n)


# A fixed value, so that the same corpus always gives the same clusters.
_SEED = 7


def _kmeans(points: np.ndarray, k: int, seed: int = _SEED, rounds: int = 100) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    while len(centres) < k:
        far = np.min([((points - x) ** 2).sum(axis=1) for x in centres], axis=0)
        centres.append(points[rng.choice(len(points), p=far / far.sum())] if far.sum() > 0 else points[0])
    centres = np.array(centres)
    own = np.zeros(len(points), dtype=int)
    for _ in range(rounds):
        new = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        centres = np.array([points[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    return own


def _silhouette(points: np.ndarray, own: np.ndarray) -> float:
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    out = []
    for i, g in enumerate(own):
        inside = own == g
        if inside.sum() < 2:
            out.append(0.0)
            continue
        a = far[i, inside].sum() / (inside.sum() - 1)
        b = min(far[i, own == h].mean() for h in set(own.tolist()) - {g})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@operator
def conceptual_structure(c: Corpus, method: str = "CA", kind: str = "author", top_n: int = 50, min_documents: int = 2, n_clusters: int | None = None) -> tuple[DataFrame, dict]:
    """A map of keywords by correspondence analysis or multidimensional scaling, with clusters.

    Correspondence analysis of documents by keywords is read off the keywords' side: with W the co-document counts in which a document
    weighs one over its keywords, and n the keywords' counts, W / sqrt(n n') has the squared singular values and the keyword axes.
    """
    if method not in ("CA", "MDS"):
        raise ValueError(f"method must be 'CA' or 'MDS', not {method!r}")
    spark = c.documents.sparkSession
    schema = "term string, x double, y double, documents long, cluster int"
    ids, both, weighted, documents = incidence(c, kind, top_n, min_documents)
    own = np.diagonal(both)
    if len(ids) < 3:
        return spark.createDataFrame([], schema), {"method": method, "documents": documents, "inertia": [0.0, 0.0], "clusters": 0}
    if method == "CA":
        mass = own / own.sum()
        values, axes = np.linalg.eigh(weighted / np.sqrt(np.outer(own, own)) - np.sqrt(np.outer(mass, mass)))
        inertia, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        points = kernels._upright(axes[:, :2] * np.sqrt(inertia[:2]) / np.sqrt(mass)[:, None])
    else:
        unlike = 1 - both / np.sqrt(np.outer(own, own))
        points, values = kernels.classical_mds(unlike)
        inertia = np.maximum(values, 0)
    best = n_clusters or max(range(2, min(8, len(ids) - 1) + 1), key=lambda k: (round(_silhouette(points, _kmeans(points, k)), 9), -k))
    groups = kernels._numbered(_kmeans(points, best))
    share = [round(float(100 * x / inertia.sum()), 2) if inertia.sum() > 0 else 0.0 for x in inertia[:2]]
    table = spark.createDataFrame([(t, round(float(x), 4), round(float(y), 4), int(n), int(g)) for t, (x, y), n, g in zip(ids, points, own, groups, strict=True)], schema)
    return table, {"method": method, "documents": documents, "inertia": share, "clusters": int(groups.max())}


@operator
def topic_dendrogram(c: Corpus, kind: str = "author", top_n: int = 40, min_documents: int = 2, max_clusters: int = 6) -> tuple[DataFrame, DataFrame]:
    """Average-linkage merges of keywords by 1 - Salton's similarity, and the clusters when cut into `max_clusters`."""
    spark = c.documents.sparkSession
    merges_schema, leaves_schema = "merge_id int, a int, b int, height double, size int", "id int, term string, cluster int"
    ids, both, _, _ = incidence(c, kind, top_n, min_documents)
    own = np.diagonal(both)
    n = len(ids)
    if n < 3:
        return spark.createDataFrame([], merges_schema), spark.createDataFrame([], leaves_schema)
    far = 1 - both / np.sqrt(np.outer(own, own))
    np.fill_diagonal(far, np.inf)
    names, sizes, members = list(range(n)), [1] * n, [[i] for i in range(n)]
    merges, cut = [], None
    while len(names) > 1:
        if len(names) == min(max_clusters, n):
            cut = [list(m) for m in members]
        i, j = divmod(int(np.argmin(far)), len(names))
        i, j = min(i, j), max(i, j)
        merges.append((n + len(merges), names[i], names[j], round(float(far[i, j]), 4), sizes[i] + sizes[j]))
        row = (far[i] * sizes[i] + far[j] * sizes[j]) / (sizes[i] + sizes[j])
        far[i] = far[:, i] = row
        far[i, i] = np.inf
        names[i], sizes[i], members[i] = merges[-1][0], sizes[i] + sizes[j], members[i] + members[j]
        far = np.delete(np.delete(far, j, 0), j, 1)
        del names[j], sizes[j], members[j]
    groups = np.zeros(n, dtype=int)
    for g, m in enumerate(cut or members):
        groups[m] = g
    leaves = [(i, t, int(g)) for i, (t, g) in enumerate(zip(ids, kernels._numbered(groups), strict=True))]
    return spark.createDataFrame(merges, merges_schema), spark.createDataFrame(leaves, leaves_schema)


@operator
def clustering_by_coupling(c: Corpus, top_n: int = 100, min_weight: int = 3, impact: str = "local") -> tuple[DataFrame, dict]:
    """Clusters of three or more coupled documents: the keywords that name them, centrality, impact and quadrant."""
    if impact not in ("local", "global"):
        raise ValueError(f"impact must be 'local' or 'global', not {impact!r}")
    spark = c.documents.sparkSession
    schema = "cluster int, label string, terms string, documents int, centrality double, impact double, mean_year double, top_document string, quadrant string"
    rows, w = collected(normalize(c.bibliographic_coupling(top_n, min_weight), "association"))
    groups = kernels.louvain(w)
    eids = spark.createDataFrame([(r.id, int(g)) for r, g in zip(rows, groups, strict=True)], "eid string, cluster int")
    cards = c.documents.groupBy("eid").agg(F.min("year").alias("year"), F.max("cited_by").alias("cited_by"), F.min("title").alias("title")).join(F.broadcast(eids), "eid").join(local_citations(c), "eid").collect()
    words: dict[int, Counter] = {}
    for r in keyword_rows(c, "all").join(F.broadcast(eids), "eid").groupBy("cluster", "norm").agg(F.count(F.lit(1)).alias("n")).collect():
        words.setdefault(r.cluster, Counter())[r.norm] = r.n
    found = []
    for g in range(1, (groups.max() if len(groups) else 0) + 1):
        inside, own = groups == g, [x for x in cards if x.cluster == g]
        if len(own) < 3:
            continue
        value = {x.eid: x.local_citations if impact == "local" else x.cited_by for x in own}
        best = sorted(words.get(g, Counter()).items(), key=lambda x: (-x[1], x[0]))[:5]
        dated = [x.year for x in own if x.year is not None]
        top = min(own, key=lambda x: (-value[x.eid], x.eid))
        label = best[0][0] if best else f"Cluster {g}"
        found.append((g, label, "; ".join(k for k, _ in best), len(own), round(float(100 * w[inside][:, ~inside].sum()), 3), round(float(np.mean(list(value.values()))), 3), round(float(np.mean(dated)), 1) if dated else None, top.title))
    middle = (float(np.median([f[4] for f in found])), float(np.median([f[5] for f in found]))) if found else (0.0, 0.0)
    table = spark.createDataFrame([(*f, _quadrant(f[4], f[5], middle)) for f in found], schema)
    return table, {"centrality": round(middle[0], 3), "impact": round(middle[1], 3), "documents": len(rows)}
