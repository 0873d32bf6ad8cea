"""Measures of networks given as nodes and edges; they collect a network, which has at most `top_n` nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.corpus import Corpus, operator
from folioscope.graph import kernels
from folioscope.operators.networks import Graph, normalize, overlay_years

#: More nodes than this aren't measured on one machine.
MOST_NODES = 5_000


def collected(graph: Graph) -> tuple[list, np.ndarray]:
    """Nodes in order of id, and their weights."""
    nodes, edges = graph
    rows = nodes.orderBy("id").limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"a network of more than {MOST_NODES} nodes is not measured; lower top_n")
    links = [(r.source, r.target, float(r.weight)) for r in edges.select("source", "target", "weight").collect()]
    return rows, kernels.weights([r.id for r in rows], links)


@operator
def network_metrics(c: Corpus, graph: Graph, overlay_unit: str | None = None, level: str = "parent", resolution: float = 1.0) -> Graph:
    """The graph with centralities, clustering and community of each node, and its mean year where a unit is given."""
    nodes, edges = graph
    rows, w = collected(graph)
    between, close, _ = kernels.betweenness_and_closeness(w)
    columns = zip([r.id for r in rows], between.round(4), close.round(4), kernels.pagerank(w).round(5), kernels.eigenvector(w).round(4), kernels.clustering(w).round(4), kernels.louvain(w, resolution), strict=True)
    measured = nodes.sparkSession.createDataFrame([(i, *map(float, x[:-1]), int(x[-1])) for i, *x in columns], "id string, betweenness double, closeness double, pagerank double, eigenvector double, clustering double, community int")
    out = nodes.join(F.broadcast(measured), "id")
    if overlay_unit:
        out = out.join(overlay_years(c, overlay_unit, level), "id", "left")
    return out.orderBy(F.desc("occurrences"), "id"), edges


@operator
def network_summary(c: Corpus, graph: Graph, resolution: float = 1.0) -> dict[str, float | int]:
    """Size, density, transitivity, components, paths and modularity of a graph."""
    _, w = collected(graph)
    n, links = len(w), int((w > 0).sum() // 2)
    plain = (w > 0).astype(float)
    degree = plain.sum(axis=1)
    triples = float((degree * (degree - 1)).sum())
    steps = kernels.hops(w)
    _, _, far = kernels.betweenness_and_closeness(w)
    off = ~np.eye(n, dtype=bool) & np.isfinite(far)
    groups = kernels.louvain(w, resolution)
    return {
        "nodes": n, "edges": links, "density": round(2 * links / (n * (n - 1)), 4) if n > 1 else 0.0, "transitivity": round(float(np.trace(plain @ plain @ plain)) / triples, 4) if triples else 0.0,
        "components": len(set(kernels.connected(w).tolist())), "mean_degree": round(2 * links / n, 2) if n else 0.0, "mean_path_length": round(float(far[off].mean()), 4) if off.any() else 0.0,
        "diameter": int(steps[np.isfinite(steps)].max()) if n else 0, "communities": len(set(groups.tolist())), "modularity": round(kernels.modularity(w, groups, resolution), 4),
    }


@operator
def network_layout(c: Corpus, graph: Graph) -> dict[str, tuple[float, float]]:
    rows, w = collected(graph)
    return {r.id: (round(float(x), 2), round(float(y), 2)) for r, (x, y) in zip(rows, kernels.layout(w), strict=True)}


@operator
def attach_layout(c: Corpus, graph: Graph) -> Graph:
    nodes, edges = graph
    places = nodes.sparkSession.createDataFrame([(k, *v) for k, v in network_layout(c, graph).items()], "id string, x double, y double")
    return nodes.join(F.broadcast(places), "id", "left").orderBy(F.desc("occurrences"), "id"), edges


@operator
def network_density(c: Corpus, graph: Graph, size: int = 48) -> np.ndarray:
    rows, w = collected(graph)
    return kernels.density(kernels.layout(w), np.array([float(r.occurrences) for r in rows]), size)


UNITS = ("authors", "keywords", "institutions", "countries", "cities", "references", "cited-authors", "coupling")


def unit_graph(c: Corpus, unit: str, top_n: int, min_weight: int, kind: str, level: str) -> Graph:
    made = {
        "authors": lambda: c.co_authorship(top_n, min_weight), "keywords": lambda: c.co_word(top_n, min_weight, kind), "institutions": lambda: c.co_institution(top_n, min_weight, level), "countries": lambda: c.co_country(top_n, min_weight),
        "cities": lambda: c.co_city(top_n, min_weight), "references": lambda: c.co_citation(top_n, min_weight), "cited-authors": lambda: c.co_citation_authors(top_n, min_weight), "coupling": lambda: c.bibliographic_coupling(top_n, min_weight),
    }
    if unit not in made:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")
    return made[unit]()


@operator
def network(c: Corpus, unit: str = "authors", top_n: int = 50, min_weight: int = 1, normalization: str = "none", overlay: bool = False, kind: str = "author", level: str = "parent", resolution: float = 1.0) -> tuple[DataFrame, DataFrame, dict]:
    """A unit's network built, normalised, measured and summed up."""
    graph = normalize(unit_graph(c, unit, top_n, min_weight, kind, level), normalization)
    dated = unit if overlay and unit in ("authors", "keywords", "institutions", "countries", "cities") else None
    nodes, edges = network_metrics(c, graph, dated, level, resolution)
    return nodes, edges, network_summary(c, graph, resolution)


@operator
def density_map(c: Corpus, unit: str = "keywords", top_n: int = 50, min_weight: int = 1, size: int = 48, kind: str = "author", level: str = "parent") -> tuple[DataFrame, np.ndarray]:
    graph = unit_graph(c, unit, top_n, min_weight, kind, level)
    return attach_layout(c, graph)[0], network_density(c, graph, size)


@operator
def term_network(c: Corpus, field: str = "abstract", ngram: int = 2, top_n: int = 40, min_weight: int = 2, min_documents: int = 2, normalization: str = "none", stopwords: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    graph = normalize(c.text_co_occurrence(field, ngram, top_n, min_weight, min_documents, stopwords), normalization)
    return (*network_metrics(c, graph), network_summary(c, graph))


@operator
def citation_graph(c: Corpus, unit: str = "sources", top_n: int = 40, min_weight: int = 1, level: str = "parent") -> tuple[DataFrame, DataFrame, dict]:
    graph = c.citation_network(unit, top_n, min_weight, level)
    return (*network_metrics(c, graph), network_summary(c, graph))
