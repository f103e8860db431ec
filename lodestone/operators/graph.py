"""Typed-graph and tree operators: bounded walks, impact, subtrees, children, entity detail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity
from ..schema import project_entity
from .lineage import cut, settle


#: Nodes that edges are looked up by, instead of being joined with them.
FEW_NODES = 200


def _few(ids: DataFrame) -> list[str] | None:
    """The ids, if they are few."""
    found = [r[0] for r in ids.select("id").distinct().limit(FEW_NODES + 1).collect()]
    return found if len(found) <= FEW_NODES else None


def links_at(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """The edges that have one of the nodes (column id) at this end. Few nodes are a filter of the scans that edges are made
    of, so that no other edge is joined, deduplicated or sorted; many are joined."""
    few = _few(nodes)
    if few is not None:
        return edges.where(F.col(end).isin(few))
    return edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi").select(*edges.columns)


class _Links:
    """Edges of which a walk needs those of its frontiers: of few nodes by a filter, else from a table of all that is made
    once, by the first hop that needs it."""

    def __init__(self, edges: DataFrame):
        self.edges, self.whole = edges.select("src", "dst", "type"), None

    def of(self, end: str, frontier: DataFrame) -> DataFrame:
        few = _few(frontier)
        if few is not None:
            return (self.edges if self.whole is None else self.whole).where(F.col(end).isin(few))
        if self.whole is None:
            self.whole = settle(self.edges)
        return self.whole


def walk(edges: DataFrame | _Links, roots: DataFrame, inbound: bool, depth: int, edge_type: str = "", enough: Callable[[DataFrame, int], bool] | None = None) -> DataFrame:
    """root, id, depth, via: each node at its shallowest hop from each root (column id), with the smallest type of the
    edges that reach it there; the root itself is left out. edge_type constrains every hop.

    A hop joins the frontier with the edges on one key, aggregates to one row a node before it looks at what was seen, and
    cuts the lineage, so the plan of a hop stays the same size whatever the depth. Nodes that are seen are never expanded
    again. Where only the nearest nodes are asked for, `enough` tells by what was reached (and its number of rows) that
    deeper ones can't be among them."""
    near, far = ("dst", "src") if inbound else ("src", "dst")
    links = edges if isinstance(edges, _Links) else _Links(edges)
    seen = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.lit("").alias("via")))
    frontier, n = seen.select("root", "id"), 0
    for hop in range(1, depth + 1):
        own = links.of(near, frontier)
        own = (own.where(F.col("type") == edge_type) if edge_type else own).select(F.col(near).alias("id"), F.col(far).alias("next"), "type")
        step = frontier.join(own, "id").groupBy("root", F.col("next").alias("id")).agg(F.min("type").alias("via"))
        fresh = step.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(hop).alias("depth"), "via")
        fresh = cut(fresh) if hop < depth else fresh
        seen = seen.unionByName(fresh)
        if hop < depth:
            more = fresh.count()
            n += more
            if not more or enough and enough(seen.where("depth > 0"), n):
                break
        frontier = fresh.select("root", "id")
    return seen.where("depth > 0")


def _enough(entities: DataFrame, most: int, kind: str = "") -> Callable[[DataFrame, int], bool]:
    """Whether `most` of the reached nodes would be listed: those that are entities (of a kind)."""

    def test(reached: DataFrame, n: int) -> bool:
        if n < most:
            return False
        own = entities.where(F.col("kind") == kind) if kind else entities
        return reached.join(own.select("id"), "id", "left_semi").limit(most).count() >= most

    return test


def _root(entities: DataFrame, id: str) -> DataFrame:
    return entities.where(F.col("id") == id).select("id").distinct()


def references(entities: DataFrame, edges: DataFrame, id: str, direction: str = "both", depth: int = 1, edge_type: str = "", kind: str = "", limit: int = 200, offset: int = 0, outbound: DataFrame | None = None) -> DataFrame:
    """Entities around `id` as id, kind, name, direction, depth, via, ordered by depth, direction and id.

    An unknown id or direction gives no rows; "" means both; a node found inbound isn't listed outbound; `kind` filters
    results only, `edge_type` every hop; dangling nodes are walked through but not listed. `outbound` are the same edges,
    where they are also stored in the order of their sources."""
    depth, limit, offset = max(1, depth), limit if limit > 0 else 200, max(0, offset)
    direction = direction or "both"
    found = None
    own = {True: _Links(edges)}
    own[False] = own[True] if outbound is None else _Links(outbound)
    # With both, what is inbound at any depth isn't listed outbound, so that neither walk may end early.
    enough = None if direction == "both" else _enough(entities, offset + limit, kind)
    for name, inbound, order in (("in", True, 0), ("out", False, 1)):
        if direction in (name, "both"):
            one = walk(own[inbound], _root(entities, id), inbound, depth, edge_type, enough).select("id", "depth", "via", F.lit(name).alias("direction"), F.lit(order).alias("turn"))
            found = one if found is None else found.unionByName(one)
    if found is None:
        return walk(edges, _root(entities, id).limit(0), True, 1).select("id", F.lit("").alias("kind"), F.lit("").alias("name"), F.lit("").alias("direction"), "depth", "via").limit(0)
    if direction == "both":
        found = found.groupBy("id").agg(F.min_by(F.struct("depth", "via", "direction", "turn"), "turn").alias("x")).select("id", "x.*")
    named = found.join(entities.select("id", "kind", "name"), "id")
    if kind:
        named = named.where(F.col("kind") == kind)
    return named.orderBy("depth", "turn", "id").offset(offset).limit(limit).select("id", "kind", "name", "direction", "depth", "via")


IMPACT_CAP = 5000


def _impacted(entities: DataFrame, edges: DataFrame, id: str, max_depth: int) -> DataFrame:
    reached = walk(edges, _root(entities, id), True, max_depth if max_depth > 0 else 4, enough=_enough(entities, IMPACT_CAP))
    named = reached.join(entities.select("id", "kind", "name"), "id")
    ranked = named.withColumn("severity", F.round(severity(F.col("via")) / F.col("depth"), 6))
    return ranked.orderBy("depth", "id").limit(IMPACT_CAP)


def impact(entities: DataFrame, edges: DataFrame, id: str, max_depth: int = 4, limit: int = 200) -> DataFrame:
    """What depends on `id`, worst first: id, kind, name, depth, via, severity (weight of the last edge over depth)."""
    return _impacted(entities, edges, id, max_depth).orderBy(F.desc("severity"), "depth", "id").limit(limit if limit > 0 else 200).select("id", "kind", "name", "depth", "via", "severity")


def impact_summary(entities: DataFrame, edges: DataFrame, id: str, max_depth: int = 4, limit: int = 200) -> DataFrame:
    """One row: total_dependents within the walk's cap, and whether a page of `limit` leaves some of them out."""
    total = _impacted(entities, edges, id, max_depth).agg(F.count("*").alias("total_dependents"))
    return total.select("total_dependents", (F.col("total_dependents") > (limit if limit > 0 else 200)).alias("truncated"))


def impact_by_kind(entities: DataFrame, edges: DataFrame, id: str, max_depth: int = 4) -> DataFrame:
    return _impacted(entities, edges, id, max_depth).groupBy("kind").agg(F.count("*").alias("n"))


def subtree(entities: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """id of all entities at or below the roots (column id), along `parent`; cycles end, `most` levels at most."""
    tree = entities.where("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    tree = settle(tree)
    seen = roots.select("id").distinct()
    frontier = seen
    for _ in range(most):
        fresh = cut(frontier.join(tree, "id").select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti"))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def ancestors(bases: DataFrame, most: int = 64) -> DataFrame:
    """node, ancestor, hops (own: 0) of all chains of `bases` (node, base), nearest first; cycles end."""
    pairs = bases.where("base is not null and base <> ''").select("node", "base").distinct()
    nodes = pairs.select("node").unionByName(pairs.select(F.col("base").alias("node"))).distinct()
    seen = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"))
    frontier = seen
    up = pairs.select(F.col("node").alias("ancestor"), F.col("base").alias("next"))
    for hop in range(1, most + 1):
        step = frontier.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        fresh = cut(step.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("hops", F.lit(hop)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def class_of():
    return F.coalesce(F.get_json_object("detail", "$.class"), F.col("kind"))


def fair_order(children: DataFrame) -> DataFrame:
    """children with class, turn (place within its class by id) and class_size: ordered by (turn, class_size, class, id),
    each class has its turn before any class has its next, rare classes first."""
    return children.withColumn("class", class_of()).withColumn("turn", F.row_number().over(Window.partitionBy("class").orderBy("id"))).withColumn("class_size", F.count("*").over(Window.partitionBy("class")))


def children(entities: DataFrame, id: str, class_filter: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the direct children of `id` in fair order: id, kind, name, class, turn, class_size, total (of all pages)."""
    own = entities.where(F.col("parent") == id)
    if class_filter:
        own = own.where(F.contains(F.lower(class_of()), F.lit(class_filter.lower())))
    total = F.count("*").over(Window.partitionBy("parent"))
    return fair_order(own).withColumn("total", total).orderBy("turn", "class_size", "class", "id").offset(max(0, offset)).limit(limit if limit > 0 else 50).select("id", "kind", "name", "class", F.col("turn").cast("long").alias("turn"), F.col("class_size").cast("long").alias("class_size"), F.col("total").cast("long").alias("total"))


def children_by_class(entities: DataFrame, id: str) -> DataFrame:
    return entities.where(F.col("parent") == id).groupBy(class_of().alias("class")).agg(F.count("*").alias("n"))


def entity_counts(entities: DataFrame, edges: DataFrame, chunks: DataFrame, id: str) -> DataFrame:
    """One row: outgoing, incoming, children and chunks of `id`; each count is one filtered scan."""
    parts = [
        edges.where((F.col("src") == id) | (F.col("dst") == id)).agg(F.count_if(F.col("src") == id).alias("n_out"), F.count_if(F.col("dst") == id).alias("n_in")),
        entities.where(F.col("parent") == id).agg(F.count("*").alias("n_children")),
        chunks.where(F.col("entity_id") == id).agg(F.count("*").alias("n_chunks")),
    ]
    keyed = [p.withColumn("one", F.lit(id)) for p in parts]  # each has one row
    return keyed[0].join(keyed[1], "one").join(keyed[2], "one").select(F.col("one").alias("id"), "n_out", "n_in", "n_children", "n_chunks")


def entity_detail(entities: DataFrame, edges: DataFrame, chunks: DataFrame, id: str, cap: int = 50) -> dict[str, DataFrame]:
    """The parts of an entity's answer, each with `cap` rows at most; counts tell what was cut."""
    cap = cap if cap > 0 else 50
    return {
        "entity": entities.where(F.col("id") == id).select(*project_entity()),
        "chunks": chunks.where(F.col("entity_id") == id).orderBy("id").limit(cap).select("id", "kind", "text"),
        "outgoing": edges.where(F.col("src") == id).orderBy("type", "dst").limit(cap),
        "incoming": edges.where(F.col("dst") == id).orderBy("type", "src").limit(cap),
        "children": children(entities, id, limit=cap),
        "classes": children_by_class(entities, id).orderBy(F.desc("n"), "class"),
        "counts": entity_counts(entities, edges, chunks, id),
        "truncated": truncated(entity_counts(entities, edges, chunks, id), cap),
    }


def truncated(counts: DataFrame, cap: int) -> DataFrame:
    """part, n, note of the parts of an entity's answer that `cap` cuts off."""
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).alias("n")) for name, c in (("outgoing", "n_out"), ("incoming", "n_in"), ("children", "n_children"), ("chunks", "n_chunks"))])
    cut_off = counts.select(F.explode(parts).alias("x")).select("x.*").where(F.col("n") > cap)
    return cut_off.select("part", "n", F.concat(F.lit(f"{cap} of "), F.col("n").cast("string"), F.lit(" listed")).alias("note"))
