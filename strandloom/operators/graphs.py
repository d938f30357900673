"""Graph analytics over edge tables (src, dst) by rounds of joins; every round is cut with a reliable checkpoint.

Frontiers hold only nodes new in a round, so the work follows the edges, and no component or path is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.session import cut_lineage

#: Separates the nodes of a path; sorts before any printable character.
STEP = "\x01"


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without null ends."""
    return cut_lineage(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())


class Grown:
    """Rows that only grow, kept as few checkpointed parts: two are merged where the later has at least half the rows of the
    earlier, so that each row is written about once for every doubling, and a plan over all parts stays small."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, rows: DataFrame, n: int) -> None:
        self.parts.append((rows, n))
        while len(self.parts) > 1 and self.parts[-2][1] <= 2 * self.parts[-1][1]:
            (b, m), (a, k) = self.parts.pop(), self.parts.pop()
            self.parts.append((cut_lineage(a.unionByName(b)), k + m))

    def all(self) -> DataFrame:
        out = self.parts[0][0]
        for rows, _ in self.parts[1:]:
            out = out.unionByName(rows)
        return out


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(root, node, hops): nodes reached from each root (within ``depth`` steps, if given), with the least number of steps; the root
    itself only by a cycle. roots: (root). Nodes in ``blocked`` (node) are reached, but not passed."""
    step = clean_edges(edges)
    if blocked is not None:
        step = cut_lineage(step.join(blocked.select(F.col("node").alias("src")), "src", "left_anti"))
    frontier = cut_lineage(roots.select("root", F.col("root").alias("src")).distinct())
    found, hops = Grown(), 0
    while depth is None or hops < depth:
        hops += 1
        new = frontier.join(step, "src").select("root", F.col("dst").alias("node")).distinct()
        if found.parts:
            new = new.join(found.all().select("root", "node"), ["root", "node"], "left_anti")
        new = cut_lineage(new.withColumn("hops", F.lit(hops).cast("bigint")))
        if not (n := new.count()):
            break
        found.add(new, n)
        frontier = new.select("root", F.col("node").alias("src"))
    if not found.parts:
        return roots.limit(0).select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("hops"))
    return found.all()


def shortest_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, path): a shortest path to each node other than the root, the first by the order of its nodes; nodes as text."""
    step = clean_edges(edges)
    new = cut_lineage(roots.select("root", F.col("root").alias("node"), F.col("root").cast("string").alias("path")).distinct())
    found = Grown()
    while n := new.count():
        found.add(new, n)
        longer = F.concat("path", F.lit(STEP), F.col("dst").cast("string"))
        nxt = new.withColumnRenamed("node", "src").join(step, "src").groupBy("root", F.col("dst").alias("node")).agg(F.min(longer).alias("path"))
        new = cut_lineage(nxt.join(found.all().select("root", "node"), ["root", "node"], "left_anti"))
    all_ = found.all() if found.parts else new
    return all_.filter(F.col("path").contains(STEP)).select("root", "node", F.regexp_replace("path", STEP, " > ").alias("path"))


def levels(edges: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """(node, level, total): wave of each node of src -> dst ('src depends on dst'), 0 without dependencies, else one more than
    the highest of its dependencies; total is the dearest chain of costs down to it, itself included. Nodes on or behind a cycle
    have a null level. cost: (node, cost), missing costs count 1."""
    step = clean_edges(edges)
    nodes = step.select(F.col("src").alias("node")).union(step.select(F.col("dst").alias("node"))).distinct()
    if cost is not None:
        nodes = nodes.join(cost, "node", "left").select("node", F.coalesce("cost", F.lit(1.0)).alias("cost"))
    else:
        nodes = nodes.withColumn("cost", F.lit(1.0))
    need = step.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("need"))
    state = cut_lineage(nodes.join(need, "node", "left").select("node", "cost", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0.0).alias("below")))
    done, level = Grown(), 0
    while True:
        ready = cut_lineage(state.filter("need = 0").select("node", F.lit(level).cast("bigint").alias("level"), (F.col("cost") + F.col("below")).alias("total")))
        if not (n := ready.count()):
            break
        done.add(ready, n)
        met = step.join(ready.select(F.col("node").alias("dst"), "total"), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"), F.max("total").alias("top"))
        state = cut_lineage(state.filter("need > 0").join(met, "node", "left").select("node", "cost", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), F.greatest("below", F.coalesce("top", F.lit(0.0))).alias("below")))
        level += 1
    stuck = state.select("node", F.lit(None).cast("bigint").alias("level"), F.lit(None).cast("double").alias("total"))
    return stuck if not done.parts else done.all().unionByName(stuck)


def _forward_least(nodes: DataFrame, step: DataFrame) -> DataFrame:
    """(node, color): the least node from which each is reached (itself included), with frontiers of changed nodes."""
    color = cut_lineage(nodes.select("node", F.col("node").alias("color")))
    moved = color
    while True:
        offers = moved.select(F.col("node").alias("src"), "color").join(step, "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("offer"))
        nxt = cut_lineage(color.join(offers, "node", "left").select("node", F.least("color", F.coalesce("offer", "color")).alias("color"), (F.col("offer") < F.col("color")).alias("moved")))
        moved, color = nxt.filter("moved").select("node", "color"), nxt.select("node", "color")
        if moved.isEmpty():
            return color


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node; by forward colours and backward searches.

    In each turn nodes take the least node that reaches them as colour; those that reach back to their colour's node within the
    colour form its component and are taken out. Nodes without predecessors or successors are set aside first.
    """
    step = clean_edges(edges)
    nodes = cut_lineage(step.select(F.col("src").alias("node")).union(step.select(F.col("dst").alias("node"))).distinct())
    done = None
    while True:
        while True:  # trim
            inside = nodes.join(step.select(F.col("src").alias("node")), "node", "left_semi").join(step.select(F.col("dst").alias("node")), "node", "left_semi")
            lone = cut_lineage(nodes.join(inside, "node", "left_anti"))
            if lone.isEmpty():
                break
            part = lone.select("node", F.col("node").alias("component"))
            done = part if done is None else done.unionByName(part)
            nodes = cut_lineage(inside)
            step = cut_lineage(step.join(lone.select(F.col("node").alias("src")), "src", "left_anti").join(lone.select(F.col("node").alias("dst")), "dst", "left_anti"))
        if nodes.isEmpty():
            return done if done is not None else nodes.select("node", F.col("node").alias("component"))
        color = _forward_least(nodes, step)
        inner = step.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd")
        inner = cut_lineage(inner.select("src", "dst", F.col("cs").alias("color")))
        frontier = cut_lineage(color.filter("node = color"))
        found = Grown()
        found.add(frontier, frontier.count())
        while True:
            new = frontier.select(F.col("node").alias("dst"), "color").join(inner, ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            frontier = cut_lineage(new.join(found.all(), ["node", "color"], "left_anti"))
            if not (n := frontier.count()):
                break
            found.add(frontier, n)
        back = found.all()
        part = back.select("node", F.col("color").alias("component"))
        done = part if done is None else cut_lineage(done.unionByName(part))
        nodes = cut_lineage(nodes.join(back.select("node"), "node", "left_anti"))
        step = cut_lineage(step.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, role): role is root (nothing points to it), leaf (points to nothing), inner."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return n.withColumn("role", F.when(F.col("n_in") == 0, "root").when(F.col("n_out") == 0, "leaf").otherwise("inner"))


def weakest_cycle_edges(edges: DataFrame, components: DataFrame, weight: str) -> DataFrame:
    """(component, src, dst): in each component of several nodes the edge of least weight, where its cycles would be broken."""
    c = components.select(F.col("node").alias("src"), "component")
    inner = edges.join(c, "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst").filter("component = cd AND src <> dst")
    return inner.groupBy("component").agg(F.min(F.struct(weight, "src", "dst")).alias("m")).select("component", "m.src", "m.dst")


def enclosing(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, ident: str) -> DataFrame:
    """points with ``owner``: the innermost span [start, end) of the group that holds the point (latest start, then greatest
    ident); null without any. Spans nest (no two cross), as definitions in a file do.

    One sweep instead of a range join: of the ends of the elementary pieces between span bounds each knows its innermost span,
    and a point takes that of the last bound before it. Spans of one depth don't overlap, so the sweep is a running value.
    """
    s = spans.select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(ident).alias("_id")).filter("_g IS NOT NULL AND _s < _e")
    opens = s.select("_g", F.col("_s").alias("_at"), F.lit(1).alias("_d"), "_s", "_e", "_id")
    closes = s.select("_g", F.col("_e").alias("_at"), F.lit(-1).alias("_d"), "_s", "_e", "_id")
    # order at one instant: closes, inner first; then opens, outer first; a point comes after both
    order = ["_at", "_d", F.when(F.col("_d") < 0, -F.col("_s")).otherwise(-F.col("_e")), F.when(F.col("_d") < 0, -F.col("_id")).otherwise(F.col("_id"))]
    run = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = opens.unionByName(closes).withColumn("_depth", F.sum("_d").over(run) + F.when(F.col("_d") < 0, 1).otherwise(0))
    # after a close the span one level up holds again: the last opened at that depth
    level = W.partitionBy("_g", "_l").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = depth.withColumn("_l", F.when(F.col("_d") > 0, F.col("_depth")).otherwise(F.col("_depth") - 1))
    opened = opened.withColumn("_top", F.last(F.when(F.col("_d") > 0, F.struct("_s", "_id")), ignorenulls=True).over(level))
    marks = opened.select("_g", "_at", F.lit(0).alias("_p"), "_d", F.when(F.col("_l") > 0, F.col("_top")["_id"]).alias("_owner"), F.row_number().over(W.partitionBy("_g").orderBy(*order)).alias("_n"))
    last = marks.groupBy("_g", "_at").agg(F.max_by(F.struct("_owner"), "_n")["_owner"].alias("_owner"))
    both = points.select("*", F.col(group).alias("_g"), F.col(at).alias("_at"), F.lit(1).alias("_p"), F.lit(None).alias("_o")).unionByName(last.select("_g", "_at", F.lit(0).alias("_p"), F.struct("_owner").alias("_o")), allowMissingColumns=True)
    held = F.last("_o", ignorenulls=True).over(W.partitionBy("_g").orderBy("_at", "_p").rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("owner", held["_owner"]).filter("_p = 1").drop("_g", "_at", "_p", "_o")


def resolved(uses: DataFrame, definitions: DataFrame, name: str, scopes: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Best definitions of each use: (use_id, def_id, scope, confidence).

    scopes: from near to far, a label and the columns of the use and of the definition that must be equal; None for both holds
    anywhere. The nearest scope with a definition of the name wins, and n definitions in it share the confidence 1 / n. Null names
    and null scopes meet nothing. Definitions are counted per name and scope and asked once for each place of use, so that uses
    meet those of their nearest scope only.
    """
    key = lambda c: F.lit("") if c is None else F.col(c).cast("string")
    at = lambda side: F.explode(F.array(*(F.struct(F.lit(i).alias("_s"), key(x[side]).alias("_k")) for i, x in enumerate(scopes))))
    places = list(dict.fromkeys(u for _, u, _ in scopes if u is not None))
    held = definitions.select("def_id", name, at(2).alias("_a")).select("def_id", name, "_a.*")
    counts = held.groupBy(name, "_s", "_k").agg(F.count("*").alias("_n"))
    asked = uses.select(name, *places).distinct().select(name, *places, at(1).alias("_a")).select(name, *places, "_a.*")
    nearest = asked.join(counts, [name, "_s", "_k"]).groupBy(name, *places).agg(F.min(F.struct("_s", "_k", "_n")).alias("_b"))
    nearest = nearest.select(F.col(name).alias("_name"), *(F.col(p).alias(f"_at_{p}") for p in places), "_b.*")
    same = F.col(name) == F.col("_name")
    for p in places:
        same &= F.col(p).eqNullSafe(F.col(f"_at_{p}"))
    best = uses.join(nearest, same).select("use_id", name, "_s", "_k", "_n").join(held, [name, "_s", "_k"])
    labels = F.array(*(F.lit(x[0]) for x in scopes))
    return best.select("use_id", "def_id", F.get(labels, F.col("_s")).alias("scope"), F.round(1 / F.col("_n"), 6).alias("confidence"))


def edit_kinds(old: DataFrame, new: DataFrame, parent: str, kind: str, order: str, name: str, signature: str) -> DataFrame:
    """Definitions paired by parent, kind and place: renamed (equal signature) or a changed signature; others give nothing."""
    place = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy(parent, kind).orderBy(order)))
    a = place(old).select(parent, kind, "_n", F.col(name).alias("old_name"), F.col(signature).alias("_sa"))
    b = place(new).select(parent, kind, "_n", F.col(name).alias("new_name"), F.col(signature).alias("_sb"))
    both = a.join(b, [parent, kind, "_n"])
    edit = F.when((F.col("old_name") != F.col("new_name")) & (F.col("_sa") == F.col("_sb")), "rename").when(F.col("_sa") != F.col("_sb"), "signature")
    return both.select(parent, kind, F.col("_n").cast("bigint").alias("ordinal"), "old_name", "new_name", edit.alias("edit")).filter("edit IS NOT NULL")


def merkle_root(rows: DataFrame, group: list[str], place: str, digest: str) -> DataFrame:
    """(group, root): pairwise SHA-256 of the hex digests in order of place (0, 1, ...), an odd last one paired with itself."""
    level = cut_lineage(rows.select(*group, F.col(place).alias("_p"), F.col(digest).alias("_d")))
    while not level.filter("_p > 0").isEmpty():
        many = level.groupBy(*group, F.floor(F.col("_p") / 2).alias("_q")).agg(F.min_by("_d", "_p").alias("a"), F.max_by("_d", "_p").alias("b"), F.max("_p").alias("top"))
        alone = F.max("top").over(W.partitionBy(*group)) == 0  # a finished group stays
        level = cut_lineage(many.select(*group, F.col("_q").alias("_p"), F.when(alone, F.col("a")).otherwise(F.sha2(F.concat("a", "b"), 256)).alias("_d")))
    return level.select(*group, F.col("_d").alias("root"))
