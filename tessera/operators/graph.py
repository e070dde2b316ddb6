"""Graphs as edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .joins import exchanged, ranked


def adjacency(edges: DataFrame, nodes: DataFrame, node: str = "path") -> DataFrame:
    """Every node with its distinct targets in order."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    return nodes.select(node).distinct().join(out.withColumnRenamed("src", node), node, "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def reverse_adjacency(edges: DataFrame, nodes: DataFrame, node: str = "path") -> DataFrame:
    """Every node, and every target that is none, with its distinct sources in order."""
    every = nodes.select(node).union(edges.select("dst"))
    return adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), every, node)


def matrix(edges: DataFrame, src_area: str = "src_area", dst_area: str = "dst_area") -> DataFrame:
    """How many edges lead from each area to each other one; repeated edges count."""
    return edges.filter(F.col(src_area) != F.col(dst_area)).groupBy(src_area, dst_area).agg(F.count("*").alias("n"))


def wide(long: DataFrame, areas: list[str], src_area: str = "src_area", dst_area: str = "dst_area") -> DataFrame:
    """The matrix with a column for each area, zero where there is no edge."""
    return long.groupBy(src_area).pivot(dst_area, areas).agg(F.sum("n")).na.fill(0)


def hubs(edges: DataFrame, most: int = 15) -> DataFrame:
    """The nodes with the most distinct sources."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("in_degree")).orderBy(F.desc("in_degree"), "dst").limit(most)


def imports_of_areas(edges: DataFrame, src_area: str = "src_area", dst_area: str = "dst_area") -> DataFrame:
    """area, imports_others, imported_by: how many other areas each one imports, and is imported by."""
    apart = edges.filter(F.col(src_area) != F.col(dst_area)).select(F.col(src_area).alias("s"), F.col(dst_area).alias("d")).distinct()
    every = edges.select(F.col(src_area).alias("area")).union(edges.select(dst_area)).distinct()
    out = apart.groupBy(F.col("s").alias("area")).agg(F.count("*").alias("imports_others"))
    into = apart.groupBy(F.col("d").alias("area")).agg(F.count("*").alias("imported_by"))
    return every.join(out, "area", "left").join(into, "area", "left").na.fill(0)


def layers(edges: DataFrame, src_area: str = "src_area", dst_area: str = "dst_area") -> DataFrame:
    """Areas numbered from the most imported one down: level, area, imported_by, imports_others."""
    return levels(imports_of_areas(edges, src_area, dst_area))


def levels(areas: DataFrame) -> DataFrame:
    """areas: area, imported_by, imports_others. level: the place of each, from 0, the most imported one first."""
    return ranked(areas, [F.desc("imported_by"), "imports_others", "area"], "level").withColumn("level", (F.col("level") - 1).cast("int"))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """Direct dependents and dependencies of a node."""
    into = edges.filter(F.col("dst") == node).select(F.lit("dependent").alias("role"), F.col("src").alias("node"))
    return into.union(edges.filter(F.col("src") == node).select(F.lit("dependency"), "dst")).distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more.

    The result is as large as the closure. Each round joins only what the last one
    found, and writes only what it finds itself.
    """
    edges = cut(edges.select("src", "dst").distinct())
    found = new = edges
    while True:
        step = new.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = cut(step.join(found, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.union(new)


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels: node, label. Along edges every node takes the least label that reaches it."""
    while True:
        sent = exchanged(labels, edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("label").alias("sent"))
        now = cut(exchanged(labels, sent, F.col("node") == F.col("dst"), "left").select("node", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") < F.col("label")).alias("less")))
        if now.filter("less").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")


#: Graphs of so few edges, once trimmed, are finished in one task; that is about 20 MB.
SMALL = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Strongly connected components of a graph that one task can hold: a walk forward for the order in which nodes are finished, and walks backward in the reverse of it."""
    node = edges.schema["src"].dataType.simpleString()

    def found(batches):
        after: dict = {}
        before: dict = {}
        for b in batches:
            for s, d in zip(b["src"], b["dst"], strict=True):
                after.setdefault(s, []).append(d)
                before.setdefault(d, []).append(s)
        order, seen = [], set()
        for start in after:
            trail = [] if start in seen else [(start, iter(after[start]))]
            seen.add(start)
            while trail:
                for d in trail[-1][1]:
                    if d not in seen:
                        seen.add(d)
                        trail.append((d, iter(after.get(d, ()))))
                        break
                else:
                    order.append(trail.pop()[0])
        taken, rows = set(), []
        for start in reversed(order):
            if start not in taken:
                taken.add(start)
                members = [start]
                for m in members:
                    new = [s for s in dict.fromkeys(before.get(m, ())) if s not in taken]
                    taken.update(new)
                    members += new
                rows += [(m, min(members)) for m in members if len(members) > 1]
        yield pd.DataFrame(rows, columns=["node", "component"])

    return edges.coalesce(1).mapInPandas(found, f"node {node}, component {node}")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Takes the nodes with one edge out away: the edges that are left, the rings of such nodes alone, and how components of the rest take in those of the nodes that belong to them.

    A path through such nodes has one end, which is found by doubling steps, so a
    path of n takes log n rounds. Edges into the path lead to its end instead. A ring that has
    no way out is a component; what leads into it is none. In the end a node of the path
    belongs to the component of its end if a node of that component leads to it, or to one before it on the path.
    """
    single = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).filter("n = 1").select(F.col("src").alias("node"), "to"))
    nodes, reached = single.count(), 1
    known = single.select(F.col("node").alias("to"), F.lit(True).alias("inner"))
    steps = [cut(exchanged(single, known, "to", "left").select("node", "to", F.col("node").alias("low"), F.coalesce("inner", F.lit(False)).alias("inner")))]
    while reached <= nodes and not steps[-1].filter("inner").isEmpty():
        last = steps[-1]
        on = last.select(F.col("node").alias("at"), F.col("to").alias("to_"), F.col("low").alias("low_"), F.col("inner").alias("inner_"))
        joined = exchanged(last, on, last["to"] == on["at"], "left")
        steps.append(cut(joined.select("node", F.coalesce("to_", "to").alias("to"), F.least("low", F.coalesce("low_", "low")).alias("low"), F.coalesce("inner_", F.lit(False)).alias("inner"))))
        reached *= 2
    last = steps[-1]
    rings = exchanged(last, last.filter("inner").select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("low").alias("component"))
    ends = last.filter(~F.col("inner")).select(F.col("node").alias("dst"), F.col("to").alias("end"))
    outer = exchanged(edges, single.select(F.col("node").alias("src")), "src", "left_anti")
    entries = cut(exchanged(outer, ends, "dst"))  # src, dst, end: where paths are entered
    kept = exchanged(outer, single.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    rest = cut(kept.union(entries.select("src", F.col("end").alias("dst"))).filter("src <> dst").distinct())

    def taken_in(components: DataFrame) -> DataFrame:
        of = lambda name, into: components.select(F.col("node").alias(name), F.col("component").alias(into))
        both = exchanged(exchanged(entries, of("src", "c1"), "src", "left"), of("end", "c2"), "end", "left")
        same = both.withColumn("c2", F.coalesce("c2", "end")).filter(F.coalesce("c1", "src") == F.col("c2"))
        found = marked = cut(same.select(F.col("dst").alias("node"), F.col("c2").alias("component"), "end").distinct())
        if marked.isEmpty():
            return components
        for step in steps[:-1] or steps:
            found = cut(found.union(exchanged(found.select("node", "component"), step.filter("inner"), "node").select(F.col("to").alias("node"), "component", F.lit(None).cast(found.schema["end"].dataType).alias("end"))).dropDuplicates(["node"]))
        ends_too = marked.select(F.col("end").alias("node"), "component").distinct()
        every = components.union(found.select("node", "component")).union(ends_too).distinct()
        least = every.groupBy("component").agg(F.min("node").alias("least"))
        return cut(exchanged(every, least, "component").select("node", F.col("least").alias("component")))

    return rest, rings, taken_in


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that have none in, or none out."""
    both = exchanged(edges.select("src").distinct().withColumnRenamed("src", "node"), edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    left = exchanged(edges, both.withColumnRenamed("node", "src"), "src", "left_semi")
    return cut(exchanged(left, both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: node, component (its least node).

    Nodes without an edge in or out are trimmed, and paths of nodes with one edge out, or one
    in, are contracted, as long as that takes a tenth of the edges away. Then every node
    takes the least label that reaches it, and of the nodes that share a label, those that reach the
    node of that name are its component. What is left goes round again. Each round
    is a few joins by exchanges; no closure is built. Once SMALL edges are left, one task ends it.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    parts: list[DataFrame] = []
    expansions: list[Callable[[DataFrame], DataFrame]] = []
    while (left := edges.count()) > SMALL:
        edges, rings, out = _contracted(_trimmed(edges))
        turned, back, into = _contracted(_turned(edges))
        parts += [rings, back]
        expansions += [out, into]
        edges = _turned(turned)
        if edges.count() <= 0.9 * left:
            continue
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        colour = _spread(nodes.select("node", F.col("node").alias("label")), edges)
        c1, c2 = colour.toDF("src", "c1"), colour.toDF("dst", "c2")
        back = cut(exchanged(exchanged(edges, c1, "src"), c2, "dst").filter("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c1"))
        found = cut(colour.filter("node = label").select("node", F.col("label").alias("component")))
        new = found
        while True:
            step = exchanged(new, back, (F.col("node") == F.col("src")) & (F.col("component") == F.col("c1"))).select(F.col("dst").alias("node"), "component").distinct()
            new = cut(exchanged(step, found, ["node", "component"], "left_anti"))
            if new.isEmpty():
                break
            found = cut(found.union(new))
        parts.append(found)
        gone = found.select(F.col("node").alias("src"))
        edges = cut(exchanged(exchanged(edges, gone, "src", "left_anti"), gone.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    done = _in_one_task(edges)
    for part in parts:
        done = done.union(part)
    if expansions:
        done = cut(done)
    for expand in reversed(expansions):
        done = expand(done)
    large = done.groupBy("component").count().filter("count > 1").select("component")
    return exchanged(done, large, "component").select("node", "component")


def cycles(edges: DataFrame) -> DataFrame:
    """The members of each strongly connected component in order."""
    return strong_components(edges).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members")


def bounded_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """starts: node. Simple paths of one to depth edges from the starts, as arrays of nodes."""
    edges = edges.select("src", "dst").distinct()
    found = paths = starts.join(edges, F.col("node") == F.col("src")).filter("src <> dst").select(F.array("src", "dst").alias("path"))
    for _ in range(depth - 1):
        paths = paths.join(edges, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = found.union(paths)
    return found


def call_paths(edges: DataFrame, start: str, end: str, depth: int = 10, most: int = 20) -> DataFrame:
    """Up to `most` paths of up to depth nodes from start to end, as arrays of nodes, the shortest first, then in order of names.

    A search in breadth that goes on from each node once, by the first path to it, and
    never from the end; so a round holds a row for each node at most.
    """
    edges = cut(edges.select("src", "dst").distinct())
    front = found = edges.sparkSession.createDataFrame([([start],)], "path array<string>")
    seen = front.select(F.lit(start).alias("node"))
    last = lambda: F.element_at("path", -1)
    for _ in range(depth - 1):
        step = front.filter(last() != end).join(edges, last() == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        arrived = step.filter(last() == end)
        onward = step.filter(last() != end).groupBy(last().alias("node")).agg(F.min("path").alias("path")).join(seen, "node", "left_anti").select("path")
        front = cut(arrived.union(onward))
        if front.isEmpty():
            break
        found, seen = found.union(front), seen.union(front.select(last().alias("node")))
    return found.filter(last() == end).orderBy(F.size("path"), "path").limit(most)


def callers(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls: caller, callee. nodes: name. For each node its callees, its callers but itself, and whether it calls itself."""
    out = calls.groupBy("caller").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    named = nodes.select("name").distinct()
    into = calls.join(named, F.col("callee") == F.col("name"), "left_semi").groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    none = F.array().cast("array<string>")
    table = named.join(out, F.col("name") == F.col("caller"), "left").join(into, F.col("name") == F.col("callee"), "left")
    every = F.coalesce("callers", none)
    return table.select("name", F.coalesce("callees", none).alias("callees"), F.array_remove(every, F.col("name")).alias("callers"), F.array_contains(every, F.col("name")).alias("self_recursive"))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls: caller, callee as written. functions: qname, ord. A callee becomes the first function whose qualified name is it or ends with a dot and it; others stay as they are.

    Qualified names are exploded into their trailing parts once, and joined by equality.
    """
    parts = F.split("qname", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, n, F.size(parts) - n + 1)))
    known = functions.select("qname", "ord", F.explode(tails).alias("callee")).groupBy("callee").agg(F.min_by("qname", F.struct("ord", "qname")).alias("qname"))
    return calls.join(known, "callee", "left").select("caller", F.coalesce("qname", "callee").alias("callee")).distinct()


def call_stats(graph: DataFrame) -> DataFrame:
    n, e = F.count("*"), F.coalesce(F.sum(F.size("callees")), F.lit(0))
    return graph.agg(n.alias("total_functions"), e.alias("total_call_edges"), F.coalesce(F.sum(F.size("callers")), F.lit(0)).alias("total_caller_edges"), F.round(F.coalesce(F.try_divide(e, n), F.lit(0.0)), 2).alias("avg_callees_per_func"))


def call_counts(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """call_stats(callers(calls, nodes)) of distinct calls between names that are not null, without a list of any node's callers."""
    named, one = nodes.select("name").distinct(), F.lit(1).alias("one")
    out = calls.join(named, F.col("caller") == F.col("name"), "left_semi").agg(F.count("*").alias("e"), one)
    into = calls.filter("caller <> callee").join(named, F.col("callee") == F.col("name"), "left_semi").agg(F.count("*").alias("c"), one)
    table = named.agg(F.count("*").alias("n"), one).join(out, "one").join(into, "one")  # one row each
    return table.select(F.col("n").alias("total_functions"), F.col("e").alias("total_call_edges"), F.col("c").alias("total_caller_edges"), F.round(F.coalesce(F.try_divide("e", "n"), F.lit(0.0)), 2).alias("avg_callees_per_func"))
