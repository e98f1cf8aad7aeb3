"""Project graphs: building, resolving, expanding and analysing them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import canonical_import, python_module

#: Findings: rule_id, message, severity, relative_path, line, symbol_id.
FINDING = "rule_id string, message string, severity string, relative_path string, line int, symbol_id string"


def nodes_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def edges_of_kind(edges: DataFrame, relation: str) -> DataFrame:
    return edges.filter(F.col("relation") == relation)


def unique_lookup(rows: DataFrame, name: str, value: str) -> DataFrame:
    """name and value, for names that only one row has."""
    return rows.groupBy(name).agg(F.count("*").alias("_n"), F.first(value).alias(value)).filter("_n = 1").drop("_n")


def java_types(files: DataFrame, symbols: DataFrame, packages: DataFrame) -> DataFrame:
    """target and resolved path for the classes of Java files; a file without classes goes by its own name.

    files: relative_path; symbols: relative_path, qualified_name, kind; packages: relative_path, package (empty for none).
    """
    java = files.select("relative_path").filter(F.endswith("relative_path", F.lit(".java")))
    classes = symbols.filter("kind = 'class'").select("relative_path", F.col("qualified_name").alias("type"))
    stem = F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"\.java$", "")
    named = java.join(packages.select("relative_path", "package"), "relative_path").join(classes, "relative_path", "left")
    return named.select(F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), F.coalesce("type", stem)).alias("target"), F.col("relative_path").alias("resolved"))


def resolve_imports(imports: DataFrame, files: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """importer, target, resolved path or null. imports: importer, target; files: relative_path; types: as java_types gives them. Names that several files have stay unresolved.

    Java files import types by their whole name, all other files Python modules.
    """
    modules = unique_lookup(files.filter(F.endswith("relative_path", F.lit(".py"))).select(python_module(F.col("relative_path")).alias("target"), F.col("relative_path").alias("resolved")), "target", "resolved")
    from_java = F.endswith("importer", F.lit(".java"))
    wanted = imports.select("importer", F.when(from_java, F.col("target")).otherwise(canonical_import(F.col("target"), F.col("importer"))).alias("target"), from_java.alias("java")).distinct()
    known = modules.withColumn("java", F.lit(False))
    if types is not None:
        known = known.unionByName(unique_lookup(types.distinct(), "target", "resolved").withColumn("java", F.lit(True)))
    return wanted.join(known, ["target", "java"], "left").select("importer", "target", "resolved")


def class_parents(symbols: DataFrame) -> DataFrame:
    """child, parent: the innermost class whose name is the child's prefix and whose lines hold it. symbols: id, relative_path, qualified_name, kind, start_line, end_line."""
    c, p = symbols.alias("c"), symbols.filter("kind = 'class'").alias("p")
    prefix = F.regexp_replace("c.qualified_name", r"\.?[^.]*$", "")
    on = (F.col("c.relative_path") == F.col("p.relative_path")) & (prefix == F.col("p.qualified_name")) & (F.col("p.start_line") <= F.col("c.start_line")) & (F.col("c.end_line") <= F.col("p.end_line")) & (F.col("c.id") != F.col("p.id"))
    best = F.max_by("p.id", F.struct("p.start_line", -F.col("p.end_line")))
    return c.join(p, on).groupBy(F.col("c.id").alias("child")).agg(best.alias("parent"))


def build_graph(project: str, files: DataFrame, symbols: DataFrame, imports: DataFrame, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (kind, identity, label) and edges (source, target, relation). files: relative_path; symbols as for class_parents; imports as for resolve_imports; packages (relative_path, package) let Java imports be resolved."""
    resolved = resolve_imports(imports, files, None if packages is None else java_types(files, symbols, packages))
    target = F.coalesce("resolved", "target")
    nodes = (
        files.sparkSession.createDataFrame([("project", project, project)], "kind string, identity string, label string")
        .unionByName(files.select(F.lit("file").alias("kind"), F.col("relative_path").alias("identity"), F.col("relative_path").alias("label")))
        .unionByName(symbols.select(F.lit("symbol").alias("kind"), F.col("id").alias("identity"), F.col("qualified_name").alias("label")))
        .unionByName(resolved.filter("resolved is null").select(F.lit("external").alias("kind"), F.col("target").alias("identity"), F.col("target").alias("label")))
        .distinct()
    )
    contains = F.lit("contains").alias("relation")
    edges = (
        files.select(F.lit(project).alias("source"), F.col("relative_path").alias("target"), contains)
        .unionByName(symbols.select(F.col("relative_path").alias("source"), F.col("id").alias("target"), contains))
        .unionByName(class_parents(symbols).select(F.col("parent").alias("source"), F.col("child").alias("target"), contains))
        .unionByName(resolved.select(F.col("importer").alias("source"), target.alias("target"), F.lit("imports").alias("relation")))
        .distinct()
    )
    return nodes, edges


def steps(edges: DataFrame, relations: tuple[str, ...] = ("contains", "imports"), signals: list[tuple[str, str]] | None = None) -> DataFrame:
    """source, target, relation, direction: every edge both ways, unless only some (relation, direction) pairs are let through."""
    some = edges.filter(F.col("relation").isin(*relations))
    both = some.select("source", "target", "relation", F.lit("forward").alias("direction")).unionByName(some.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", F.lit("reverse").alias("direction")))
    if signals is not None:
        if not signals or len(set(signals)) != len(signals):
            raise ValueError("signals are different pairs, at least one")
        allowed = F.lit(False)
        for r, w in signals:
            allowed = allowed | ((F.col("relation") == r) & (F.col("direction") == w))
        both = both.filter(allowed)
    return both.distinct()


def expand(edges: DataFrame, seeds: DataFrame, shown: DataFrame, max_hops: int = 1, per_seed: int = 5, total: int = 30, group: str | None = None, **kw) -> DataFrame:
    """group, seed, node, relation, direction, hop, for nodes reached from seeds in at most max_hops steps.

    A seed reaches a node once, on the first hop and by the least (relation, direction). Nodes that aren't in `shown` (column
    node) are passed through but not returned and don't count. Of each seed the first `per_seed` by hop and node stay; of the
    seeds, in order of their names, the first that reaches a node keeps it; of all, the first `total` stay. group: a column of
    seeds to expand apart, such as the query. Each hop is one join by node.
    """
    own = [group] if group else []
    adjacency = steps(edges, **kw).withColumnsRenamed({"source": "_at", "target": "node"})
    reached = seeds.select(*own, "seed").distinct().withColumns({"node": F.col("seed"), "hop": F.lit(0), "relation": F.lit(None).cast("string"), "direction": F.lit(None).cast("string")})
    seen = frontier = reached
    for hop in range(1, max_hops + 1):
        following = frontier.select(*own, "seed", F.col("node").alias("_at")).join(adjacency, "_at")
        best = following.groupBy(*own, "seed", "node").agg(F.min(F.struct("relation", "direction")).alias("_by")).select(*own, "seed", "node", F.lit(hop).alias("hop"), "_by.relation", "_by.direction")
        frontier = best.join(seen.select(*own, "seed", "node"), [*own, "seed", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    found = seen.filter("hop > 0").join(shown.select("node").distinct(), "node", "left_semi")
    order = ["hop", "node", "relation", "direction"]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*own, "seed").orderBy(*order))).filter(F.col("_n") <= per_seed)
    # the first seed that reaches a node keeps it; then the cap holds in the order in which seeds add nodes
    once = found.withColumn("_k", F.row_number().over(Window.partitionBy(*own, "node").orderBy("seed", "_n"))).filter("_k = 1")
    if own:
        capped = once.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy("seed", "_n"))).filter(F.col("_k") <= total)
    else:  # each task keeps its first ones, then the first of all
        capped = once.orderBy("seed", "_n").limit(total)
    return capped.select(*own, "seed", "node", "relation", "direction", "hop")


def finding(rule: str, message: Column, path: Column) -> list[Column]:
    return [F.lit(rule).alias("rule_id"), message.alias("message"), F.lit("warning").alias("severity"), path.alias("relative_path"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("symbol_id")]


def method_counts(edges: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """Findings: classes with too many methods of their own. symbols: id, kind, relative_path, qualified_name."""
    kinds = symbols.select("id", "kind")
    inner = edges.filter("relation = 'contains'").join(kinds.filter("kind = 'class'").select(F.col("id").alias("source")), "source", "left_semi").join(kinds.filter("kind = 'method'").select(F.col("id").alias("target")), "target", "left_semi")
    many = inner.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("n")).filter(F.col("n") > most)
    text = F.format_string("Class '%s' defines %d direct methods, exceeding the limit of %d.", "qualified_name", "n", F.lit(most))
    return many.join(symbols, "id").select(*finding("complexity.class_method_count", text, F.col("relative_path")))


def symbol_density(files: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """Findings: files with too many symbols."""
    n = files.select("relative_path").join(symbols.groupBy("relative_path").agg(F.count("*").alias("n")), "relative_path", "left").filter(F.col("n") > most)
    return n.select(*finding("structure.symbol_density", F.format_string("File defines %d symbols, exceeding the limit of %d.", "n", F.lit(most)), F.col("relative_path")))


def import_fan_out(edges: DataFrame, most: int = 10) -> DataFrame:
    """Findings: files that import too many different targets."""
    n = edges.filter("relation = 'imports'").groupBy("source").agg(F.countDistinct("target").alias("n")).filter(F.col("n") > most)
    return n.select(*finding("dependency.concentration", F.format_string("File imports %d distinct targets, exceeding the limit of %d.", "n", F.lit(most)), F.col("source")))


#: A graph of at most so many different edges is solved by one task, in memory that this bounds.
ONE_TASK = 300_000


def _strong_by_depth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strong components of more than one node, from all edges of a small graph: one depth-first walk with a stack of its own."""
    following: dict[str, list[str]] = {}
    for frame in frames:
        for a, b in zip(frame["source"], frame["target"]):
            following.setdefault(a, []).append(b)
            following.setdefault(b, [])
    number, low, open_, out = {}, {}, [], []
    held: set[str] = set()
    for root in following:
        if root in number:
            continue
        walk = [(root, iter(following[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        held.add(root)
        while walk:
            node, rest = walk[-1]
            new = next((x for x in rest if x not in number or (x in held and number[x] < low[node])), None)
            if new is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    at = open_.index(node, number_at(open_, number, node))
                    group, open_[at:] = open_[at:], []
                    held.difference_update(group)
                    out += [(x, min(group)) for x in group] if len(group) > 1 else []
            elif new in number:
                low[node] = number[new]
            else:
                number[new] = low[new] = len(number)
                open_.append(new)
                held.add(new)
                walk.append((new, iter(following[new])))
    yield pd.DataFrame(out, columns=["node", "component"], dtype=object)


def number_at(open_: list[str], number: dict[str, int], node: str) -> int:
    """Where a node stands in a list that its numbers order."""
    return bisect_left(open_, number[node], key=number.__getitem__)


def _strong_by_group(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same from edges that are sorted by `root`, the groups they lie in: whole groups, as many as a batch ends, at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame["root"].ne(frame["root"].iloc[-1]).sum()  # where the last group, which may go on, starts
        if held and (last or held[-1]["root"].iloc[-1] != frame["root"].iloc[0]):
            yield from _strong_by_depth([*held, frame.iloc[:last]])
            held = []
        elif last:
            yield from _strong_by_depth([frame.iloc[:last]])
        held.append(frame.iloc[last:])
    yield from _strong_by_depth(held)


def weak_components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that is connected with it by edges of any direction. edges: source, target; own loops don't count.

    Alternating stars: a round turns each node's larger neighbours, then its smaller ones, towards its least neighbour, so
    rounds grow with the logarithm of the longest chain. Rounds are written to the shared folder.
    """
    from codeloom.operators.rounds import drop, written

    pairs, path = written(edges.filter("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct(), "stars")
    while True:
        # stars: every node above has one edge, to a node that has none to a lesser one
        ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(pairs.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or (up = 1 and top = 1)").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large, large_path = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        lowest, lowest_path = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, new = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(path, least_path, large_path, lowest_path)
        path = new


def strong_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (its least node) for nodes on a cycle, their own loop included. edges: source, target.

    A small graph, or what is small enough after some rounds, is walked by one task. A larger one is first cut into its weak
    components, which no cycle leaves: those that are small enough are walked whole, each by one task. Of the others,
    first, nodes that nothing enters or that nothing leaves are peeled off, round by round; then colours spread: in each
    outer round every node takes the largest node that reaches it, and those that reach back to their colour's node
    form its component and leave. Every step is a join and an aggregate by node; rounds are written to the shared folder.
    """
    from codeloom.operators.rounds import drop, written

    edges, _ = written(edges.select("source", "target").distinct(), "edges")
    loops = edges.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    left, left_path = edges.filter("source <> target"), None
    walked = None
    if left.count() > one_task:
        weak = weak_components(left)
        rooted, rooted_path = written(left.join(weak.withColumnRenamed("node", "source"), "source").select("root", "source", "target"), "rooted")
        large, large_path = written(rooted.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > one_task).select("root"), "large")
        small = rooted.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
        walked, _ = written(small.mapInPandas(_strong_by_group, "node string, component string"), "components")
        left, left_path = written(rooted.join(large, "root", "left_semi").select("source", "target"), "edges")
        drop(rooted_path, large_path)

    def named(found: DataFrame | None) -> DataFrame:
        both = [x for x in (walked, found) if x is not None]
        if not both:
            return loops
        out = both[0] if len(both) == 1 else both[0].unionByName(both[1])
        return out.unionByName(loops.join(out.select("node"), "node", "left_anti"))

    done = None
    while True:
        while True:  # peel
            before = left.count()
            if before <= one_task:
                break
            entered = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            old = left_path
            left, left_path = written(entered.join(entered.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "edges")
            drop(*filter(None, [old]))
            if left.count() == before:
                break
        if before == 0:
            break
        if before <= one_task:
            found, _ = written(left.repartition(1).mapInPandas(_strong_by_depth, "node string, component string"), "components")
            return named(found if done is None else found.unionByName(_least_named(done)))
        nodes = left.select(F.col("source").alias("node")).distinct()
        colour, colour_path = written(nodes.withColumn("colour", F.col("node")), "colours")
        while True:
            spread = left.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max("colour").alias("c"))
            new, new_path = written(colour.join(spread, "node", "left").select("node", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("changed")), "colours")
            drop(colour_path)
            changed = not new.filter("changed").isEmpty()
            colour, colour_path = new.select("node", "colour"), new_path
            if not changed:
                break
        # backwards from each colour's own node, within the colour
        inside = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target").filter("a = b").select("source", "target")
        members, members_path = written(colour.filter("node = colour"), "members")
        while True:
            more = inside.join(members.select(F.col("node").alias("target"), "colour"), "target").select(F.col("source").alias("node"), "colour").distinct().join(members, "node", "left_anti")
            grown, grown_path = written(members.unionByName(more), "members")
            same = grown.count() == members.count()
            drop(members_path)
            members, members_path = grown, grown_path
            if same:
                break
        drop(colour_path)
        done = members if done is None else done.unionByName(members)
        gone = members.select("node")
        old = left_path
        left, left_path = written(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti"), "edges")
        drop(*filter(None, [old]))
    return named(None if done is None else _least_named(done))


def _least_named(members: DataFrame) -> DataFrame:
    """node, component: the least node of each colour that more than one node has."""
    least = members.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).filter("n > 1")
    return members.join(least, "colour").select("node", "component")


def import_cycles(edges: DataFrame) -> DataFrame:
    """Findings: groups of files that import each other in a circle, or a file that imports itself. edges: between files only."""
    groups = strong_components(edges).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("files"))
    text = F.concat(F.lit("Import cycle includes "), F.size("files").cast("string"), F.when(F.size("files") == 1, " file: ").otherwise(" files: "), F.array_join("files", ", "), F.lit("."))
    return groups.select(*finding("dependency.cycle", text, F.col("component")))


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule_id", "relative_path", "line", F.col("symbol_id").isNull(), "symbol_id", "severity", "message")


def analyse(tools: dict[str, Callable[[], DataFrame]], spark) -> DataFrame:
    """Findings of all tools, in order of their names; a tool that fails gives one finding instead."""
    out = spark.createDataFrame([], FINDING)
    for name in sorted(tools):
        try:
            found = tools[name]()
            found.schema  # noqa: B018  a plan that can't be resolved fails here
        except Exception as error:
            found = spark.createDataFrame([("analysis.tool_failure", f"Analysis tool '{name}' failed: {type(error).__name__}.", "error", "", 0, None)], FINDING)
        out = out.unionByName(found)
    return out


def canonical_order(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges sorted by their JSON."""
    return nodes.orderBy(F.to_json(F.struct(*sorted(nodes.columns)))), edges.orderBy(F.to_json(F.struct(*sorted(edges.columns))))
