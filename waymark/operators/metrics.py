"""Ratio metrics over fact tables; the first key is always the project."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.functions.checkpoints import settled
from waymark.functions.stats import strong_components

#: A window counts as cloned in 2 to so many places; common boilerplate beyond it is no clone of anything.
LARGEST_BUCKET = 40

#: So many keys of sections are broadcast, each a single long; of more, the windows are shuffled.
SECTION_KEYS = 2_000_000


def ratio(part: Column, whole: Column, empty: float | None, digits: int = 6) -> Column:
    """part / whole, rounded; `empty` where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty).cast("double")), digits)


def normalised_tokens(text: Column) -> Column:
    """array<struct<tok,line>>: white-space tokens by line; digits are alike, words are lower-cased."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    words = lambda line: F.filter(F.split(F.trim(F.lower(line)), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(lines, lambda line, i: F.transform(words(line), lambda w: F.struct(F.regexp_replace(w, "[0-9]", "0").alias("tok"), i.alias("line")))))


def _run_ranks(h: Column, window: int) -> list[tuple[str, Column]]:
    """Columns, each from those before it, whose last holds the rank of the `window` tokens from every place.

    Ranks of runs of 1, 2, 4, … tokens: a run's rank is the hash of its halves' ranks, and a window is put together from
    runs as its length has binary digits. Runs over the end have ranks that mean nothing.
    """
    out, size = [("r1", h)], 1
    while 2 * size <= window:
        out.append((f"r{2 * size}", _joined(f"r{size}", f"r{size}", size)))
        size *= 2
    whole, done = f"r{size}", size
    while done < window:
        size = 1 << ((window - done).bit_length() - 1)
        out.append((f"w{done + size}", _joined(whole, f"r{size}", done)))
        whole, done = f"w{done + size}", done + size
    return [*out, ("windows", F.col(whole))]


def _joined(first: str, then: str, size: int) -> Column:
    """Ranks of the runs of `first`, `size` tokens long, each with the run of `then` behind it."""
    return F.transform(first, lambda x, i: F.xxhash64(x, F.get(then, i + size)))


def _least_runs(runs: str, span: int) -> list[tuple[str, Column]]:
    """Columns, each from those before it, whose last holds the least of the `span` ranks from every place of `runs`."""
    least = lambda name, size: F.transform(name, lambda x, i: F.least(x, F.get(name, i + size)))
    out, name, size = [], runs, 1
    while 2 * size <= span:
        out.append((f"l{2 * size}", least(name, size)))
        name, size = f"l{2 * size}", 2 * size
    return [*out, ("least", least(name, span - size))]


def _sections(least: str, n: Column) -> list[tuple[str, Column]]:
    """Columns, the last an array<struct<key,start,length>>: neighbouring windows of one least run, for the first n places of `least`; key: that run and the project."""
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
    cut = F.transform("starts", lambda i, k: F.struct(F.xxhash64("project", F.get(least, i)).alias("key"), i.alias("start"), (F.coalesce(F.get("starts", k + 1), n) - i).alias("length")))
    return [("starts", F.when(n > 0, starts)), ("sections", cut)]


def _repeated(df: DataFrame, window: int) -> DataFrame:
    """project, file, start, run: the windows that can be in two places, by the sections they lie in. df: project, file, h, sections.

    Equal windows have the same least run. A section whose run is the least of no other section of the project has windows of
    its own, and if it is no longer than a window, no two of them lie a window apart: it holds no clone, nor does a match
    go on through it. So one row a section is counted, where a section has some twenty windows, and only the rest is read by windows.
    """
    counted = df.select(F.inline("sections")).groupBy("key").agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    keys = _bounded(counted.where((F.col("n") > 1) | (F.col("longest") > window)).select("key"), SECTION_KEYS)
    held = df.select("project", "file", "h", "sections")
    for name, ranks in _run_ranks(F.col("h"), window):
        held = held.withColumn(name, ranks)
    runs = F.transform("sections", lambda s: F.struct(s["key"].alias("key"), s["start"].alias("start"), F.slice("windows", s["start"] + 1, s["length"]).alias("run")))
    return settled(held.select("project", "file", F.inline(runs)).join(keys, "key", "left_semi").select("project", "file", "start", "run"))


def clone_lines(files: DataFrame, window: int = 50) -> DataFrame:
    """project, lines, cloned_lines, clone_ratio. files: project, file, tokens.

    Windows are known by ranks of token runs, see `_run_ranks`; only those that can be in two places are counted, see `_repeated`.
    Pairs are never formed for coverage: in a valid bucket every window is covered, but in a bucket of one file only those at least a window away from its first or last
    place. Where the next window is in too large a bucket, a match goes on through such windows as long as both agree: the
    ranks of the windows that follow, up to the next that is in no too large bucket, are compared among the few places of the valid bucket.
    """
    df = files.where(F.size("tokens") > 0).select("project", "file", F.transform("tokens", lambda t: F.xxhash64(t["tok"])).alias("h"), F.col("tokens.line").alias("line_of"))
    short = 1 << (max(window // 4, 1).bit_length() - 1)
    n_windows = F.greatest(F.size("h") - window + 1, F.lit(0))
    for name, column in [*_run_ranks(F.col("h"), short), *_least_runs("windows", window - short + 1), *_sections("least", n_windows)]:
        df = df.withColumn(name, column)
    df = settled(df.select("project", "file", "line_of", "h", "sections"))  # few different tokens: their hashes pack better than ranks of windows
    repeated = _repeated(df, window)
    places = repeated.select("project", "file", "start", F.posexplode("run").alias("k", "h")).select("project", "file", (F.col("start") + F.col("k")).alias("pos"), "h")
    # equal runs are counted together before their windows are
    alike = repeated.groupBy("project", "run").agg(F.count("*").alias("n"), F.min("file").alias("from"), F.max("file").alias("to"), F.min("start").alias("low"), F.max("start").alias("high"))
    alike = alike.select("project", "n", "from", "to", "low", "high", F.posexplode("run").alias("k", "h"))
    counted = alike.groupBy("project", "h").agg(F.sum("n").alias("n"), (F.min("from") == F.max("to")).alias("one_file"), F.min(F.col("low") + F.col("k")).alias("low"), F.max(F.col("high") + F.col("k")).alias("high"))
    buckets = settled(counted.where("n > 1"))
    valid = buckets.where((F.col("n") <= LARGEST_BUCKET) & (~F.col("one_file") | (F.col("high") - F.col("low") >= window)))
    large = buckets.where(F.col("n") > LARGEST_BUCKET).select("project", "h")
    # windows in large buckets are most of a hot key: those are taken off before the rest is shuffled
    n_large = large.count()
    seldom = places.join(F.broadcast(large), ["project", "h"], "left_anti") if 0 < n_large <= BROADCAST_ROWS else places
    hits = seldom.join(_bounded(valid), ["project", "h"]).where(~F.col("one_file") | (F.col("pos") - F.col("low") >= window) | (F.col("high") - F.col("pos") >= window))
    hits = settled(hits.select("project", "file", "pos", "h"))
    spans = hits.select("project", "file", "pos", F.lit(window).alias("length"))
    if n_large:
        spans = spans.unionByName(_beyond_borders(places, hits, large, n_large, window))
    # a file's spans meet its tokens once, as merged intervals
    merged = spans.groupBy("project", "file", "pos").agg(F.max("length").alias("length"))
    before = F.max(F.col("pos") + F.col("length")).over(Window.partitionBy("project", "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    fresh = merged.withColumn("from", F.greatest("pos", F.coalesce(before, F.lit(0)))).withColumn("to", F.col("pos") + F.col("length")).where("to > from")
    parts = fresh.groupBy("project", "file").agg(F.collect_list(F.struct("from", "to")).alias("parts"))  # apart from each other within a file
    lined = df.select("project", "file", "line_of").join(parts, ["project", "file"], "left")
    covered = F.size(F.array_distinct(F.flatten(F.transform("parts", lambda p: F.slice("line_of", p["from"] + 1, p["to"] - p["from"])))))
    out = lined.select("project", F.size(F.array_distinct("line_of")).alias("lines"), F.when(F.col("parts").isNotNull(), covered).otherwise(0).alias("covered"))
    out = out.groupBy("project").agg(F.sum("lines").alias("lines"), F.sum("covered").alias("cloned_lines"))
    return out.withColumn("clone_ratio", ratio(F.col("cloned_lines"), F.col("lines"), 0.0))


def _beyond_borders(places: DataFrame, hits: DataFrame, large: DataFrame, n_large: int, window: int) -> DataFrame:
    """project, file, pos, length of matches that go on from a hit into windows of large buckets."""
    inside = places.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, ["project", "h"], "left_semi")
    # neighbouring places are a stretch: their place less their number in the file stays the same
    stretch = F.col("pos") - F.row_number().over(Window.partitionBy("project", "file").orderBy("pos"))
    stretches = inside.withColumn("k", stretch).groupBy("project", "file", "k").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "h")))["h"].alias("run"))
    border = hits.join(stretches.withColumn("pos", F.col("first") - 1), ["project", "file", "pos"]).select("project", "h", F.struct("file", "pos", "run").alias("at"))
    groups = border.groupBy("project", "h").agg(F.collect_list("at").alias("ats")).where(F.size("ats") > 1)  # at most LARGEST_BUCKET

    def shared(a: Column, b: Column) -> Column:
        apart = (a["file"] != b["file"]) | (F.abs(a["pos"] - b["pos"]) >= window)
        same = F.zip_with(a["run"], b["run"], lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(same, False).cast("int")
        return F.when(apart, F.when(stop > 0, stop - 1).otherwise(F.size(same))).otherwise(0)

    # the windows that agree after the hit, with the partner that agrees longest
    longest = F.transform("ats", lambda a: F.struct(a["file"].alias("file"), a["pos"].alias("pos"), F.array_max(F.transform("ats", lambda b: shared(a, b))).alias("more")))
    return groups.select("project", F.inline(longest)).where("more > 0").select("project", "file", "pos", (F.col("more") + window).alias("length"))


_LAYER = r"\.(controller|service|repository|entity)\.[cm]?[jt]sx?$"


def _module(path: Column) -> Column:
    return F.regexp_extract(path, "^src/modules/([^/]+)/", 1)


def layer_violations(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges inside one module between layers that must not import each other."""
    layered = edges.withColumns({"from_layer": F.regexp_extract("src", _LAYER, 1), "to_layer": F.regexp_extract("dst", _LAYER, 1)})
    return layered.where(_module(F.col("src")) == _module(F.col("dst"))).join(F.broadcast(forbidden), ["from_layer", "to_layer"], "left_semi").drop("from_layer", "to_layer")


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("project", F.col(end).alias("node")).distinct()


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges left when those of nodes without a way in or without a way out are gone, until none goes, and their number."""
    n = edges.count()
    while n:
        into = edges.join(_ends(edges, "dst").withColumnRenamed("node", "src"), ["project", "src"], "left_semi")
        edges = settled(into.join(_ends(into, "src").withColumnRenamed("node", "dst"), ["project", "dst"], "left_semi").select("project", "src", "dst"))
        was, n = n, edges.count()
        if n == was:
            break
    return edges, n


def _colours(edges: DataFrame) -> DataFrame:
    """project, node, colour: the least node that reaches each node, spread along the edges until none changes."""
    nodes = settled(_ends(edges, "src").unionByName(_ends(edges, "dst")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = edges.join(nodes.withColumnRenamed("node", "src"), ["project", "src"]).groupBy("project", F.col("dst").alias("node")).agg(F.min("colour").alias("sent"))
        moved = nodes.join(sent, ["project", "node"], "left").select("project", "node", F.least("colour", "sent").alias("colour"), (F.coalesce("sent", "colour") < F.col("colour")).alias("moved"))
        moved = settled(moved)
        nodes = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return nodes


def _inside(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Edges with both ends among the nodes (left_semi), or neither (left_anti)."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("project", F.col("node").alias(end)), ["project", end], how)
    return edges.select("project", "src", "dst")


#: Projects of at most so many edges have their components found in one task each.
SMALL_PROJECT = 200_000


def cyclic_edges(edges: DataFrame, small: int = SMALL_PROJECT) -> DataFrame:
    """Distinct (project, src, dst) on a cycle: both ends in one strongly connected component, or a loop.

    Projects of at most `small` edges are dealt out by project, and each is one depth-first search. Larger ones go through joins and
    aggregates alone, so no task holds them, see `_cyclic_of_large`.
    """
    whole = settled(edges.select("project", "src", "dst").where("src is not null and dst is not null").distinct())
    sizes = settled(whole.groupBy("project").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > small).select("project")
    if large.isEmpty():
        return _cyclic_of_small(whole)
    of_large = whole.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "project", "left_semi")
    return _cyclic_of_large(of_large).unionByName(_cyclic_of_small(whole.join(sizes.where(F.col("n") <= small), "project", "left_semi")))


def _cyclic_of_small(edges: DataFrame) -> DataFrame:
    def search(rows):
        at, ends = np.unique(rows[["src", "dst"]].to_numpy(dtype=object).ravel(), return_inverse=True)
        src, dst = ends.reshape(-1, 2).T
        part = strong_components(len(at), src, dst)
        return rows[part[src] == part[dst]]

    return edges.where("project is not null").groupBy("project").applyInPandas(search, edges.schema)


def _cyclic_of_large(edges: DataFrame) -> DataFrame:
    """Cyclic edges of projects of any size: ways without a branch are contracted, what is left is coloured.

    Contraction follows pointers that double their reach, so a long way takes as many rounds as its length has binary digits.
    Ways forward and backward are contracted in turn while that takes away a tenth of the edges.
    """
    return edges.where("src = dst").unionByName(_contracted(edges.where("src <> dst"), 0))


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))


def _contracted(edges: DataFrame, idle: int) -> DataFrame:
    """Cyclic edges of a graph without loops; idle: how many contractions before took little away. The contracted graph goes on reversed.

    Nodes with one way out form chains. A chain that comes back to itself is a component, and nothing that
    leads into it is; a chain that ends at a node without a way out is on no cycle. Other chains are
    replaced by the node they end at: an edge into a chain is cyclic if its image is, and then so are the chain's edges from there on.
    """
    edges = settled(edges)
    n = edges.count()
    if not n:
        return edges
    if idle == 2:
        return _by_colours(edges)
    outs = edges.groupBy("project", F.col("src").alias("node")).agg(F.count("*").alias("ways"), F.min("dst").alias("to"))
    chain = settled(outs.where("ways = 1").select("project", "node", "to"))
    n_chain, hops, going = chain.count(), [chain], 0
    named = lambda df, a, b: df.select("project", F.col("node").alias(a), F.col("to").alias(b))
    while n_chain:
        on = hops[-1].join(named(hops[-1], "to", "then"), ["project", "to"], "left").select("project", "node", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved"))
        hops.append(settled(on))
        going = hops[-1].where("moved").count()
        if not going or 1 << (len(hops) - 1) >= n_chain:
            break
    ends = hops[-1].select("project", "node", F.col("to").alias("root"))
    rings = settled(hops[-1].select("project", F.col("to").alias("node")).distinct().join(chain, ["project", "node"], "left_semi")) if going else chain.select("project", "node").limit(0)
    found = chain.join(rings, ["project", "node"], "left_semi").select("project", F.col("node").alias("src"), F.col("to").alias("dst"))
    branching = outs.where("ways > 1").select("project", "node")
    ends = settled(ends.join(branching.withColumnRenamed("node", "root"), ["project", "root"], "left_semi"))
    # edges out of branching nodes, into branching nodes or chains that end at one
    image = ends.unionByName(branching.withColumn("root", F.col("node"))).select("project", F.col("node").alias("dst"), "root")
    kept = settled(edges.join(branching.withColumnRenamed("node", "src"), ["project", "src"], "left_semi").join(image, ["project", "dst"]))
    inner = kept.where("src <> root").select("project", "src", F.col("root").alias("dst")).distinct()
    inner = settled(inner)
    cyclic = _reversed(_contracted(_reversed(inner), idle + 1 if inner.count() > 0.9 * n else 0))
    through = settled(kept.where("src = root").unionByName(kept.join(cyclic.withColumnRenamed("dst", "root"), ["project", "src", "root"], "left_semi")))
    marked = settled(through.join(ends.select("project", F.col("node").alias("dst")), ["project", "dst"], "left_semi").select("project", F.col("dst").alias("node")).distinct())
    for hop in hops[:-1] if marked.limit(1).count() else []:
        reached = marked.join(hop.select("project", "node", "to"), ["project", "node"]).join(ends.select("project", F.col("node").alias("to")), ["project", "to"], "left_semi")
        marked = settled(marked.unionByName(reached.select("project", F.col("to").alias("node"))).distinct())
    along = chain.join(marked, ["project", "node"], "left_semi").select("project", F.col("node").alias("src"), F.col("to").alias("dst"))
    return found.unionByName(through.select("project", "src", "dst")).unionByName(along)


def _by_colours(left: DataFrame) -> DataFrame:
    """Cyclic edges of a graph without loops, by colours.

    What lies on no way from cycle to cycle is trimmed first. Then the least node that reaches a node is its
    colour; of the nodes of a colour, those that also reach the node it is named after are that
    node's component. Components are taken off and the rest goes round again. Rounds follow the longest
    way through the graph, not its size.
    """
    found = left.limit(0)
    while True:
        left, n = _trimmed(left)
        if not n:
            return found
        nodes = _colours(left)
        of = lambda end: nodes.select("project", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        same = settled(left.join(of("src"), ["project", "src"]).join(of("dst"), ["project", "dst"]).where("src_colour = dst_colour").select("project", "src", "dst"))
        back, size = settled(nodes.where("node = colour").select("project", "node")), 0
        while (now := back.count()) != size:
            size = now
            before = same.join(back.withColumnRenamed("node", "dst"), ["project", "dst"], "left_semi").select("project", F.col("src").alias("node"))
            back = settled(back.unionByName(before).distinct())
        found = found.unionByName(_inside(same, back, "left_semi"))
        left = settled(_inside(same, back, "left_anti"))


def dependency_density(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(layer violations + cyclic edges) / edges, 0 without edges; unresolved targets are dropped."""
    resolved = settled(edges.where("dst is not null").select("project", "src", "dst").distinct())  # read by every count below
    count = lambda df, name: df.groupBy("project").agg(F.count("*").alias(name))
    out = count(resolved, "edges").join(count(layer_violations(resolved, forbidden), "violations"), "project", "left").join(count(cyclic_edges(resolved), "cyclic"), "project", "left").fillna(0)
    return out.withColumn("density", ratio(F.col("violations") + F.col("cyclic"), F.col("edges"), 0.0))


def deep_imports(edges: DataFrame, rule: str, pattern: str = "^src/modules?/([^/]+)/") -> DataFrame:
    """Edges tagged with a rule, counted by the module they come from and go to."""
    module = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit("<unknown>"))
    hit = edges.where(F.col("dst").isNotNull() & F.array_contains("rules", rule))
    ends = F.array(F.struct(F.lit("from").alias("direction"), module("src").alias("module")), F.struct(F.lit("to").alias("direction"), module("dst").alias("module")))
    return hit.select("project", F.inline(ends)).groupBy("project", "direction", "module").agg(F.count("*").alias("imports"))


def distinct_cycles(cycles: DataFrame, members: str = "members") -> DataFrame:
    """One row by set of members."""
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(members, lambda m: m.isNotNull()))), "|")
    return cycles.select("project", key.alias("cycle")).distinct()


def weighted_density(findings: DataFrame, service_files: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted findings of the listed rules by service file; at least one file is assumed."""
    sums = findings.join(F.broadcast(weights), "rule_id").groupBy("evaluation_id").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    return service_files.join(sums, "evaluation_id", "left").select("evaluation_id", F.round(F.coalesce("w", F.lit(0.0)) / F.greatest("files", F.lit(1)), 6).alias("value"))


def endpoint_misses(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Call sites whose path no route has, by project; null without call sites."""
    known = routes.select("path").distinct().withColumn("known", F.lit(True))
    return calls.join(known, "path", "left").groupBy("project").agg(F.count("path").alias("calls"), F.count_if(F.col("path").isNotNull() & F.col("known").isNull()).alias("missed")).withColumn("miss_ratio", ratio(F.col("missed"), F.col("calls"), None))


def contract_checks(evidence: DataFrame, contract: DataFrame) -> DataFrame:
    """id, endpoint, kind, key, problem. evidence: id, endpoint, kind (query or body), key, value, value_type.

    Endpoints without contract are skipped. An optional body field that is null is fine as it is.
    """
    endpoints = contract.select("endpoint").distinct()
    rows = evidence.join(F.broadcast(endpoints), "endpoint", "left_semi").join(F.broadcast(contract), ["endpoint", "kind", "key"], "left")
    null, body = F.col("value_type") == "null", F.col("kind") == "body"
    wrong_type = ~null & F.col("value_type").isNotNull() & (F.col("value_type") != F.col("type"))
    outside = ~null & F.col("enum").isNotNull() & ~F.array_contains(F.coalesce("enum", F.array().cast("array<string>")), F.coalesce("value", F.lit("")))
    problems = F.when(F.col("type").isNull(), F.array(F.lit("undeclared"))).when(body & ~F.col("required") & null, F.array().cast("array<string>")).otherwise(
        F.filter(F.array(F.when(body & F.col("required") & null, "required_null"), F.when(wrong_type, "type"), F.when(outside, "enum")), lambda p: p.isNotNull()))
    return rows.select("id", "endpoint", "kind", "key", F.explode(problems).alias("problem"))


def param_mismatches(calls: DataFrame, contract: DataFrame) -> DataFrame:
    """Calls with another number of path parameters than the endpoint has."""
    return calls.join(F.broadcast(contract), "endpoint").where(F.col("params") != F.col("wanted")).select("id", "endpoint", "params", "wanted")


def drift_density(problems: DataFrame, positions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted problems by contract position (weight 1 unless listed); null without positions."""
    w = problems.join(F.broadcast(weights), "kind", "left").groupBy("project").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    out = positions.join(w, "project", "left")
    return out.select("project", F.round(F.try_divide(F.coalesce("w", F.lit(0.0)), F.col("positions").cast("double")), 6).alias("density"))


def propagation(changed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counterpart slots and missing ones by project and resource.

    changed: project, resource, surface (controller, dto, adapter, ui, test, route). A changed route
    file counts as a change of every resource's front end. inventory: resource, has_frontend, has_backend.
    """
    has = lambda s: F.bool_or(F.col("surface").isin(*s))
    routed = changed.groupBy("project").agg(has(["route"]).alias("routed"))
    by = changed.where("resource is not null").groupBy("project", "resource").agg(has(["controller", "dto"]).alias("backend"), has(["adapter"]).alias("adapter"), has(["ui"]).alias("ui"))
    rows = by.join(routed, "project").join(F.broadcast(inventory), "resource", "left").where("backend or adapter")
    front, back = F.col("backend") & F.coalesce("has_frontend", F.lit(False)), F.col("adapter") & F.coalesce("has_backend", F.lit(False))
    n = lambda c: c.cast("int")
    return rows.select("project", "resource", (n(front) + n(back)).alias("slots"), (n(front & ~(F.col("adapter") | F.col("ui") | F.col("routed"))) + n(back & ~F.col("backend"))).alias("missing"))


def propagation_incompleteness(slots: DataFrame) -> DataFrame:
    return slots.groupBy("project").agg(F.sum("missing").alias("missing"), F.sum("slots").alias("slots")).withColumn("incompleteness", ratio(F.col("missing"), F.col("slots"), None))


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed or modified columns; both sides: project, table_name, column_name, signature (null: not there)."""
    keys = ["project", "table_name", "column_name"]
    both = before.withColumnRenamed("signature", "old").join(after.withColumnRenamed("signature", "new"), keys, "full")
    kind = F.when(F.col("old").isNull() & F.col("new").isNull(), None).when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select(*keys, kind.alias("change")).where("change is not null")


#: Texts are cut into pieces of so many characters; names are looked up by their rarest piece of so many; tables up to so many rows are broadcast.
CHUNK, GRAM, BROADCAST_ROWS = 512, 3, 200_000


def occurrences(texts: DataFrame, words: DataFrame) -> DataFrame:
    """id, word: which words of its project a text contains, anywhere. texts: project, id, text; words: project, word.

    An inverted index: texts are cut into chunks that overlap by the longest word, chunks are known by
    their grams, and each word by the one of its grams that fewest chunks have. Words whose rarest gram a chunk
    has are looked for in that chunk. Work follows the texts' length, and what is found, not texts by words. The
    empty word is in every text.
    """
    words = settled(words.where("project is not null and word is not null").distinct())
    longest, sizes = words.agg(F.max(F.length("word")), F.collect_set(F.least(F.length("word"), F.lit(GRAM)))).first()  # sizes: 0 to GRAM
    sizes = [n for n in sizes if n]
    everywhere = texts.join(words.where("word = ''"), "project").select("id", "word") if words.where("word = ''").limit(1).count() else None
    if not sizes:
        return texts.select("id", F.lit("").alias("word")).limit(0) if everywhere is None else everywhere
    cut = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{CHUNK + longest}}})).{{1,{CHUNK}}}"), F.lit(1))
    chunks = settled(settled(texts.select("project", "id", F.explode(cut).alias("chunk"))).withColumn("at", F.monotonically_increasing_id()))
    of_size = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    grams = chunks.select("project", "at", F.explode(F.array_distinct(F.flatten(F.array(*[of_size(F.col("chunk"), F.lit(n)) for n in sizes])))).alias("gram"))
    parts = words.where("word <> ''").select("project", "word", F.explode(F.array_distinct(of_size(F.col("word"), F.least(F.length("word"), F.lit(GRAM))))).alias("gram"))
    asked = _bounded(parts.select("project", "gram").distinct())
    held = grams.join(asked, ["project", "gram"], "left_semi").groupBy("project", "gram").agg(F.count("*").alias("n"))
    rarest = parts.join(held, ["project", "gram"], "left").groupBy("project", "word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    met = grams.join(_bounded(rarest.where("all").drop("all")), ["project", "gram"]).select("at", "word")
    found = met.join(chunks, "at").where(F.contains("chunk", "word")).select("id", "word").distinct()
    return found if everywhere is None else found.unionByName(everywhere)


def _bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows, or BROADCAST_ROWS; more are shuffled."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= (rows or BROADCAST_ROWS) else df


def uncovered_changes(changes: DataFrame, migrations: DataFrame) -> DataFrame:
    """Changes that no executable migration of the project names, table and column, both up and down.

    Names are looked for in plain text, letters and digits only. A name's migrations are those that hold the
    rarer of its two words, which must hold the other word as well, both up and down.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = settled(changes.select("project", "table_name", "column_name", plain("table_name").alias("t"), plain("column_name").alias("c")).distinct())
    m = settled(migrations.where("executable").select("project", plain("up").alias("up"), plain("down").alias("down")))
    m = settled(m.withColumn("id", F.monotonically_increasing_id()))
    words = names.select("project", F.explode(F.array("t", "c")).alias("word"))
    texts = m.select("project", F.inline(F.array(*[F.struct((2 * F.col("id") + i).alias("id"), F.col(side).alias("text")) for i, side in enumerate(("up", "down"))]))).where("text is not null")
    found = occurrences(texts, words).groupBy(F.shiftright("id", 1).alias("id"), "word").agg(F.count("*").alias("ways")).where("ways = 2")
    both = settled(found.join(m.select("id", "project"), "id").select("id", "word", "project"))  # up and down
    often = both.groupBy("project", "word").agg(F.count("*").alias("n"))
    counted = lambda c: often.select("project", F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    keyed = names.join(counted("t"), ["project", "t"]).join(counted("c"), ["project", "c"])
    first = F.col("n_t") <= F.col("n_c")
    keyed = keyed.select("project", "table_name", "column_name", F.when(first, F.col("t")).otherwise(F.col("c")).alias("word"), F.when(first, F.col("c")).otherwise(F.col("t")).alias("other"))
    covered = both.join(keyed, ["project", "word"]).join(both.select("id", F.col("word").alias("other")), ["id", "other"], "left_semi")
    return changes.join(covered.select("project", "table_name", "column_name").distinct(), ["project", "table_name", "column_name"], "left_anti")


def module_composition(files: DataFrame) -> DataFrame:
    """Missing layers by module; files: project, module, layer."""
    got = files.groupBy("project", "module").agg(F.collect_set("layer").alias("layers"))
    need = F.when(F.col("module").rlike("(?:-link|-relation)$"), F.array(F.lit("controller"), F.lit("service"))).when(F.array_contains("layers", "entity"), F.array(F.lit("controller"), F.lit("service"), F.lit("repository"))).otherwise(F.array(F.lit("service")))
    return got.select("project", "module", F.array_join(F.array_except(need, "layers"), ",").alias("missing"))


def incomplete_share(modules: DataFrame) -> DataFrame:
    return modules.groupBy("project").agg(F.count("*").alias("modules"), F.count_if(F.col("missing") != "").alias("incomplete")).withColumn("share", ratio(F.col("incomplete"), F.col("modules"), 0.0))


def _later_elsewhere(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in another file than the first of their group; the first comes from an aggregate, not a sorted window."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, "file")).alias("first")).select(*keys, F.col("first.file").alias("first_file"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    return rows.alias("r").join(first.alias("f"), on).where("r.file <> first_file").select("r.*", "first_file")


def duplicate_owners(owners: DataFrame) -> DataFrame:
    """owners: kind, resource, version, file, seq."""
    return _later_elsewhere(owners, ["kind", "resource", "version"], ["seq"])


def equivalent_bodies(bodies: DataFrame, least: int = 24) -> DataFrame:
    """bodies: name, body, file, seq, policy. Policies go by name and body, others by body; short others are skipped."""
    flat = F.regexp_replace("body", r"\s+", "")
    rows = bodies.where(F.col("policy") | (F.length(flat) >= least)).withColumn("key", F.sha2(F.concat_ws(":", F.when(F.col("policy"), F.lower("name")), flat), 256))
    return _later_elsewhere(rows, ["key"], ["seq"])


def share_over_limit(rows: DataFrame, value: str, limit: float) -> DataFrame:
    return rows.groupBy("project").agg(F.count("*").alias("n"), F.count_if(F.col(value) > limit).alias("over")).withColumn("share", ratio(F.col("over"), F.col("n"), 0.0, 4))


def coverage(rows: DataFrame) -> DataFrame:
    """covered / total; nothing to cover is full coverage."""
    return rows.groupBy("project").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).withColumn("coverage", ratio(F.col("covered"), F.col("total"), 1.0))


def route_violations(endpoints: DataFrame) -> DataFrame:
    """endpoints: project, prefixed (the project's global prefix is set), violates. Without the prefix all violate."""
    return endpoints.groupBy("project").agg(F.count("*").alias("endpoints"), F.count_if(~F.col("prefixed") | F.col("violates")).alias("violating")).withColumn("ratio", ratio(F.col("violating"), F.col("endpoints"), 0.0))


def per_case(rows: DataFrame) -> DataFrame:
    """mocks / test cases; null without cases."""
    return rows.groupBy("project").agg(F.sum("mocks").alias("mocks"), F.sum("cases").alias("cases")).withColumn("per_case", ratio(F.col("mocks"), F.col("cases"), None))


def depth_stats(rows: DataFrame, limit: int = 3) -> DataFrame:
    """Mean, largest and nearest-rank 90th percentile of depth, and how many are over the limit."""
    return rows.groupBy("project").agg(F.round(F.avg("depth"), 2).alias("mean_depth"), F.max("depth").alias("max_depth"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY depth)").alias("p90_depth"), F.count_if(F.col("depth") > limit).alias("over_limit"))


def provider_ratio(rows: DataFrame) -> DataFrame:
    """Shares of local and context state."""
    out = rows.groupBy("project").agg(F.sum("local").alias("l"), F.sum("context").alias("c"))
    return out.select("project", ratio(F.col("l"), F.col("l") + F.col("c"), 0.0).alias("local_share"), ratio(F.col("c"), F.col("l") + F.col("c"), 0.0).alias("context_share"))


def mixed_signals(rows: DataFrame) -> DataFrame:
    """Share of files with more than one style signal; least and greatest signal tell, so no distinct count is needed."""
    per = rows.groupBy("project", "file").agg((F.min("signal") != F.max("signal")).alias("mixed"))
    return per.groupBy("project").agg(F.count("*").alias("files"), F.count_if("mixed").alias("mixed")).withColumn("ratio", ratio(F.col("mixed"), F.col("files"), 0.0))


def approved_calls(calls: DataFrame, patterns: list[str]) -> DataFrame:
    ok = F.lit(False)
    for p in patterns:
        ok |= F.col("path").rlike(p)
    return calls.groupBy("project").agg(F.count("*").alias("calls"), F.count_if(ok).alias("approved")).withColumn("ratio", ratio(F.col("approved"), F.col("calls"), 1.0))


def fanout(elements: DataFrame, least: int = 4) -> DataFrame:
    """Mean number of props of elements with at least four, 0 if there is none."""
    return elements.groupBy("project").agg(F.round(F.coalesce(F.avg(F.when(F.col("props") >= least, F.col("props"))), F.lit(0.0)), 6).alias("fanout"))


def route_params(routes: DataFrame) -> DataFrame:
    return routes.groupBy("project").agg(F.round(F.avg(F.size(F.regexp_extract_all("path", F.lit("/:[^/]+"), F.lit(0)))), 6).alias("params"))


def baseline_delta(target: DataFrame, base: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """target minus baseline value; null without a baseline."""
    return target.join(base.withColumnRenamed("value", "baseline"), keys, "left").select(*keys, F.round(F.col("value") - F.col("baseline"), digits).alias("delta"))
