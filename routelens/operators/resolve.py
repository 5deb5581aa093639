"""Type index, reference resolution and schema-graph operators.

Graph work is a bulk-synchronous frontier loop: each round is one join of the
frontier with the edge table and one anti join with the visited set, both
keyed by ``(repo_id, node)``. Each round is checkpointed into the shared
checkpoint folder (lineage stays flat, a lost executor re-reads one round) and
the loop stops on an ``isEmpty`` test or the round bound. Nothing is
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.session import cut_lineage, drop_stages, spread, write_stage

REF_TARGET_RE = r'"\$ref"\s*:\s*"#/components/schemas/([^"]+)"'


def typedef_scan(lines: DataFrame, rules) -> DataFrame:
    """Definitions found by rule regexes over source lines.

    ``rules(rule_ord, regex, kind)``: group 1 = name, group 2 = comma list of
    parents (may be empty); a line takes its first matching rule. A literal
    rule list is compiled into one projection (regexes compiled once per
    task); a rule DataFrame is broadcast and theta-joined.
    Output ``type_defs(repo_id, name, path, line, kind, inherits)``.
    """
    if isinstance(rules, DataFrame):
        r = F.broadcast(rules)
        j = lines.join(r, F.regexp_like(lines["line"], r["regex"]))
        j = j.select("repo_id", "path", F.col("line_no").alias("line"), "kind", "rule_ord",
                     F.expr("regexp_extract(line, regex, 1)").alias("name"),
                     F.expr("regexp_extract(line, regex, 2)").alias("inherits"))
        first = j.groupBy("repo_id", "path", "line").agg(F.min_by(F.struct("name", "kind", "inherits"), "rule_ord").alias("d"))
        return first.select("repo_id", "d.name", "path", "line", "d.kind", "d.inherits")
    rules = sorted(rules, key=lambda r: r[0])
    pick = F.coalesce(*[F.when(F.col("line").rlike(rx), F.struct(
        F.regexp_extract("line", rx, 1).alias("name"), F.lit(kind).alias("kind"),
        F.regexp_extract("line", rx, 2).alias("inherits"))) for _, rx, kind in rules])
    d = lines.select("repo_id", "path", F.col("line_no").alias("line"), pick.alias("d")).where(F.col("d").isNotNull())
    return d.select("repo_id", "d.name", "path", "line", "d.kind", "d.inherits")


def inheritance_edges(type_defs: DataFrame) -> DataFrame:
    """``parent -> child`` edges from the comma-separated ``inherits`` column."""
    e = type_defs.select("repo_id", F.col("name").alias("child"),
                         F.explode(F.split(F.coalesce("inherits", F.lit("")), ",")).alias("parent"))
    return e.select("repo_id", F.trim("parent").alias("parent"), "child").where(F.col("parent") != "")


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None,
            src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes reachable from ``seeds(repo_id, node)`` with their first round.

    Frontier iteration with a visited anti join (cycles terminate). The visited
    set carries its round number, so the frontier is a filter on the one table
    that is checkpointed per round. Runs to the fixpoint (G11, G14); ``depth`` tells how
    far a node lies, a caller may bound the rounds with ``max_rounds``.
    """
    # the edge list is materialised once; every round probes it instead of re-deriving it.  It is a table before it is dealt:
    # its size tells over how many tasks, and a literal repo_id is a column there, so the distinct keeps the dealing
    e = write_stage(edges.select("repo_id", F.col(src).alias("node"), F.col(dst).alias("nxt")), "closure-edges")
    rows = e.count()
    e = cut_lineage(spread(e, "repo_id", "node", rows=rows).distinct())
    visited = cut_lineage(seeds.select("repo_id", "node").distinct().withColumn("depth", F.lit(0)))
    d = 0
    while max_rounds is None or d < max_rounds:
        frontier = visited.where(F.col("depth") == d).select("repo_id", "node")
        nxt = (frontier.join(spread(e, "repo_id", "node", rows=rows), ["repo_id", "node"]).select("repo_id", F.col("nxt").alias("node")).distinct()
               .join(visited.select("repo_id", "node"), ["repo_id", "node"], "left_anti"))
        d += 1
        visited = cut_lineage(visited.unionByName(nxt.withColumn("depth", F.lit(d))))
        if visited.where(F.col("depth") == d).isEmpty():
            break
    return visited


def schema_refs(json_col: Column) -> Column:
    """Every ``$ref`` target in a JSON text."""
    return F.regexp_extract_all(json_col, F.lit(REF_TARGET_RE), 1)


def name_collision(resolved: DataFrame) -> DataFrame:
    """Names that resolve to more than one distinct file in a repository."""
    return (resolved.groupBy("repo_id", "name").agg(F.count_distinct("path").alias("n_files"))
            .where(F.col("n_files") > 1))


def qualified_names(defs: DataFrame) -> DataFrame:
    """For colliding names, the smallest parent-directory depth at which the
    directory components of all files differ -> ``{component}_{name}``; else the
    full path (slashes -> ``_``). One component per depth, as the original does.
    """
    coll = name_collision(defs).select("repo_id", "name")
    d = defs.join(coll, ["repo_id", "name"], "left_semi").select("repo_id", "name", "path").distinct()
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    d = d.withColumn("dirs", dirs)
    x = d.select("repo_id", "name", "path", F.posexplode(F.reverse("dirs")).alias("pos", "comp"))
    x = x.withColumn("depth", F.col("pos") + 1)
    n = d.groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n_files"))
    per = (x.groupBy("repo_id", "name", "depth").agg(F.count_distinct("comp").alias("n_comp"), F.count(F.lit(1)).alias("n"))
           .join(n, ["repo_id", "name"]).where((F.col("n_comp") == F.col("n_files")) & (F.col("n") == F.col("n_files"))))
    best = per.groupBy("repo_id", "name").agg(F.min("depth").alias("depth"))
    q = d.join(best, ["repo_id", "name"], "left").join(x.select("repo_id", "name", "path", "depth", "comp"),
                                                       ["repo_id", "name", "path", "depth"], "left")
    full = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), "/", "_")
    return q.select("repo_id", "name", "path", F.col("depth"),
                    F.when(F.col("comp").isNotNull(), F.concat_ws("_", "comp", "name")).otherwise(full).alias("qualified"))


def resolve_indexed(refs: DataFrame, type_defs: DataFrame) -> DataFrame:
    """Ref ``(repo_id, ref_id, name, fragment)`` -> one definition file.

    ``type_defs(repo_id, name, path, line[, scope])``. A dotted ``Outer.Inner`` looks for ``Inner``
    first where the scope ends with ``Outer`` (rank 0), then in files named like ``Outer`` (rank 1),
    then for the whole name (rank 2, as for plain names). Within the best rank a single candidate
    wins; of several the first whose path holds the import fragment (not in rank 1), else in rank 2
    the best stem score (2 equal, 1 the stem contains the name), first (path, line) on ties.
    The choice depends only on ``(name, fragment)``, so it is made once per distinct key (dedup
    before the candidate join) and joined back to the refs.  Definitions of a name that lie in one file and scope
    are told apart by their line only: the candidate is the first of them, with their number.
    """
    outer = F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", ""))
    leaf = F.regexp_extract("name", r"([^.]*)$", 1)
    keys = refs.select("repo_id", "name", "fragment").distinct().withColumn("outer", outer)
    keys = keys.withColumn("lookup", F.explode(F.array_distinct(F.array("name", leaf))))
    scope = F.col("scope") if "scope" in type_defs.columns else F.lit(None).cast("string")
    defs = type_defs.select("repo_id", F.col("name").alias("lookup"), "path", "line", scope.alias("scope"),
                            F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).alias("stem"))
    defs = defs.groupBy("repo_id", "lookup", "path", "scope", "stem").agg(  # a null line is the first
        F.when(F.count("line") == F.count(F.lit(1)), F.min("line")).alias("line"), F.count(F.lit(1)).alias("n"))
    c = keys.join(defs, ["repo_id", "lookup"])
    rank = (F.when(F.col("lookup") == F.col("name"), 2).when(F.col("scope").endswith(F.col("outer")), 0)
            .when(F.col("stem") == F.lower("outer"), 1))
    c = c.withColumn("rank", rank).where(F.col("rank").isNotNull())
    frag_hit = F.col("fragment").isNotNull() & (F.col("fragment") != "") & F.col("path").contains(F.col("fragment"))
    ln = F.lower("name")
    score = F.when(F.col("rank") != 2, 0).when(F.col("stem") == ln, 2).when(F.col("stem").contains(ln), 1).otherwise(0)
    c = c.withColumn("tier", F.when(frag_hit & (F.col("rank") != 1), 0).otherwise(1)).withColumn("score", score)
    key = F.struct("rank", "tier", (-F.col("score")).alias("neg_score"), "path", "line")
    best = c.groupBy("repo_id", "name", "fragment").agg(
        F.min_by(F.struct("path", "line", "tier", "rank"), key).alias("w"),
        *[F.sum(F.when(F.col("rank") == r, F.col("n"))).alias(f"n{r}") for r in range(3)])
    n = F.when(F.col("w.rank") == 0, F.col("n0")).when(F.col("w.rank") == 1, F.col("n1")).otherwise(F.col("n2"))
    best = best.select(F.col("repo_id").alias("b_repo"), F.col("name").alias("b_name"), F.col("fragment").alias("b_frag"),
                       "w", n.alias("n_candidates"))
    j = refs.join(best, (F.col("repo_id") == F.col("b_repo")) & (F.col("name") == F.col("b_name"))
                  & F.col("fragment").eqNullSafe(F.col("b_frag")))
    return j.select("repo_id", "ref_id", "name", "w.path", "w.line", "n_candidates",
                    F.when(F.col("n_candidates") == 1, "single").when(F.col("w.tier") == 0, "import")
                    .when(F.col("w.rank") == 0, "scope").otherwise("stem").alias("how"))


def dotted_alias(resolved: DataFrame) -> DataFrame:
    """Every resolved dotted request with the leaf schema it stands for and its file."""
    return resolved.where(F.col("name").contains(".")).select(
        "ref_id", F.col("name").alias("dotted"), F.regexp_extract("name", r"([^.]*)$", 1).alias("leaf"), "path")


def case_alias(requested: DataFrame, extracted: DataFrame) -> DataFrame:
    """Requested names that differ only by letter case from an extracted schema."""
    r = requested.select("repo_id", F.col("name").alias("requested"), F.lower("name").alias("k"))
    e = extracted.select("repo_id", F.col("name").alias("schema"), F.lower("name").alias("k"))
    j = r.join(e, ["repo_id", "k"]).where(F.col("requested") != F.col("schema"))
    exact = extracted.select("repo_id", F.col("name").alias("requested"))
    return j.join(exact, ["repo_id", "requested"], "left_anti").groupBy("repo_id", "requested").agg(
        F.min("schema").alias("schema"))


def remove_unused(schemas: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """one pass - a schema stays if any ref (from paths or any schema, itself
    included) names it. Returns ``(kept, dropped)``."""
    r = refs.select("repo_id", F.col("dst").alias("name")).distinct()
    return schemas.join(r, ["repo_id", "name"], "left_semi"), schemas.join(r, ["repo_id", "name"], "left_anti")


def dangling_refs(path_refs: DataFrame, schemas: DataFrame) -> DataFrame:
    """refs under paths whose target schema is missing (each gets an unresolved stub)."""
    return (path_refs.select("repo_id", F.col("dst").alias("name")).distinct()
            .join(schemas.select("repo_id", "name"), ["repo_id", "name"], "left_anti"))


# ------------------------------------------------------------ F10 cycle cutting

def _labelled(e: DataFrame, rows: int, key: str, labels: DataFrame, name: str, of: str) -> DataFrame:
    """``e`` with the label ``of`` that ``labels(repo_id, node, ...)`` gives the node in column ``key``; null where it gives none.

    The labels of a task's share are hashed, so the links, which are many more, are dealt but not sorted.
    """
    at = labels.select("repo_id", F.col("node").alias(key), F.col(of).alias(name))
    return spread(e, "repo_id", key, rows=rows).join(at.hint("shuffle_hash"), ["repo_id", key], "left")


def _mutual_groups(e: DataFrame, rows: int) -> DataFrame | None:
    """(repo_id, node, rep): nodes that refer to each other, directly or through such pairs, and the largest name of their group.

    Every round takes the largest label of the neighbours and then that node's own label, until no label changes.
    """
    up, down = F.col("src") < F.col("dst"), F.col("src") > F.col("dst")
    met = e.where(up | down).select("repo_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), up.alias("up"))
    met = spread(met, "repo_id", "a", "b", rows=rows).groupBy("repo_id", "a", "b").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down"))
    met = write_stage(met.where("up and down").select("repo_id", "a", "b"), "mutual")
    pairs = met.select("repo_id", F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
        met.select("repo_id", F.col("b").alias("node"), F.col("a").alias("near")))
    n = 2 * met.count()
    if not n:
        return None
    labels = write_stage(pairs.groupBy("repo_id", "node").agg(F.max("near").alias("m")).select(
        "repo_id", "node", F.greatest("node", "m").alias("rep"), F.lit(True).alias("chg")), "labels")
    while True:
        far = labels.select("repo_id", F.col("node").alias("rep"), F.col("rep").alias("far"))
        jump = labels.join(far, ["repo_id", "rep"]).select("repo_id", "node", "rep", "far")
        push = _labelled(pairs, n, "near", jump, "m", "far").groupBy("repo_id", "node").agg(F.max("m").alias("m"))
        nxt = jump.join(push, ["repo_id", "node"]).select(
            "repo_id", "node", F.greatest("far", "m").alias("rep"), (F.greatest("far", "m") > F.col("rep")).alias("chg"))
        nxt = write_stage(nxt, "labels")
        drop_stages(labels)
        labels = nxt
        if labels.where("chg").isEmpty():
            drop_stages(met)
            return labels.select("repo_id", "node", "rep")


def _cycle_groups(e: DataFrame) -> list[DataFrame]:
    """Tables (repo_id, node, scc) that hold every node on a cycle of ``e(repo_id, src, dst)``, a stage without self references.

    Forward-backward colouring: (1) trim nodes without an active in- or
    out-edge; (2) propagate the largest node name
    forward along active edges until it stops changing (the colour); (3) from
    every node that kept its own name, search backwards inside its colour - the
    nodes reached form its component; remove them and repeat. Every round is a
    keyed join plus an aggregation, written as a table in place of the round before; nothing is grouped per component.
    """
    done = []
    left = e.count()
    while left:  # every round settles at least one component
        while True:  # trimming
            both = e.select("repo_id", F.col("src").alias("node")).distinct().join(
                e.select("repo_id", F.col("dst").alias("node")).distinct(), ["repo_id", "node"], "left_semi")
            active = write_stage(both, "active")
            kept = write_stage(e.join(active.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_semi")
                               .join(active.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_semi"), "links")
            n = kept.count()
            drop_stages(e)
            e = kept
            if n == left:
                break
            drop_stages(active)
            left = n
        if not left:
            break
        color = write_stage(active.withColumn("c", F.col("node")), "color")
        while True:  # forward max colour
            push = (e.join(color.withColumnRenamed("node", "src"), ["repo_id", "src"])
                    .groupBy("repo_id", F.col("dst").alias("node")).agg(F.max("c").alias("m")))
            nxt = color.join(push, ["repo_id", "node"], "left").select(
                "repo_id", "node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("chg"))
            nxt = write_stage(nxt, "color")
            drop_stages(color)
            color = nxt.select("repo_id", "node", "c")
            if nxt.where("chg").isEmpty():
                break
        cs = color.withColumnRenamed("node", "src").withColumnRenamed("c", "cs")
        cd = color.withColumnRenamed("node", "dst").withColumnRenamed("c", "cd")
        inside = write_stage(e.join(cs, ["repo_id", "src"]).join(cd, ["repo_id", "dst"]).where(F.col("cs") == F.col("cd"))
                             .select("repo_id", "src", "dst", F.col("cs").alias("c")), "inside")
        frontier = write_stage(color.where(F.col("node") == F.col("c")).select("repo_id", "node", "c"), "component")
        comp, found = frontier, [frontier]
        while True:  # backward search inside the colour
            back = (inside.join(frontier.select("repo_id", F.col("node").alias("dst"), "c"), ["repo_id", "dst", "c"])
                    .select("repo_id", F.col("src").alias("node"), "c").distinct()
                    .join(comp.select("repo_id", "node"), ["repo_id", "node"], "left_anti"))
            frontier = write_stage(back, "component")
            if frontier.isEmpty():
                break
            found.append(frontier)
            comp = comp.unionByName(frontier)
        done.append(write_stage(comp.select("repo_id", "node", F.col("c").alias("scc")), "component"))
        gone = done[-1].select("repo_id", "node")
        rest = write_stage(e.join(gone.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti")
                           .join(gone.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti"), "links")
        drop_stages(e, active, color, inside, *found)
        e, left = rest, rest.count()
    return done


def _grouped_links(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Links ``edges(repo_id, src, dst, ...)`` with ``c1`` and ``c2``, the groups of their ends; the names of the groups of
    mutual references (repo_id, node, rep); the groups that lie on a cycle of groups (repo_id, node, scc).

    Nodes that refer to each other are one component: they are contracted first, and only the links between groups,
    mostly few, go through the rounds of ``_cycle_groups``.
    """
    e = write_stage(edges, "links")
    rows = e.count()
    reps = _mutual_groups(e.select("repo_id", "src", "dst"), rows)
    if reps is None:
        linked = e.withColumns({"c1": F.col("src"), "c2": F.col("dst")})
    else:
        half = write_stage(_labelled(e, rows, "src", reps, "c1", "rep").withColumn("c1", F.coalesce("c1", "src")), "links")
        drop_stages(e)
        linked = write_stage(_labelled(half, rows, "dst", reps, "c2", "rep").withColumn("c2", F.coalesce("c2", "dst")), "links")
        drop_stages(half)
    between = write_stage(linked.where("c1 <> c2").select("repo_id", F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct(), "between")
    cycles = None
    for part in _cycle_groups(between):
        cycles = part if cycles is None else cycles.unionByName(part)
    return linked, reps, cycles


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Strongly connected components ``(repo_id, node, scc)`` with DataFrame rounds only; ``scc`` is the largest name of the component.

    Groups of mutual references are components of their own or parts of one that runs through several groups.
    """
    linked, reps, cycles = _grouped_links(edges.select("repo_id", "src", "dst"))
    nodes = linked.select("repo_id", F.col("src").alias("node")).unionByName(linked.select("repo_id", F.col("dst").alias("node"))).distinct()
    scc = F.col("node")
    if reps is not None:
        nodes, scc = nodes.join(reps, ["repo_id", "node"], "left"), F.coalesce("rep", "node")
    nodes = nodes.select("repo_id", "node", scc.alias("rep"))
    if cycles is None:
        return nodes.withColumnRenamed("rep", "scc")
    return nodes.join(cycles.withColumnRenamed("node", "rep"), ["repo_id", "rep"], "left").select(
        "repo_id", "node", F.coalesce("scc", "rep").alias("scc"))


def _links_inside(edges: DataFrame) -> DataFrame:
    """The links whose ends are in one component, from a stage."""
    linked, _, cycles = _grouped_links(edges.where("repo_id is not null and src is not null and dst is not null"))
    inside = linked.where("c1 = c2").drop("c1", "c2")
    if cycles is not None:
        k1 = cycles.select("repo_id", F.col("node").alias("c1"), F.col("scc").alias("k1"))
        k2 = cycles.select("repo_id", F.col("node").alias("c2"), F.col("scc").alias("k2"))
        more = linked.where("c1 <> c2").join(k1, ["repo_id", "c1"]).join(k2, ["repo_id", "c2"]).where("k1 = k2")
        inside = write_stage(inside.unionByName(more.drop("c1", "c2", "k1", "k2")), "inside")
        drop_stages(linked)
    return inside


def break_ref_cycles(edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """edges to cut so that the reference graph becomes acyclic.

    Only edges inside a strongly connected component (and self references) can
    lie on a cycle, so every other edge is left untouched. Inside a component
    the nodes get a total order - larger (out-degree - in-degree) first, the
    greedy feedback-arc-set order; on ties nodes without an outgoing array edge
    first; then by name - and each edge running backwards in that order is cut.
    What is left inside a component follows the order, hence no cycle remains.
    In a two-node cycle the degrees tie, so the array edge is the one cut (the
    original's preference). Deterministic (Q6); all steps are keyed aggregations.
    """
    edges = edges.select("repo_id", "src", "dst", "via_array")
    if scc is None:
        inside = _links_inside(edges)
    else:
        s1 = scc.select("repo_id", F.col("node").alias("src"), F.col("scc").alias("c1"))
        s2 = scc.select("repo_id", F.col("node").alias("dst"), F.col("scc").alias("c2"))
        inside = edges.join(s1, ["repo_id", "src"]).join(s2, ["repo_id", "dst"]).where(F.col("c1") == F.col("c2"))
        inside = write_stage(inside.select(edges.columns), "inside")
    rows = inside.count()
    out_d = inside.groupBy("repo_id", F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("outd"), F.max(F.col("via_array").cast("int")).alias("has_arr"))
    in_d = inside.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ind"))
    # one number orders like (in-degree - out-degree, has an array edge); names decide where it ties
    rank = write_stage(out_d.join(in_d, ["repo_id", "node"], "full_outer").fillna(0, ["outd", "ind", "has_arr"])
                       .select("repo_id", "node", ((F.col("ind") - F.col("outd")) * 2 + F.col("has_arr")).alias("rk")), "rank")
    half = write_stage(_labelled(inside, rows, "src", rank, "rk1", "rk"), "inside")
    drop_stages(inside)
    x = _labelled(half, rows, "dst", rank, "rk2", "rk")
    back = (F.col("rk1") > F.col("rk2")) | ((F.col("rk1") == F.col("rk2")) & (F.col("src") >= F.col("dst")))
    return x.where(back).select("repo_id", "src", "dst", "via_array").distinct()


IMPORT_LINE_RE = r"^\s*(import|from|require|using|use|#include)\b"


def resolve_by_scan(refs: DataFrame, lines: DataFrame, def_rules: DataFrame) -> DataFrame:
    """Fallback resolution by scanning source lines once.

    Every line yields the names it defines (``def_rules(rule_ord, regex)`` with the
    name in group 1, e.g. class/interface declarations and ``Name =``
    assignments); import lines are dropped; the refs are equi-joined on the name
    (no scan per name). For a dotted ``Outer.Inner`` files that also
    define ``Outer`` (all before the last dot) come first, the others only where no
    file does; then the import fragment decides, else the first (path, line).
    """
    ln = lines.where(~F.col("line").rlike(IMPORT_LINE_RE))
    if isinstance(def_rules, DataFrame):
        r = F.broadcast(def_rules)
        d = ln.join(r, F.regexp_like(ln["line"], r["regex"])).select(
            "repo_id", "path", "line_no", F.expr("regexp_extract(line, regex, 1)").alias("defined"))
    else:  # literal rule list: one literal-regex extraction per rule, no join
        d = None
        for _, rx in def_rules:
            part = ln.where(F.col("line").rlike(rx)).select("repo_id", "path", "line_no",
                                                           F.regexp_extract("line", rx, 1).alias("defined"))
            d = part if d is None else d.unionByName(part)
    d = d.where(F.col("defined") != "").distinct()
    leaf = F.element_at(F.split("name", r"\."), -1)
    outer = F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", ""))
    c = refs.withColumn("leaf", leaf).withColumn("outer", outer).join(
        d.withColumnRenamed("defined", "leaf"), ["repo_id", "leaf"])
    outer_defs = d.select("repo_id", "path", F.col("defined").alias("outer")).distinct().withColumn("__o", F.lit(True))
    c = c.join(outer_defs, ["repo_id", "path", "outer"], "left").withColumn("outside", F.col("__o").isNull())
    tier = F.when(F.col("fragment").isNotNull() & (F.col("fragment") != "") & F.col("path").contains(F.col("fragment")), 0).otherwise(1)
    return (c.withColumn("tier", tier).groupBy("repo_id", "ref_id", "name")
            .agg(F.min_by(F.struct("path", F.col("line_no").alias("line")), F.struct("outside", "tier", "path", "line_no")).alias("w"))
            .select("repo_id", "ref_id", "name", "w.path", "w.line"))


def resolve_type(refs: DataFrame, type_defs: DataFrame, lines: DataFrame, def_rules: DataFrame) -> DataFrame:
    """The index first (G4); only the refs it leaves open are scanned."""
    idx = resolve_indexed(refs, type_defs).select("repo_id", "ref_id", "name", "path", "line", F.lit("index").alias("how"))
    rest = refs.join(idx.select("repo_id", "ref_id"), ["repo_id", "ref_id"], "left_anti")
    scan = resolve_by_scan(rest, lines, def_rules).withColumn("how", F.lit("scan"))
    found = idx.unionByName(scan)
    none = (rest.join(scan.select("repo_id", "ref_id"), ["repo_id", "ref_id"], "left_anti")
            .select("repo_id", "ref_id", "name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"),
                    F.lit("none").alias("how")))
    return found.unionByName(none)


def ref_hints_collect(hints: DataFrame) -> DataFrame:
    """Per file, each (name, import_line, namespace) once, tagged with the source of
    its first occurrence (request body before responses within an endpoint)."""
    k = ["repo_id", "source_file", "name", "import_line", "namespace"]
    return hints.groupBy(*k).agg(F.min_by("source", F.struct("ep_ord", "src_ord")).alias("source"),
                                 F.min("ep_ord").alias("first_ep"))


def ref_hints_dedup(collected: DataFrame) -> DataFrame:
    """Across the repository the same key keeps the first file's hint."""
    k = ["repo_id", "name", "import_line", "namespace"]
    return collected.groupBy(*k).agg(F.min_by(F.struct("source_file", "source"), F.struct("file_ord", "first_ep")).alias("w")) \
        .select(*k, "w.source_file", "w.source")


def props_to_json_schema(props: DataFrame, schemas: DataFrame) -> DataFrame:
    """Property rows -> JSON Schema text per schema.

    ``props(repo_id, schema, prop_ord, name, type, format, ref, is_array, nullable,
    enum_values, constraints_json)``; ``schemas(repo_id, schema, required ARRAY, parent_ref)``.
    A ref wins over enum over type/format; arrays wrap; nullable and constraints
    are added last; a parent turns the result into ``allOf``.
    """
    base = (F.when(F.col("ref") != "", F.concat(F.lit('{"$ref":"#/components/schemas/'), "ref", F.lit('"}')))
            .when(F.size("enum_values") > 0, F.concat(F.lit('{"type":"string","enum":'), F.to_json("enum_values"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"type":"'), "type", F.lit('"'),
                                F.when(F.col("format") != "", F.concat(F.lit(',"format":"'), "format", F.lit('"'))).otherwise(F.lit("")),
                                F.lit("}"))))
    s = F.when(F.col("is_array"), F.concat(F.lit('{"type":"array","items":'), base, F.lit("}"))).otherwise(base)
    extra = F.concat(F.when(F.col("nullable"), F.lit(',"nullable":true')).otherwise(F.lit("")),
                     F.when(F.coalesce(F.col("constraints_json"), F.lit("{}")) != "{}",
                            F.concat(F.lit(","), F.expr("substring(constraints_json, 2, length(constraints_json) - 2)"))).otherwise(F.lit("")))
    prop = F.concat(F.regexp_replace(s, r"\}$", ""), extra, F.lit("}"))
    key = F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", "")  # JSON-escaped "name"
    p = props.select("repo_id", "schema", "prop_ord", F.concat(key, F.lit(":"), prop).alias("kv"))
    agg = p.groupBy("repo_id", "schema").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prop_ord", "kv"))),
                                                            lambda x: x["kv"]), ",").alias("body"))
    j = schemas.join(agg, ["repo_id", "schema"], "left")
    obj = F.concat(F.lit('{"type":"object","properties":{'), F.coalesce("body", F.lit("")), F.lit("}"),
                   F.when(F.size("required") > 0, F.concat(F.lit(',"required":'), F.to_json("required"))).otherwise(F.lit("")), F.lit("}"))
    out = F.when(F.col("parent_ref") != "", F.concat(F.lit('{"allOf":[{"$ref":"#/components/schemas/'), "parent_ref",
                                                      F.lit('"},'), obj, F.lit("]}"))).otherwise(obj)
    return j.select("repo_id", "schema", out.alias("schema_json"))


def property_closure(props: DataFrame, parents: DataFrame) -> DataFrame:
    """M4: the properties of a schema with those of its parents, transitively, within a repository.

    ``props(repo_id, node, prop)``, ``parents(repo_id, src, dst)``; (repo_id, node, n_props, props) of every schema that
    has properties of its own. A round follows one level of parents; each round's new pairs are written once.
    """
    up = parents.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("nxt")).distinct()
    fresh = props.select("repo_id", F.col("node").alias("root"), "node").distinct()
    known = fresh
    while True:
        fresh = cut_lineage(fresh.join(up, ["repo_id", "node"]).select("repo_id", "root", F.col("nxt").alias("node")).distinct()
                            .join(known, ["repo_id", "root", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    sets = known.join(props, ["repo_id", "node"]).groupBy("repo_id", F.col("root").alias("node")).agg(F.array_sort(F.collect_set("prop")).alias("props"))
    return sets.select("repo_id", "node", F.size("props").cast("long").alias("n_props"), "props")
