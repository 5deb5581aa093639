"""Whole API descriptions in pieces: assembled (A1-A6, A10, A11, A13), finished (F10, F12, F15, F17-F19), written as
valid documents and read back (S9, S10), checked (V1-V3, V5-V8).

A description is the pieces ``(repo_id, section, name, body)`` of ``operators/document.py``: one row a path, schema or
security scheme.  A written document is a folder of text files a repository; the files in the order of their names
are one JSON document, a piece a line, so neither writing nor reading holds a document in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.hints import primitive_schema
from routelens.functions.paths import path_params
from routelens.operators import document as D
from routelens.operators.resolve import break_ref_cycles, closure
from routelens.operators.spec import schema_case_align
from routelens.session import write_stage

# The head of every description, the placeholder of a schema that was not found.
HEAD = ('{"openapi":"3.0.3","info":{"title":"API Specification","version":"1.0.0"},'
        '"servers":[{"url":"{server}","variables":{"server":{"default":"","description":"Target server URL"}}}]')
NOT_FOUND = ('{"description":"Schema could not be resolved from source code. Referenced by endpoint but not found in '
             'extracted schemas.","type":"object","x-unresolved":true}')
SECTIONS = ("paths", "schemas", "securitySchemes")
BODY_METHODS = ("post", "put", "patch")


def _object(*parts: Column) -> Column:
    """JSON object of the members that are not null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _member(name: str | Column, json: Column) -> Column:
    return F.concat(F.lit(f'"{name}":') if isinstance(name, str) else F.concat(D.quote(name), F.lit(":")), json)


def parameter_list(path: Column, declared: Column) -> Column:
    """A1: JSON texts of the parameters: those of the path, then declared ones of other names, the first of each (name, in).

    ``declared``: array<struct<name, in, required, schema (JSON or null), description>>.
    """
    names = path_params(path)
    own = F.transform(F.array_distinct(names), lambda n: _object(_member("name", D.quote(n)), F.lit('"in":"path","required":true,"schema":{"type":"string"}')))
    other = F.filter(declared, lambda p: ~F.array_contains(names, p["name"]))
    first = F.filter(other, lambda p, i: ~F.exists(F.slice(other, F.lit(1), i), lambda q: (q["name"] == p["name"]) & (q["in"] == p["in"])))
    return F.concat(own, F.transform(first, lambda p: _object(
        _member("name", D.quote(p["name"])), _member("in", D.quote(p["in"])), _member("required", p["required"].cast("string")),
        F.when(p["schema"].isNotNull(), _member("schema", p["schema"])),
        F.when(p["description"].isNotNull(), _member("description", D.quote(p["description"]))))))


def operation_texts(ops: DataFrame) -> DataFrame:
    """(repo_id, path, method, body): canonical JSON of every operation.

    ``ops(repo_id, path, method, operation_id, tag, declared, has_body, content_type, body_schema, responses, security)``:
    ``body_schema`` null stands for an empty ref (A2: a bare object); ``responses`` are final
    array<struct<code, description, schema (JSON or null)>>; ``security`` is array<struct<name, scopes>>, empty for a
    public operation (A4), null where nothing is declared.
    """
    response = F.transform("responses", lambda r: _member(r["code"], _object(
        _member("description", D.quote(r["description"])),
        F.when(r["schema"].isNotNull(), F.concat(F.lit('"content":{"application/json":{"schema":'), r["schema"], F.lit("}}"))))))
    scopes = lambda s: F.coalesce(F.to_json(s["scopes"]), F.lit("[]"))
    security = _list(F.transform("security", lambda s: _object(_member(s["name"], scopes(s)))))
    body = F.concat(F.lit('{"content":{'), D.quote(F.col("content_type")), F.lit(':{"schema":'),
                    F.coalesce("body_schema", F.lit('{"type":"object"}')), F.lit("}}}"))
    staged = ops.withColumn("__params", parameter_list(F.col("path"), F.col("declared")))
    text = _object(_member("operationId", D.quote(F.col("operation_id"))),
                   F.when(F.coalesce("tag", F.lit("")) != "", _member("tags", _list(F.array(D.quote(F.col("tag")))))),
                   F.when(F.size("__params") > 0, _member("parameters", _list(F.col("__params")))),
                   F.when(F.col("has_body"), _member("requestBody", body)),
                   _member("responses", F.concat(F.lit("{"), F.array_join(response, ","), F.lit("}"))),
                   F.when(F.col("security").isNotNull(), _member("security", security)))
    return staged.select("repo_id", "path", F.lower("method").alias("method"), D.canonical(text).alias("body"))


def path_pieces(operations: DataFrame) -> DataFrame:
    """One piece a path: its methods (at most a handful a group) in name order."""
    m = F.sort_array(F.collect_list(F.struct("method", "body")))
    joined = F.concat(F.lit("{"), F.array_join(F.transform(m, lambda x: _member(x["method"], x["body"])), ","), F.lit("}"))
    return operations.groupBy("repo_id", F.col("path").alias("name")).agg(joined.alias("body")).select(
        "repo_id", F.lit("paths").alias("section"), "name", "body")


def scheme_pieces(schemes: DataFrame) -> DataFrame:
    """``schemes(repo_id, name, scheme struct of A6, scopes)`` as pieces."""
    s = F.col("scheme")
    known = F.transform("scopes", lambda x: _member(x, F.lit('""')))
    flow = F.concat(F.lit("{"), D.quote(s["flow"]), F.lit(':{"scopes":{'), F.array_join(known, ","), F.lit("}"),
                    F.when(s["flow"].isin("authorizationCode", "implicit"), F.lit(',"authorizationUrl":""')).otherwise(F.lit("")),
                    F.when(s["flow"] != "implicit", F.lit(',"tokenUrl":""')).otherwise(F.lit("")), F.lit("}}"))
    text = _object(_member("type", D.quote(s["type"])), *(F.when(s[c].isNotNull(), _member(k, D.quote(s[c]))) for c, k in (
        ("scheme", "scheme"), ("bearer_format", "bearerFormat"), ("in", "in"), ("name", "name"))), F.when(s["flow"].isNotNull(), _member("flows", flow)))
    return schemes.select("repo_id", F.lit("securitySchemes").alias("section"), "name", D.canonical(text).alias("body"))


def component_pieces(paths: DataFrame, schemas: DataFrame) -> DataFrame:
    """The schemas that paths need, directly or through other schemas, under the names they are asked by.

    ``schemas(repo_id, name, body)``.  A name is met exactly, else in another spelling (the first in name order), else
    by a placeholder; primitives are left out, they are inlined.
    """
    found = schemas.select("repo_id", F.lit("schemas").alias("section"), "name", "body")
    inner = write_stage(D.ref_nodes(D.shred(found).nodes()).select("repo_id", "name", "target"), "schema-refs")
    seeds = write_stage(D.ref_nodes(D.shred(paths).nodes()).select("repo_id", F.col("target").alias("node")).distinct(), "path-refs")
    asked = seeds.unionByName(inner.select("repo_id", F.col("target").alias("node"))).distinct()
    exact = schemas.select("repo_id", F.col("name").alias("node"), F.col("name").alias("exact"))
    spelled = schemas.groupBy("repo_id", F.lower("name").alias("low")).agg(F.min("name").alias("other"))
    held = asked.join(exact, ["repo_id", "node"], "left").withColumn("low", F.lower("node")).join(spelled, ["repo_id", "low"], "left").select(
        "repo_id", "node", F.coalesce("exact", "other").alias("name"))
    held = write_stage(held, "schema-names")
    edges = held.join(inner, ["repo_id", "name"]).select("repo_id", F.col("node").alias("src"), F.col("target").alias("dst"))
    needed = closure(seeds, edges).join(held, ["repo_id", "node"]).where(primitive_schema(F.col("node")).isNull())
    return needed.join(schemas, ["repo_id", "name"], "left").select(
        "repo_id", F.lit("schemas").alias("section"), F.col("node").alias("name"), F.coalesce("body", F.lit(NOT_FOUND)).alias("body"))


def assemble(operations: DataFrame, schemas: DataFrame, schemes: DataFrame) -> DataFrame:
    """All pieces of the descriptions, before they are cleaned."""
    paths = write_stage(path_pieces(operations), "paths")
    return paths.unionByName(component_pieces(paths, schemas)).unionByName(scheme_pieces(schemes))


def merge_paths(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths that differ by parameter names only are merged into the first in name order; a method it has stays.

    Returns the pieces and the log ``(repo_id, name, canonical, method)``; method null: the path was removed.
    """
    paths = pieces.where("section = 'paths'").withColumn("template", F.regexp_replace("name", r"\{[^}]+\}", "{_}"))
    canon = paths.groupBy("repo_id", "template").agg(F.min("name").alias("canonical"))
    each = paths.join(canon, ["repo_id", "template"]).select("repo_id", "name", "canonical", F.explode(D.members(F.col("body"))).alias("method", "body"))
    first = each.groupBy("repo_id", "canonical", "method").agg(F.min("name").alias("name"), F.min_by("body", "name").alias("body"))
    merged = path_pieces(first.select("repo_id", F.col("canonical").alias("path"), "method", "body"))
    moved = first.where("name <> canonical").select("repo_id", "name", "canonical", "method")
    gone = paths.join(canon, ["repo_id", "template"]).where("name <> canonical").select(
        "repo_id", "name", "canonical", F.lit(None).cast("string").alias("method"))
    return merged.unionByName(pieces.where("section <> 'paths'")), moved.unionByName(gone)


def finish(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned and fixed pieces, and the patch table of all passes (F1-F12, F14, F17); F18 drops unused schemas.

    A section without pieces does not appear in a document (F19).
    """
    tree = D.clean(pieces)
    cleaned = write_stage(tree.fold(), "cleaned")
    refs = write_stage(D.ref_nodes(tree.nodes()), "refs")
    names = D.schema_names(cleaned)
    inside = refs.where("section = 'schemas'").join(names.withColumnRenamed("name", "target"), ["repo_id", "target"], "left_semi")
    edges = inside.groupBy("repo_id", F.col("name").alias("src"), F.col("target").alias("dst")).agg(F.bool_or("via_array").alias("via_array"))
    cuts = write_stage(break_ref_cycles(edges), "cuts")
    cycles = D.cycle_patches(refs, cuts)
    left = refs.join(cycles.select(*D.PIECE, "ptr").distinct(), [*D.PIECE, "ptr"], "left_anti")
    renames = write_stage(schema_case_align(names.withColumn("ord", F.col("name")), left.select("repo_id", "target")), "renames")
    renamed = D.rename_pieces(cleaned, renames)
    now = left.join(renames.withColumnRenamed("actual", "target"), ["repo_id", "target"], "left").withColumn(
        "target", F.coalesce("renamed_to", "target")).drop("renamed_to")
    dangling = D.dangling_patches(now, D.schema_names(renamed))
    patches = write_stage(cycles.unionByName(D.case_patches(left, renames)).unionByName(dangling), "patches")
    fixed = write_stage(D.rename_pieces(D.replay(cleaned, patches).fold(), renames), "fixed")
    kept = now.join(dangling.select(*D.PIECE, "ptr").distinct(), [*D.PIECE, "ptr"], "left_anti")
    unused = D.unused_schemas(renamed, kept).withColumn("section", F.lit("schemas"))
    return fixed.join(unused, D.PIECE, "left_anti"), tree.patches().unionByName(patches)


# ---------------------------------------------------------------- written documents

def document_lines(pieces: DataFrame) -> DataFrame:
    """(repo_id, seq, line): the lines of every repository's document in the order of ``seq``.

    The indentation of a line (one to three spaces) tells its section.
    """
    firsts = pieces.groupBy("repo_id", "section").agg(F.min("name").alias("first"))
    place = {s: str(2 * i + 1) for i, s in enumerate(SECTIONS)}
    number = F.when(F.col("section") == "paths", place["paths"]).when(F.col("section") == "schemas", place["schemas"]).otherwise(place["securitySchemes"])
    indent = F.when(F.col("section") == "paths", " ").when(F.col("section") == "schemas", "  ").otherwise("   ")
    inner = pieces.join(firsts, ["repo_id", "section"]).select("repo_id", F.concat(number, F.lit(" "), "name").alias("seq"), F.concat(
        indent, F.when(F.col("name") == F.col("first"), "").otherwise(","), D.quote(F.col("name")), F.lit(":"), "body").alias("line"))
    has = pieces.groupBy("repo_id").agg(F.bool_or(F.col("section") == "schemas").alias("s"), F.bool_or(F.col("section") == "securitySchemes").alias("x"))
    frame = has.select("repo_id", F.explode(F.array(
        F.struct(F.lit("0").alias("seq"), F.lit(HEAD + ',"paths":{').alias("line")),
        F.struct(F.lit("2").alias("seq"), F.when(F.col("s"), '},"components":{"schemas":{').when(F.col("x"), '},"components":{"securitySchemes":{').otherwise("}").alias("line")),
        F.struct(F.lit("4").alias("seq"), F.when(F.col("s") & F.col("x"), '},"securitySchemes":{').otherwise("").alias("line")),
        F.struct(F.lit("6").alias("seq"), F.when(F.col("s") | F.col("x"), "}}}").otherwise("}").alias("line")))).alias("f"))
    return inner.unionByName(frame.select("repo_id", "f.seq", "f.line"))


def write_documents(pieces: DataFrame, out_dir: str, compression: str | None = None) -> str:
    """Ordered part files a repository; joined in the order of their names they are one valid JSON document.

    Rows are ranged by (repository, place), so a large document is written by many tasks, each in its own file.
    """
    ordered = document_lines(pieces).repartitionByRange("repo_id", "seq").sortWithinPartitions("repo_id", "seq")
    w = ordered.select("repo_id", "line").write.mode("overwrite").partitionBy("repo_id")
    (w.option("compression", compression) if compression else w).text(out_dir)
    return out_dir


def read_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """The pieces of written documents, a line at a time."""
    lines = spark.read.text(out_dir).where(F.col("value").startswith(" "))
    depth = F.length("value") - F.length(F.ltrim(F.col("value")))
    one = D.members(F.concat(F.lit("{"), F.regexp_replace(F.ltrim(F.col("value")), "^,", ""), F.lit("}")))
    section = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), depth)
    return lines.select(F.col("repo_id").cast("string").alias("repo_id"), section.alias("section"), F.explode(one).alias("name", "body"))


def load_documents(documents: DataFrame) -> DataFrame:
    """The pieces of any OpenAPI documents ``(repo_id, document)`` given as one JSON text each."""
    top = documents.select("repo_id", D.members(F.col("document")).alias("m"))
    components = D.members(F.try_element_at("m", F.lit("components")))
    sections = F.map_from_arrays(F.array(*[F.lit(s) for s in SECTIONS]), F.array(
        F.try_element_at("m", F.lit("paths")), F.try_element_at(components, F.lit("schemas")), F.try_element_at(components, F.lit("securitySchemes"))))
    parts = top.select("repo_id", F.explode(sections).alias("section", "text")).where("text is not null")
    return parts.select("repo_id", "section", F.explode(D.members(F.col("text"))).alias("name", "body"))


def operations_of(pieces: DataFrame) -> DataFrame:
    """(repo_id, path, method, m): the operations of a document's paths with their members."""
    each = pieces.where("section = 'paths'").select("repo_id", F.col("name").alias("path"), F.explode(D.members(F.col("body"))).alias("method", "body"))
    return each.where(F.col("body").startswith("{")).select("repo_id", "path", "method", D.members(F.col("body")).alias("m"))


# ---------------------------------------------------------------- references and findings

def pointer(section: Column, name: Column, ptr: Column) -> Column:
    """JSON Pointer of a node in the whole document (as it stands in a ``$ref``)."""
    home = F.when(section == "paths", F.lit("#/paths/")).otherwise(F.concat(F.lit("#/components/"), section, F.lit("/")))
    return F.concat(home, F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), ptr)


def all_refs(nodes: DataFrame) -> DataFrame:
    """(repo_id, at, target): every object with a local ``$ref``, by its pointer."""
    ref = D.unquote(F.try_element_at("m", F.lit("$ref")))
    return nodes.where("m is not null").select("repo_id", pointer(F.col("section"), F.col("name"), F.col("ptr")).alias("at"),
                                               ref.alias("target")).where("target like '#%'")


def dangling(nodes: DataFrame) -> DataFrame:
    """V8: refs that lead nowhere ``(repo_id, at, target)``.

    A target is a pointer to a node (an anti join).  Where the pointer runs through an object that is a ref itself, it
    goes on from that ref's target, round by round; a pointer that comes back to a ref it ran through leads nowhere.
    """
    have = write_stage(nodes.select("repo_id", pointer(F.col("section"), F.col("name"), F.col("ptr")).alias("goal")), "pointers")
    refs = write_stage(all_refs(nodes), "refs")
    open_ = write_stage(refs.withColumns({"goal": F.col("target"), "seen": F.array().cast("array<string>")}).join(
        have, ["repo_id", "goal"], "left_anti"), "open")
    lost = None
    via = refs.select("repo_id", F.col("at").alias("through"), F.col("target").alias("onward"))
    while True:
        steps = F.split("goal", "/")
        cut = open_.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))))).withColumn(
            "through", F.array_join(F.slice(steps, F.lit(1), F.col("n")), "/"))
        met = cut.join(via, ["repo_id", "through"]).groupBy("repo_id", "at", "target", "goal", "seen").agg(
            F.max_by(F.struct("through", "onward", "n"), "n").alias("by"))
        stuck = open_.join(met, ["repo_id", "at", "target", "goal"], "left_anti").select("repo_id", "at", "target")
        turned = met.where(F.array_contains("seen", F.col("by.through"))).select("repo_id", "at", "target")
        lost = stuck.unionByName(turned) if lost is None else lost.unionByName(stuck).unionByName(turned)
        onward = F.concat("by.onward", F.lit("/"), F.array_join(F.slice(F.split("goal", "/"), F.col("by.n") + 1, F.size(F.split("goal", "/"))), "/"))
        nxt = met.where(~F.array_contains("seen", F.col("by.through"))).select(
            "repo_id", "at", "target", onward.alias("goal"), F.concat("seen", F.array("by.through")).alias("seen"))
        open_ = write_stage(nxt.join(have, ["repo_id", "goal"], "left_anti"), "open")
        if open_.isEmpty():
            return lost


def opaque_bodies(nodes: DataFrame) -> DataFrame:
    """V7: (repo_id, path, method) of post, put and patch operations whose body schema is an object without any structure,
    directly or behind refs and single ``allOf`` wrappers.

    The chains are followed by doubling: a pointer's goal is replaced by its goal's goal, so rounds grow with
    the logarithm of the longest chain; chains that end in a circle have no end and no finding.
    """
    objects = nodes.where("m is not null").withColumn("at", pointer(F.col("section"), F.col("name"), F.col("ptr")))
    get = lambda k: F.try_element_at("m", F.lit(k))
    ref = D.unquote(get("$ref"))
    single = (F.size(D.elements(get("allOf"))) == 1) & get("properties").isNull() & get("oneOf").isNull() & get("anyOf").isNull()
    onward = F.when(ref.like("#%"), ref).when(single, F.concat("at", F.lit("/allOf/0")))
    bare = (get("type") == '"object"') & ~F.exists(F.array(*[F.lit(k) for k in ("$ref", "allOf", "oneOf", "anyOf", "properties")]),
                                                   lambda k: F.map_contains_key(F.col("m"), k))
    step = write_stage(objects.select("repo_id", "at", onward.alias("goal"), F.coalesce(bare, F.lit(False)).alias("bare")), "shapes")
    jump = step.where("goal is not null").select("repo_id", "at", "goal")
    longest = jump.count() + 1
    rounds = 0
    while (1 << rounds) <= longest:
        far = jump.select("repo_id", F.col("at").alias("goal"), F.col("goal").alias("farther"))
        new = write_stage(jump.join(far, ["repo_id", "goal"], "left").select("repo_id", "at", F.coalesce("farther", "goal").alias("goal"), "farther"), "jumps")
        done = new.where("farther is not null").isEmpty()
        jump, rounds = new.select("repo_id", "at", "goal"), rounds + 1
        if done:
            break
    ends = step.where("bare").select("repo_id", F.col("at").alias("goal"))
    behind = jump.join(ends, ["repo_id", "goal"], "left_semi").select("repo_id", "at")
    opaque = behind.unionByName(step.where("bare").select("repo_id", "at")).distinct()
    bodies = objects.where("section = 'paths'").where(F.col("ptr").rlike("^/(" + "|".join(BODY_METHODS) + ")/requestBody/content/[^/]+/schema$"))
    return bodies.select("repo_id", "at", F.col("name").alias("path"), F.split("ptr", "/")[1].alias("method")).join(
        opaque, ["repo_id", "at"], "left_semi").select("repo_id", "path", "method").distinct()


def document_findings(pieces: DataFrame) -> DataFrame:
    """V1-V3 and V5-V8 on documents: (repo_id, rule, severity, subject)."""
    nodes = write_stage(D.shred(pieces).nodes(), "document")
    get = lambda k: F.try_element_at("m", F.lit(k))
    where = pointer(F.col("section"), F.col("name"), F.col("ptr"))
    ops = nodes.where("section = 'paths' and depth = 1 and m is not null").withColumn(
        "subject", F.concat(F.upper("key"), F.lit(" "), "name"))

    def rule(rows: DataFrame, name: str, severity: str, subject: Column) -> DataFrame:
        return rows.select("repo_id", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"))

    out = [
        rule(nodes.where((get("type") == '"array"') & ~F.map_contains_key("m", "items")), "array_items", "error", where),
        rule(nodes.where("section = 'schemas' and depth = 0").where(get("x-unresolved") == "true"), "unresolved_schema", "warning", F.col("name")),
        rule(D.unused_schemas(pieces, D.ref_nodes(nodes)), "unused_schema", "warning", F.col("name")),
        rule(ops.where(~F.map_contains_key("m", "security")), "missing_security", "warning", F.col("subject")),
        rule(ops.where(F.col("key").isin(*BODY_METHODS) & ~F.map_contains_key("m", "requestBody")), "missing_body", "warning", F.col("subject")),
        rule(opaque_bodies(nodes), "opaque_body", "warning", F.concat(F.upper("method"), F.lit(" "), "path")),
        rule(dangling(nodes), "dangling_ref", "error", F.concat("at", F.lit(" -> "), "target"))]
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    return all_
