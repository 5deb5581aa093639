"""Description documents as node tables: shredding, clean-up passes with a patch log, replay, folding back.

A description is stored in pieces ``(repo_id, section, name, body)``, one per path, schema or other component, so no
repository is ever one row; ``body`` is JSON text.  ``descend`` walks all pieces together, one depth a round:
the objects of a depth are rewritten by their edits, then their members are the next depth.  A node is keyed by
(repo_id, section, name, ptr), ``ptr`` being its JSON Pointer in the piece.  ``fold`` writes the JSON text of a piece
from its nodes in document order, in one grouping.  Members are written in key order and without spaces (the canonical text).

Every edit is a row of the patch table ``(repo_id, section, name, ptr, pass, seq, key, value, depth)``: the member
``key`` of the object at ``ptr`` becomes ``value`` (JSON text), or goes where ``value`` is null.  ``replay`` puts
a patch table on the pieces it was made from and gives the same document.

``clean`` and ``replay`` walk a piece as a whole (``operators/walk.py``) and leave odd ones to ``descend``.

The clean-up passes look at one object and its members only, so a pass over the whole document followed by
the next equals all passes on an object before its members:

1 leaked hints, 2 primitive refs, 3 property values, 4 constraint names, 5 exclusive bounds, 6 JSON in strings, 7 empty
required lists, 8 string bounds, 9 siblings of a ref, 11 array items, 14 nullable without type (the numbers of the
inventory's F items).  Passes 3 to 9 apply to schemas only.  What a string was parsed into is not seen by passes 1 and
2, which come before.

Members of an object that are null in JSON are values; a body that is no JSON, or null, has no nodes and no folded row.
Depth is bounded by the documents, not by a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.functions.hints import primitive_schema
from routelens.operators import walk as W
from routelens.operators.spec import CONSTRAINT_RENAMES, STRING_VALUE_KEYS, coerce_property
from routelens.session import spread, write_stage

PIECE = ["repo_id", "section", "name"]
REF = "#/components/schemas/"
EDIT = "array<struct<pass:int,key:string,value:string>>"


def quote(text: Column) -> Column:
    """JSON text of a string."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def unquote(json: Column) -> Column:
    """The string a JSON text holds; NULL if it holds none."""
    return F.when(json.startswith('"'), F.try_variant_get(F.try_parse_json(json), "$", "string"))


def members(json: Column) -> Column:
    """map of an object's members to their JSON texts."""
    return F.transform_values(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def elements(json: Column) -> Column:
    """JSON texts of an array's elements."""
    return F.transform(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null")))


def canonical(json: Column) -> Column:
    return F.to_json(F.try_parse_json(json))


def _has(m: Column, key: str | Column) -> Column:
    return F.map_contains_key(m, F.lit(key) if isinstance(key, str) else key)


def _get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _truthy(json: Column) -> Column:
    return F.coalesce(~json.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _is_number(json: Column) -> Column:
    return F.coalesce(json.rlike(r"^-?[0-9]"), F.lit(False))


def _edit(number: int, key: str | Column, value: str | Column | None) -> Column:
    v = F.lit(None).cast("string") if value is None else F.lit(value) if isinstance(value, str) else value
    return F.struct(F.lit(number).alias("pass"), (F.lit(key) if isinstance(key, str) else key).alias("key"), v.alias("value"))


def _edits(*conditional: tuple[Column, Column]) -> Column:
    """The edits whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, edit) for cond, edit in conditional]), lambda e: e.isNotNull())


def _none() -> Column:
    return F.array().cast(EDIT)


def apply_edits(m: Column, edits: Column) -> Column:
    """Members after the edits, one after the other."""
    def step(acc: Column, e: Column) -> Column:
        rest = F.map_filter(acc, lambda k, v: k != e["key"])
        return F.when(e["value"].isNull(), rest).otherwise(F.map_concat(rest, F.create_map(e["key"], e["value"])))
    return F.when(F.size(edits) > 0, F.aggregate(edits, m, step)).otherwise(m)


# ---------------------------------------------------------------- the passes: members -> edits

def leaked_hint(m: Column) -> Column:
    """an object that holds a ref hint and neither type nor ``$ref`` becomes the ref it hints at."""
    hint = _get(m, "ref_hint")
    found = _has(m, "ref_hint") & ~_has(m, "type") & ~_has(m, "$ref")
    gone = F.transform(F.array_sort(F.map_keys(m)), lambda k: _edit(1, k, None))
    ref = _edit(1, "$ref", quote(F.concat(F.lit(REF), F.coalesce(unquote(hint), hint))))
    return F.when(found, F.concat(gone, F.array(ref))).otherwise(_none())


def _ref_target(m: Column) -> Column:
    ref = unquote(_get(m, "$ref"))
    return F.when(ref.startswith(REF), F.substring(ref, F.lit(len(REF) + 1), F.length(ref)))


def primitive_ref(m: Column) -> Column:
    """a ref to a primitive type is replaced by the inline schema, whose members win."""
    inline = members(primitive_schema(_ref_target(m)))
    puts = F.transform(F.array_sort(F.map_keys(inline)), lambda k: _edit(2, k, F.element_at(inline, k)))
    return F.when(inline.isNotNull(), F.concat(F.array(_edit(2, "$ref", None)), puts)).otherwise(_none())


def property_values(m: Column) -> Column:
    """members of ``properties`` that are no objects become schemas."""
    wrong = F.filter(F.array_sort(F.map_keys(m)), lambda k: ~F.element_at(m, k).startswith("{"))
    return F.transform(wrong, lambda k: _edit(3, k, canonical(coerce_property(F.parse_json(F.element_at(m, k))))))


def constraint_names(m: Column) -> Column:
    """aliases of constraint names are renamed unless the name is there, or an earlier alias takes it."""
    table = F.array(*[F.struct(F.lit(alias).alias("alias"), F.lit(name).alias("name")) for alias, name in CONSTRAINT_RENAMES])
    free = lambda r, i: _has(m, r["alias"]) & ~_has(m, r["name"]) & ~F.exists(
        F.slice(table, F.lit(1), i), lambda q: (q["name"] == r["name"]) & _has(m, q["alias"]))
    return F.flatten(F.transform(F.filter(table, free), lambda r: F.array(
        _edit(4, r["alias"], None), _edit(4, r["name"], F.element_at(m, r["alias"])))))


def exclusive_bounds(m: Column) -> Column:
    """exclusive bounds given as numbers become the bound and a flag."""
    out = []
    for flag, bound in (("exclusiveMinimum", "minimum"), ("exclusiveMaximum", "maximum")):
        number = _is_number(_get(m, flag))
        out += [(number, _edit(5, bound, _get(m, flag))), (number, _edit(5, flag, "true"))]
    return _edits(*out)


def json_strings(m: Column) -> Column:
    """strings that hold a JSON object or array, or a bare schema ref, become nodes (not where strings belong)."""
    keys = F.filter(F.array_sort(F.map_keys(m)), lambda k: ~k.isin(*STRING_VALUE_KEYS) & F.element_at(m, k).startswith('"'))

    def value(k: Column) -> Column:
        s = F.regexp_replace(unquote(F.element_at(m, k)), r"^\s+|\s+$", "")
        braced = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
        return F.when(braced, canonical(s)).when(s.startswith(REF), F.concat(F.lit('{"$ref":'), quote(s), F.lit("}")))

    return F.filter(F.transform(keys, lambda k: _edit(6, k, value(k))), lambda e: e["value"].isNotNull())


def empty_required(m: Column) -> Column:
    """an empty ``required`` goes."""
    return _edits((_get(m, "required") == "[]", _edit(7, "required", None)))


def string_bounds(m: Column) -> Column:
    """F8: minimum and maximum of strings become lengths, cut to whole numbers."""
    out = []
    for bound, length in (("minimum", "minLength"), ("maximum", "maxLength")):
        wrong = F.coalesce((_get(m, "type") == '"string"') & _is_number(_get(m, bound)) & ~_has(m, length), F.lit(False))
        whole = F.try_variant_get(F.try_parse_json(_get(m, bound)), "$", "double").cast("bigint").cast("string")
        out += [(wrong, _edit(8, bound, None)), (wrong, _edit(8, length, whole))]
    return _edits(*out)


def ref_siblings(m: Column) -> Column:
    """a ref beside other members moves into ``allOf``; a nullable wrapper gets a type."""
    beside = _has(m, "$ref") & (F.size(m) > 1)
    untyped = _truthy(_get(m, "nullable")) & ~_has(m, "type") & (_has(m, "allOf") | beside)
    return _edits((beside, _edit(9, "allOf", F.concat(F.lit('[{"$ref":'), _get(m, "$ref"), F.lit("}]")))),
                  (beside, _edit(9, "$ref", None)), (untyped, _edit(9, "type", '"object"')))


def array_items(m: Column) -> Column:
    """an array without items gets string items."""
    return _edits((F.coalesce(_get(m, "type") == '"array"', F.lit(False)) & ~_has(m, "items"), _edit(11, "items", '{"type":"string"}')))


def nullable_type(m: Column) -> Column:
    """a nullable object without type and ref becomes an object type."""
    return _edits((_truthy(_get(m, "nullable")) & ~_has(m, "type") & ~_has(m, "$ref"), _edit(14, "type", '"object"')))


# ---------------------------------------------------------------- descent

class Tree:
    """Materialised depths of all pieces after their edits, from the root down."""

    def __init__(self, levels: list[DataFrame]):
        self.levels = levels

    def nodes(self) -> DataFrame:
        """(repo_id, section, name, ptr, parent, key, idx, depth, text, m): one row a node; ``m`` holds an object's members."""
        out = self.levels[0]
        for level in self.levels[1:]:
            out = out.unionByName(level)
        return out.drop("edits", "props", "parsed", "settled", "steps", "stack")

    def patches(self) -> DataFrame:
        """The patch table of the descent."""
        out = None
        for level in self.levels:
            part = level.where(F.size("edits") > 0).select(*PIECE, "ptr", "depth", F.posexplode("edits").alias("seq", "e")).select(
                *PIECE, "ptr", "depth", F.col("e.pass").alias("pass"), "seq", "e.key", "e.value")
            out = part if out is None else out.unionByName(part)
        return out

    def fold(self) -> DataFrame:
        """(repo_id, section, name, body): the pieces as canonical JSON text.

        The nodes of a piece meet once, in document order (their steps compare like it); what has to be closed after a
        node follows from the depth of the next one and the kinds of its own ancestors.
        """
        nodes = None
        for level in self.levels:
            open_ = F.when(F.col("text").startswith("{"), F.when(F.size("m") > 0, "{").otherwise("{}")).when(
                F.col("text").startswith("["), F.when(F.col("text") == "[]", "[]").otherwise("[")).otherwise(F.col("text"))
            part = level.select(*PIECE, F.struct("steps", "depth", "stack", F.concat(
                F.when(F.col("key").isNull(), "").otherwise(F.concat(quote(F.col("key")), F.lit(":"))), open_).alias("token")).alias("n"))
            nodes = part if nodes is None else nodes.unionByName(part)
        ns = nodes.groupBy(*PIECE).agg(F.sort_array(F.collect_list("n")).alias("ns"))

        def written(n: Column, i: Column) -> Column:
            before = F.coalesce(F.get("ns", i - 1)["depth"], F.lit(-1))
            after = F.coalesce(F.get("ns", i + 1)["depth"], F.lit(0))
            closers = F.reverse(F.translate(F.substring(n["stack"], after + 1, F.length(n["stack"])), "{[", "}]"))
            return F.concat(F.when(before < n["depth"], "").otherwise(","), n["token"], F.when(after <= n["depth"], closers).otherwise(""))

        return ns.select(*PIECE, F.array_join(F.transform("ns", written), "").alias("body"))


def _escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def descend(pieces: DataFrame, rewrite: Callable[[DataFrame], DataFrame]) -> Tree:
    """Walk the pieces depth by depth.  ``rewrite`` adds ``edits`` to rows with the members ``m`` (null: no object).

    ``props``: the members are properties of a schema; ``parsed``: below a parsed string; ``settled``: below a
    primitive put in place of a ref.  The pieces are dealt out first: a depth is written by as many tasks as the one above it.
    """
    level = spread(pieces, *PIECE).select(*PIECE, F.lit("").alias("ptr"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"),
                          F.lit(None).cast("int").alias("idx"), F.lit(0).alias("depth"), canonical(F.col("body")).alias("text"),
                          F.lit(False).alias("props"), F.lit(False).alias("parsed"), F.lit(False).alias("settled"),
                          F.array().cast("array<string>").alias("steps"), F.lit("").alias("stack")).where("text is not null")
    levels = []
    while True:
        level = level.withColumn("m", F.when(F.col("text").startswith("{"), members(F.col("text"))))
        level = write_stage(rewrite(level).withColumn("m", apply_edits(F.col("m"), F.col("edits"))), "nodes")
        levels.append(level)
        settled = F.col("settled") | F.exists("edits", lambda e: e["pass"] == 2)
        item = lambda key, idx, text: F.struct(key.alias("key"), idx.alias("idx"), text.alias("text"))
        inside = F.when(F.col("m").isNotNull(), F.transform(F.map_entries("m"), lambda e: item(e["key"], F.lit(None).cast("int"), e["value"]))).when(
            F.col("text").startswith("["), F.transform(elements(F.col("text")), lambda t, i: item(F.lit(None).cast("string"), i, t)))
        below = level.select(*PIECE, F.col("ptr").alias("parent"), "depth", F.col("props").alias("__props"), F.col("parsed").alias("__parsed"), "edits",
                             settled.alias("settled"), "steps", F.concat("stack", F.substring("text", 1, 1)).alias("stack"), F.explode(inside).alias("x"))  # nulls and empty containers have no rows
        if below.isEmpty():
            return Tree(levels)
        level = below.select(
            *PIECE, F.concat("parent", F.lit("/"), F.coalesce(_escape(F.col("x.key")), F.col("x.idx").cast("string"))).alias("ptr"), "parent",
            "x.key", "x.idx", (F.col("depth") + 1).alias("depth"), "x.text",
            F.coalesce(~F.col("__props") & (F.col("x.key") == "properties"), F.lit(False)).alias("props"),
            (F.col("__parsed") | F.exists("edits", lambda e: e["pass"].isin(3, 6) & e["key"].eqNullSafe(F.col("x.key")))).alias("parsed"), "settled",
            F.concat("steps", F.array(F.coalesce(F.col("x.key"), F.lpad(F.col("x.idx").cast("string"), 10, "0")))).alias("steps"), "stack")


def no_edits(level: DataFrame) -> DataFrame:
    return level.withColumn("edits", _none())


def shred(pieces: DataFrame) -> Tree:
    """The nodes of the pieces as they are."""
    return descend(pieces, no_edits)


def clean_rules() -> Callable[[DataFrame], DataFrame]:
    """All passes on the objects of a depth, each on what the one before left: two projections a pass.

    The expressions are made once and used for every depth.
    """
    schema, early = F.col("section") == "schemas", ~F.col("parsed")
    steps = [(leaked_hint, early), (primitive_ref, early & ~F.col("settled")), (property_values, schema & F.col("props")),
             (constraint_names, schema), (exclusive_bounds, schema), (json_strings, schema), (empty_required, schema),
             (string_bounds, schema), (ref_siblings, schema), (array_items, F.lit(True)), (nullable_type, F.lit(True))]
    m = F.col("__m")
    made = [F.when(where & m.isNotNull(), edits(m)).otherwise(_none()).alias("__e") for edits, where in steps]
    after, log = apply_edits(m, F.col("__e")).alias("__m"), F.concat("edits", "__e").alias("edits")

    def rewrite(level: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in level.columns]
        out = level.select("*", F.col("m").alias("__m"), _none().alias("edits"))
        for edits in made:
            out = out.select(*keep, m, "edits", edits).select(*keep, after, log)
        return out.drop("__m")

    return rewrite


class Walk(Tree):
    """Pieces rewritten by whole documents (``operators/walk.py``): their texts and patches are one stage, a row a piece.

    Odd pieces, and those whose key comes several times, are rewritten depth by depth.  So are all of them
    where the nodes are asked for: ``levels`` are made then.
    """

    def __init__(self, pieces: DataFrame, rewrite: Callable[[DataFrame], DataFrame], rows: DataFrame, run: Callable):
        self.pieces, self.rewrite, self.made = pieces, rewrite, None
        schema = f"repo_id string, section string, name string, text string, patches {W.PATCH}, odd boolean"
        self.rows = write_stage(rows.mapInArrow(run, schema), "walked")
        odd = self.rows.where("odd").select(*PIECE, F.col("text").alias("body"))
        self.odd = None if odd.isEmpty() else descend(odd, rewrite)

    @property
    def levels(self) -> list[DataFrame]:
        if self.made is None:
            self.made = descend(self.pieces, self.rewrite).levels
        return self.made

    def patches(self) -> DataFrame:
        each = self.rows.where("not odd").select(*PIECE, F.explode("patches").alias("e")).select(
            *PIECE, "e.ptr", "e.depth", "e.pass", "e.seq", "e.key", "e.value")
        return each if self.odd is None else each.unionByName(self.odd.patches())

    def fold(self) -> DataFrame:
        whole = self.rows.where("not odd").select(*PIECE, F.col("text").alias("body"))
        return whole if self.odd is None else whole.unionByName(self.odd.fold())


def _counted(pieces: DataFrame) -> DataFrame:
    """Canonical texts of the pieces (null: no JSON) and how many texts have the same key.

    Rows without a text are left to the walk: a filter here would be computed before the pieces are dealt, on the text itself.
    """
    text = pieces.withColumn("text", canonical(F.col("body"))).drop("body")
    return text.withColumn("copies", F.count("text").over(Window.partitionBy(*PIECE)))


def clean(pieces: DataFrame) -> Tree:
    """The cleaned documents with their patch table (passes 1 to 9, 11 and 14)."""
    pieces = pieces.select(*PIECE, "body")
    return Walk(pieces, clean_rules(), _counted(spread(pieces, "repo_id", "name")), W.clean_batches)


def one_pass(edits: Callable[[Column], Column], where: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A single pass as a rewriting of all objects (those that ``where`` holds for)."""
    found = F.col("m").isNotNull() if where is None else F.col("m").isNotNull() & where
    made = F.when(found, edits(F.col("m"))).otherwise(_none())
    return lambda level: level.withColumn("edits", made)


def replay(pieces: DataFrame, patches: DataFrame) -> Tree:
    """The pieces with a patch table put on: one keyed join, edits of an object in the order of (pass, seq)."""
    pieces = pieces.select(*PIECE, "body")
    grouped = patches.groupBy(*PIECE, "ptr").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pass", "seq", "key", "value"))),
        lambda e: F.struct(e["pass"].alias("pass"), e["key"].alias("key"), e["value"].alias("value"))).alias("edits"))

    def rewrite(level: DataFrame) -> DataFrame:
        return level.join(grouped, [*PIECE, "ptr"], "left").withColumn("edits", F.coalesce("edits", _none()))

    own = patches.groupBy(*PIECE).agg(F.collect_list(F.struct("ptr", "pass", "seq", "key", "value")).alias("patches"))
    return Walk(pieces, rewrite, _counted(spread(pieces, "repo_id", "name").join(own, PIECE, "left")), W.replay_batches)


# ---------------------------------------------------------------- references over pieces

def ref_nodes(nodes: DataFrame) -> DataFrame:
    """(repo_id, section, name, ptr, target, via_array): every object whose ``$ref`` names a schema."""
    holders = nodes.where("m is not null").withColumn("target", _ref_target(F.col("m"))).where("target is not null")
    return holders.select(*PIECE, "ptr", "depth", "target", F.col("ptr").endswith("/items").alias("via_array"))


def schema_names(pieces: DataFrame) -> DataFrame:
    return pieces.where("section = 'schemas'").select("repo_id", "name").distinct()


def _patch(rows: DataFrame, number: int, edits: list[tuple[str, Column | None]]) -> DataFrame:
    """Rows of (piece, ptr, depth) with the same list of edits as patches."""
    array = F.array(*[_edit(number, key, value) for key, value in edits])
    return rows.select(*PIECE, "ptr", "depth", F.posexplode(array).alias("seq", "e")).select(
        *PIECE, "ptr", "depth", F.col("e.pass").alias("pass"), "seq", "e.key", "e.value")


def cycle_patches(refs: DataFrame, cuts: DataFrame) -> DataFrame:
    """every ref along a cut edge ``(repo_id, src, dst)`` of the schemas becomes a stub that names the circle."""
    cut = cuts.select("repo_id", F.col("src").alias("name"), F.col("dst").alias("target")).distinct()
    hit = refs.where("section = 'schemas'").join(cut, ["repo_id", "name", "target"])
    return _patch(hit, 10, [("$ref", None), ("description", quote(F.concat(F.lit("Circular reference to "), "target"))),
                            ("type", F.lit('"object"')), ("x-circular-ref", quote(F.concat(F.lit(REF), "target")))])


def case_patches(refs: DataFrame, renames: DataFrame) -> DataFrame:
    """refs to a renamed schema ``(repo_id, actual, renamed_to)`` follow it."""
    hit = refs.join(renames.withColumnRenamed("actual", "target"), ["repo_id", "target"])
    return _patch(hit, 12, [("$ref", quote(F.concat(F.lit(REF), "renamed_to")))])


def rename_pieces(pieces: DataFrame, renames: DataFrame) -> DataFrame:
    """schemas under their new names; a schema that had the new name gives way."""
    r = renames.select("repo_id", F.col("actual").alias("name"), "renamed_to").withColumn("section", F.lit("schemas"))
    taken = renames.select("repo_id", F.lit("schemas").alias("section"), F.col("renamed_to").alias("name"))
    return pieces.join(taken, PIECE, "left_anti").join(r, PIECE, "left").withColumn(
        "name", F.coalesce("renamed_to", "name")).drop("renamed_to")


def dangling_patches(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs of paths to schemas that are not there become unresolved stubs."""
    hit = refs.where("section = 'paths'").join(names.withColumnRenamed("name", "target"), ["repo_id", "target"], "left_anti")
    return _patch(hit, 17, [("$ref", None), ("description", quote(F.concat(F.lit("Unresolved reference to "), "target"))),
                            ("type", F.lit('"object"')), ("x-unresolved", F.lit("true"))])


def unused_schemas(pieces: DataFrame, refs: DataFrame) -> DataFrame:
    """schemas that no ref of a path or schema names."""
    used = refs.select("repo_id", F.col("target").alias("name")).distinct()
    return schema_names(pieces).join(used, ["repo_id", "name"], "left_anti")


def schema_table(pieces: DataFrame) -> DataFrame:
    """One row a schema: its properties, required names and refs counted, and whether it was resolved."""
    m = members(F.col("body"))
    rows = spread(pieces.where("section = 'schemas'"), *PIECE).select("repo_id", "name", "body", m.alias("m"))
    count = lambda texts: F.coalesce(F.size(texts), F.lit(0)).cast("long")
    return rows.select(
        "repo_id", "name", count(F.map_keys(members(_get(F.col("m"), "properties")))).alias("n_properties"),
        count(elements(_get(F.col("m"), "required"))).alias("n_required"),
        count(F.regexp_extract_all("body", F.lit(r'"\$ref"\s*:'), 0)).alias("n_refs"),
        F.when(_truthy(_get(F.col("m"), "x-unresolved")), "unresolved").otherwise("resolved").alias("status"))
