"""A whole document rewritten in one walk: the passes of ``operators/document.py`` and the replay of their patches on parsed values.

One task holds one piece, as ``fold`` does.  The walk takes canonical texts whose values read the same in every
parser and sort the same in every engine: plain numbers, no control characters, nothing from U+D800 on.  Any other text
raises ``Odd`` and goes the way of tables, depth by depth.

Values are dicts, lists, strings, booleans, None and ``Num``, the text of a number.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute

from routelens.functions.hints import OPAQUE, PRIMITIVE_TYPES
from routelens.operators.spec import CONSTRAINT_RENAMES, JSON_SCHEMA_TYPES, STRING_VALUE_KEYS

REF = "#/components/schemas/"
PATCH = "array<struct<ptr:string,depth:int,pass:int,seq:int,key:string,value:string>>"
PATCH_TYPES = {"ptr": pa.string(), "depth": pa.int32(), "pass": pa.int32(), "seq": pa.int32(), "key": pa.string(), "value": pa.string()}
ALIASES = frozenset(alias for alias, _ in CONSTRAINT_RENAMES)
SPACE = " \t\n\x0b\f\r"
STARTS = frozenset("{[#" + SPACE)  # of strings that hold JSON or a ref
PLAIN = re.compile(r"-?(?:0|[1-9][0-9]{0,17})(?!\n)\Z|-?(?=[0-9.]{3,19}\Z)(?:0|[1-9][0-9]*)\.[0-9]*[1-9](?!\n)\Z")
ODD = re.compile("[\\x85\\u2028\\u2029\\ud800-\\U0010ffff]")
PLAIN_STRING = re.compile(r'"[^"\\\x00-\x1f]*"\Z')
NAME = re.compile(r"[A-Z][A-Za-z0-9_]*\Z")

quote = json.encoder.encode_basestring


class Odd(Exception):
    """A text that only the tables read right."""


class Num(str):
    __slots__ = ()


def _number(token: str) -> Num:
    if not (len(token) < 18 and token.isdigit() or token != "-0" and PLAIN.match(token)):
        raise Odd
    return Num(token)


def _no_constant(token: str) -> None:
    raise Odd


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Odd
    return out


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_number, parse_int=_number, parse_constant=_no_constant)


def parsed(text: str):
    if text.isascii() and PLAIN_STRING.match(text):
        return text[1:-1]
    if "\\u" in text or not text.isascii() and ODD.search(text):
        raise Odd
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        raise Odd from None


def written(v) -> str:
    """The canonical text of a value."""
    kind = type(v)
    if kind is str:
        return quote(v)
    if kind is dict:
        return "{" + ",".join([quote(k) + ":" + written(v[k]) for k in sorted(v)]) + "}"
    if kind is Num:
        return v
    if kind is list:
        return "[" + ",".join([written(x) for x in v]) + "]"
    return "null" if v is None else "true" if v else "false"


# ---------------------------------------------------------------- the passes: members -> edits (key, value), GONE: the member goes

GONE = object()
TRUE_LIKE = {"0", "0.0"}


def _truthy(v) -> bool:
    return bool(v) and not (type(v) is Num and v in TRUE_LIKE)


def leaked_hint(m: dict) -> list:
    if "ref_hint" not in m or "type" in m or "$ref" in m:
        return []
    hint = m["ref_hint"]
    return [(k, GONE) for k in sorted(m)] + [("$ref", REF + (hint if type(hint) is str else written(hint)))]


def _primitive(name: str) -> dict | None:
    found = PRIMITIVE_TYPES.get(name.lower())
    if found is None and ", " in name and all(p.strip(SPACE).lower() in PRIMITIVE_TYPES for p in name.split(",")):
        found = OPAQUE
    return None if found is None else parsed(found)


def primitive_ref(m: dict) -> list:
    ref = m.get("$ref")
    if type(ref) is not str or not ref.startswith(REF):
        return []
    inline = _primitive(ref[len(REF):])
    return [] if inline is None else [("$ref", GONE)] + [(k, inline[k]) for k in sorted(inline)]


def _property(v) -> dict:
    if v is None:
        return {"type": "string", "nullable": True}
    if v is True or v is False:
        return {"type": "boolean"}
    if type(v) is Num:
        return {"type": "number"}
    if type(v) is list:
        return {"type": "array", "items": {"type": "string"}}
    s = v.strip(SPACE)
    low = s.lower()
    if low in JSON_SCHEMA_TYPES:
        return {"type": low}
    if s.startswith(REF):
        return {"$ref": s}
    if s.startswith("{") and s.endswith("}"):
        return parsed(s)
    return {"$ref": REF + s} if NAME.match(s) else {"type": "string"}


def property_values(m: dict) -> list:
    return [(k, _property(m[k])) for k in sorted(k for k, v in m.items() if type(v) is not dict)]


def constraint_names(m: dict) -> list:
    if ALIASES.isdisjoint(m):
        return []
    out, taken = [], set()
    for alias, name in CONSTRAINT_RENAMES:
        if alias in m:
            if name not in m and name not in taken:
                out += [(alias, GONE), (name, m[alias])]
            taken.add(name)
    return out


def exclusive_bounds(m: dict) -> list:
    out = []
    for flag, bound in (("exclusiveMinimum", "minimum"), ("exclusiveMaximum", "maximum")):
        if type(m.get(flag)) is Num:
            out += [(bound, m[flag]), (flag, True)]
    return out


def json_strings(m: dict) -> list:
    out = []
    for k in sorted([k for k, v in m.items() if type(v) is str and v[:1] in STARTS and k not in STRING_VALUE_KEYS]):
        s = m[k].strip(SPACE)
        if s.startswith("{") and s.endswith("}") or s.startswith("[") and s.endswith("]"):
            out.append((k, parsed(s)))
        elif s.startswith(REF):
            out.append((k, {"$ref": s}))
    return out


def empty_required(m: dict) -> list:
    return [("required", GONE)] if m.get("required") == [] else []


def string_bounds(m: dict) -> list:
    if m.get("type") != "string" or type(m["type"]) is not str:
        return []
    out = []
    for bound, length in (("minimum", "minLength"), ("maximum", "maxLength")):
        if type(m.get(bound)) is Num and length not in m:
            out += [(bound, GONE), (length, Num(int(float(m[bound]))))]
    return out


def ref_siblings(m: dict) -> list:
    beside = "$ref" in m and len(m) > 1
    out = [("allOf", [{"$ref": m["$ref"]}]), ("$ref", GONE)] if beside else []
    if (beside or "allOf" in m) and "type" not in m and _truthy(m.get("nullable")):
        out.append(("type", "object"))
    return out


def array_items(m: dict) -> list:
    return [("items", {"type": "string"})] if m.get("type") == "array" and type(m["type"]) is str and "items" not in m else []


def nullable_type(m: dict) -> list:
    return [("type", "object")] if "type" not in m and "$ref" not in m and _truthy(m.get("nullable")) else []


# (number, members one of which an object must have to be edited, pass); no members: any object is looked at
HINT, PRIMITIVE = (1, frozenset({"ref_hint"}), leaked_hint), (2, frozenset({"$ref"}), primitive_ref)
VALUES = (3, None, property_values)
SCHEMA_PASSES = ((4, ALIASES, constraint_names), (5, frozenset({"exclusiveMinimum", "exclusiveMaximum"}), exclusive_bounds), (6, None, json_strings),
                 (7, frozenset({"required"}), empty_required), (8, frozenset({"minimum", "maximum"}), string_bounds),
                 (9, frozenset({"$ref", "allOf"}), ref_siblings))
LAST_PASSES = ((11, frozenset({"type"}), array_items), (14, frozenset({"nullable"}), nullable_type))


def _passes(schema: bool, props: bool, late: bool, settled: bool) -> tuple:
    early = () if late else (HINT,) if settled else (HINT, PRIMITIVE)
    return early + ((VALUES,) if schema and props else ()) + (SCHEMA_PASSES if schema else ()) + LAST_PASSES


PASSES = {flags: _passes(*flags) for flags in itertools.product((False, True), repeat=4)}


def _put(m: dict, edits: list) -> None:
    for key, value in edits:
        if value is GONE:
            m.pop(key, None)
        else:
            m[key] = value


def _escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def clean(section: str | None, text: str) -> tuple[str, list]:
    """The cleaned text and its patches (ptr, depth, pass, seq, key, value)."""
    schema, log = section == "schemas", []

    def walk(v, ptr: str, depth: int, props: bool, late: bool, settled: bool) -> None:
        if type(v) is list:
            for i, x in enumerate(v):
                if type(x) in (dict, list):
                    walk(x, f"{ptr}/{i}", depth + 1, False, late, settled)
            return
        seq, read = 0, ()
        for number, need, find in PASSES[schema, props, late, settled]:
            if need and need.isdisjoint(v):
                continue
            edits = find(v)
            if edits:
                _put(v, edits)
                for key, value in edits:
                    log.append((ptr, depth, number, seq, key, None if value is GONE else written(value)))
                    seq += 1
                if number == 2:
                    settled = True
                elif number in (3, 6):
                    read = {*read, *(key for key, _ in edits)}
        for k, x in v.items():
            if type(x) in (dict, list):
                walk(x, f"{ptr}/{_escape(k)}", depth + 1, not props and k == "properties", late or k in read, settled)

    root = parsed(text)
    if type(root) in (dict, list):
        walk(root, "", 0, False, False, False)
    return written(root), log


def _order(e: tuple) -> tuple:
    return tuple((x is not None, x) for x in e)


def replay(text: str, patches: list[tuple]) -> str:
    """The text with patches ``(ptr, pass, seq, key, value)`` put on, those of an object in the order of (pass, seq)."""
    at: dict[str, list] = {}
    for ptr, *e in patches:
        if ptr is None or e[2] is None:
            raise Odd
        at.setdefault(ptr, []).append(e)

    def walk(v, ptr: str) -> None:
        if type(v) is list:
            for i, x in enumerate(v):
                if type(x) in (dict, list):
                    walk(x, f"{ptr}/{i}")
            return
        edits = at.get(ptr)
        if edits:
            if len(edits) > 1:
                edits.sort(key=_order)
            _put(v, [(key, GONE if value is None else parsed(value)) for _, _, key, value in edits])
        for k, x in v.items():
            if type(x) in (dict, list):
                walk(x, f"{ptr}/{_escape(k)}")

    root = parsed(text)
    if type(root) in (dict, list):
        walk(root, "")
    return written(root)


def _patch_column(logs: list) -> pa.Array:
    offsets, rows = [0], []
    for log in logs:
        rows += log
        offsets.append(len(rows))
    columns = [*zip(*rows)] or [()] * len(PATCH_TYPES)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, PATCH_TYPES.values())], names=[*PATCH_TYPES])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _patch_lists(column: pa.ListArray) -> list[list[tuple]]:
    """The patches of every row; a column at a time, which costs less than a row at a time."""
    flat = column.flatten()
    rows = [*zip(*(field.to_pylist() if field.null_count and not pa.types.is_string(field.type) else field.to_numpy(zero_copy_only=False).tolist()
                   for field in flat.flatten()))]
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).to_pylist()
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


def _walked(batches: Iterator[pa.RecordBatch], one: Callable[..., tuple[str, list]], own: Callable[[pa.RecordBatch], list]) -> Iterator[pa.RecordBatch]:
    """Batches of (repo_id, section, name, text, copies, ...) as (piece, text, patches, odd); odd rows keep their text, rows without one go.

    ``one`` takes a row's text and what ``own`` finds for it in the batch.
    """
    for batch in batches:
        texts, logs, odd = [], [], []
        batch = batch.filter(batch.column("text").is_valid())
        for text, copies, mine in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist(), own(batch)):
            try:
                if copies > 1:  # pieces of one key meet in one document
                    raise Odd
                made, log = one(text, mine)
            except (Odd, RecursionError):
                made, log = text, None
            texts.append(made)
            logs.append(log or ())
            odd.append(log is None)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("repo_id", "section", "name")), pa.array(texts, pa.string()), _patch_column(logs), pa.array(odd, pa.bool_())],
            names=["repo_id", "section", "name", "text", "patches", "odd"])


def clean_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _walked(batches, lambda text, section: clean(section, text), lambda batch: batch.column("section").to_pylist())


def replay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _walked(batches, lambda text, patches: (replay(text, patches), []), lambda batch: _patch_lists(batch.column("patches")))
