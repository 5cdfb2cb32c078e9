"""Arrays, vectors and JSON as Column builders."""

import json as _json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# --- arrays: 1-based, inclusive slices, null where an element is absent ---


def array_append(a, x):
    """A null array counts as empty."""
    return F.concat(F.coalesce(_c(a), F.array()), F.array(_c(x)))


def array_prepend(x, a):
    return F.concat(F.array(_c(x)), F.coalesce(_c(a), F.array()))


def array_get(a, n: int):
    return F.try_element_at(_c(a), F.lit(n)) if n > 0 else F.lit(None)


def array_slice(a, start: int, end: int):
    low = max(start, 1)
    return F.slice(_c(a), low, end - low + 1) if end >= low else F.when(_c(a).isNotNull(), F.filter(_c(a), lambda _: F.lit(False)))


def array_position(a, x):
    return F.nullif(F.array_position(_c(a), _c(x)), F.lit(0).cast("long"))


def array_contains_all(a, b):
    return F.size(F.array_except(_c(b), _c(a))) == 0


def array_remove(a, x):
    return F.filter(_c(a), lambda v: ~v.eqNullSafe(_c(x)))


def array_upper(a):
    """The highest index; null for an empty array."""
    return F.when(F.size(_c(a)) > 0, F.size(_c(a)))


def array_compare(a, b):
    """-1, 0 or 1: by the first elements that differ, then by length."""
    return F.when(_c(a) < _c(b), -1).when(_c(a) > _c(b), 1).when(_c(a) == _c(b), 0)


def array_from_text(x):
    """An array of texts from {a,b} or a JSON array."""
    x = F.trim(_c(x))
    inner = F.regexp_extract(x, r"(?s)^\{(.*)\}$", 1)
    listed = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda v: F.when(F.trim(v) != "NULL", F.regexp_replace(F.trim(v), '^"(.*)"$', "$1"))))
    return F.when(x.startswith("{"), listed).otherwise(F.from_json(x, "array<string>"))


def array_overlap(a, b):
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False))


def array_length(a):
    return F.when(_c(a).isNotNull(), F.size(_c(a)))


def string_to_array(x, delimiter: str | None, null: str | None = None):
    import re

    parts = F.split(_c(x), "" if delimiter is None else re.escape(delimiter)) if delimiter != "" else F.array(_c(x))
    return parts if null is None else F.transform(parts, lambda p: F.when(p != null, p))


def array_to_string(a, delimiter: str, null: str | None = None):
    return F.array_join(_c(a), delimiter) if null is None else F.array_join(_c(a), delimiter, null)


def array_agg(x, order):
    """Keeps nulls; in the order given; null for no rows."""
    kept = F.array_sort(F.collect_list(F.struct(_c(order).alias("k"), _c(x).alias("x"))))
    return F.when(F.count("*") > 0, F.transform(kept, lambda s: s["x"]))


# --- vectors ---


def _double(v):
    return F.transform(_c(v), lambda x: x.cast("double"))


def _same(a, b, value):
    return F.when(F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different dimensions")).isNull(), value)


def _sum(v):
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b):
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def distance_dot(a, b):
    return _same(_c(a), _c(b), -dot(a, b))


def distance_l2(a, b):
    return _same(_c(a), _c(b), F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def distance_cos(a, b):
    """1 - cosine; 0 if a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return _same(_c(a), _c(b), F.when(norm == 0, F.lit(0.0)).otherwise(1 - dot(a, b) / F.nullif(norm, F.lit(0.0))))


def distance_jaccard(a, b):
    """1 - sum of least over sum of greatest."""
    low, high = (_sum(F.zip_with(_double(a), _double(b), f)) for f in (lambda x, y: F.least(x, y), lambda x, y: F.greatest(x, y)))
    return _same(_c(a), _c(b), F.when(high == 0, F.lit(0.0)).otherwise(1 - low / F.nullif(high, F.lit(0.0))))


def vector(text, kind: str = "float"):
    return F.from_json(_c(text), f"array<{kind}>")


def vector_extract(v):
    return F.to_json(_c(v))


def vector_slice(v, start: int, end: int):
    """0-based, the end left out."""
    return F.slice(_c(v), start + 1, end - start)


def vector_concat(a, b):
    return F.concat(_c(a), _c(b))


def vector_bits(v):
    """1-bit codes: whether each component is above 0, as 0 and 1."""
    return F.transform(_c(v), lambda x: (x > 0).cast("int"))


def distance_hamming(a, b):
    """Of 1-bit codes: places that differ."""
    return _same(_c(a), _c(b), F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x))


def vector_sparse(v):
    """The places (from 0) and values of the components other than 0, and the dimension."""
    pairs = F.filter(F.transform(_c(v), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.size(_c(v)).alias("dimension"), F.transform(pairs, lambda p: p["i"]).alias("places"), F.transform(pairs, lambda p: p["x"]).alias("weights"))


def vector_dense(s):
    """A sparse vector's components."""
    s = _c(s)
    at = F.map_from_arrays(s["places"], s["weights"])
    return F.when(s["dimension"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(s["dimension"] - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(at, i).cast("double"), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))


def vector_quantised(v):
    """8-bit codes, with the scale and least value to read them: code * scale + least."""
    v = _double(v)
    low, high = F.array_min(v), F.array_max(v)
    scale = (high - low) / 255
    return F.struct(F.transform(v, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.round((x - low) / F.nullif(scale, F.lit(0.0)))).cast("short")).alias("codes"), scale.alias("scale"), low.alias("least"))


# --- JSON ---


def json_get(x, path: str):
    """->>: the value at a path as text; [#-N] counts from an array's end."""
    x = _c(x)
    if "[#-" in path:
        head, _, rest = path.partition("[#-")
        n, _, tail = rest.partition("]")
        inner = F.get_json_object(x, head)
        item = F.try_element_at(F.from_json(inner, "array<string>"), F.lit(-int(n)))
        return json_get(item, "$" + tail) if tail else item
    return F.get_json_object(x, path)


def json_valid(x):
    x = _c(x)
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("int"))


def json_type(x, path: str = "$"):
    """The JSON type of the value at a path: null, true, false, integer, real, text, array or object."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(_c(x)), path, "variant"))
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "text").when(kind == "VOID", "null").when(kind == "BIGINT", "integer")
        .when(kind == "BOOLEAN", F.try_variant_get(F.try_parse_json(_c(x)), path, "string")).when(kind.isNotNull(), "real")
    )


def json_quote(x):
    """A text as a JSON string."""
    return F.substring(F.to_json(F.array(_c(x))), F.lit(2), F.char_length(F.to_json(F.array(_c(x)))) - 2)


def json_array_length(x, path: str = "$"):
    return F.coalesce(F.json_array_length(F.get_json_object(_c(x), path)), F.when(F.get_json_object(_c(x), path).isNotNull(), 0)).cast("long")


def json_group_array(x, order):
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(_c(order).alias("k"), _c(x).alias("x")))), lambda s: s["x"]))


def _json_text(x):
    """A scalar as JSON text: null, a quoted text, else as it is."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def json_group_object(key, value):
    """Text of an object; equal keys all stay, ordered by key. Values by their type: texts are quoted."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(key).cast("string").alias("k"), _json_text(_c(value)).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_quote(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


class Json:
    """A column that a JSON function returned: passed directly to another, it is embedded; as plain text it is quoted."""

    def __init__(self, column):
        self.column = column


def json(x) -> Json:
    """Minified JSON."""
    return Json(F.to_json(F.parse_json(_c(x))))


def _member(x):
    return x.column if isinstance(x, Json) else F.lit("null") if x is None else _json_text(x if isinstance(x, Column) else F.lit(x))


def json_array(*xs) -> Json:
    return Json(F.concat(F.lit("["), F.concat_ws(",", *map(_member, xs)), F.lit("]")))


def json_object(*pairs) -> Json:
    """Of names and values in turn."""
    members = [F.concat(_member(k), F.lit(":"), _member(v)) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return Json(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))


def text_of(x):
    """What a query returns of a JSON value."""
    return x.column if isinstance(x, Json) else x


def json_path(path: str) -> str:
    """A path with quoted keys as Spark reads it."""
    import re

    return re.sub(r'\."([^"]*)"', r"['\1']", path)


def json_extract(x, *paths: str):
    """One path: the SQL value as text; several: a JSON array of the values."""
    if len(paths) == 1:
        return json_get(x, json_path(paths[0]))
    return F.concat(F.lit("["), F.concat_ws(",", *(json_arrow(x, p) for p in paths)), F.lit("]"))


def json_arrow(x, path: str):
    """->: the value at a path as JSON text; null if there is none."""
    value, kind = json_get(x, json_path(path)), json_type(x, json_path(path))
    return F.when(kind == "text", json_quote(value)).when(kind == "null", F.lit("null")).otherwise(value)


def merge_patch(target, patch):
    """RFC 7396 on Python values."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def path_steps(path: str) -> list:
    import re

    steps: list = []
    for quoted, key, end, at in re.findall(r'\."([^"]*)"|\.([^.\[]+)|\[#-?(\d*)\]|\[(\d+)\]', path.removeprefix("$")):
        steps.append(int(at) if at else (("end", int(end or 0)) if not quoted and not key else quoted or key))
    return steps


def edit(doc, path: str, value, mode: str):
    """insert (only new), replace (only present), set (both) or remove at a path of a parsed document."""
    steps = path_steps(path)
    if not steps:
        return None if mode == "remove" else value if mode != "insert" else doc
    at = doc
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        if isinstance(at, list):
            i = len(at) - step[1] if isinstance(step, tuple) else step
            if not isinstance(i, int) or i < 0 or i > len(at) or (not last and i == len(at)):
                return doc
            if last:
                if i < len(at):
                    if mode == "remove":
                        del at[i]
                    elif mode != "insert":
                        at[i] = value
                elif mode in ("insert", "set"):
                    at.append(value)
                return doc
            at = at[i]
        elif isinstance(at, dict) and isinstance(step, str):
            if last:
                if step in at:
                    if mode == "remove":
                        del at[step]
                    elif mode != "insert":
                        at[step] = value
                elif mode in ("insert", "set"):
                    at[step] = value
                return doc
            if step not in at:
                return doc
            at = at[step]
        else:
            return doc
    return doc


def _arrow_text(function):
    import pandas as pd

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else _json.dumps(function(_json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run


def json_set(x, path: str, value):
    return _arrow_text(lambda d: edit(d, path, value, "set"))(_c(x))


def json_insert(x, path: str, value):
    return _arrow_text(lambda d: edit(d, path, value, "insert"))(_c(x))


def json_replace(x, path: str, value):
    return _arrow_text(lambda d: edit(d, path, value, "replace"))(_c(x))


def json_remove(x, *paths: str):
    def run(d):
        for p in paths:
            d = edit(d, p, None, "remove")
        return d

    return _arrow_text(run)(_c(x))


def json_patch(x, patch: str):
    return _arrow_text(lambda d: merge_patch(d, _json.loads(patch)))(_c(x))


def json_pretty(x):
    import pandas as pd

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if v is None else _json.dumps(_json.loads(v), indent=4, ensure_ascii=False))

    return run(_c(x))


# --- binary JSON: Spark's variant ---


def jsonb(x):
    return F.parse_json(_c(x))


def jsonb_extract(v, path: str):
    """The value at a path, as a variant; null if there is none."""
    return F.try_variant_get(_c(v), json_path(path), "variant")


def jsonb_text(v):
    return F.to_json(_c(v))


def json_error_position(x):
    """0 for valid JSON, else 1: Spark does not say where a text stops being JSON."""
    return F.when(_c(x).isNotNull(), 1 - json_valid(x))
