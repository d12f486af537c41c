"""Objects kept as maps or JSON text (W5 external_id_merge, F10).

``merge_objects`` is a map aggregate: of every map key the last non-null value
by arrival. It is two hash aggregations with map-side partial ones, so a key
that a third of all rows share never lands whole in one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# how deep nested values are compared; deeper ones must be equal as text
MAX_DEPTH = 3


def merge_objects(rows: DataFrame, key: str, column: str, state: DataFrame | None = None) -> DataFrame:
    """Per ``key`` the map of the last non-null value of every map key.

    ``rows`` has ``key``, the map ``column`` and ``seq``. ``state`` (key,
    column) comes before all rows. Keys of null or empty maps only are left out.
    """
    each = rows.select(key, "seq", F.explode(column).alias("_k", "_v"))
    if state is not None:
        nothing = F.lit(None).cast(rows.schema["seq"].dataType)
        each = each.unionByName(state.select(key, nothing.alias("seq"), F.explode(column).alias("_k", "_v")))
    # the state's null seq sorts before every message
    order = F.struct(F.col("seq").isNotNull().alias("is_message"), "seq")
    last = each.where("_v is not null").groupBy(key, "_k").agg(F.max_by("_v", order).alias("_v"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(column))


def object_concat(left: Column, right: Column) -> Column:
    """F10 concatenation: the right side wins per key, whatever the session's policy for equal keys is."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def _members(text: Column) -> Column:
    """JSON object -> map of JSON texts, strings still quoted."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.to_json(v))


def _items(text: Column) -> Column:
    return F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))


def json_contains(outer: Column, inner: Column, depth: int = MAX_DEPTH) -> Column:
    """F10 containment over JSON text: every member of an inner object is in
    the outer one and contains its value; every item of an inner array is
    contained in some item of the outer one; scalars are equal. Null or broken
    text contains nothing and is in nothing."""
    def inside(o: Column, i: Column, left: int) -> Column:
        same = o == i
        if not left:
            return same
        both = lambda c: F.startswith(F.ltrim(o), F.lit(c)) & F.startswith(F.ltrim(i), F.lit(c))
        members = F.forall(F.map_entries(_members(i)), lambda e: F.map_contains_key(_members(o), e["key"]) & inside(
            F.try_element_at(_members(o), e["key"]), e["value"], left - 1))
        items = F.forall(_items(i), lambda x: F.exists(_items(o), lambda y: inside(y, x, left - 1)))
        return F.when(both("{"), members).when(both("["), items).otherwise(same)
    plain = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(inside(plain(outer), plain(inner), depth), F.lit(False))


def contains_value(outer: Column, wanted) -> Column:
    """F10 containment of a given value (``json.loads`` types) in a VARIANT:
    the same rules as ``json_contains``, to any depth, by paths that are known
    beforehand, so each row's text is parsed once whatever is asked of it."""
    def inside(v: Column, x, path: str = "$") -> Column:
        at = F.try_variant_get(v, path, "variant")
        kind = F.coalesce(F.schema_of_variant(at), F.lit(""))
        if isinstance(x, dict):
            if any("'" in k for k in x):
                raise ValueError("a key with a quote cannot be asked for")
            return reduce(lambda a, b: a & b, [inside(v, y, f"{path}['{k}']") for k, y in x.items()],
                          F.startswith(kind, F.lit("OBJECT")))
        if isinstance(x, list):
            items = F.try_variant_get(v, path, "array<variant>")
            return reduce(lambda a, b: a & b, [some(items, y) for y in x],
                          F.startswith(kind, F.lit("ARRAY")))
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, path, "double") == float(x))
        return F.coalesce(F.to_json(at) == json.dumps(x, ensure_ascii=False), F.lit(False))

    def some(items: Column, x) -> Column:
        return F.exists(items, lambda w: inside(w, x))
    return F.coalesce(inside(outer, wanted), F.lit(False))
