"""Walking JSON documents level by level, inside the row that holds them.

A document is a variant. Its nodes are gathered from the top down: the children of all open nodes are the next level,
and nodes that a caller prunes have no children. A document is one value, so a walk needs no shuffle and no recursion
limit; it ends when no node is open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE = "struct<path:string,key:string,value:variant>"
_NODES = f"array<{_NODE}>"


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def is_integer(value: Column) -> Column:
    """Whole numbers of 64 bits, not booleans, nor numbers with a point."""
    return F.schema_of_variant(value) == "BIGINT"


def field(value: Column, name: str, kind: str) -> Column:
    """A field of an object as a type; null where the value is none, has no such field, or one of another form."""
    return F.try_variant_get(value, f"$.{name}", kind)


def flag(value: Column, name: str) -> Column:
    """Whether a field of an object is true itself, and not text that says so."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.coalesce((F.schema_of_variant(found) == "BOOLEAN") & F.try_variant_get(found, "$", "boolean"), F.lit(False))


def text(value: Column, name: str) -> Column:
    """A field of an object if it is a string."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def whole(value: Column, name: str) -> Column:
    """A field of an object if it is a whole number."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(is_integer(found), F.try_variant_get(found, "$", "bigint"))


def _children(node: Column) -> Column:
    """The nodes below one: an object's fields, under its path and their name; a list's elements, under its own path and key."""
    fields = F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>"))
    below = lambda e: F.struct(F.concat(node["path"], F.when(node["path"] == "", "").otherwise(" / "), e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("value"))
    elements = F.try_variant_get(node["value"], "$", "array<variant>")
    own = lambda v: F.struct(node["path"].alias("path"), node["key"].alias("key"), v.alias("value"))
    return F.coalesce(F.transform(fields, below), F.transform(elements, own), F.array().cast(_NODES))


def nodes(document: Column, depth: Column, pruned: Callable[[Column], Column], path: Column | None = None) -> Column:
    """All nodes of a variant, array<struct<path, key, value>>, from the top; below pruned ones none. Null documents have no nodes.

    path names the top node, '' by default; depth is the number of levels or more.
    """
    top = F.struct((F.lit("") if path is None else path).alias("path"), F.lit("").alias("key"), document.alias("value")).cast(_NODE)
    start = F.struct(F.filter(F.array(top), lambda n: n["value"].isNotNull()).cast(_NODES).alias("open"), F.array().cast(_NODES).alias("seen"))

    def step(so_far: Column, _: Column) -> Column:
        inner = F.filter(so_far["open"], lambda n: ~F.coalesce(pruned(n), F.lit(False)))
        return F.struct(F.flatten(F.transform(inner, _children)).cast(_NODES).alias("open"), F.concat(so_far["seen"], so_far["open"]).cast(_NODES).alias("seen"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), start, step, lambda x: x["seen"])


def levels(json: Column) -> Column:
    """The number of levels of a JSON text: how deep its brackets go, strings apart, and one for values."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(so_far: Column, c: Column) -> Column:
        now = so_far["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(so_far["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda x: x["most"]) + 1
