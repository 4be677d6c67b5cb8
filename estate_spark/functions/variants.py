"""Reading loosely shaped JSON: typed wrappers, references, first usable field.

A field is handled as VARIANT while types matter (the text "0" counts as a
value, the number 0 does not) and turned into text at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from estate_spark.functions.text import blank_to_null, title_case

# Fixed pattern: JSON texts that count as "no value".
EMPTY_JSON = r'^(null|false|""|\{\}|\[\]|-?0+(\.0+)?([eE][+-]?\d+)?)$'
# Fixed pattern: values whose plain text may stand for such a JSON text; the text "0" and the number 0 look alike here.
MAYBE_EMPTY = r"^(null|false|\{\}|\[\]|[-+]?0*(\.0*)?([eE][+-]?\d+)?)$"
# An object with one of these keys is not empty.
OBJECT_KEYS = ("__typename", "__ref")

# Where a value may sit inside an unknown wrapper, in this order.
WRAPPED_KEYS = ("value", "amount", "name", "code", "label")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def fields_of(v: Column, names: Sequence[str]) -> Column:
    """The named fields of an object as one struct of variants, read in a single pass."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def usable(v: Column) -> Column:
    """The value unless it is absent, null, zero, false or empty.

    Writing a value as JSON is dear: only what its keys and plain text leave open is written.
    """
    filled = lambda x: [at(x, key).isNotNull() for key in OBJECT_KEYS]
    plain = lambda x: ~F.rlike(text_of(x), F.lit(MAYBE_EMPTY))
    whole = lambda x: ~F.rlike(F.to_json(x), F.lit(EMPTY_JSON))
    return let(v, lambda x: F.when(functools.reduce(Column.__or__, [*filled(x), plain(x), whole(x)]), x))


def first_usable(*values: Column) -> Column:
    """First usable value; the last one is taken whatever it holds."""
    *head, last = values
    return F.coalesce(*[usable(v) for v in head], last)


def follow(v: Column, cache: Column) -> Column:
    """Object behind ``{"__ref": key}``; the value itself when it is no reference or unknown."""
    return let(v, lambda x: F.coalesce(F.try_element_at(cache, at(x, "__ref", "string")), x))


def _by_kind(o: Column, whole: Column) -> Column:
    filled = lambda c: let(text_of(c), blank_to_null)
    name = filled(o["name"])
    code = text_of(o["code"])
    generic = F.to_json(whole)
    for key in reversed(WRAPPED_KEYS):
        generic = F.when(o[key].isNotNull(), text_of(o[key])).otherwise(generic)

    def chosen(kind: Column) -> Column:
        return (
            F.when(kind == "Money", text_of(o["amount"]))
            .when(kind == "HousingForm", F.coalesce(name, title_case(code)))
            .when(kind == "Tenure", F.coalesce(name, title_case(F.replace(code, F.lit("_"), F.lit(" ")))))
            .when(kind == "Location", F.coalesce(filled(o["fullName"]), name))
            .when(kind == "Coordinate", F.to_json(whole))
            .otherwise(generic)
        )

    return let(text_of(o["__typename"]), chosen)


def unwrap(v: Column, cache: Column | None = None) -> Column:
    """Text of a value that may be wrapped in a typed object or behind a reference."""
    target = v if cache is None else follow(v, cache)

    def read(t: Column) -> Column:
        parts = fields_of(t, ("__typename", "fullName", *WRAPPED_KEYS))
        return let(parts, lambda o: F.when(o.isNull(), text_of(t)).otherwise(_by_kind(o, t)))

    return let(target, read)
