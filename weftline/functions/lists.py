"""Array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(a: Column) -> Column:
    """Mean of the elements that are not null; null without any."""
    known = F.array_compact(a)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def zip_shortest(names: Sequence[str], *arrays: Column) -> Column:
    """Structs of elements at the same place, as far as the shortest array goes (arrays_zip pads with null)."""
    n = F.least(*[F.size(a) for a in arrays])
    return F.transform(F.slice(arrays[0], F.lit(1), n), lambda _, k: F.struct(*[F.get(a, k).alias(c) for c, a in zip(names, arrays, strict=True)]))


def first_seen(a: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(a)


def ordered(value: Column, *order: Column) -> Column:
    """Aggregate: the group's values in order of `order`."""
    keyed = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"])


def ordered_concat(value: Column, separator: str, *order: Column) -> Column:
    """Aggregate: strings in order, joined; null ones are skipped."""
    return F.array_join(ordered(value, *order), separator)


def first_by(value: Column, order: Column) -> Column:
    return F.min_by(value, order)


def roots(nodes: Column) -> Column:
    """Nodes without causes: none listed, and in no other node's effects."""
    effects = F.flatten(F.transform(nodes, lambda n: F.coalesce(n["caused"], F.array().cast("array<string>"))))
    return F.filter(nodes, lambda n: (F.coalesce(F.size(n["caused_by"]), F.lit(0)) <= 0) & ~F.coalesce(F.array_contains(effects, n["id"]), F.lit(False)))


def relationships(node_id: Column, caused: Column, caused_by: Column) -> Column:
    """array<struct<source, target>> of a node's effects, then of its causes; null without any."""
    none = F.array().cast("array<string>")
    out = F.concat(
        F.transform(F.coalesce(caused, none), lambda c: F.struct(node_id.alias("source"), c.alias("target"))),
        F.transform(F.coalesce(caused_by, none), lambda c: F.struct(c.alias("source"), node_id.alias("target"))),
    )
    return F.when(F.size(out) > 0, out)
