"""How a line's share of a bridge leg comes about: operands with roles and units, and an expression over them.

A leg is a small tree of operators over columns. The same tree is written with the columns' names, written with the
line's values, and evaluated, so what is shown cannot differ from what is computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.bridge import LEGS, PRICE_FIRST, VOLUME_FIRST

Tree = str | tuple
VALUE = "decimal(28,8)"
UNITS = {"sign": "factor", "plan_quantity": "units", "actual_quantity": "units", "plan_unit_price": "currency per unit",
         "actual_unit_price": "currency per unit", "plan_fx": "USD per currency", "actual_fx": "USD per currency",
         "actual_amount": "currency", "node_price": "USD per unit"}


def tree_of(leg: str, convention: str = VOLUME_FIRST) -> Tree:
    """The operators behind one leg, the line's sign first."""
    late = convention == PRICE_FIRST
    quantity, price = ("plan_quantity", "actual_unit_price") if late else ("actual_quantity", "plan_unit_price")
    more, dearer = ("-", "actual_quantity", "plan_quantity"), ("-", "actual_unit_price", "plan_unit_price")
    body = {
        "price": (dearer, quantity, "plan_fx"), "rate": (dearer, quantity, "plan_fx"),
        "efficiency": (more, price, "plan_fx"), "volume": (more, "node_price"),
        "mix": (more, ("-", ("*", price, "plan_fx"), "node_price")),
        "fx": ("actual_amount", ("-", "actual_fx", "plan_fx")),
    }
    if leg not in LEGS:
        raise ValueError(f"{leg!r} is not a bridge leg; one of {', '.join(LEGS)}")
    return ("*", "sign", *body[leg])


def operands(tree: Tree) -> list[str]:
    """The columns of a tree in the order they are read, each once."""
    if isinstance(tree, str):
        return [tree]
    return list(dict.fromkeys(name for part in tree[1:] for name in operands(part)))


def written(tree: Tree, leaf, inner: bool = False) -> Column:
    """The tree as text, ``leaf(name)`` in place of each column; what binds less stands in brackets."""
    if isinstance(tree, str):
        return leaf(tree)
    parts = [written(part, leaf, tree[0] != part[0]) for part in tree[1:]]
    text = F.concat_ws(f" {tree[0]} ", *parts)
    return F.concat(F.lit("("), text, F.lit(")")) if inner else text


def evaluated(tree: Tree) -> Column:
    """The tree's value as a double."""
    if isinstance(tree, str):
        return F.col(tree).cast("double")
    apply = {"*": lambda a, b: a * b, "-": lambda a, b: a - b}[tree[0]]
    return reduce(apply, map(evaluated, tree[1:]))


def applies(leg: str) -> Column:
    """Rate and efficiency are effects of cost lines, exchange rates of all, the others of revenue lines."""
    cost = F.col("is_cost")
    return F.lit(True) if leg == "fx" else cost if leg in ("rate", "efficiency") else ~cost


def shown(name: str) -> Column:
    return F.col(name).cast("string")


def calculation(rows: DataFrame, leg: str, convention: str = VOLUME_FIRST) -> DataFrame:
    """Rows of ``bridge.contributions`` with the expression of their leg, by name and by value, and what it gives.

    Where the leg has no effect on the kind of account the three are NULL.
    """
    tree, here = tree_of(leg, convention), applies(leg)
    return rows.withColumns({
        "applies": here,
        "expression": F.when(here, written(tree, F.lit)),
        "by_value": F.when(here, written(tree, shown)),
        "result": F.when(here, evaluated(tree)),
    })


def operand_rows(rows: DataFrame, keys: list[str], leg: str, convention: str = VOLUME_FIRST) -> DataFrame:
    """One row per line of ``bridge.contributions`` and operand of its leg: place, role, value, unit."""
    listed = F.posexplode(F.array(*[
        F.struct(F.lit(name).alias("role"), F.col(name).cast(VALUE).alias("value"), F.lit(UNITS[name]).alias("unit"))
        for name in operands(tree_of(leg, convention))])).alias("place", "o")
    return rows.filter(applies(leg)).select(*keys, listed).select(*keys, "place", "o.role", "o.value", "o.unit")
