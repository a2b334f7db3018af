"""Column functions: shared ids, escaping, name tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Library types whose methods are not looked up in the project.
BUILTIN_TYPES = [
    "Boolean", "Character", "Byte", "Short", "Integer", "Long", "Float", "Double",
    "List", "Queue", "Deque", "Set", "SortedSet", "NavigableSet", "Map",
    "ArrayList", "LinkedList", "ArrayDeque", "HashSet", "TreeSet", "LinkedHashSet", "PriorityQueue", "HashMap", "TreeMap",
]


def is_builtin(type_name: Column) -> Column:
    """The first identifier of a type is a library type."""
    return F.regexp_extract(type_name, r"^\s*([\w$]+)", 1).isin(BUILTIN_TYPES)


def is_usable(expression: Column) -> Column:
    """An expression that names something: no literal mark, operator, call, index or initialiser."""
    return ~expression.rlike(r"^[$+!~<-]") & ~expression.rlike(r"([)\]}]|\+\+|--)$")


def infix(prefix: Column) -> Column:
    """Infix text of an array of prefix tokens over ``+ - * /``; the last operand alone if operands are missing."""
    push = lambda stack, x: F.concat(F.array(x), stack)
    two = lambda stack, x: F.concat(
        F.array(F.concat(F.lit("("), F.get(stack, F.lit(0)), x, F.get(stack, F.lit(1)), F.lit(")"))), F.slice(stack, 3, F.greatest(F.size(stack) - 2, F.lit(0)))
    )
    step = lambda stack, x: F.when(x.isin("+", "-", "*", "/") & (F.size(stack) >= 2), two(stack, x)).otherwise(push(stack, x))
    return F.get(F.aggregate(F.reverse(prefix), F.array().cast("array<string>"), step), F.lit(0))


def shared_id(context: Column, start: Column, stop: Column) -> Column:
    """The key that joins nodes of one syntax element across graphs."""
    return F.md5(F.concat(context, start.cast("string"), stop.cast("string")))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def changes_state(method: Column) -> Column:
    """A method whose name says that it alters its object."""
    return F.lower(method).rlike("^(set|put|add|insert|push|append)")


def capitalise(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))


def last_segment(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)
