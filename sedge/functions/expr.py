"""Expressions: what a lambda over an entity records.  Small frozen nodes; the binder turns them into Columns."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from sedge.errors import TranslationError

_scopes = itertools.count(1)


@dataclass(frozen=True)
class Field:
    """A value by its path from the entity of one scope."""

    path: tuple[str, ...]
    scope: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Cased:
    """lower or upper of a value."""

    name: str
    of: Any


@dataclass(frozen=True)
class ChildCount:
    """Number of rows behind a to-many navigation."""

    nav: Field


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Junction:
    """All (`and`) or any (`or`) of the parts."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Negation:
    of: Any


@dataclass(frozen=True)
class NullTest:
    of: Any
    negated: bool = False


@dataclass(frozen=True)
class Match:
    """starts, ends, contains (literal, case-sensitive) or like (a SQL pattern)."""

    kind: str
    of: Any
    pattern: str


@dataclass(frozen=True)
class Member:
    of: Any
    values: tuple


@dataclass(frozen=True)
class Truth:
    value: bool


@dataclass(frozen=True)
class Children:
    """Whether any (or all) rows behind a to-many navigation fulfil a predicate."""

    nav: Field
    mode: str
    predicate: Any = None


class Predicate:
    """A recorded condition; combined with & | ~."""

    def __init__(self, node):
        self.node = node

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(conjunction([self.node, _condition(other)]))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(Junction("or", (*_parts(self.node, "or"), *_parts(_condition(other), "or"))))

    def __invert__(self) -> Predicate:
        return Predicate(Negation(self.node))

    def __bool__(self) -> bool:
        raise TranslationError("a condition has no truth value while a query is built; use & | ~ in place of and, or, not")


def _parts(node, op: str) -> tuple:
    return node.parts if isinstance(node, Junction) and node.op == op else (node,)


def conjunction(nodes: list):
    """All of the nodes; Truth(True) parts vanish."""
    parts = [p for n in nodes if n is not None for p in _parts(n, "and") if p != Truth(True)]
    return parts[0] if len(parts) == 1 else Junction("and", tuple(parts)) if parts else Truth(True)


def _condition(x):
    if isinstance(x, Predicate):
        return x.node
    if isinstance(x, bool):
        return Truth(x)
    raise TranslationError(f"not a condition: {x!r}")


def value_node(x):
    """The node of an operand: a recorded value, a scalar, or a structure for a property whose converter stores one."""
    if isinstance(x, Value):
        return x._node
    if x is None or isinstance(x, (dict, str, int, float, bool, Decimal, dt.date, dt.datetime, bytes)):
        return Literal(x)
    raise TranslationError(f"not a value: {x!r}")


class Value:
    """A recorded value with the operators of the query language."""

    def __init__(self, node):
        object.__setattr__(self, "_node", node)

    def __setattr__(self, *_):
        raise TranslationError("recorded values cannot be assigned to")

    __hash__ = None

    def __bool__(self) -> bool:
        raise TranslationError("a recorded value has no truth value; compare it, as in x.flag == True")

    def _compare(self, op: str, other) -> Predicate:
        if other is None:
            raise TranslationError("comparing with None is never true; use is_null() or is_not_null()")
        return Predicate(Compare(op, self._node, value_node(other)))

    def __eq__(self, other):  # type: ignore[override]
        return self._compare("eq", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._compare("ne", other)

    def __gt__(self, other):
        return self._compare("gt", other)

    def __ge__(self, other):
        return self._compare("ge", other)

    def __lt__(self, other):
        return self._compare("lt", other)

    def __le__(self, other):
        return self._compare("le", other)

    def eq(self, other):
        return self._compare("eq", other)

    def ne(self, other):
        return self._compare("ne", other)

    def between(self, low, high) -> Predicate:
        """Both bounds included."""
        return (self >= low) & (self <= high)

    def is_in(self, values) -> Predicate:
        """Membership; an empty list is never true."""
        found = tuple(value_node(v).value for v in values)
        return Predicate(Member(self._node, found) if found else Truth(False))

    def is_null(self) -> Predicate:
        return Predicate(NullTest(self._node))

    def is_not_null(self) -> Predicate:
        return Predicate(NullTest(self._node, True))

    def _match(self, kind: str, pattern) -> Predicate:
        if not isinstance(pattern, str):
            raise TranslationError(f"{kind} takes a string")
        return Predicate(Match(kind, self._node, pattern))

    def starts_with(self, text: str) -> Predicate:
        return self._match("starts", text)

    def ends_with(self, text: str) -> Predicate:
        return self._match("ends", text)

    def contains(self, text: str) -> Predicate:
        return self._match("contains", text)

    def like(self, pattern: str) -> Predicate:
        return self._match("like", pattern)

    def lower(self) -> Value:
        return Value(Cased("lower", self._node))

    def upper(self) -> Value:
        return Value(Cased("upper", self._node))


class Item(Value):
    """An entity, or a member of it: attributes go deeper; x["name"] reaches members that operators shadow."""

    def __getattr__(self, name: str) -> Item:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Item:
        if not isinstance(name, str):
            raise TranslationError("members are named by strings")
        return Item(Field((*self._node.path, name), self._node.scope))

    def _children(self, mode: str, predicate: Callable | None) -> Predicate:
        return Predicate(Children(self._node, mode, None if predicate is None else record(predicate)))

    def any(self, predicate: Callable | None = None) -> Predicate:
        """Some row behind this navigation (that fulfils the predicate)."""
        return self._children("any", predicate)

    def all(self, predicate: Callable) -> Predicate:
        """No row behind this navigation fails the predicate."""
        return self._children("all", predicate)

    def count(self) -> Value:
        """Rows behind this navigation, 0 without any."""
        return Value(ChildCount(self._node))


def record(function: Callable):
    """The condition that a lambda over one entity states.  A nested lambda may not reach back to an outer entity."""
    scope = next(_scopes)
    node = _condition(function(Item(Field((), scope))))
    _check(node, scope)
    return node


def record_value(function: Callable):
    """The value (or, for a dict, the named values) that a lambda gives."""
    scope = next(_scopes)
    out = function(Item(Field((), scope)))
    if isinstance(out, dict):
        named = {k: value_node(v) for k, v in out.items()}
        for v in named.values():
            _check(v, scope)
        return named
    node = value_node(out)
    _check(node, scope)
    return node


def record_path(selector) -> tuple[str, ...]:
    """A member's path from a lambda or a dotted name."""
    if isinstance(selector, str):
        return tuple(selector.split("."))
    node = record_value(selector)
    if not isinstance(node, Field) or not node.path:
        raise TranslationError("a member is expected, as in lambda x: x.name")
    return node.path


def walk(node):
    """The node and all nodes below it, not entering the predicates of Children."""
    yield node
    for name in getattr(node, "__dataclass_fields__", ()):
        child = getattr(node, name)
        if isinstance(node, Children) and name == "predicate":
            continue
        for c in child if isinstance(child, tuple) else (child,):
            if hasattr(c, "__dataclass_fields__"):
                yield from walk(c)


def _check(node, scope: int) -> None:
    for n in walk(node):
        if isinstance(n, Field) and n.scope != scope:
            raise TranslationError(f"'{'.'.join(n.path)}' belongs to an outer entity; a nested condition can use its own entity alone")


def field_of(*path: str) -> Field:
    """A path node made without a lambda."""
    return Field(tuple(path))


# ---- JSON form, for snapshots ---------------------------------------------------------------------------------------

_NODES = {c.__name__: c for c in (Field, Literal, Cased, ChildCount, Compare, Junction, Negation, NullTest, Match, Member, Truth, Children)}


def to_json(node):
    """A node as JSON values; literals must be JSON scalars."""
    if isinstance(node, tuple):
        return [to_json(x) for x in node]
    if not hasattr(node, "__dataclass_fields__"):
        if node is not None and not isinstance(node, (str, int, float, bool)):
            raise TranslationError(f"{node!r} cannot be stored in a model; use strings, numbers or booleans")
        return node
    return {"node": type(node).__name__} | {n: to_json(getattr(node, n)) for n in node.__dataclass_fields__ if n != "scope"}


def from_json(x):
    if isinstance(x, list):
        return tuple(from_json(v) for v in x)
    if isinstance(x, dict):
        return _NODES[x["node"]](**{k: from_json(v) for k, v in x.items() if k != "node"})
    return x
