"""A query before it meets tables: frozen, every step makes a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Include:
    """A navigation to load along, with those below it."""

    name: str
    where: Any = None
    children: tuple[Include, ...] = ()


@dataclass(frozen=True)
class Spec:
    entity: str
    where: tuple = ()
    order: tuple[tuple[tuple[str, ...], bool], ...] = ()
    skip: int | None = None
    take: int | None = None
    project: tuple[tuple[str, Any], ...] | None = None
    distinct: bool = False
    includes: tuple[Include, ...] = ()
    ignore_filters: bool = False
    tracked: bool = True

    def with_(self, **changes) -> Spec:
        return replace(self, **changes)


def add_include(have: tuple[Include, ...], path: tuple[str, ...], where=None) -> tuple[Include, ...]:
    """The includes with one more at a path; the same path again is merged."""
    head, *rest = path
    old = next((i for i in have if i.name == head), Include(head))
    new = replace(old, children=add_include(old.children, tuple(rest), where)) if rest else replace(old, where=where if where is not None else old.where)
    return tuple(new if i.name == head else i for i in have) if any(i.name == head for i in have) else (*have, new)
