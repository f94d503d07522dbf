"""Decorators that state a model on classes; fluent configuration wins over them, they over conventions."""

from __future__ import annotations

from collections.abc import Callable

from sedge.model.build import ModelConfig, entity_name

_marked: dict[type, dict] = {}


def _of(cls: type) -> dict:
    return _marked.setdefault(cls, {"table": None, "namespace": None, "key": [], "columns": [], "navs": []})


def entity(table: str | None = None, namespace: str | None = None) -> Callable[[type], type]:
    """Marks a class as an entity."""

    def mark(cls: type) -> type:
        _of(cls).update(table=table, namespace=namespace)
        return cls

    return mark


def key(*names: str) -> Callable[[type], type]:
    def mark(cls: type) -> type:
        _of(cls)["key"] += names
        return cls

    return mark


def column(name: str, **said) -> Callable[[type], type]:
    """said: column, type, max_length, nullable, conversion, token, comment, default_sql."""

    def mark(cls: type) -> type:
        _of(cls)["columns"].append((name, said))
        return cls

    return mark


def _nav(many: bool, name: str, target, **said) -> Callable[[type], type]:
    def mark(cls: type) -> type:
        _of(cls)["navs"].append((many, name, target, said))
        return cls

    return mark


def has_many(name: str, target, inverse: str | None = None, foreign_key: str | None = None) -> Callable[[type], type]:
    return _nav(True, name, target, inverse=inverse, foreign_key=foreign_key)


def has_one(name: str, target, inverse: str | None = None, foreign_key: str | None = None) -> Callable[[type], type]:
    return _nav(False, name, target, inverse=inverse, foreign_key=foreign_key)


def apply_markers(model: ModelConfig, *classes: type) -> ModelConfig:
    """States the marked classes (all, or those given) in a model; what the model already says stays."""
    for cls, said in list(_marked.items()):
        if classes and cls not in classes:
            continue
        e = model.configure(entity_name(cls))
        if e.said_table is None and said["table"] is not None:
            e.table(said["table"], said["namespace"])
        if e.said_key is None and said["key"]:
            e.key(*said["key"])
        for name, values in said["columns"]:
            have = e.property(name).said
            e.property(name).said = values | have
        for many, name, target, values in said["navs"]:
            if name in {n.name for n in e.navs}:
                continue
            nav = e.has_many(name, target) if many else e.has_one(name, target)
            if values["inverse"]:
                nav.with_one(values["inverse"]) if many else nav.with_many(values["inverse"])
            if values["foreign_key"]:
                nav.foreign_key(values["foreign_key"])
    return model


def clear_markers() -> None:
    _marked.clear()
