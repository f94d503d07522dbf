"""Value converters: a name in the model, functions here, applied on write, on read and to constants in conditions."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge.errors import SedgeError


@dataclass(frozen=True)
class Converter:
    """to_store and to_value never see None.  read, where given, is the same as to_value on a Column."""

    name: str
    to_store: Callable[[Any], Any]
    to_value: Callable[[Any], Any]
    read: Callable[[Column], Column] | None = None


def _iso(x: dt.datetime) -> str:
    return x.isoformat(timespec="milliseconds") + ("Z" if x.tzinfo is None else "")


BUILT_IN = {
    c.name: c
    for c in (
        Converter("json", lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")), json.loads),
        Converter("bool01", lambda x: int(bool(x)), lambda x: x != 0, lambda c: c != 0),
        Converter("iso", _iso, lambda s: dt.datetime.fromisoformat(s.rstrip("Z")), lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")),
    )
}


class Converters:
    """The registry a workspace uses: the built-in ones and its own."""

    def __init__(self, own: list[Converter] | None = None):
        self.by_name = BUILT_IN | {c.name: c for c in own or []}

    def get(self, name: str | None) -> Converter | None:
        if name is None:
            return None
        if name not in self.by_name:
            raise SedgeError(f"no converter named '{name}' is registered")
        return self.by_name[name]

    def stored(self, name: str | None, x):
        c = self.get(name)
        return x if c is None or x is None else c.to_store(x)

    def value(self, name: str | None, x):
        c = self.get(name)
        return x if c is None or x is None else c.to_value(x)
