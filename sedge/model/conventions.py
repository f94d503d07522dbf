"""Names, keys and types that hold where nothing is configured."""

from __future__ import annotations

import datetime as dt

# fixed values: words whose plural follows no rule, and words without one
IRREGULAR = {
    "person": "people",
    "child": "children",
    "man": "men",
    "woman": "women",
    "foot": "feet",
    "tooth": "teeth",
    "goose": "geese",
    "mouse": "mice",
}
UNCOUNTABLE = {"sheep", "series", "species", "fish", "deer", "equipment", "information"}

#: (ending, letters to cut, letters to add), first match wins; words in y are handled before.
_ENDINGS = [(("s", "x", "z", "ch", "sh"), 0, "es"), (("fe",), 2, "ves"), (("f",), 1, "ves"), (("",), 0, "s")]


def plural(word: str) -> str:
    """The table name of an entity name."""
    low = word.lower()
    if not word or low in UNCOUNTABLE:
        return word
    if low in IRREGULAR:
        many = IRREGULAR[low]
        return capital(many) if word[0].isupper() else many
    if low.endswith("y"):
        return word + "s" if len(low) < 2 or low[-2] in "aeiou" else word[:-1] + "ies"
    cut, add = next((c, a) for ends, c, a in _ENDINGS if low.endswith(ends))
    return word[: len(word) - cut] + add


def capital(word: str) -> str:
    return word[:1].upper() + word[1:]


def camel(word: str) -> str:
    return word[:1].lower() + word[1:]


def find_key(entity: str, names: list[str]) -> str | None:
    """The first name that is id or <entity>id, whatever its case."""
    return next((n for n in names if n.lower() in ("id", entity.lower() + "id")), None)


def foreign_key_names(nav: str, principal: str, key: str) -> list[str]:
    """Where a foreign key is looked for, in this order; the first is made up if none exists."""
    return [stem + end for stem in (nav, camel(principal)) for end in (capital(key), "Id")]


def type_of(explicit: str | None, max_length: int | None, default) -> str:
    """A property's type tag: said, implied by a length, told by a default value, or unknown."""
    if explicit:
        return explicit
    if max_length is not None:
        return "string"
    if isinstance(default, bool):
        return "boolean"
    if isinstance(default, (int, float)):
        return "number"
    if isinstance(default, str):
        return "string"
    return "timestamp" if isinstance(default, (dt.date, dt.datetime)) else "unknown"
