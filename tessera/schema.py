"""Concepts from dataclasses: fields become attributes, values become writes."""

from __future__ import annotations

import dataclasses
import types
import typing

from tessera.model import Attribute, Concept, QueryError
from tessera.store import Changes

#: Value types of Python's; an entity is a text that names one.
KINDS = {str: "Text", int: "SignedInteger", float: "Float", bool: "Boolean", bytes: "Bytes"}


class Entity(str):
    """A reference to an entity."""


def attribute(the: str | None = None, kind: str | None = None, conforms: Concept | None = None, one_of: tuple[str, ...] = (), **rest):
    """A dataclass field with more to say than its type: its attribute's name, type or choices."""
    return dataclasses.field(metadata={"the": the, "kind": kind, "conforms": conforms, "one_of": one_of}, **rest)


def _attribute(domain: str, f: dataclasses.Field, hint) -> Attribute:
    optional, many = False, False
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        own = [x for x in typing.get_args(hint) if x is not type(None)]
        optional = len(own) < len(typing.get_args(hint))
        hint = own[0] if len(own) == 1 else object
    if typing.get_origin(hint) in (list, set, frozenset):
        many, hint = True, typing.get_args(hint)[0]
    kind = f.metadata.get("kind") or ("Entity" if hint is Entity or hasattr(hint, "concept") else KINDS.get(hint, "Any"))
    conforms = f.metadata.get("conforms") or getattr(hint, "concept", None)
    return Attribute(f.metadata.get("the") or f"{domain}/{f.name.replace('_', '-')}", kind, "many" if many else "one", optional, conforms, tuple(f.metadata.get("one_of") or ()))


def concept(domain: str):
    """Class decorator, over ``dataclass``: gives the class its ``concept``, and ``written``
    to turn an entity's values into a batch. ``T | None`` is optional, a list has many values,
    a class with a concept of its own is an entity that conforms to it."""

    def add(cls):
        if not dataclasses.is_dataclass(cls):
            raise QueryError("NotADataclass", cls.__name__)
        hints = typing.get_type_hints(cls, localns={cls.__name__: object})
        cls.concept = Concept(tuple((f.name, _attribute(domain, f, hints[f.name])) for f in dataclasses.fields(cls)), cls.__name__)

        def written(this: str, value) -> Changes:
            out = Changes()
            for n, a in cls.concept.fields:
                v = getattr(value, n)
                for x in v if a.cardinality == "many" else [] if v is None else [v]:
                    out.concept(cls.concept, this, **{n: x})
            return out

        cls.written = staticmethod(written)
        return cls

    return add
