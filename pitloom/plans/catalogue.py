"""Named specs of factors and labels in a fixed order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, Protocol

_NAME = re.compile(r"[a-z][a-z0-9_]*")


class Spec(Protocol):
    name: str
    description: str

    @property
    def field(self) -> str: ...


def require_name(spec: Spec) -> None:
    """ValueError unless the spec has a name in snake case and says what it is."""
    if not _NAME.fullmatch(spec.name):
        raise ValueError(f"{spec.name!r} isn't in snake case")
    if not spec.description.strip():
        raise ValueError(f"{spec.name} has no description")


class Catalogue[S: Spec]:
    """Specs with unique names and columns; they are listed by `order`."""

    kind = "spec"

    def __init__(self, specs: Iterable[S] = (), *, order: Callable[[S], Any] = lambda s: s.name) -> None:
        self._order = order
        self._specs: dict[str, S] = {}
        self.register_many(specs)

    def register(self, spec: S) -> None:
        taken = {s.field: s.name for s in self._specs.values()}
        if spec.name in self._specs or spec.field in taken:
            raise ValueError(f"{spec.name} ({spec.field}) is registered already")
        self._specs[spec.name] = spec

    def register_many(self, specs: Iterable[S]) -> None:
        for s in specs:
            self.register(s)

    def get(self, name: str) -> S:
        if name not in self._specs:
            raise KeyError(f"no {self.kind} {name!r}")
        return self._specs[name]

    def _chosen(self, names: Sequence[str] | None = None) -> list[S]:
        return sorted((self.get(n) for n in names) if names is not None else self._specs.values(), key=self._order)

    def list(self, names: Sequence[str] | None = None) -> list[S]:
        return self._chosen(names)

    def groups(self, attribute: str) -> list:
        """The values of an attribute in the order in which they are listed."""
        return list(dict.fromkeys(getattr(s, attribute) for s in self._chosen()))

    def output_fields(self) -> list[str]:
        return [s.field for s in self._chosen()]

    def __iter__(self) -> Iterator[S]:
        return iter(self._chosen())

    def __contains__(self, name: object) -> bool:
        return name in self._specs

    def __len__(self) -> int:
        return len(self._specs)
