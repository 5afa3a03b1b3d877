"""User functions of a session, which shadow built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class UserFunctions:
    """Scalar, aggregate, window and table-valued functions by lower-case name."""

    enabled: bool = True
    scalar: dict[str, tuple[Callable, int, int]] = field(default_factory=dict)
    aggregate: dict[str, Callable] = field(default_factory=dict)
    window: dict[str, Callable] = field(default_factory=dict)
    table: dict[str, Callable] = field(default_factory=dict)

    def _check(self) -> None:
        if not self.enabled:
            raise PermissionError("user functions are disabled in this session")

    def register_scalar(self, name: str, fn: Callable[..., Any], least: int = 1, most: int | None = None) -> None:
        """fn takes Columns and gives a Column (a pandas_udf does too)."""
        self._check()
        self.scalar[name.lower()] = (fn, least, least if most is None else most)

    def register_aggregate(self, name: str, fn: Callable[..., Any]) -> None:
        """fn(field, *literals) gives an aggregate Column (a grouped pandas_udf does too)."""
        from tessera.functions.aggregates import CORE

        self._check()
        if name.lower() in CORE:
            raise ValueError(f"{name} can't be replaced")
        self.aggregate[name.lower()] = fn

    def register_window(self, name: str, fn: Callable[..., Any]) -> None:
        """fn(df, series, out, field, *literals) gives df with the column ``out``."""
        self._check()
        self.window[name.lower()] = fn

    def register_table(self, name: str, fn: Callable[..., Any]) -> None:
        """fn(session, *arguments) gives a DataFrame."""
        self._check()
        if name.lower() == "forecast":
            raise ValueError("forecast is reserved")
        self.table[name.lower()] = fn

    def unregister(self, name: str) -> bool:
        return any([d.pop(name.lower(), None) is not None for d in (self.scalar, self.aggregate, self.window, self.table)])
