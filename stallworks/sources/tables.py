"""The bundle of business tables that every query takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stallworks.sources.schemas import TABLE_NAMES

Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """Up to eight tables by name; a table a query does not touch may be left out.

    A table may be given as a function, which is called when a query first asks for it.
    Stored summary layers may be attached, with their numbers of rows; totals are then read
    from them.
    """

    def __init__(
        self,
        layers: dict[str, Source] | None = None,
        rows: dict[str, int] | None = None,
        **sources: Source,
    ):
        unknown = set(sources) - set(TABLE_NAMES)
        if unknown:
            raise KeyError(f"unknown tables {sorted(unknown)}")
        self._sources = sources
        self._layers = dict(layers or {})
        self._rows = dict(rows or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(f"unknown table {name!r}")
        if name not in self._sources:
            raise KeyError(f"table {name!r} was not loaded")
        return self._resolved(self._sources, name)

    @staticmethod
    def _resolved(sources: dict[str, Source], name: str) -> DataFrame:
        source = sources[name]
        if not isinstance(source, DataFrame):
            source = sources[name] = source()
        return source

    def present(self) -> list[str]:
        """Names of the loaded tables, parents before children."""
        return [name for name in TABLE_NAMES if name in self._sources]

    def replaced(self, **sources: Source) -> Tables:
        """The same bundle with some tables exchanged; layers no longer fit and are dropped."""
        return Tables(**(self._sources | sources))

    def with_layers(self, rows: dict[str, int] | None = None, /, **layers: Source) -> Tables:
        counted = {name: n for name, n in self._rows.items() if name not in layers} | (rows or {})
        return Tables(layers=self._layers | layers, rows=counted, **self._sources)

    def attached(self) -> list[str]:
        """Names of the attached layers."""
        return list(self._layers)

    def layer_rows(self, name: str) -> float:
        """Rows of an attached layer; infinity where nobody counted them."""
        return self._rows.get(name, float("inf"))

    def layer(self, name: str) -> DataFrame | None:
        return self._resolved(self._layers, name) if name in self._layers else None
