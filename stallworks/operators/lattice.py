"""Stored group-bys that measures can be derived from, and which of them answers a request.

A grain is a set of dimensions, always with month and status, and optionally the person. It
keeps additive sums per combination. It answers a request if

* it holds every dimension that the request splits or filters by, and the person where people
  are counted;
* its rows come from the same item lines: both or neither have item dimensions, and both leave
  out lines without a product, or without a seller, or neither does;
* where orders or people's orders are counted, the request splits by all its item
  dimensions: an order with two categories is two rows of a category grain, and adding them up
  would count it twice. Amounts have no such bound.

Of all that can answer, the one with the fewest stored rows is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from stallworks.sources.tables import Tables

ORDER_DIMENSIONS = ("ym", "state", "city")
ITEM_DIMENSIONS = ("category", "product_id", "seller_id", "seller_state", "seller_city")
PERSON = "person"

# Amounts of item lines add up over any dimension.
AMOUNTS = frozenset({"gmv", "freight"})
PEOPLE = frozenset({"buyers", "repeat_buyers", "repeat_rate"})
SALES = AMOUNTS | PEOPLE | {"valid_orders", "aov"}

# An id has one value of these, so a split by the id is a split by them.
_DETERMINED = {"product_id": {"category"}, "seller_id": {"seller_state", "seller_city"}}
# The parent that an item dimension is looked up in; lines without it are left out.
_PARENT = {"category": "products", "seller_state": "sellers", "seller_city": "sellers"}

_PREFIX = "measures"


def _parents(dims: Iterable[str]) -> set[str]:
    return {_PARENT[d] for d in dims if d in _PARENT}


@dataclass(frozen=True)
class Grain:
    """Dimensions beside the month, in a fixed order, and whether rows are per person."""

    dims: tuple[str, ...]
    people: bool = False

    @property
    def name(self) -> str:
        """The name of its layer, and of its folder."""
        return ".".join([_PREFIX, *self.dims, *[PERSON] * self.people])

    @property
    def of_items(self) -> list[str]:
        return [d for d in self.dims if d in ITEM_DIMENSIONS]

    @property
    def many_rows(self) -> bool:
        """Whether there is a row per person or id, so that rows by month are many."""
        return self.people or bool({"product_id", "seller_id"} & {*self.dims})

    def answers(self, measures: Iterable[str], dims: Sequence[str], filters: Iterable[str]) -> bool:
        wanted = set(measures)
        used = {*dims, *filters}
        if not used <= {"ym", *self.dims} or (wanted & PEOPLE and not self.people):
            return False
        lines = [d for d in used if d in ITEM_DIMENSIONS]
        if bool(lines) != bool(self.of_items) or _parents(lines) != _parents(self.of_items):
            return False
        told = {*dims}.union(*[_DETERMINED.get(d, set()) for d in dims])
        return wanted <= AMOUNTS or set(self.of_items) <= told


def grain(dims: Iterable[str] = (), people: bool = False) -> Grain:
    """The grain of these dimensions, whatever their order; the month is always among them."""
    asked = set(dims)
    unknown = asked - {*ORDER_DIMENSIONS, *ITEM_DIMENSIONS}
    if unknown:
        raise ValueError(f"unknown dimensions {sorted(unknown)}")
    known = [*ORDER_DIMENSIONS, *ITEM_DIMENSIONS]
    return Grain(tuple(d for d in known if d in asked and d != "ym"), people)


def grain_of(name: str) -> Grain | None:
    """The grain of a layer's name; None if it is another layer."""
    prefix, *dims = name.split(".")
    if prefix != _PREFIX:
        return None
    return grain([d for d in dims if d != PERSON], PERSON in dims)


def serving_layer(
    t: Tables, measures: Sequence[str], dims: Sequence[str], filters: Iterable[str]
) -> str | None:
    """The attached layer with the fewest rows that answers; None if none does.

    ``person_months`` is a grain of people without further dimensions that holds sales only.
    """
    able = []
    for name in t.attached():
        stored = Grain((), True) if name == "person_months" else grain_of(name)
        if name == "person_months" and not set(measures) <= SALES:
            continue
        if stored is not None and stored.answers(measures, dims, filters):
            able.append((t.layer_rows(name), len(stored.dims) + stored.people, name))
    return min(able)[2] if able else None
