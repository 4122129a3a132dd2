"""Options that every reader and writer of a file format shares."""

from __future__ import annotations

# Quotes inside a quoted field are doubled, as in the public files.
CSV = {"header": True, "quote": '"', "escape": '"'}


def format_options(fmt: str, table: str) -> dict[str, object]:
    """Only reviews hold line breaks, and only they pay for an unsplittable read."""
    return CSV | {"multiLine": table == "order_reviews"} if fmt == "csv" else {}
