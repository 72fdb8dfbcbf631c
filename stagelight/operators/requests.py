"""Filters as URL parameters and back, for listing pages; plain values, nothing relational."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode

from stagelight.operators.listing import Filters

_LISTS = {"venues": int, "formats": str, "genres": str, "decades": str, "times_of_day": str}
_NUMBERS = ("hour_from", "hour_to")
_TEXTS = ("search", "date_from", "date_to")


def to_params(f: Filters) -> str:
    """Only what is set; lists joined by commas."""
    params = {k: getattr(f, k) for k in _TEXTS + _NUMBERS if getattr(f, k) is not None}
    params |= {k: ",".join(map(str, getattr(f, k))) for k in _LISTS if getattr(f, k)}
    return urlencode(params | ({"single_only": "1"} if f.single_only else {}))


def from_params(query: str) -> Filters:
    """Unknown and malformed parameters are left out."""
    given = {k: v[-1] for k, v in parse_qs(query).items()}
    out = Filters(single_only=given.get("single_only") == "1", **{k: given[k] for k in _TEXTS if k in given})
    for k in _NUMBERS:
        if given.get(k, "").isdigit():
            setattr(out, k, int(given[k]))
    for k, kind in _LISTS.items():
        parts = [p for p in given.get(k, "").split(",") if p]
        setattr(out, k, [kind(p) for p in parts if kind is str or p.isdigit()])
    return out
