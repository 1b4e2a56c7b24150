"""Criteria of saved and structured searches as a tree of typed nodes, compiled to one Column.

A row meets a criterion only where its value is known: a null meets neither a criterion nor its negation. Texts are compared without case and outer blanks; ``contains`` takes its text as it is,
without wildcards. Columns are given as texts or numbers and cast to what a criterion compares, values that can't be cast are unknown.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILES_PER_DEGREE = (69.0, 55.2)  # of latitude, and of longitude at some 37 degrees north


@dataclass(frozen=True)
class OneOf:
    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Between:
    """low <= value <= high, each end where given; of several columns the first known one counts."""

    columns: tuple[str, ...]
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Contains:
    columns: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class Within:
    """A date in the last ``days`` before the as-of date, or later."""

    column: str
    days: int


@dataclass(frozen=True)
class Near:
    lat: float
    lng: float
    miles: float
    columns: tuple[str, str] = ("lat", "lng")


@dataclass(frozen=True)
class Given:
    """The text is there and not blank."""

    column: str


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Node = OneOf | Between | Contains | Within | Near | Given | All | Any | Not


def planar_miles(lat: float, lng: float, columns: tuple[str, str] = ("lat", "lng")) -> Column:
    """Straight-line miles on a plane, to hundredths."""
    a, b = (F.col(c).try_cast("double") for c in columns)
    return F.round(F.sqrt(F.pow((a - lat) * MILES_PER_DEGREE[0], 2) + F.pow((b - lng) * MILES_PER_DEGREE[1], 2)), 2)


def _verdict(node: Node, as_of: str) -> Column:
    """True, false, or null where it can't be known."""
    text = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    if isinstance(node, OneOf):
        return text(node.column).isin(*(v.strip().upper() for v in node.values))
    if isinstance(node, Between):
        value = F.coalesce(*(F.col(c).try_cast("double") for c in node.columns))
        ends = [value >= node.low] * (node.low is not None) + [value <= node.high] * (node.high is not None)
        return F.when(value.isNotNull(), reduce(lambda a, b: a & b, ends, F.lit(True)))
    if isinstance(node, Contains):
        found = [F.contains(F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(node.text.upper())) for c in node.columns]
        known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in node.columns])
        return F.when(known, reduce(lambda a, b: a | b, found))
    if isinstance(node, Within):
        return F.col(node.column).try_cast("date") >= F.date_sub(F.lit(as_of).cast("date"), node.days)
    if isinstance(node, Near):
        a, b = (F.col(c).try_cast("double") for c in node.columns)
        up, across = (node.miles / m for m in MILES_PER_DEGREE)
        box = a.between(node.lat - up, node.lat + up) & b.between(node.lng - across, node.lng + across)  # plain ranges, which a scan can use
        return box & (planar_miles(node.lat, node.lng, node.columns) <= node.miles)
    if isinstance(node, Given):
        return F.length(text(node.column)) > 0
    if isinstance(node, All):
        return reduce(lambda a, b: a & b, (_verdict(p, as_of) for p in node.parts), F.lit(True))
    if isinstance(node, Any):
        return reduce(lambda a, b: a | b, (_verdict(p, as_of) for p in node.parts), F.lit(False))
    if isinstance(node, Not):
        return ~_verdict(node.part, as_of)
    raise TypeError(f"no criterion: {node!r}")


def compiled(node: Node, as_of: str) -> Column:
    """Whether a row is known to meet ``node``."""
    return F.coalesce(_verdict(node, as_of), F.lit(False))


# The criteria of a watch list by name.
_RANGES = {"price": "list_price", "beds": "bedrooms", "full_baths": "full_baths", "sqft": "sqft", "acres": "acres"}
WATCH = ("cities", "classes", "statuses", "min_price", "max_price", "min_beds", "max_beds", "min_full_baths", "min_sqft", "max_sqft", "min_acres", "max_acres", "zoning_like", "subdivision_like", "school_districts", "center_lat", "center_lng", "radius_mi", "listed_within_days")


def watch_criteria(asked: Mapping) -> dict[str, Node]:
    """A node for each criterion of a watch list that is given (the three of a circle are one, ``radius``). Classes are RE_1 and statuses Active and Pending where not given; unknown names are refused."""
    unknown = set(asked) - set(WATCH)
    if unknown:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    given = {"classes": ("RE_1",), "statuses": ("Active", "Pending"), **{k: v for k, v in asked.items() if v is not None}}
    out: dict[str, Node] = {}
    for name, column in (("cities", "city"), ("classes", "class_id"), ("statuses", "status"), ("school_districts", "high_school")):
        if given.get(name):
            out[name] = OneOf(column, tuple(given[name]))
    for name, value in given.items():
        end, _, what = name.partition("_")
        if end in ("min", "max"):
            out[name] = Between((_RANGES[what],), **{"low" if end == "min" else "high": float(value)})
    for name, column in (("zoning_like", "zoning"), ("subdivision_like", "subdivision")):
        if given.get(name):
            out[name] = Contains((column,), given[name])
    if "listed_within_days" in given:
        out["listed_within_days"] = Within("list_date", given["listed_within_days"])
    if all(k in given for k in ("center_lat", "center_lng", "radius_mi")) and given["radius_mi"] > 0:
        out["radius"] = Near(given["center_lat"], given["center_lng"], given["radius_mi"])
    return out


def watch_list(listings: DataFrame, as_of: str, **asked) -> DataFrame:
    """Listings that meet every criterion, with miles_to_center (null without a circle)."""
    nodes = watch_criteria(asked)
    near = nodes.get("radius")
    miles = planar_miles(near.lat, near.lng) if near else F.lit(None).cast("double")
    return listings.filter(compiled(All(tuple(nodes.values())), as_of)).withColumn("miles_to_center", miles)


def criteria_met(listings: DataFrame, as_of: str, key: str, **asked) -> DataFrame:
    """key, criterion: which criteria each listing meets, so a search without results shows what empties it. One scan."""
    met = F.array(*(F.when(compiled(node, as_of), name) for name, node in watch_criteria(asked).items()))
    return listings.select(key, F.explode(F.array_compact(met)).alias("criterion"))


def structured(filters: Mapping) -> Node:
    """The node of a structured query: city, subdivision, min_/max_ beds, baths, price (sold, else list), sqft and acres, status (Active or Closed), keywords (four at most, in either remark).

    An address has to be there. Unknown keys and other statuses are left out, as what wrote the query may err.
    """
    parts: list[Node] = [Given("address")]
    if filters.get("city"):
        parts.append(OneOf("city", (str(filters["city"]),)))
    if filters.get("subdivision"):
        parts.append(Contains(("subdivision",), str(filters["subdivision"])))
    for what, columns in (("beds", ("bedrooms",)), ("baths", ("full_baths",)), ("price", ("sold_price", "list_price")), ("sqft", ("sqft",)), ("acres", ("acres",))):
        low, high = filters.get(f"min_{what}"), filters.get(f"max_{what}") if what not in ("beds", "baths") else None
        if low is not None or high is not None:
            parts.append(Between(columns, None if low is None else float(low), None if high is None else float(high)))
    if filters.get("status") in ("Active", "Closed"):
        parts.append(OneOf("status", (filters["status"],)))
    words = filters.get("keywords")
    parts += [Contains(("public_remarks", "agent_remarks"), str(w)) for w in (words if isinstance(words, (list, tuple)) else [])[:4]]
    return All(tuple(parts))


def structured_search(listings: DataFrame, filters: Mapping, as_of: str, limit: int = 12) -> DataFrame:
    """The first ``limit`` listings of a structured query: active ones first, then the latest closed (none last), ties to the smaller listing_id."""
    rows = listings.filter(compiled(structured(filters), as_of))
    return rows.orderBy((F.col("status") == "Active").desc(), F.col("close_date").desc_nulls_last(), "listing_id").limit(limit)
