"""All station networks as one table of observations, from a folder tree that names network, station and year.

``<root>/network=<name>/station=<id>/year=<yyyy>/<files>``: raw text as a network publishes it. Network, station and year are partition columns, so a request
opens only the files it can need; a year is one more than asked for at either side where records of its first or last hours may stand in the neighbour's file.
Each network's reader turns its own rows into the common ones (``rejects.OBSERVATION``, with the network), and the readers' results are one union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stations
from .rejects import OBSERVATION

LAYOUT = "value string, network string, station string, year int"


@dataclass(frozen=True)
class Network:
    """How a network's raw rows are read: ``read`` takes a DataFrame with ``value`` (a line, or a whole document)."""

    read: Callable[[DataFrame], DataFrame]
    documents: bool


NETWORKS = {
    "climate": Network(stations.climate_reference, False),
    "airport": Network(stations.one_minute, False),
    "agricultural": Network(stations.agricultural, True),
    "weather": Network(stations.geojson, True),
    "mesonet": Network(stations.mesonet, True),
}


def years(begin: datetime, end: datetime, slack: timedelta = timedelta(days=1)) -> list[int]:
    """Years whose files may hold records of a window; times in files are local or end of interval, hence the slack."""
    if end < begin:
        raise ValueError("bad-window: it ends before it begins")
    return list(range((begin - slack).year, (end + slack).year + 1))


def union(raw: dict[str, DataFrame]) -> DataFrame:
    """Raw rows by network as one table: network and the common columns. Unknown networks are refused."""
    out = None
    for name, rows in raw.items():
        if name not in NETWORKS:
            raise ValueError(f"no-such-network: {name}; there are {', '.join(NETWORKS)}")
        read = NETWORKS[name].read(rows).select(F.lit(name).alias("network"), *[F.col(c) for c in OBSERVATION])
        out = read if out is None else out.unionByName(read)
    if out is None:
        raise ValueError("no-network: nothing to read")
    return out


def observations(spark: SparkSession, root: str, networks: list[str], begin: datetime, end: datetime, ids: list[str] | None = None) -> DataFrame:
    """Observations of networks (and stations ``ids``, by folder) in a window, both ends included. Rows without a time keep their code and stay."""
    raw = {}
    for name in networks:
        if name not in NETWORKS:
            raise ValueError(f"no-such-network: {name}; there are {', '.join(NETWORKS)}")
        files = spark.read.schema(LAYOUT).option("wholetext", NETWORKS[name].documents).text(root)
        wanted = files.where((F.col("network") == name) & F.col("year").isin(years(begin, end)))
        raw[name] = wanted.where(F.col("station").isin(ids)) if ids is not None else wanted
    rows = union(raw)
    return rows.where(F.col("time").isNull() | F.col("time").between(F.lit(begin), F.lit(end)))
