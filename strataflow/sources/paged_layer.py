"""A paged feature layer over HTTP as a Spark data source.

The layer answers ``returnIdsOnly`` queries with its ids, and queries by id with features
(attributes and a point). Each batch of ids is one partition, fetched with retries where it
is read, so that a lost executor costs its batches only. A server may answer with fewer
features than asked for: what is missing is asked for again, and a batch that stays short is
an error, not a loss.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def get_json(url: str, params: dict, retries: int = 5, pause: float = 2.0) -> dict:
    """A JSON answer; null parameters are left out, errors are retried with a pause that grows with each try."""
    query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
    for attempt in range(1, retries + 1):
        try:
            with urllib.request.urlopen(f"{url}?{query}", timeout=60) as answer:
                got = json.load(answer)
            if "error" in got:
                raise RuntimeError(str(got["error"]))
            return got
        except (OSError, ValueError, RuntimeError):
            if attempt == retries:
                raise
            time.sleep(pause * attempt)
    raise AssertionError


class IdBatch(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


class PagedLayerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.box = options["url"], options.get("bbox")
        self.crs, self.id_field = int(options.get("crs", 4326)), options.get("idfield", "OBJECTID")
        self.batch = int(options.get("batch", 500))
        self.retries, self.pause = int(options.get("retries", 5)), float(options.get("pause", 2.0))

    def _get(self, **params) -> dict:
        return get_json(self.url, {"f": "json", **params}, self.retries, self.pause)

    def partitions(self) -> list[IdBatch]:
        ids = sorted(self._get(where="1=1", returnIdsOnly="true", **self.area()).get("objectIds") or [])
        return [IdBatch(ids[i : i + self.batch]) for i in range(0, len(ids), self.batch)]

    def area(self) -> dict:
        """The parameters of a spatial filter: the box ``west,south,east,north`` in the system ``crs``."""
        if not self.box:
            return {}
        west, south, east, north = (float(v) for v in self.box.split(","))
        box = {"xmin": west, "ymin": south, "xmax": east, "ymax": north, "spatialReference": {"wkid": self.crs}}
        return {"geometry": json.dumps(box), "geometryType": "esriGeometryEnvelope", "inSR": str(self.crs), "spatialRel": "esriSpatialRelIntersects"}

    def features(self, ids: list[int]) -> Iterator[dict]:
        """The features of ``ids``, asked for until all are there; an answer that brings none of them is an error."""
        left = set(ids)
        while left:
            got = self._get(objectIds=",".join(map(str, sorted(left))), outFields="*", returnGeometry="true", outSR=str(self.crs)).get("features", [])
            fresh = [f for f in got if (f.get("attributes") or {}).get(self.id_field) in left]
            if not fresh:
                raise RuntimeError(f"the layer gives no feature for {len(left)} of {len(ids)} ids, such as {min(left)}")
            left -= {f["attributes"][self.id_field] for f in fresh}
            yield from fresh

    def read(self, partition: IdBatch) -> Iterator[tuple]:
        if partition is None or not partition.ids:
            return
        for f in self.features(partition.ids):
            point = f.get("geometry") or {}
            yield (json.dumps(f.get("attributes") or {}, sort_keys=True), point.get("x"), point.get("y"))


class PagedLayer(DataSource):
    """``spark.read.format("paged_layer").option("url", ...)``: attributes as JSON text, lon and lat.

    Options: ``bbox`` (west,south,east,north), ``crs`` of box and answer (4326), ``idfield``
    (OBJECTID), ``batch``, ``retries`` and ``pause``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_layer"

    def schema(self) -> str:
        return "attributes string, lon double, lat double"

    def reader(self, schema) -> PagedLayerReader:
        return PagedLayerReader(dict(self.options))
