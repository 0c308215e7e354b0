"""A paged feature service as a Spark data source.

``spark.read.format("feature_pages").option("folder", ...)`` reads pages ``page-<start>.json`` that a fetcher has stored
in a folder that all executors share; each page is a partition of its own. Bounds and times are pushed down as options
and checked again by the reader, as a service would.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, lon double, lat double, time string, properties string"


def bbox_text(west: float, south: float, east: float, north: float) -> str:
    """Bounds in the order that the service's filters take them: south, west, north, east."""
    if not (west < east and south < north):
        raise ValueError(f"empty bounds: {west}, {south}, {east}, {north}")
    return ",".join(f"{v:g}" for v in (south, west, north, east))


def filter_text(bbox: tuple[float, float, float, float], start: str, stop: str, field: str = "time") -> str:
    """The service's filter: inside the bounds and the closed range of times."""
    if start > stop:
        raise ValueError(f"times out of order: {start}, {stop}")
    return f"BBOX(geom,{bbox_text(*bbox)}) AND {field} >= '{start}' AND {field} <= '{stop}'"


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeaturePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["folder"], int(options.get("pagesize", 2000))
        self.most = int(options.get("maxpages", 20))
        self.box = [float(x) for x in options["bbox"].split(",")] if "bbox" in options else None

    def partitions(self) -> list[Page]:
        """Pages in order of their start, up to and with the first short one."""
        found = sorted((int(m[1]), str(p)) for p in Path(self.folder).iterdir() if (m := re.fullmatch(r"page-(\d+)\.json", p.name)))
        out = []
        for _, path in found:
            out.append(Page(path))
            if len(json.loads(Path(path).read_text()).get("features") or ()) < self.size:
                break
        if len(out) > self.most:
            raise ValueError(f"more than {self.most} pages")
        return out or [Page("")]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.path:
            return
        page = json.loads(Path(partition.path).read_text())
        if page.get("type") != "FeatureCollection" or not isinstance(page.get("features"), list):
            raise ValueError(f"not a feature collection: {partition.path}")
        for f in page["features"]:
            p, c = f.get("properties") or {}, (f.get("geometry") or {}).get("coordinates") or [None, None]
            lon, lat = p.get("Lon", c[0]), p.get("Lat", c[1])
            if self.box and not (lon is not None and lat is not None and self.box[0] <= lon <= self.box[2] and self.box[1] <= lat <= self.box[3]):
                continue
            yield f.get("id"), lon, lat, p.get("time") or p.get("Datetime"), json.dumps(p, sort_keys=True)
