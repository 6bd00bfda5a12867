"""Feature markup: members of a collection read at their closing tags, features with their first attributes and
geometry, and what schema the features turn out to have."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Elements that are geometries, those that identify a feature, and how many values a field is sampled by.
GEOMETRIES = ("Polygon", "MultiSurface", "Surface", "LineString", "MultiCurve", "Curve", "Point", "MultiPoint")
IDENTIFIERS = ("identifier", "inspireId", "localId")
SAMPLES, LONGEST = 12, 200
#: What eastings and northings of the projection lie between.
EAST, NORTH = (100_000.0, 1_000_000.0), (5_000_000.0, 6_500_000.0)


def members(spark: SparkSession, path: str, tag: str = "wfs:member") -> DataFrame:
    """(xml) of the members of collections, however long: files are split at the closing tags. A
    document that is an exception report is an error that cites it."""
    text = spark.read.option("lineSep", f"</{tag}>").text(path)
    at = F.instr("value", f"<{tag}")
    said = F.concat(F.lit("the provider refused: "), F.substring("value", 1, 600))
    refused = (at == 0) & F.col("value").rlike(r"<[\w.:-]*Exception")
    rest = F.substring(F.col("value"), at, F.length("value"))
    xml = F.when(refused, F.raise_error(said)).when(at > 0, F.concat(rest, F.lit(f"</{tag}>")))
    return text.select(xml.alias("xml")).where("xml IS NOT NULL")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parsed(xml: str) -> ET.Element:
    """The last element of a fragment whose prefixes are declared elsewhere; before it there may be empty ones."""
    prefixes = set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[\w.-]", xml)) - {"xml", "xmlns"}
    return ET.fromstring(f"<r {' '.join(f'xmlns:{p}=\"{p}\"' for p in sorted(prefixes))}>{xml}</r>")[-1]


def positions(text: str | None) -> list[tuple[float, float]]:
    values = [float(v) for v in (text or "").split()]
    return list(zip(values[0::2], values[1::2], strict=False))


def eastings_first(point: tuple[float, float]) -> None:
    """Raises where the axes are not easting and northing: their order is told by magnitude, not by a name."""
    if not (EAST[0] < point[0] < EAST[1] and NORTH[0] < point[1] < NORTH[1]):
        raise ValueError(f"{point} is not an easting and a northing")


def features(spark: SparkSession, path: str, tag: str = "wfs:member", check: bool = True) -> DataFrame:
    """(type, attributes, points) of the features of a collection: of each name the first text of a leaf,
    and the first geometry, in the order of the document. With `check`, a geometry whose first point is
    not easting-first is an error."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for xml in pdf["xml"]:
                for feature in parsed(xml):
                    found: dict[str, str] = {}
                    points = None
                    for node in feature.iter():
                        name, text = _local(node.tag), (node.text or "").strip()
                        if name in ("pos", "posList"):
                            points = positions(text) if points is None else points
                        elif not len(node) and text:
                            found.setdefault(name, text)
                    if points and check:
                        eastings_first(points[0])
                    rows.append((_local(feature.tag), found, [{"x": x, "y": y} for x, y in points or []]))
            yield pd.DataFrame(rows, columns=["type", "attributes", "points"])

    return members(spark, path, tag).mapInPandas(scan, "type string, attributes map<string,string>, points array<struct<x: double, y: double>>")


def rings(spark: SparkSession, path: str, tag: str = "wfs:member", feature: str | None = None) -> DataFrame:
    """(type, id, polygon, ring, k, x, y) of the polygons of features: ring 0 is the first outer ring, the others
    are holes. Lists of fewer than four points, or with a lone number, are no rings; polygons without
    an outer ring, and features without polygons, have no rows. Axes are checked by magnitude."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lists(polygon: ET.Element, side: str) -> list[list[tuple[float, float]]]:
            found = (n.text for s in polygon if _local(s.tag) == side for n in s.iter() if _local(n.tag) == "posList")
            return [positions(t) for t in found if t and len(t.split()) >= 8 and len(t.split()) % 2 == 0]

        for pdf in batches:
            rows = []
            for xml in pdf["xml"]:
                for f in parsed(xml):
                    if feature in (None, _local(f.tag)):
                        own = next((v for k, v in f.attrib.items() if _local(k) == "id"), None)
                        whole = [(lists(p, "exterior"), lists(p, "interior")) for p in f.iter() if _local(p.tag) == "Polygon"]
                        for n, (outer, holes) in enumerate(w for w in whole if w[0]):
                            eastings_first(outer[0][0])
                            rows += [(_local(f.tag), own, n, r, k, x, y) for r, ring in enumerate([outer[0], *holes]) for k, (x, y) in enumerate(ring)]
            yield pd.DataFrame(rows, columns=["type", "id", "polygon", "ring", "k", "x", "y"])

    return members(spark, path, tag).mapInPandas(scan, "type string, id string, polygon int, ring int, k int, x double, y double")


def inventory(spark: SparkSession, path: str, tag: str = "wfs:member") -> DataFrame:
    """(kind, name, n, samples): what the features of a collection are made of.

    kind is feature, field (children of features that neither are nor directly hold a geometry),
    reference (fields that link elsewhere), identifier, geometry or srs (at any depth). Fields have the
    least twelve of their values as samples, cut after 200 characters: links, own texts, or the first text
    within. Nodes become rows where a member is read, and no task or driver gathers more than a sample.
    (Not read as VARIANT: that takes 007 and 1e5 for numbers, and forgets the order of elements.)
    """

    def value(child: ET.Element) -> tuple[bool, str]:
        link = next((v for k, v in child.attrib.items() if k.endswith("}href")), None)
        return link is not None, link or next((t.strip() for t in child.itertext() if t.strip()), "")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[str, str, str | None]] = []
            for xml in pdf["xml"]:
                for feature in list(parsed(xml))[:1]:
                    rows.append(("feature", _local(feature.tag), None))
                    for node in feature.iter():
                        if _local(node.tag) in GEOMETRIES:
                            rows.append(("geometry", _local(node.tag), None))
                        if node.get("srsName"):
                            rows.append(("srs", node.get("srsName"), None))
                    for child in feature:
                        name = _local(child.tag)
                        if name in GEOMETRIES or any(_local(g.tag) in GEOMETRIES for g in child):
                            continue
                        linked, text = value(child)
                        rows.append(("field", name, text[:LONGEST] or None))
                        if linked:
                            rows.append(("reference", name, None))
                        elif name in IDENTIFIERS:
                            rows.append(("identifier", name, None))
            yield pd.DataFrame(rows, columns=["kind", "name", "value"])

    counted = members(spark, path, tag).mapInPandas(scan, "kind string, name string, value string").groupBy("kind", "name", "value").agg(F.count("*").alias("n"))
    counted = checkpointed(counted)
    # a rank up to a limit: each task keeps no more of a field before they meet
    order = F.row_number().over(Window.partitionBy("kind", "name").orderBy("value"))
    few = counted.where("value IS NOT NULL").select("kind", "name", "value").withColumn("k", order).where(F.col("k") <= SAMPLES)
    samples = few.groupBy("kind", "name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    total = counted.groupBy("kind", "name").agg(F.sum("n").alias("n"))
    return total.join(samples, ["kind", "name"], "left").select("kind", "name", "n", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
