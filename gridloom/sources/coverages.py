"""What to ask a coverage service for: coverage, axes and scaling settled from its own documents, refusals kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of eastings and northings in lower case, and forms of scaling, the most widely supported first.
EASTINGS = ("x", "e", "easting", "lon", "long", "longitude")
NORTHINGS = ("y", "n", "northing", "lat", "latitude")
FORMS = ("SCALEFACTOR", "SCALEAXESBYFACTOR", "none")


def _texts(xml: Column, name: str) -> Column:
    return F.xpath(xml, F.lit(f"//*[local-name()='{name}']/text()"))


def capabilities(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs with `available`, the coverages that a service offers, and `refused`, what an exception report says."""
    c = F.col(xml)
    said = F.xpath_string(c, F.lit("/*[contains(local-name(), 'Exception')]"))
    return docs.withColumns({"available": _texts(c, "CoverageId"), "refused": F.when(said != "", F.concat(F.lit("exception: "), F.substring(F.trim(said), 1, 1200)))})


def described(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs with what a description states: labels, srs, origin, low, high and size; null where it does not."""
    c = F.col(xml)
    numbers = lambda name, kind: F.transform(F.split(F.trim(F.get(_texts(c, name), F.lit(0))), r"\s+"), lambda v: v.cast(kind))
    attribute = lambda name: F.get(F.xpath(c, F.lit(f"//*[local-name()='Envelope' or local-name()='EnvelopeWithTimePeriod']/@{name}")), F.lit(0))
    labels = F.split(F.trim(attribute("axisLabels")), r"\s+")
    low, high = numbers("low", "long"), numbers("high", "long")
    size = F.when(F.size(low) == F.size(high), F.zip_with(low, high, lambda a, b: b - a + 1))
    return docs.withColumns({"labels": F.when(F.size(labels) > 0, labels), "srs": attribute("srsName"), "origin": numbers("pos", "double"), "low": low, "high": high, "size": size})


def _tail(name: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(name, ":"), -1), "__"), -1)


def asked(requests: DataFrame, services: DataFrame, by: str) -> DataFrame:
    """requests (by, wanted) with what is told of their service; of `available` only the names that `wanted` can
    mean, met by equality: no request has to read all that a service offers."""
    offers = services.select(by, F.explode("available").alias("name"))
    names = offers.withColumn("wanted", F.explode(F.array_distinct(F.array("name", _tail(F.col("name"))))))
    names = names.groupBy(by, "wanted").agg(F.collect_list("name").alias("available"))
    met = requests.join(services.drop("available"), by).join(names, [by, "wanted"], "left")
    return met.withColumn("available", F.coalesce("available", F.array().cast("array<string>")))


def resolved(wanted: Column, available: Column) -> tuple[Column, Column]:
    """(coverage, refusal): the one of that name, else the only one whose last part, after `__` or `:`, is that name."""
    close = F.filter(available, lambda a: _tail(a) == wanted)
    exact = F.array_contains(available, wanted)
    coverage = F.when(exact, wanted).when(F.size(close) == 1, close[0])
    refusal = F.when(~exact & (F.size(close) > 1), F.concat(F.lit("ambiguous: "), F.array_join(F.array_sort(close), " "))).when(~exact & (F.size(close) < 1), F.lit("absent"))
    return coverage, refusal


def axes(labels: Column) -> tuple[Column, Column, Column]:
    """(easting, northing, refusal): of the first two labels the one that names each, as it is spelt; x and y only
    where no labels are stated at all."""
    two = F.slice(labels, 1, 2)
    pick = lambda names: F.get(F.filter(two, lambda v: F.lower(v).isin(*names)), F.lit(0))
    east, north = pick(EASTINGS), pick(NORTHINGS)
    unstated = labels.isNull() | (F.size(labels) == 0)
    refusal = F.when(unstated, None).when(F.size(labels) < 2, "too few axes").when(east.isNull() | north.isNull(), "no easting and northing")
    told = refusal.isNull()
    return F.when(unstated, "x").when(told, east), F.when(unstated, "y").when(told, north), refusal


def scalings(east: Column, north: Column, factor: float) -> Column:
    """The forms of scaling in order, each with what it adds to a request."""
    by_axis = F.concat(east, F.lit(f"({factor!r}),"), north, F.lit(f"({factor!r})"))
    return F.array(*(F.struct(F.lit(f).alias("form"), v.alias("value")) for f, v in zip(FORMS, (F.lit(repr(factor)), by_axis, F.lit("")), strict=True)))


def negotiated(requests: DataFrame, factor: float) -> DataFrame:
    """requests (wanted, available, refused, labels, accepts) with coverage, easting, northing, form, value and
    refusal: the first form that the service accepts, none where it accepts no other, and of what is refused
    the first reason."""
    coverage, absent = resolved(F.col("wanted"), F.col("available"))
    east, north, unclear = axes(F.col("labels"))
    out = requests.withColumns({"coverage": coverage, "easting": east, "northing": north})
    refusal = F.coalesce("refused", absent, unclear)
    tried = F.filter(scalings(F.col("easting"), F.col("northing"), factor), lambda s: F.array_contains("accepts", s["form"]) | (s["form"] == FORMS[-1]))
    first = F.when(F.col("refusal").isNull(), tried[0])
    return out.withColumn("refusal", refusal).withColumns({"form": first["form"], "value": first["value"]})
