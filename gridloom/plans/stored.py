"""Pages that are written once for each set of tables and then read by their place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources import sinks
from ..sources.shared import shared_dir
from ..sources.tables import SIDE, nodes
from .pages import paged

_written: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The page relation of a folder of tables, in the folder that the cluster shares: written when it
    is first asked for in an application, by rows of pages, sorted within, so that a read by place
    opens only the folders of the rows and the row groups of the columns that it needs. The tables
    are taken not to change while the application runs."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        sinks.atlas(paged(nodes(spark, d), 8, SIDE), path, by=("y",), order=("x", "region"))
        _written[key] = path
    return spark.read.schema("region bigint, x int, low double, high double, z array<double>, y int").parquet(_written[key])
