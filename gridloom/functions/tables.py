"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import resample


@udtf(returnType="out int, src int, w double")
class OperatorWeights:
    """operator_weights(kind, side, factor): the weights of a resampling operator along an axis."""

    def eval(self, kind: str, side: int, factor: int) -> Iterator[tuple]:
        yield from resample.weights(kind, side, factor)


def register(spark: SparkSession) -> None:
    spark.udtf.register("operator_weights", OperatorWeights)
