"""Models for tasks."""

import pickle
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def sent(spark: SparkSession, model: Any) -> Broadcast:
    """A broadcast of the model with its class by value, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(b: Broadcast) -> Any:
    return pickle.loads(b.value)
