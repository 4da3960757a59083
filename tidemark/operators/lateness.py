"""Events that arrive after newer ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import SAFETY_SECONDS, micros
from tidemark.plans.positions import with_running_max


def late_within_window(arrivals: DataFrame, arrival, ts, keys=("index_name",), seconds=SAFETY_SECONDS) -> DataFrame:
    """Late events the safety window still catches, with ``lag_us`` behind the newest before them."""
    seen = with_running_max(arrivals, keys, arrival, ts, "_high")
    lag = micros(F.col("_high")) - micros(F.col(ts))
    return seen.withColumn("lag_us", lag).filter((lag > 0) & (lag < seconds * 1_000_000)).drop("_high")
