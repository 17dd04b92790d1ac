"""Spark session settings that every plan of this package relies on."""

from pyspark.sql import SparkSession

#: UTC keeps timestamps equal across engines; AQE coalesces small and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benches; a cluster submits with its own master and sizes."""
    b = SparkSession.builder.master(master).appName("kinetrace").config("spark.ui.enabled", "false")
    b = b.config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
