"""The session that everything is tested with; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle: int = 8, name: str = "tidemark", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("TIDEMARK_MASTER", f"local[{cores}]"))
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
