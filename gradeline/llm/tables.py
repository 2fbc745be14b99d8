"""Tables written to the shared checkpoint folder, for steps that read a large one several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from gradeline.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet under spark.checkpoint.dir and read again; it goes with that folder's content."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
