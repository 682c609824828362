"""Table access and the logical inputs every operator reads."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread long texts by request when the files give fewer splits than cores.

    With many input splits (the cluster case) the frame is returned as is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def document_parts(spark: SparkSession, folder: str) -> DataFrame:
    """documents as one-part requests."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.lit(0).alias("message_index"),
        F.lit(0).alias("part_index"),
        F.lit("user").alias("role"),
        F.lit("text").alias("part_type"),
        "text",
    )
    return spread(docs, "request_id")


def conversation_parts(spark: SparkSession, folder: str) -> DataFrame:
    """conversations as requests: one message per turn, one part per message."""
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").cast("int").alias("message_index"),
        F.lit(0).alias("part_index"),
        "role",
        F.lit("text").alias("part_type"),
        "text",
    )
    return spread(rows, "request_id", "message_index")


def provider_of(doc_id: Column) -> Column:
    return F.when(doc_id % 2 == 0, "cloud").otherwise("local")


def document_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Caller context per document request; reads no text."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.col("source").alias("tenant"),
        F.col("lang").alias("application"),
        provider_of(F.col("doc_id")).alias("provider"),
    )


# Fixed values of the event binding: outcome type -> protective action.
EVENT_ACTIONS = {
    "error": "BLOCK",
    "signup": "TOKENIZE",
    "click": "ALLOW",
    "view": "ALLOW",
    "purchase": "REDACT",
}


def action_of(event_type: Column) -> Column:
    out = None
    for kind, action in EVENT_ACTIONS.items():
        cond = event_type == kind
        out = F.when(cond, action) if out is None else out.when(cond, action)
    return out


def decision_events(spark: SparkSession, folder: str) -> DataFrame:
    """events read as decisions and findings over time."""
    pick = F.col("event_id") % 3
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        action_of(F.col("event_type")).alias("action"),
        F.when(pick == 0, "PII").when(pick == 1, "SECRET").otherwise("POLICY").alias("category"),
        F.col("event_type").alias("subtype"),
    )
