"""Audit events leave as a stream: a file sink by day, and batches to a receiver with dead letters.

Both restart from the checkpoint of their query. The file sink is exactly once by its log of files.
The export numbers events as they come and sends them in batches under a key that depends on their ids
alone; each micro-batch leaves one folder of outcomes, whose presence means that it is done. A
micro-batch that died half-way is sent again under the same keys, which a receiver knows; one that is done
never is.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import export_batches, sanitize

#: Takes an idempotency key and the payloads of a batch, gives an HTTP-like status or raises.
Deliver = Callable[[str, list[str]], int]

OUTCOME = "batch long, events int, first_sequence long, last_sequence long, idempotency_key string, outcome string, attempts int, reason string, items array<struct<sequence:long,id:string,payload:string>>"
SENT, DEAD = "sent", "dead"


def event_sink(events: DataFrame, path: str, checkpoint: str, day: Column) -> StreamingQuery:
    """Sanitized events of a stream as JSON files by day; runs until all that is there is written.

    A restart goes on behind the last finished micro-batch, and readers see only files of finished ones.
    """
    rows = sanitize(events.withColumn("_day", day), keep=("_day",)).withColumnRenamed("_day", "day")
    writer = rows.writeStream.format("json").partitionBy("day").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _attempt(deliver: Deliver, key: str, payloads: list[str], retries: int, base: float, longest: float) -> tuple[str, int, str]:
    """Outcome, attempts and reason: success ends it, and so does a refusal other than 429."""
    reason = ""
    for attempt in range(1, retries + 2):
        try:
            status = deliver(key, payloads)
        except Exception as error:  # A receiver may fail in any way; the batch must not stop those behind it.
            status, reason = 0, type(error).__name__
        if 200 <= status < 300:
            return SENT, attempt, ""
        if status:
            reason = f"status {status}"
        if 400 <= status < 500 and status != 429:
            return DEAD, attempt, reason
        if attempt <= retries and base:
            delay = min(longest, base * 2 ** min(attempt - 1, 10))
            time.sleep(delay * random.uniform(1, 1.5))
    return DEAD, retries + 1, reason


def _delivered(deliver: Deliver, retries: int, base: float, longest: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [
                _attempt(deliver, key, [i["payload"] for i in items], retries, base, longest)
                for key, items in zip(pdf["idempotency_key"], pdf["items"], strict=True)
            ]
            outcome, attempts, reason = zip(*ends) if ends else ((), (), ())
            yield pdf.assign(outcome=outcome, attempts=attempts, reason=reason)

    return run


class Export:
    """Batches of a stream of events to a receiver; `folder` keeps outcomes and dead letters by micro-batch."""

    def __init__(
        self, folder: str, deliver: Deliver, event_id: str, payload: Column, order: Iterable[str], block: Column,
        size: int = 500, retries: int = 3, base: float = 0.1, longest: float = 5.0,
    ):
        self.folder, self.deliver, self.event_id, self.payload = folder.rstrip("/"), deliver, event_id, payload
        self.order, self.block, self.size = list(order), block, size
        self.retries, self.base, self.longest = retries, base, longest

    def _table(self, rows: DataFrame, epoch: int, name: str) -> None:
        # Replaces what an earlier try of this micro-batch left.
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def _done(self, spark, epoch: int) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/outcomes/epoch={epoch}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _sent_before(self, spark, epoch: int) -> int:
        """The last sequence number given in earlier micro-batches."""
        if epoch == 0:
            return 0
        rows = self.outcomes(spark).where(F.col("epoch") < epoch)
        return rows.agg(F.coalesce(F.max("last_sequence"), F.lit(0))).first()[0]

    def batch(self, events: DataFrame, epoch: int) -> None:
        """One micro-batch: number, send, then write what became of it."""
        spark = events.sparkSession
        if self._done(spark, epoch):
            return
        before = self._sent_before(spark, epoch)
        made = export_batches(events, self.block, self.order, self.event_id, self.size, payload=self.payload)
        made = made.withColumns({c: (F.col(c) + before).cast("long") for c in ("first_sequence", "last_sequence")})
        items = F.transform("items", lambda i: i.withField("sequence", (i["sequence"] + before).cast("long")))
        named = made.withColumn("items", items).withColumn("batch", F.col("batch").cast("long"))
        named = named.withColumns({"outcome": F.lit(""), "attempts": F.lit(0), "reason": F.lit("")})
        run = _delivered(self.deliver, self.retries, self.base, self.longest)
        # The dead letters come from the written outcomes, so that nothing is sent for them again.
        whole = named.select(*[f.split(" ")[0] for f in OUTCOME.split(", ")]).repartition("batch").mapInPandas(run, OUTCOME)
        self._table(whole, epoch, "attempts")
        back = spark.read.schema(OUTCOME).parquet(f"{self.folder}/attempts/epoch={epoch}")
        self._table(back.where(F.col("outcome") == DEAD), epoch, "dead")
        self._table(back.drop("items"), epoch, "outcomes")

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs until all that is there is sent or dead."""
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def outcomes(self, spark) -> DataFrame:
        schema = OUTCOME.split(", items")[0] + ", epoch long"
        return spark.read.schema(schema).parquet(f"{self.folder}/outcomes")

    def dead_letters(self, spark) -> DataFrame:
        """One row per event of a batch that was not accepted, with the reason."""
        rows = spark.read.schema(OUTCOME + ", epoch long").parquet(f"{self.folder}/dead")
        return rows.select("epoch", "batch", "idempotency_key", "reason", F.explode("items").alias("i")).select(
            "epoch", "batch", "idempotency_key", "reason", "i.*"
        )
