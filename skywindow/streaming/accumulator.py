"""Live reports into hourly tables: late data are merged, never dropped."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .hourstore import HourlyStore
from .spool import MemoryLog, Spool

PAYLOAD = "sq long, f string, md string, rp string, t string, t_tx string, sc string, sl string, rc string, rl string, sa long, ra long, b string"


def topic(band: str) -> str:
    """The broker's own filter by band."""
    return f"pskr/filter/v2/{band}/#"


def parse_reports(raw: DataFrame, column: str = "value") -> DataFrame:
    """Spots from JSON payloads; ``parse_error`` where one is no object, or lacks a field or a number.

    The time of sending goes before the time of the report. Grids keep their case: whoever reads them normalises.
    """
    whole = lambda c: F.when(F.trim(F.col(c)).rlike(r"^[+-]?\d+$"), F.trim(F.col(c)).try_cast("long"))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    p = raw.select(F.from_json(F.col(column).cast("string"), PAYLOAD).alias("p")).select("p.*")
    rows = p.select(
        F.lit("pskreporter").alias("source"), F.timestamp_seconds(F.coalesce(whole("t_tx"), whole("t"))).alias("ts"), F.lower(text("b")).alias("band"), F.upper(text("md")).alias("mode"),
        whole("f").alias("freq_hz"), F.upper(text("sc")).alias("dx_call"), F.upper(text("rc")).alias("de_call"), text("sl").alias("dx_grid"), text("rl").alias("de_grid"), whole("rp").alias("snr_db"),
    )
    bad = F.lit(False)
    for c in ("ts", "band", "mode", "freq_hz", "dx_call", "de_call", "snr_db"):
        bad = bad | F.col(c).isNull()
    return rows.withColumn("parse_error", F.when(bad, "unparsed"))


def accumulate(reports: DataFrame, store: HourlyStore, checkpoint: str, on_flush: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes a stream of JSON payloads (column ``value``) into a store. ``on_flush`` gets each batch's counts by reason, which
    are taken while the batch is written."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        counts = store.upsert(parse_reports(batch), batch_id, checkpoint)
        if on_flush and counts:
            on_flush(store.spark.createDataFrame(sorted(counts.items()), "reason string, n long"), batch_id)

    return reports.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class MqttSource(DataSource):
    """``spark.readStream.format("mqtt_reports").option("host", ...).option("bands", "20m,15m").option("spool", ...)``.

    ``spool`` is a folder beside the checkpoint, on a disk that outlasts the driver. A client that the cluster's Python has
    (paho) does the transport; without one, starting the stream says so.
    """

    @classmethod
    def name(cls) -> str:
        return "mqtt_reports"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return MqttReader(self.options)


class MqttReader(SimpleDataSourceStreamReader):
    """Numbers messages from the offset that the query begins or goes on with.

    A batch's messages are in the spool, and only then acknowledged to the broker, before Spark hears of their offsets: a
    batch that was planned is read again after a crash, and what was received but not spooled comes again from the broker
    (quality of service 1, a session that lasts). So every message is given at least once. Segments go once a batch is
    committed. Without ``spool`` messages wait in memory, and those of a planned batch are lost in a crash.
    """

    def __init__(self, options: dict, client_factory: Callable | None = None):
        self.topics = [topic(b) for b in options.get("bands", "").split(",") if b]
        self.host, self.port = options.get("host", "localhost"), int(options.get("port", 1883))
        self.client_id = options.get("client_id", "skywindow")
        self.make = client_factory
        self.log = Spool(options["spool"]) if options.get("spool") else MemoryLog()
        self.waiting: deque[tuple] = deque()
        self.lock = threading.Lock()
        self.client = None

    def _connect(self) -> None:
        if self.client is not None:
            return
        if self.make is None:
            from paho.mqtt.client import CallbackAPIVersion, Client

            self.make = lambda: Client(CallbackAPIVersion.VERSION2, client_id=self.client_id, clean_session=False, manual_ack=True)
        client = self.make()
        client.on_connect = lambda c, *_: [c.subscribe(t) if isinstance(self.log, MemoryLog) else c.subscribe(t, qos=1) for t in self.topics]  # again on every reconnect
        client.on_message = self._receive
        client.connect(self.host, self.port)
        client.loop_start()
        self.client = client

    def _receive(self, client, userdata, message) -> None:
        with self.lock:
            self.waiting.append((message.payload.decode("utf-8", "replace"), getattr(message, "mid", None), getattr(message, "qos", 0)))

    def _store(self, start: int) -> None:
        with self.lock:
            got = list(self.waiting)
            self.log.append([text for text, _, _ in got], start)
            self.waiting.clear()
        for _, mid, qos in got:
            if qos and hasattr(self.client, "ack"):
                self.client.ack(mid, qos)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._connect()
        self._store(start["n"])
        end = max(self.log.end, start["n"])
        return iter([(x,) for x in self.log.read(start["n"], end)]), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in self.log.read(start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        """What is committed is forgotten."""
        self.log.forget(end["n"])
