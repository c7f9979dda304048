"""The message source's spool: what was planned comes again."""

import pytest

from skywindow.streaming.accumulator import MqttReader, MqttSource, accumulate  # noqa: F401
from skywindow.streaming.spool import MemoryLog, Spool


class Broker:
    """Keeps what is not acknowledged, and sends it again to whoever connects."""

    def __init__(self, *messages):
        self.unacked = dict(enumerate(messages, 1))
        self.subscribed = []

    def client(self):
        broker = self

        class Client:
            def connect(self, host, port):
                self.on_connect(self)

            def subscribe(self, topic, qos=0):
                broker.subscribed.append((topic, qos))

            def loop_start(self):
                broker.send(self, list(broker.unacked))

            def ack(self, mid, qos):
                broker.unacked.pop(mid)

        return Client()

    def send(self, client, mids):
        for mid in mids:
            client.on_message(client, None, type("M", (), {"payload": self.unacked[mid].encode(), "mid": mid, "qos": 1}))

    def publish(self, reader, text):
        mid = max(self.unacked, default=100) + 1
        self.unacked[mid] = text
        self.send(reader.client, [mid])


def values(rows):
    return [x for (x,) in rows]


def test_killed_between_plan_and_commit(tmp_path):
    broker, options = Broker("a", "b\nc", "é"), {"bands": "20m,15m", "spool": str(tmp_path / "s")}
    first = MqttReader(options, broker.client)
    rows, planned = first.read(first.initialOffset())
    assert values(rows) == ["a", "b\nc", "é"] and planned == {"n": 3} and not broker.unacked
    assert broker.subscribed == [("pskr/filter/v2/20m/#", 1), ("pskr/filter/v2/15m/#", 1)]
    broker.publish(first, "received but not planned")
    del first  # killed
    again = MqttReader(options, broker.client)
    assert values(again.readBetweenOffsets({"n": 0}, planned)) == ["a", "b\nc", "é"]  # the batch that Spark had planned
    again.commit(planned)
    rows, end = again.read(planned)
    assert values(rows) == ["received but not planned"] and end == {"n": 4}  # the broker had no acknowledgement of it
    again.commit(end)
    assert values(again.read(end)[0]) == [] and len(Spool(options["spool"]).segments()) == 1
    third = MqttReader(options, broker.client)
    third._connect()
    broker.publish(third, "later")
    assert values(third.read(end)[0]) == ["later"] and third.log.end == 5


def test_killed_before_the_offset_was_written(tmp_path):
    """The spool is ahead of the checkpoint: its messages are given out with the next batch."""
    broker, options = Broker("a", "b"), {"bands": "20m", "spool": str(tmp_path)}
    MqttReader(options, broker.client).read({"n": 0})
    again = MqttReader(options, broker.client)
    assert values(again.read({"n": 0})[0]) == ["a", "b"]


def test_half_a_segment_does_not_count(tmp_path):
    log = Spool(str(tmp_path))
    log.append(["x", "y"])
    (tmp_path / ".77-2").write_text('"z"\n"cut o')
    assert log.end == 2 and list(log.read(0, 9)) == ["x", "y"]
    log.append(["z"], at_least=10)  # the folder was behind the checkpoint
    assert log.end == 11 and list(log.read(0, 99)) == ["x", "y", "z"] and list(log.read(10, 11)) == ["z"]
    log.forget(11)
    assert [(a, b) for a, b, _ in log.segments()] == [(10, 11)]


@pytest.mark.parametrize("make", [lambda p: MemoryLog(), lambda p: Spool(str(p))])
def test_logs_agree(tmp_path, make):
    log = make(tmp_path)
    log.append(["a", "b"], 5)
    log.append(["c"])
    assert log.end == 8 and list(log.read(6, 8)) == ["b", "c"]
    log.forget(7)
    log.append(["d"])
    assert list(log.read(7, 9)) == ["c", "d"]
