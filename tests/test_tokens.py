"""The token stream over micro-batches, against the fold over whole arrays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scopewise.streaming import ingest, tokens

SCHEMA = "message string, seq long, token string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def rows_of(messages, batch):
    """(message, seq, token, second) rows as a folder's file would hold them."""
    return [(m, k, messages[m][k], START + dt.timedelta(seconds=s)) for m, k, s in batch]


def run(spark, folder, check, out, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = tokens.messages(stream, "<|im_end|>", **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.fixture(scope="module")
def said():
    return {
        "a": ["\n", "<think>", "\n\n", "why", "\n", "</think>", "\n", "so", " it", "\n", " is", "<|im_end|>", "late"],
        "b": ["<|start_header_id|>", "assistant", "<|end_header_id|>", "\n\n", "yes", "<|im_end|>"],
        "c": ["no", " end", " yet"],
        "d": ["<|im_end|>"],
        "e": ["x", "lost", "y"],
    }


def test_messages_over_batches_and_a_restart(spark, tmp_path, said):
    folder, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    write = lambda batch: spark.createDataFrame(rows_of(said, batch), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    write([("a", k, k) for k in (0, 1, 3, 2)] + [("b", 4, 1), ("c", 0, 1), ("e", 0, 1)])
    write([("a", k, 10 + k) for k in (6, 5, 4, 4)] + [("b", 0, 11), ("b", 1, 11), ("c", 2, 12), ("d", 0, 12), ("e", 2, 11)])
    run(spark, folder, check, out)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("d", "", "", True)]
    # another run goes on from the checkpoint
    write([("a", k, 20 + k) for k in (7, 8, 9, 10, 11, 12)] + [("b", 2, 21), ("b", 3, 21), ("b", 5, 22), ("c", 1, 21)])
    run(spark, folder, check, out)
    stop = F.lit("<|im_end|>")
    folded = spark.createDataFrame([(m, t) for m, t in said.items() if m in "abd"], "message string, t array<string>").select("message", ingest.spoken(F.col("t"), "<|im_end|>").alias("s")).select("message", "s.*")
    want = sorted((r.message, r.text, r.thinking, True) for r in folded.collect())
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and stop is not None
    # time goes on: what never stopped is given out as far as it is whole, and late tokens say nothing
    spark.createDataFrame([("f", 0, "<|im_end|>", START + dt.timedelta(hours=2)), ("a", 13, "more", START + dt.timedelta(hours=2))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, check, out)
    spark.createDataFrame([("g", 0, "<|im_end|>", START + dt.timedelta(hours=3))], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, check, out)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted([*want, ("c", "no end yet", "", False), ("e", "x", "", False), ("f", "", "", True), ("g", "", "", True)])


def test_state_goes_with_the_rows():
    """early tokens are one value of the message's state, however many; the time of a message is that of its last token."""
    import pandas as pd

    class Group:
        def __init__(self):
            self.get, self.until, self.mark, self.hasTimedOut, self.calls = None, None, 0, False, 0

        exists = property(lambda self: self.get is not None)
        getCurrentWatermarkMs = lambda self: self.mark

        def update(self, value):
            self.get, self.calls = value, self.calls + 1

        def setTimeoutTimestamp(self, at):
            self.until, self.calls = at, self.calls + 1

        def remove(self):
            self.get = None

    take, group = tokens.taking("<|im_end|>", 1000), Group()
    rows = lambda *at, token="x": iter([pd.DataFrame({"seq": at, "token": [token] * len(at), "ts": pd.to_datetime([s for s in at], unit="s", utc=True)})])
    assert list(take(("m",), rows(*range(1, 500)), group)) == [] and group.calls == 2 and group.until == 499_999
    assert len(group.get[-1]) == 498 + 1 and group.get[4] == 0
    assert list(take(("m",), rows(0), group)) == [] and group.get[:2] == ("x" * 500, "") and group.get[-1] == [] and group.until == 499_999
    [given] = take(("m",), rows(500, token="<|im_end|>"), group)
    assert given.values.tolist() == [["m", "x" * 500, "", True]]
    group.hasTimedOut = True
    assert list(take(("m",), iter([]), group)) == [] and not group.exists
    late = Group()
    late.mark = 10**9
    assert [x.values.tolist() for x in take(("n",), rows(0), late)] == [[["n", "x", "", False]]] and not late.exists
