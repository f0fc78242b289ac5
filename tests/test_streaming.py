from pyspark.sql import types as T

from seqloom.diagnostics import Diagnostics
from seqloom.functions.topics import channel_topic, exact_topic
from seqloom.streaming.bus import Bus


def test_channel_grammar(spark):
    def match(wanted, topic):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(topic,)], "t string").select(channel_topic(F.col("t"), wanted)).first()[0]

    assert match("A/B/", "A/B") and match("A", "A/B") and match("A/B", "A/B/C/D") and match("A/./B", "A/X/B/C")
    assert not match("A/B", "A/Bish") and not match("A/./B", "A/X/Bish") and not match("A/B", "A")


def test_publish_and_subscribe(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("topic", T.StringType())])
    bus = Bus(spark, str(tmp_path / "bus"), schema)
    got = []
    bus.publish(spark.createDataFrame([(1, "a/b"), (2, "c")], schema))
    read = lambda: bus.subscribe(lambda df, n: got.extend(r["id"] for r in df.collect()), str(tmp_path / "log"), lambda c: channel_topic(c, "a")).awaitTermination(60)
    read()
    bus.publish(spark.createDataFrame([(3, "a"), (4, "ab")], schema))
    read()
    assert got == [1, 3]
    assert bus.stream(lambda c: exact_topic(c, "c")).isStreaming


def test_batches_that_were_handled_are_counted(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("topic", T.StringType())])
    bus, logs = Bus(spark, str(tmp_path / "bus"), schema), [str(tmp_path / x) for x in ("yes", "no", "none")]
    bus.publish(spark.createDataFrame([(1, "a")], schema))
    for log, answer in zip(logs, (True, False, None)):
        bus.subscribe(lambda df, n, answer=answer: answer, log).awaitTermination(60)
    assert [bus.handled()[log] for log in logs] == [1, 0, 1]


def test_diagnostics(spark):
    d = Diagnostics(spark)
    with d.task("x"):
        spark.range(3).count()
    try:
        with d.task("x"):
            raise ValueError
    except ValueError:
        pass
    r = d.summary().first()
    assert (r["name"], r["n"], r["failed"]) == ("x", 2, 1)
