
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import personas
from tidemark.operators.quality import IntegrityError
from tidemark.streaming import events as stream


def first(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_numbered_lists(spark):
    got = first(spark, text.numbered_items("x"), x="Intro\n1. **A b** - first - one\n 2. C: second\n3 no")
    assert [(r["no"], r["name"], r["definition"]) for r in got] == [(1, "A b", "first - one"), (2, "C", "second")]
    assert first(spark, text.numbered_items("x"), x="") == []


def test_replies(spark):
    for reply, want in (('x {"personas": ["a"]} y', ["a"]), ("{'personas': ['b', 'c']}", ["b", "c"]), ("none", None), ("{broken", None), ("", None)):
        got = first(spark, text.parse_reply("x", "personas array<string>"), x=reply)
        assert (got["personas"] if got else None) == want, reply


def test_formatting_and_checks(spark):
    assert first(spark, text.percent("x"), x=0.1234) == "12.3%" and spark.range(1).select(text.percent(F.lit(None).cast("double"))).first()[0] == "none"
    assert first(spark, text.tokens("x", ["the"]), x="The cat, the CAT & a d0g") == ["cat", "d0g"]
    assert first(spark, text.schema_errors({"name": "a", "text": "b"}, {}), a="ok", b="  ") == ["text is missing"]
    assert first(spark, text.keyword_warnings("x", ["lux", "zzz"]), x="DeLuxe") == ["lux"]
    assert first(spark, text.normalise_dashes("x"), x=" a –  b−c ") == "a - b-c"
    assert first(spark, text.mapped("x", {"teh": "the"}), x="teh") == "the"


def test_fan_out_turns_failures_into_rows(spark):
    def reply_of(prompt):
        if "bad" in prompt:
            raise RuntimeError("refused")
        return f"echo {prompt}"

    prompts = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "done")], "id string, prompt string")
    got = {r["key"]: (r["status"], r["reply"], r["attempts"]) for r in personas.fan_out(prompts, reply_of, "id", "prompt", retries=1).collect()}
    assert got == {"1": ("ok", "echo ok", 1), "2": ("query_failed", "refused", 2), "3": ("ok", "echo done", 1)}
    strict = personas.fan_out(prompts, reply_of, "id", "prompt", accept=lambda r: "done" in r)
    assert {r["key"]: r["status"] for r in strict.collect()} == {"1": "invalid", "2": "query_failed", "3": "ok"}


def test_naming_and_merge(spark):
    replies = spark.createDataFrame([("s1", '{"segment_name": "N", "description": "D", "evidence": ["e"], "cautions": []}'), ("s2", "nothing")], "key string, reply string")
    named = personas.naming_status(replies)
    assert {r["key"]: (r["status"], r["segment_name"]) for r in named.collect()} == {"s1": ("OK", "N"), "s2": ("NAMING_FAILED", None)}
    customers = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s1"), (4, "s2")], "customer_id long, segment string")
    rows = named.withColumnRenamed("key", "segment").drop("errors")
    merged = personas.validate_merge(personas.merge_personas(customers, rows), 4, rows)
    assert {r["customer_id"]: (r["evidence"], r["status"]) for r in merged.collect()} == {1: ('["e"]', "OK"), 3: ('["e"]', "OK"), 2: ("[]", "NAMING_FAILED"), 4: ("[]", "NAMING_FAILED")}
    with pytest.raises(IntegrityError):
        personas.validate_merge(personas.merge_personas(customers, rows.where("segment = 's1'")), 4, rows)
    with pytest.raises(IntegrityError):
        personas.validate_merge(personas.merge_personas(customers, rows.unionByName(rows)), 4, rows)
    with pytest.raises(IntegrityError):
        extra = rows.unionByName(rows.limit(1).withColumn("segment", F.lit("s9")))
        personas.validate_merge(personas.merge_personas(customers, extra), 4, extra)


def test_rounds_reduce_to_one_text():
    calls = []

    def client(prompt):
        calls.append(prompt)
        return f"list {len(calls)}"

    assert personas.map_reduce_rounds([str(i) for i in range(8)], client, (4, 2)) == "list 3"


def test_item_split_keeps_one_for_training(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(1, 4) for i in range(u * u)], "user_id long, item_id long")
    got = personas.split_items(pairs).groupBy("user_id").agg(F.count_if(F.col("part") == "train").alias("n")).collect()
    assert {r["user_id"]: r["n"] for r in got} == {1: 1, 2: 3, 3: 7}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    source = stream.event_stream(spark, f"{tmp_path}/events")
    query = stream.running_scores(source, {"view": 1, "purchase": 5}).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, stream.running_scores(events, {"view": 1, "purchase": 5}).collect()))
    query = stream.daily_counts(stream.event_stream(spark, f"{tmp_path}/events", 10), "40 days").writeStream.format("memory").queryName("daily").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("daily").groupBy().agg(F.sum("n")).first()[0] == events.count()
    windows = stream.session_windows(stream.event_stream(spark, f"{tmp_path}/events", 10), "1 day", "60 days").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").start()
    windows.processAllAvailable()
    windows.stop()
    assert spark.table("sessions").columns == ["user_id", "start", "last", "n_events"]


def test_replies_with_apostrophes_are_read(spark):
    from tidemark.functions.text import parse_reply

    rows = [("{'personas': ['Day\'s End', 'O' , 'Rock n\' Roll fan']}".replace("\\'", "'"),), ('{"personas": ["It\'s fine"]}',), ("{'personas': ['a', \"b's\"]}",), ("none",)]
    got = [r["x"]["personas"] if r["x"] else None for r in spark.createDataFrame(rows, "reply string").select(parse_reply("reply", "personas array<string>").alias("x")).collect()]
    assert got == [["Day's End", "O", "Rock n' Roll fan"], ["It's fine"], ["a", "b's"], None]


def test_calls_run_side_by_side_and_failures_are_rows(spark):
    import time

    def client(prompt):
        time.sleep(0.2)
        if prompt == "3":
            raise ValueError("down")
        return prompt

    df = spark.createDataFrame([(i, str(i)) for i in range(24)], "k long, p string").coalesce(1)
    personas.fan_out(df.limit(1), client, "k", "p").collect()
    began = time.time()
    got = personas.fan_out(df, client, "k", "p", retries=1).collect()
    assert time.time() - began < 0.2 * 24 and [r["key"] for r in got] == [str(i) for i in range(24)]
    assert (got[3]["status"], got[3]["reply"], got[3]["attempts"]) == ("query_failed", "down", 2) and {r["status"] for r in got} == {"ok", "query_failed"}


def test_the_order_of_a_sum_does_not_decide_a_half(spark):
    rows = spark.createDataFrame([(2418895.8499999996,), (2418895.8500000006,), (2418895.84,), (-0.25,), (1e300,), (float("nan"),), (None,)], "x double")
    want = ["2418895.9", "2418895.9", "2418895.8", "-0.3", f"{1e300:.1f}"[:3], "NaN", "none"]
    got = [r[0] for r in rows.select(text.number("x", 1)).collect()]
    assert [*got[:4], got[4][:3], *got[5:]] == want
    shares = spark.createDataFrame([(0.20049999999999998,), (0.2005,)], "x double")
    assert [r[0] for r in shares.select(text.percent("x")).collect()] == ["20.1%", "20.1%"]
