from pyspark.sql import functions as F

from jobscope.functions import decode as B
from jobscope.functions.text import pct2, slurm_time


def _one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_hostlist_ranges(spark):
    lists = {"rack7-n[08-11],login3": ["rack7-n08", "rack7-n09", "rack7-n10", "rack7-n11", "login3"],
             "fat[98-102]": ["fat98", "fat99", "fat100", "fat101", "fat102"],  # no padding: it grows
             "fat[098-102,7,7]": ["fat098", "fat099", "fat100", "fat101", "fat102", "fat7", "fat7"],
             "blade[12-10]": ["blade10", "blade11", "blade12"],  # the wrong way round
             "r[1-2]s[05-06]x": ["r1s05x", "r1s06x", "r2s05x", "r2s06x"], "solo": ["solo"]}
    df = spark.createDataFrame([(k,) for k in lists], "h string")
    assert {r.h: r.n for r in df.select("h", B.hostlist_array("h").alias("n")).collect()} == lists


def test_tres_and_cpuset(spark):
    df = spark.createDataFrame([("1=4,2=1000,1001=3", "0-3,8")], "t string, c string")
    r = df.select(B.tres_get(B.tres_map(F.col("t")), 2).alias("m"), B.tres_get(B.tres_map(F.col("t")), 4).alias("n"),
                  B.cpuset_count(F.col("c")).alias("c")).first()
    assert (r.m, r.n, r.c) == (1000, 0, 5)
    s = B.tres_sum(spark.createDataFrame([(1, "1=1,6=5"), (1, "6=7")], "j int, t string")
                   .select("j", B.tres_map(F.col("t")).alias("m")), ["j"], "m").first()["tres"]
    assert s == {1: 1, 6: 12}


def test_clock_reasons_roundtrip(spark):
    df = spark.createDataFrame([(0,), (0x41,), (0x1000 | 0x2,)], "m long")
    r = df.select(B.clock_reasons(F.col("m")).alias("t")).withColumn("b", B.clock_mask(F.col("t"))).collect()
    assert [x.t for x in r] == ["-", "app,temp", "idle,other"]
    assert [x.b for x in r] == [0, 0x41, 0x1002]


def test_step_names_and_text(spark):
    df = spark.createDataFrame([(-5,), (-3,), (7,), (None,)], "s long")
    assert [r.n for r in df.select(B.step_name(F.col("s")).alias("n")).collect()] == ["batch", "pending", "7", "null"]
    assert _one(spark, B.machine_name(F.col("x")), "GPU Usage") == "gpu_usage"
    assert _one(spark, B.user_of_address(F.col("x")), "alice@example.org") == "alice"


def test_entity_and_proc_stat(spark):
    e = spark.createDataFrame([('hostname="n1",job_id="5",gpu="12"',), ('hostname="n2",gpu="x"',)], "e string")
    r = B.parse_entity(e, "e", F.lit("n1")).collect()
    assert [(x.entity_host, x.entity_jobid, x.gpuid) for x in r] == [("n1", 5, 12)]
    line = "12 (my (odd) proc) S 7 1 1 0 -1 4194304 55 66 0 0 100 200 300 400 20 0 1 0 123 4096 77 1"
    p = B.parse_proc_stat(spark.createDataFrame([(line,)], "l string"), "l").first()
    assert (p.pid, p.comm, p.ppid, p.minflt, p.utime, p.cstime, p.rss_pages) == (12, "my (odd) proc", 7, 55, 100, 400, 77)


def test_text_formats(spark):
    df = spark.createDataFrame([(1, 32, 100000), (2, 3, 86400 * 400 + 3661), (-1, 8, 0)], "a long, b long, s long")
    r = df.select(pct2(F.col("a"), F.col("b")).alias("p"), slurm_time(F.col("s")).alias("t")).collect()
    assert [(x.p, x.t) for x in r] == [("3.12", "1-03:46:40"), ("66.67", "1-35-01:01:01"), ("-12.50", "0-00:00:00")]
    sec, usec = B.split_ticks(F.lit(12345), 100)
    assert spark.range(1).select(sec.alias("s"), usec.alias("u")).first() == (123, 450000)
