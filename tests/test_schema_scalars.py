import math

import pytest
from pyspark.sql import functions as F

from flowloom import fixed, schema
from flowloom.functions import scalars as S
from helpers import flow, table, two_windows


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_empty_frame_is_valid(spark):
    schema.validate_flow_df(schema.empty_flow_df(spark))


@pytest.mark.parametrize("change, message", [
    (lambda d: d.drop("scenario"), "Column mismatch"),
    (lambda d: d.withColumn("label", F.lit("wrong")), "Invalid labels"),
    (lambda d: d.withColumn("protocol", F.lit("sctp")), "Invalid protocols"),
    (lambda d: d.withColumn("flow_id", F.lit(1).cast("bigint")), "not unique"),
    (lambda d: d.withColumn("start_time", F.col("start_time").cast("timestamp_ntz")), "time zone"),
    (lambda d: d.withColumn("src_port", F.col("src_port").cast("bigint")), "dtype"),
])
def test_validator_rejects(spark, change, message):
    with pytest.raises(schema.SchemaError, match=message):
        schema.validate_flow_df(change(two_windows(spark)))


def test_validator_accepts_and_coerces_nan(spark):
    df = table(spark, [flow(0, "a", "b", 0, iat=math.nan, mx=5.0)])
    schema.validate_flow_df(df)
    assert df.first()["mean_iat_ms"] is None and df.first()["max_pkt_size"] == 5.0


def test_binetflow_labels(spark):
    raw = ["flow=From-Botnet-V52-1-TCP-CC42", "flow=To-Botnet-V52-UDP", "flow=Normal-V52-Web", "x-Normal-y",
           "flow=Background-attempt", "", None, "flow=Normal-Botnet"]
    assert column(spark, raw, S.binetflow_label) == [
        "bot", "bot", "benign", "benign", "background", "background", "background", "bot"]


def test_zeek_labels(spark):
    assert column(spark, ["Malicious", "  Malicious  ", "malicious", "Benign", "-", None], S.zeek_label) == [
        "bot", "bot", "background", "benign", "background", "background"]


def test_capture_names(spark):
    names = ["d/mirai_mal_CC_all.pcap", "bashlite_leg.pcap", "MIRAI_MAL_LOCK.PCAP", "torii_mal.pcap", "random.pcap"]
    assert column(spark, names, S.capture_label) == ["bot", "benign", "bot", "bot", "background"]
    assert column(spark, names, S.capture_family) == ["mirai", "bashlite", "mirai", "torii", "unknown"]
    assert column(spark, names[:2], S.capture_scenario) == ["medbiot-mirai_mal_CC_all", "medbiot-bashlite_leg"]


def test_scenario_names(spark):
    paths = ["file:/r/CTU-IoT-Malware-Capture-48-1/bro/conn.log.labeled", "file:/r/CTU-Honeypot-Capture-4-1/bro/conn.log.labeled"]
    assert column(spark, paths, S.zeek_scenario) == ["iot23-48-1", "iot23-honeypot-4-1"]
    assert column(spark, ["file:/r/10/x.binetflow"], S.binetflow_scenario) == ["ctu13-10"]


def test_ports(spark):
    raw = ["80", "0x0035", "0X1F", "", None, "99999", "-5", "80.9", "0xZZ", "abc", " 443 ", "80d", "0xFFFFF"]
    assert column(spark, raw, S.port_number) == [80, 53, 31, 0, 0, 65535, 0, 80, 0, 0, 443, 0, 65535]


def test_lenient_numbers(spark):
    raw = ["1.5", "1e3", ".5", "x", "1d", None, " 7 ", "9007199254740993"]
    assert column(spark, raw, S.lenient_double) == [1.5, 1000.0, 0.5, None, None, None, 7.0, 9007199254740992.0]
    assert column(spark, raw, S.lenient_long) == [1, 1000, 0, 0, 0, 0, 7, 9007199254740993]


def test_protocols(spark):
    assert column(spark, ["TCP", "ipv6-icmp", "icmpv6", "arp", None], S.protocol_from_name) == ["tcp", "icmp", "icmp", "other", "other"]
    assert column(spark, [6, 17, 1, 58, 2, None], S.protocol_from_number, "int") == ["tcp", "udp", "icmp", "icmp", "other", "other"]
    assert column(spark, [6, 58], S.profile_protocol, "int") == ["tcp", "proto-58"]
    df = spark.createDataFrame([("tcp",), ("gre",), (None,)], "p string")
    assert [tuple(r) for r in df.select(*S.protocol_flags(F.col("p"))).collect()] == [
        (1, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 1)]


def test_prague_time(spark):
    raw = ["2011/08/18 10:19:13.328739", "2011-03-27 02:30:00", "2011-10-30 02:30:00", "2011-10-30 03:30:00", "nonsense"]

    def utc(how):
        return lambda c: F.unix_micros(S.local_to_utc(S.parse_naive(c), fixed.BINETFLOW_ZONE, how))

    summer, gap, twice, after, bad = column(spark, raw, utc("null"))
    assert summer == 1313655553328739           # 08:19:13 UTC
    assert gap == 1301187600000000              # jump: 03:00 local = 01:00 UTC
    assert twice is None and bad is None
    assert after == 1319941800 * 10**6          # 02:30 UTC, winter time
    assert column(spark, raw, utc("first"))[2] is not None


def test_packet_estimate_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1000, 500, 5), (0, 0, 3), (100, 300, 4), (1000, 500, 3)], "tot bigint, src bigint, n bigint")
    cols = S.split_by_direction(F.col("tot"), F.col("src"), F.col("n"))
    got = [tuple(r) for r in df.select(*cols.values()).collect()]
    assert got == [(500, 500, 2, 3), (0, 0, 2, 1), (300, 0, 12, 0), (500, 500, 2, 1)]


def test_softmax_and_focal_loss(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1), (1000.0, -1000.0, 0), (-1.0, 1.0, 1)], "a double, b double, y int")
    p = [r[0] for r in df.select(S.positive_probability(F.col("a"), F.col("b"))).collect()]
    assert p == [0.5, 0.0, pytest.approx(1 / (1 + math.exp(-2)))]
    loss = [r[0] for r in df.select(S.focal_loss(F.col("a"), F.col("b"), F.col("y"))).collect()]
    assert loss[0] == pytest.approx(0.25 * math.log(2)) and loss[1] == 0.0


def test_hash_unit_is_repeatable_and_uniform(spark):
    u = spark.range(20000).select(S.hash_unit(F.col("id"), seed=1).alias("u"))
    m = u.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.01 and m[1] >= 0 and m[2] < 1
    assert u.exceptAll(spark.range(20000).select(S.hash_unit(F.col("id"), seed=1))).isEmpty()
