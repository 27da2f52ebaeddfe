import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.operators import packets as P, profile as R
from flowloom.plans import views as V

PACKET = "file string, packet_no bigint, ts double, src string, sport int, dst string, dport int, proto int, size int"


def late(spark):
    rows = [("mirai_mal_CC_all.pcap", 0, 1.0, "A", 1, "B", 2, 6, 60), ("mirai_mal_CC_all.pcap", 1, 1.5, "B", 2, "A", 1, 6, 40),
            ("mirai_mal_CC_all.pcap", 2, 1.2, "A", 1, "B", 2, 6, 60), ("mirai_mal_CC_all.pcap", 3, 3.0, "A", 1, "B", 2, 6, 100)]
    return spark.createDataFrame(rows, PACKET)


@pytest.mark.parametrize("spread", [False, True])
def test_late_packet(spark, spread):
    df = P.packets_to_flows(late(spark), spread=spread)
    schema.validate_flow_df(df)
    r = df.first()
    assert (r["src_ip"], r["pkts_fwd"], r["bytes_fwd"], r["pkts_bwd"], r["bytes_bwd"]) == ("A", 3, 220, 1, 40)
    assert (r["duration_s"], r["mean_iat_ms"], r["std_iat_ms"]) == (2.0, 1000, 500)
    assert (r["min_pkt_size"], r["max_pkt_size"], r["label"], r["detailed_label"]) == (40, 100, "bot", "mirai-mirai_mal_CC_all")
    c = P.packets_to_flows(late(spark), compat_first_ts=True, spread=spread).first()
    gaps = [500, -300, 1800]
    assert c["duration_s"] == 0 and c["end_time"] == c["start_time"]
    assert c["mean_iat_ms"] == pytest.approx(np.mean(gaps)) and c["std_iat_ms"] == pytest.approx(np.std(gaps))


def test_caps(spark):
    p = late(spark)
    assert P.packets_to_flows(p, max_packets=1).first()["mean_iat_ms"] is None
    assert P.packets_to_flows(p, max_packets=2).first()["std_iat_ms"] == 0.0
    extra = p.unionByName(p.withColumns({"packet_no": F.col("packet_no") + 10, "src": F.lit("C")}))
    assert P.conversations(extra, max_flows=1).select("src_ip").distinct().first()[0] == "A"


@pytest.mark.parametrize("fn", [
    lambda p, s: P.conversations(p, max_flows=40, spread=s), lambda p, s: R.host_profile(P.host_packets(p), spread=s),
    lambda p, s: R.peer_churn(P.host_packets(p), spread=s), lambda p, s: R.host_gaps(P.host_packets(p), spread=s)])
def test_spread_way_gives_the_same_rows(spark, sf, fn):
    p = V.packets(spark, sf)

    def r(df):
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    a, b = r(fn(p, False)), r(fn(p, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_churn_brute_force(spark):
    rng = np.random.default_rng(0)
    dst = [f"d{int(x)}" for x in rng.integers(0, 9, 23)]
    df = spark.createDataFrame([("h", "f", i, float(i), d, 0, "tcp", 1) for i, d in enumerate(dst)],
                               "src string, file string, packet_no bigint, ts double, dst_ip string, dst_port int, protocol string, size int")
    got = [r["peers"] for r in R.peer_churn(df).orderBy("quarter").collect()]
    assert got == [len(set(dst[:k])) for k in (5, 10, 15, 20)]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in np.concatenate([rng.normal(0, 5, 500), [30.0]])]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r["bin"]: r["rows"] for r in R.histogram(df, "v").collect()}
    want = np.histogram(v, bins=80)[0]
    assert [got.get(i, 0) for i in range(80)] == want.tolist()
    flat = R.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").collect()
    assert [(r["bin"], r["rows"]) for r in flat] == [(40, 3)]


def test_cohen_d(spark):
    rows = [("s", 1, x) for x in (1.0, 2.0, 3.0)] + [("s", 0, x) for x in (5.0, 7.0)]
    r = R.class_separation(spark.createDataFrame(rows, "scenario string, y int, f double"), ["f"]).first()
    assert r["cohen_d"] == pytest.approx((2 - 6) / math.sqrt((np.var([1, 2, 3]) + 1) / 2 + 1e-9))
