import pytest
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.sources import logs

HEADER = "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label"
ROWS = [
    "2011/08/18 10:00:02.000000,1.5,tcp,1.1.1.1,1025,->,2.2.2.2,80,CON,0,0,5,500,300,flow=From-Botnet-V52-TCP",
    "2011/08/18 10:00:01.000000,0.5,udp,1.1.1.1,0x0035,<->,3.3.3.3,53,CON,0,0,2,200,100,flow=Normal-V52-DNS",
    "2011/08/18 10:00:03.000000,0.5,tcp,4.4.4.4,99,->,3.3.3.3,53,CON,0,0,0,200,100,flow=Normal-V52-DNS",
    "bad time,0.5,tcp,4.4.4.4,99,->,3.3.3.3,53,CON,0,0,3,200,100,flow=Normal-V52-DNS",
    "2011/10/30 02:30:00.000000,0.5,tcp,5.5.5.5,99,->,3.3.3.3,53,CON,0,0,3,200,100,flow=Background",
]


@pytest.fixture()
def ctu(tmp_path):
    d = tmp_path / "10"
    d.mkdir()
    (d / "a.binetflow").write_text("\n".join([HEADER, *ROWS[:3]]) + "\n")
    (d / "b.binetflow").write_text("\n".join([HEADER, *ROWS[3:]]) + "\n")
    (d / "notes.txt").write_text("ignored\n")
    return tmp_path


@pytest.mark.parametrize("spread", [False, True])
def test_binetflow(spark, ctu, spread):
    df = logs.parse_binetflow(spark, str(ctu), spread=spread)
    schema.validate_flow_df(df)
    rows = df.orderBy("flow_id").collect()
    assert [r["flow_id"] for r in rows] == [0, 1, 2]
    udp, tcp, late = rows
    assert (tcp["label"], tcp["bytes_fwd"], tcp["bytes_bwd"], tcp["pkts_fwd"], tcp["scenario"]) == ("bot", 300, 200, 3, "ctu13-10")
    assert (udp["label"], udp["src_port"], udp["protocol"]) == ("benign", 53, "udp")
    # The repeated hour has no instant, but the row stays, last.
    assert late["start_time"] is None and late["src_ip"] == "5.5.5.5"
    assert logs.find_binetflow_files(spark, str(ctu)).count() == 2


def test_single_binetflow_file_and_bad_headers(spark, ctu, tmp_path):
    one = ctu / "10" / "a.binetflow"
    assert logs.load_binetflow(spark, str(one)).count() == 3
    bad = tmp_path / "x.binetflow"
    bad.write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="Unexpected columns"):
        logs.load_binetflow(spark, str(bad))
    # A wrong header in a later file is found by the scan.
    (ctu / "10" / "z.binetflow").write_text(HEADER.replace("Dur", "Length") + "\n" + ROWS[0] + "\n")
    with pytest.raises(Exception):
        logs.load_binetflow(spark, str(ctu)).collect()


def _zeek(**kw):
    f = dict(ts="1525879831.015811", uid="C1", oh="192.168.1.1", op="51524", rh="65.1.1.1", rp="23", proto="tcp", service="-",
             duration="2.99", ob="149", rb="119442", state="S0", lo="-", lr="-", mb="0", hist="S", opk="174", oib="180",
             rpk="172", rib="40", tail="-   Malicious   C&C-HeartBeat") | kw
    return "\t".join(f.values())


def test_zeek(spark, tmp_path):
    d = tmp_path / "CTU-IoT-Malware-Capture-48-1" / "bro"
    d.mkdir(parents=True)
    lines = ["#separator \\x09", _zeek(), _zeek(ts="1525879830.5", tail="(empty)   Benign   -", duration="-", ob="-", proto="ICMPv6"),
             _zeek(tail="-   -   -", ts="1525879840.0"), _zeek(opk="0", rpk="0"), _zeek(oh="-"), "",
             _zeek(ts="1525879850.0") + " # Malicious", _zeek(ts="x")]
    (d / "conn.log.labeled").write_text("\n".join(lines) + "\n")
    df = logs.parse_zeek(spark, str(tmp_path))
    schema.validate_flow_df(df)
    rows = df.orderBy("flow_id").collect()
    assert [r["label"] for r in rows] == ["benign", "bot", "background", "bot"]
    benign, bot = rows[0], rows[1]
    assert (bot["bytes_fwd"], bot["pkts_fwd"], bot["bytes_bwd"], bot["pkts_bwd"]) == (149, 174, 119442, 172)
    assert bot["detailed_label"] == "C&C-HeartBeat" and bot["scenario"] == "iot23-48-1"
    assert (benign["duration_s"], benign["bytes_fwd"], benign["protocol"], benign["detailed_label"]) == (0.0, 0, "icmp", "-")
    raw = logs.load_zeek(spark, str(d / "conn.log.labeled"))
    assert raw.count() == 7 and raw.where("service IS NOT NULL").isEmpty()
    assert logs.find_zeek_files(spark, str(tmp_path)).first()["scenario"] == "iot23-48-1"


def test_find_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        logs.find_captures(spark, str(tmp_path))


def test_find_captures(spark, tmp_path):
    for sub in ("malware", "normal"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / f"{sub}.pcap").write_bytes(b"x")
    assert logs.find_captures(spark, str(tmp_path)).count() == 2
    assert logs.find_captures(spark, str(tmp_path), malware_only=True).count() == 1


def test_flow_ids_follow_time_whatever_the_partitions(spark):
    from helpers import flow, table

    rows = [flow(0, f"h{i % 7}", "x", (i * 37) % 100, scenario="big" if i % 3 else "small") for i in range(300)]
    df = table(spark, rows)
    plain, spread = logs.assign_flow_ids(df, spread=False), logs.assign_flow_ids(df.repartition(5), spread=True)
    assert plain.exceptAll(spread).isEmpty() and spread.count() == 300
    assert spread.groupBy("scenario").agg((F.max("flow_id") - F.min("flow_id") + 1 - F.count_distinct("flow_id")).alias("d")).where("d <> 0").isEmpty()
