"""Small flow tables for value-level tests."""

import datetime as dt

from flowloom.schema import FLOW_SCHEMA, coerce_to_schema

T0 = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)


def flow(i, src, dst, t, *, proto="tcp", port=80, sport=1000, label="benign", dur=0.5, bf=500, bb=1000, pf=5, pb=10,
         iat=None, mx=None, scenario="s"):
    start = T0 + dt.timedelta(seconds=t)
    return (i, scenario, src, dst, sport, port, proto, start, start + dt.timedelta(seconds=dur), float(dur), bf, bb, pf, pb,
            iat, None, None, mx, label, label)


def table(spark, rows):
    return coerce_to_schema(spark.createDataFrame(rows, FLOW_SCHEMA))


def two_windows(spark):
    """Sixty flows in two windows of 300 s."""
    rows = []
    for t in range(0, 100, 10):
        rows.append(("10.0.0.1", "10.0.0.2", t, "tcp", 6667, "bot"))
        rows.append(("10.0.0.2", "10.0.0.1", t + 1, "tcp", 6667, "bot"))
        rows.append(("10.0.0.3", "8.8.8.8", t + 2, "udp", 53, "benign"))
    for t in range(300, 400, 10):
        rows.append(("10.0.0.4", "8.8.8.8", t, "udp", 53, "benign"))
        rows.append(("10.0.0.5", "1.1.1.1", t + 5, "tcp", 443, "benign"))
        rows.append(("10.0.0.5", "1.1.1.1", t + 8, "tcp", 443, "benign"))
    return table(spark, [flow(i, s, d, t, proto=p, port=q, label=l) for i, (s, d, t, p, q, l) in enumerate(rows)])
