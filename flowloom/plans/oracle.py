"""Reference SQL for the registered queries, in DuckDB's dialect.

Shared sub-results are named once here; ``sql(body)`` prepends the ones a body
needs. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import re

DAY = 86400

CTES: dict[str, str] = {}

CTES["flows"] = """
SELECT event_id AS flow_id,
       CASE WHEN event_id % 2 = 0 THEN 'sc-a' ELSE 'sc-b' END AS scenario,
       concat('u', CAST(user_id AS STRING)) AS src_ip,
       concat('u', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 20 AS STRING)) AS dst_ip,
       CAST(1024 + event_id % 500 AS INT) AS src_port,
       CAST(CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 53 WHEN 2 THEN 443 WHEN 3 THEN 6667 ELSE 23 END AS INT) AS dst_port,
       CASE event_type WHEN 'click' THEN 'tcp' WHEN 'purchase' THEN 'tcp' WHEN 'view' THEN 'udp'
                       WHEN 'error' THEN 'icmp' ELSE 'other' END AS protocol,
       ts AS start_time, epoch_us(ts) AS us,
       value / 10.0 AS duration_s,
       CAST(floor(value * 100) AS BIGINT) AS bytes_fwd,
       CAST(floor(value * 37) AS BIGINT) AS bytes_bwd,
       1 + event_id % 7 AS pkts_fwd,
       event_id % 5 AS pkts_bwd,
       CASE WHEN event_id % 3 = 0 THEN value END AS mean_iat_ms,
       CASE WHEN event_id % 4 = 0 THEN 1500.0 END AS max_pkt_size,
       CASE WHEN event_type = 'error' AND user_id % 10 < 2 THEN 'bot'
            WHEN event_type = 'signup' THEN 'background' ELSE 'benign' END AS label,
       event_type AS detailed_label
FROM events"""

CTES["kept"] = """
SELECT *, (us - us % 86400000000) // 1000000 AS ws FROM flows WHERE label IN ('bot', 'benign')"""

CTES["act"] = """
SELECT scenario, ws, ip, count(*) AS activity
FROM (SELECT scenario, ws, src_ip AS ip FROM kept UNION ALL SELECT scenario, ws, dst_ip FROM kept)
GROUP BY scenario, ws, ip"""

CTES["sizes"] = """
SELECT scenario, ws, n_flows, n_hosts
FROM (SELECT scenario, ws, count(*) AS n_flows FROM kept GROUP BY scenario, ws)
JOIN (SELECT scenario, ws, count(*) AS n_hosts FROM act GROUP BY scenario, ws) USING (scenario, ws)"""

CTES["big"] = "SELECT scenario, ws FROM sizes WHERE n_flows >= 5 AND n_hosts >= 2"

_SELECT = """
SELECT scenario, ws, ip, activity,
       CAST(row_number() OVER (PARTITION BY scenario, ws ORDER BY ip) - 1 AS INT) AS node_idx
FROM (SELECT act.*, row_number() OVER (PARTITION BY scenario, ws ORDER BY activity DESC, ip) AS r
      FROM act JOIN big USING (scenario, ws) WHERE activity >= 3)
WHERE r <= {cap}"""
CTES["sel"] = _SELECT.format(cap=400)
CTES["sel20"] = _SELECT.format(cap=20)

CTES["rf"] = """
SELECT k.*, s.node_idx AS src_idx, d.node_idx AS dst_idx
FROM kept k
JOIN sel s ON k.scenario = s.scenario AND k.ws = s.ws AND k.src_ip = s.ip
JOIN sel d ON k.scenario = d.scenario AND k.ws = d.ws AND k.dst_ip = d.ip"""

CTES["dom"] = """
SELECT scenario, ws, src_ip, dst_ip, protocol AS dominant
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, ws, src_ip, dst_ip ORDER BY c DESC, f) AS r
      FROM (SELECT scenario, ws, src_ip, dst_ip, protocol, count(*) AS c, min(flow_id) AS f
            FROM rf GROUP BY scenario, ws, src_ip, dst_ip, protocol)) WHERE r = 1"""

CTES["edges"] = """
SELECT e.*, CASE WHEN dominant = 'tcp' THEN 1.0 ELSE 0.0 END AS proto_tcp,
       CASE WHEN dominant = 'udp' THEN 1.0 ELSE 0.0 END AS proto_udp,
       CASE WHEN dominant = 'icmp' THEN 1.0 ELSE 0.0 END AS proto_icmp,
       CASE WHEN dominant = 'other' THEN 1.0 ELSE 0.0 END AS proto_other
FROM (SELECT scenario, ws, src_ip, dst_ip, src_idx, dst_idx,
             CAST(sum(bytes_fwd + bytes_bwd) AS DOUBLE) AS total_bytes,
             CAST(sum(pkts_fwd + pkts_bwd) AS DOUBLE) AS total_packets,
             CAST(count(DISTINCT dst_port) AS DOUBLE) AS distinct_dst_ports,
             CAST(count(DISTINCT src_port) AS DOUBLE) AS distinct_src_ports,
             avg(duration_s) AS mean_flow_duration,
             coalesce(avg(mean_iat_ms), 0.0) AS mean_iat_ms
      FROM rf GROUP BY scenario, ws, src_ip, dst_ip, src_idx, dst_idx) e
JOIN dom USING (scenario, ws, src_ip, dst_ip)"""

CTES["outs"] = """
SELECT scenario, ws, src_ip AS ip, count(DISTINCT dst_ip) AS fan_out, sum(bytes_fwd) AS bf, sum(bytes_bwd) AS bb,
       sum(pkts_fwd + pkts_bwd) AS pk, avg(duration_s) AS dur, count(*) AS n
FROM rf GROUP BY scenario, ws, src_ip"""
CTES["ins"] = """
SELECT scenario, ws, dst_ip AS ip, count(DISTINCT src_ip) AS fan_in, sum(bytes_fwd) AS bf, sum(bytes_bwd) AS bb,
       sum(pkts_fwd + pkts_bwd) AS pk, avg(duration_s) AS dur, count(*) AS n
FROM rf GROUP BY scenario, ws, dst_ip"""
CTES["pent"] = """
SELECT scenario, ws, ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h
FROM (SELECT scenario, ws, src_ip AS ip, dst_port, count(*) AS c FROM rf GROUP BY scenario, ws, src_ip, dst_port)
GROUP BY scenario, ws, ip"""
CTES["qent"] = """
SELECT scenario, ws, ip, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h
FROM (SELECT scenario, ws, src_ip AS ip, protocol, count(*) AS c FROM rf GROUP BY scenario, ws, src_ip, protocol)
GROUP BY scenario, ws, ip"""
CTES["botip"] = """
SELECT DISTINCT scenario, ws, ip FROM (
  SELECT scenario, ws, src_ip AS ip FROM rf WHERE label = 'bot'
  UNION ALL SELECT scenario, ws, dst_ip FROM rf WHERE label = 'bot')"""

CTES["nodes"] = """
SELECT s.scenario, s.ws, s.ip, s.node_idx,
       CAST(coalesce(o.fan_out, 0) AS DOUBLE) AS fan_out,
       CAST(coalesce(i.fan_in, 0) AS DOUBLE) AS fan_in,
       greatest(coalesce(pent.h, 0.0), 0.0) AS port_entropy,
       (coalesce(o.bf + o.bb, 0) + coalesce(i.bf + i.bb, 0)) / 86400.0 AS byte_rate,
       (coalesce(o.pk, 0) + coalesce(i.pk, 0)) / 86400.0 AS packet_rate,
       greatest(coalesce(qent.h, 0.0), 0.0) AS protocol_entropy,
       CASE WHEN coalesce(o.bf + o.bb, 0) + coalesce(i.bf + i.bb, 0) > 0
            THEN (coalesce(o.bf, 0) + coalesce(i.bb, 0))
                 / (CAST(coalesce(o.bf + o.bb, 0) + coalesce(i.bf + i.bb, 0) AS DOUBLE) + 1e-9) ELSE 0.0 END AS out_in_ratio,
       coalesce(o.dur, i.dur, 0.0) AS avg_flow_duration,
       ln(1 + coalesce(o.n, i.n, 0)) AS log1p_total_flows,
       CASE WHEN b.ip IS NULL THEN 0 ELSE 1 END AS y
FROM sel s
LEFT JOIN outs o USING (scenario, ws, ip) LEFT JOIN ins i USING (scenario, ws, ip)
LEFT JOIN pent USING (scenario, ws, ip) LEFT JOIN qent USING (scenario, ws, ip)
LEFT JOIN botip b ON s.scenario = b.scenario AND s.ws = b.ws AND s.ip = b.ip"""

CTES["graphs"] = """
SELECT g.scenario, g.ws, n_nodes, n_bot_nodes, graph_y, coalesce(n_edges, 0) AS n_edges,
       CAST(row_number() OVER (PARTITION BY g.scenario ORDER BY g.ws) - 1 AS INT) AS window_idx
FROM (SELECT scenario, ws, count(*) AS n_nodes, CAST(sum(y) AS BIGINT) AS n_bot_nodes, max(y) AS graph_y
      FROM nodes GROUP BY scenario, ws) g
LEFT JOIN (SELECT scenario, ws, count(*) AS n_edges FROM edges GROUP BY scenario, ws) e USING (scenario, ws)"""

CTES["focal"] = """
SELECT k.*, s.ip, s.node_idx FROM kept k JOIN sel s
  ON k.scenario = s.scenario AND k.ws = s.ws AND (k.src_ip = s.ip OR k.dst_ip = s.ip)"""

CTES["ranked"] = """
SELECT *, row_number() OVER (PARTITION BY scenario, ws, ip ORDER BY us, flow_id) - 1 AS p,
       count(*) OVER (PARTITION BY scenario, ws, ip) AS n FROM focal"""

_SEQ = """
SELECT scenario, ws, ip, node_idx, flow_id,
  CAST(row_number() OVER (PARTITION BY scenario, ws, ip ORDER BY us, flow_id) - 1 AS INT) AS pos,
  CASE WHEN protocol = 'tcp' THEN 1.0 ELSE 0.0 END AS proto_tcp,
  CASE WHEN protocol = 'udp' THEN 1.0 ELSE 0.0 END AS proto_udp,
  CASE WHEN protocol = 'icmp' THEN 1.0 ELSE 0.0 END AS proto_icmp,
  CASE WHEN protocol = 'other' THEN 1.0 ELSE 0.0 END AS proto_other,
  CASE WHEN src_ip = ip THEN 1.0 ELSE 0.0 END AS is_outgoing,
  ln(1 + greatest(duration_s, 0)) AS log1p_duration_s,
  ln(1 + bytes_fwd + bytes_bwd) AS log1p_total_bytes,
  ln(1 + pkts_fwd + pkts_bwd) AS log1p_total_packets,
  ln(1 + greatest(coalesce(mean_iat_ms, 0), 0)) AS log1p_mean_iat_ms,
  CASE WHEN mean_iat_ms IS NULL THEN 0.0 ELSE 1.0 END AS has_iat,
  ln(1 + coalesce(max_pkt_size, 0)) AS log1p_max_pkt_size,
  CASE WHEN max_pkt_size IS NULL THEN 0.0 ELSE 1.0 END AS has_max_pkt,
  least(greatest((us - ws * 1000000) / 86400000000.0, 0.0), 1.0) AS norm_time
FROM ({source})"""
CTES["seq_all"] = _SEQ.format(source="SELECT * FROM ranked")
# Pick k of 8 from n rows: k * (n-1)/7 rounded half to even.
CTES["seq_even"] = _SEQ.format(source="""SELECT * FROM ranked WHERE n <= 8 OR p IN (
  SELECT round_even(k * ((n - 1) / 7.0), 0) FROM (SELECT unnest(range(0, 8)) AS k))""")
CTES["seq_hash"] = _SEQ.format(source="""SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY scenario, ws, ip ORDER BY md5(concat_ws('|', flow_id, ip)), flow_id) AS r FROM focal) WHERE r <= 8""")

CTES["splits"] = """
SELECT *, CASE WHEN scenario = 'sc-b' THEN 'test' WHEN k <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train'
               WHEN k <= floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ws) AS k, count(*) OVER (PARTITION BY scenario) AS n FROM graphs)"""

CTES["scored"] = """
SELECT l_linestatus AS scenario, concat(l_orderkey, '-', l_linenumber) AS node_key, l_linenumber AS run,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
       CASE WHEN (CAST(l_quantity AS BIGINT) * 2 % 100) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS y_pred,
       CAST((CAST(l_quantity AS BIGINT) * 2 % 100) AS DOUBLE) / CAST(100 AS DOUBLE) AS proba
FROM lineitem"""

CTES["missing"] = """
SELECT * REPLACE (CASE WHEN run NOT IN (2, 3) THEN proba END AS proba, CASE WHEN run NOT IN (2, 3) THEN y_pred ELSE 0 END AS y_pred) FROM scored"""

CTES["packets"] = """
SELECT CASE WHEN scenario = 'sc-a' THEN 'caps/mirai_mal_CC_all.pcap' ELSE 'caps/torii_leg.pcap' END AS file,
       flow_id AS packet_no, (us + (flow_id * 7919 % 1000) * 1000000) / CAST(1000000 AS DOUBLE) AS ts,
       concat('h', a) AS src, CAST(1000 + a AS INT) AS sport, concat('h', b) AS dst, CAST(1000 + b AS INT) AS dport,
       CASE protocol WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 2 END AS proto,
       CAST(bytes_fwd % 1500 AS INT) AS size
FROM (SELECT *, CAST(substr(src_ip, 2) AS BIGINT) % 20 AS a, CAST(substr(dst_ip, 2) AS BIGINT) AS b FROM flows)"""

# Direction-free conversation key: the smaller (host, port) first.
CTES["keyed"] = """
SELECT *, CASE WHEN (src, sport) <= (dst, dport) THEN concat(src, ':', sport, '|', dst, ':', dport)
               ELSE concat(dst, ':', dport, '|', src, ':', sport) END AS conv FROM packets"""

CTES["pgaps"] = """
SELECT *, CASE WHEN ts > seen THEN (ts - seen) * 1000 END AS gap_ms
FROM (SELECT *, max(ts) OVER (PARTITION BY file, conv, proto ORDER BY packet_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM keyed)"""

CTES["convs"] = """
SELECT file, conv, proto, min(packet_no) AS first_packet, min(ts) AS t_first, max(ts) AS t_last,
       arg_min(src, packet_no) AS src_ip, arg_min(dst, packet_no) AS dst_ip,
       arg_min(sport, packet_no) AS src_port, arg_min(dport, packet_no) AS dst_port,
       arg_min(ts, packet_no) AS ts0, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS packets,
       min(size) AS min_size, max(size) AS max_size, avg(gap_ms) AS mean_iat, stddev_pop(gap_ms) AS std_iat
FROM pgaps GROUP BY file, conv, proto"""

CTES["hostp"] = """
SELECT src, file, packet_no, ts, dst AS dst_ip, CASE WHEN proto IN (6, 17) THEN dport ELSE 0 END AS dst_port,
       CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE concat('proto-', proto) END AS protocol, size
FROM packets"""

CTES["hgaps"] = """
SELECT *, ts - lag(ts) OVER (PARTITION BY src ORDER BY file, packet_no) AS gap_s FROM hostp"""

CTES["nlogits"] = """
SELECT *, fan_out / 10.0 - port_entropy AS logit0, fan_in / 10.0 - protocol_entropy AS logit1 FROM nodes"""

CTES["eunit"] = """
SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', scenario, ws, src_idx, dst_idx)), 1, 8)) AS BIGINT) / 4294967296.0 AS unit FROM edges"""

CTES["runs"] = """
SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS f1, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision,
       tp / CAST(tp + fn AS DOUBLE) AS recall
FROM (SELECT run, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
             count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn
      FROM scored GROUP BY run)"""


def _needed(text: str, out: list[str]) -> None:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text))
    for name in CTES:
        if name in words and name not in out:
            _needed(CTES[name], out)
            out.append(name)


def sql(body: str) -> str:
    """``body`` with the named sub-results it uses in front."""
    names: list[str] = []
    _needed(body, names)
    inline = body.strip()
    head = ", ".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    if inline.upper().startswith("WITH "):
        return f"WITH {head}, {inline[5:]}" if names else inline
    return f"WITH {head} {inline}" if names else inline


def r(expr: str, name: str | None = None) -> str:
    """Rounded double column; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name or expr}"
