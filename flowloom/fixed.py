"""Fixed values.

Everything in this module is a contract with existing data sets and published
results: column orders, feature orders, name tables, defaults. They are stated
once, as plain text, and imported from here.
"""

# --- canonical flow table -------------------------------------------------
FLOW_COLUMNS = [
    "flow_id", "scenario", "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "start_time", "end_time", "duration_s",
    "bytes_fwd", "bytes_bwd", "pkts_fwd", "pkts_bwd",
    "mean_iat_ms", "std_iat_ms", "min_pkt_size", "max_pkt_size",
    "label", "detailed_label",
]
LABELS = ["bot", "benign", "background"]
PROTOCOLS = ["tcp", "udp", "icmp", "other"]

# --- feature orders -------------------------------------------------------
NODE_FEATURES = [
    "fan_out", "fan_in", "port_entropy", "byte_rate", "packet_rate",
    "protocol_entropy", "out_in_ratio", "avg_flow_duration",
    "log1p_total_flows",
]
EDGE_FEATURES = [
    "total_bytes", "total_packets", "distinct_dst_ports",
    "distinct_src_ports", "mean_flow_duration", "mean_iat_ms",
    "proto_tcp", "proto_udp", "proto_icmp", "proto_other",
]
FLOW_FEATURES = [
    "proto_tcp", "proto_udp", "proto_icmp", "proto_other", "is_outgoing",
    "log1p_duration_s", "log1p_total_bytes", "log1p_total_packets",
    "log1p_mean_iat_ms", "has_iat", "log1p_max_pkt_size", "has_max_pkt",
    "norm_time",
]

# --- raw log layouts ------------------------------------------------------
BINETFLOW_COLUMNS = [
    "StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr",
    "Dport", "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes",
    "Label",
]
BINETFLOW_ZONE = "Europe/Prague"
BINETFLOW_TIME_FORMATS = [
    "yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
]
ZEEK_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p",
    "proto", "service", "duration", "orig_bytes", "resp_bytes",
    "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents", "label", "detailed-label",
]
ZEEK_NULLS = ["-", "(empty)", ""]

# --- name tables ----------------------------------------------------------
PROTOCOL_BY_NAME = {
    "tcp": "tcp", "udp": "udp", "icmp": "icmp", "icmpv6": "icmp",
    "ipv6-icmp": "icmp",
}
PROTOCOL_BY_NUMBER = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp"}
PROFILE_PROTOCOL_BY_NUMBER = {6: "tcp", 17: "udp", 1: "icmp"}
MALWARE_FAMILIES = ["mirai", "bashlite", "torii"]

# --- defaults -------------------------------------------------------------
WINDOW_S = 300
MIN_FLOWS = 20
MIN_NODES = 5
MIN_FLOWS_PER_NODE = 3
MAX_NODES = 400
MAX_FLOWS = 256
SEED = 42
TRAIN_FRAC = 0.6
VAL_FRAC = 0.2
STD_FLOOR = 1e-6
RATIO_EPS = 1e-9
# Decision thresholds 0.05, 0.06, ... 0.95.
THRESHOLD_FIRST, THRESHOLD_LAST, THRESHOLD_COUNT = 0.05, 0.95, 91
FALLBACK_THRESHOLD = 0.5
EDGE_DROP_RATES = [0.0, 0.05, 0.10, 0.20, 0.30]
SANITY_F1 = 0.85
SIZE_QUANTILES = [0.25, 0.50, 0.75, 0.99]
GAP_QUANTILES = [0.01, 0.25, 0.50, 0.75, 0.99]
HISTOGRAM_BINS = 80
SEED_METRICS = ["f1", "precision", "recall", "pr_auc", "roc_auc", "fn"]
FOCAL_GAMMA = 2.0
MARGIN_ALPHA = 1.5
MARGIN_BETA = 0.5
MASK_RATIO = 0.15
POOL_RATIO = 0.5
