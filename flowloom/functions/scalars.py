"""Row-level column expressions; everything stays inside generated code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from flowloom import fixed


# --- labels ---------------------------------------------------------------

def binetflow_label(raw: Column) -> Column:
    return (
        F.when(raw.contains("Botnet"), "bot")
        .when(raw.startswith("flow=Normal") | raw.contains("Normal-"), "benign")
        .otherwise("background")
    )


def zeek_label(raw: Column) -> Column:
    s = F.trim(raw)
    return F.when(s == "Malicious", "bot").when(s == "Benign", "benign").otherwise("background")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def capture_label(path: Column) -> Column:
    """Class of a capture from its file name: ``*_mal_*`` bot, ``*_leg_*`` benign."""
    name = F.lower(file_name(path))
    return (
        F.when(name.rlike(r"_mal[_.]"), "bot")
        .when(name.rlike(r"_leg[_.]"), "benign")
        .otherwise("background")
    )


def capture_family(path: Column) -> Column:
    name = F.lower(file_name(path))
    known = [F.when(name.startswith(f), F.lit(f)) for f in fixed.MALWARE_FAMILIES]
    return F.coalesce(*known, F.lit("unknown"))


# --- scenario names -------------------------------------------------------

def binetflow_scenario(path: Column) -> Column:
    """``.../<N>/x.binetflow`` -> ``ctu13-<N>``."""
    return F.concat(F.lit("ctu13-"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def zeek_scenario(path: Column) -> Column:
    """``...Capture-48-1/...`` -> ``iot23-48-1``; honeypot captures keep the word."""
    short = F.regexp_extract(path, r"Capture-([^/]+)", 1)
    honeypot = path.rlike(r"Honeypot[^/]*Capture-")
    return F.concat(F.when(honeypot, "iot23-honeypot-").otherwise("iot23-"), short)


def capture_scenario(path: Column) -> Column:
    return F.concat(F.lit("medbiot-"), file_stem(path))


# --- protocols and ports --------------------------------------------------

def _lookup(table: dict, key: Column, default: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(m, key), default)


def protocol_from_name(raw: Column) -> Column:
    key = F.lower(F.coalesce(raw, F.lit("other")))
    return _lookup(fixed.PROTOCOL_BY_NAME, key, F.lit("other"))


def protocol_from_number(number: Column) -> Column:
    key = F.coalesce(number.cast("int"), F.lit(-1))
    return _lookup(fixed.PROTOCOL_BY_NUMBER, key, F.lit("other"))


def profile_protocol(number: Column) -> Column:
    """Protocol name in host profiles: unlisted numbers stay visible."""
    key = F.coalesce(number.cast("int"), F.lit(-1))
    return _lookup(fixed.PROFILE_PROTOCOL_BY_NUMBER, key,
                   F.concat(F.lit("proto-"), number.cast("string")))


def protocol_flags(protocol: Column) -> list[Column]:
    """One 0/1 double per protocol; anything unknown counts as ``other``."""
    named = fixed.PROTOCOLS[:-1]
    flags = [F.coalesce((protocol == p).cast("double"), F.lit(0.0)).alias(f"proto_{p}") for p in named]
    rest = F.coalesce((~protocol.isin(named)).cast("double"), F.lit(1.0)).alias("proto_other")
    return [*flags, rest]


# Letters that only occur in spellings such as 1d, 0x1p3, NaN or Infinity.
_NOT_DECIMAL = "[dDfFxXnNiI]"
_HEX = r"^\s*0[xX][0-9A-Fa-f]+\s*$"


def lenient_double(raw: Column) -> Column:
    """Number or NULL; no exception, no Java-only spellings such as ``1d``."""
    return F.when(~raw.rlike(_NOT_DECIMAL), raw.try_cast("double"))


def lenient_long(raw: Column) -> Column:
    """Integer part of a number, exact for large integers; bad text is 0.

    The pattern is only looked at when the text is not a plain integer.
    """
    return F.coalesce(raw.try_cast("bigint"), lenient_double(raw).try_cast("bigint"), F.lit(0).cast("bigint"))


def port_number(raw: Column) -> Column:
    """Decimal, else 0x-hex, else 0; clipped to 0..65535."""
    from_hex = F.when(raw.rlike(_HEX), F.conv(F.substring(F.trim(raw), 3, 64), 16, 10).try_cast("double"))
    value = F.coalesce(raw.try_cast("bigint").cast("double"), lenient_double(raw), from_hex, F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(65535.0), F.floor(value))).cast("int")


# --- time -----------------------------------------------------------------

def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def epoch_to_timestamp(seconds: Column) -> Column:
    """Fractional epoch seconds -> timestamp, rounded to the microsecond."""
    return F.timestamp_micros(F.rint(seconds * 1_000_000).cast("bigint"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.rint(seconds * 1_000_000).cast("bigint"))


def floor_div(a: Column, n: int) -> Column:
    """Integer floor division, exact for large and for negative ``a``."""
    return ((a - F.pmod(a, F.lit(n).cast("bigint"))) / n).cast("bigint")


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned interval that holds ``ts``."""
    w = seconds * 1_000_000
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(w).cast("bigint")))


def parse_naive(raw: Column) -> Column:
    """Zone-less timestamp from the accepted text layouts, else NULL."""
    return F.coalesce(*[
        F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in fixed.BINETFLOW_TIME_FORMATS
    ])


def local_to_utc(naive: Column, zone: str, ambiguous: str = "null") -> Column:
    """Wall clock of ``zone`` (timestamp_ntz) -> UTC instant.

    A wall time inside a forward jump moves to the first instant after it. A
    wall time that occurs twice becomes NULL, or its first occurrence with
    ``ambiguous="first"``.
    """
    from flowloom.schema import ntz_to_utc

    z, utc = F.lit(zone), F.lit("UTC")

    def to_utc(c):
        return F.convert_timezone(z, utc, c)

    def to_wall(c):
        return F.convert_timezone(utc, z, c)

    plain = to_utc(naive)
    back = to_wall(plain)
    after_gap = to_utc(F.date_trunc("HOUR", back).cast("timestamp_ntz"))
    out = F.when(back != naive, after_gap).otherwise(plain)
    if ambiguous == "null":
        hour = F.make_dt_interval(hours=F.lit(1))
        twice = (to_wall(plain + hour) == naive) | (to_wall(plain - hour) == naive)
        out = F.when(~twice | (back != naive), out)
    return ntz_to_utc(out)


# --- traffic --------------------------------------------------------------

def split_by_direction(total_bytes: Column, sent_bytes: Column, total_packets: Column) -> dict[str, Column]:
    """Directional bytes, and packets estimated from the byte share."""
    fwd = F.greatest(sent_bytes, F.lit(0).cast("bigint"))
    bwd = F.greatest(total_bytes - sent_bytes, F.lit(0).cast("bigint"))
    share = F.when(total_bytes > 0, fwd / total_bytes).otherwise(0.5)
    pkts = F.rint(total_packets * share).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return {
        "bytes_fwd": fwd,
        "bytes_bwd": bwd,
        "pkts_fwd": F.greatest(pkts, zero),
        "pkts_bwd": F.greatest(total_packets - pkts, zero),
    }


def conversation_key(src: Column, sport: Column, dst: Column, dport: Column) -> tuple[Column, Column]:
    """The two endpoints of a conversation in a direction-free order."""
    a = F.struct(src.alias("ip"), sport.alias("port"))
    b = F.struct(dst.alias("ip"), dport.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def entropy_bits(counts: list[Column]) -> Column:
    """Shannon entropy over a fixed, short list of category counts."""
    total = sum((c for c in counts[1:]), counts[0])
    weighted = [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in counts]
    acc = sum((w for w in weighted[1:]), weighted[0])
    # The clip removes the -1e-17 that rounding leaves for a single category.
    return F.when(total > 0, F.greatest(F.log2(total.cast("double")) - acc / total, F.lit(0.0))).otherwise(0.0)


def log1p_or_zero(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


# --- hashing --------------------------------------------------------------

def hash_unit(*keys: Column, seed: int) -> Column:
    """A repeatable pseudo-uniform number in [0, 1) for a row key.

    Unlike ``rand`` it survives a re-run of a lost task unchanged.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    return F.pmod(h, F.lit(1_000_000).cast("bigint")) / F.lit(1_000_000.0)


# --- scores ---------------------------------------------------------------

def positive_probability(logit0: Column, logit1: Column) -> Column:
    """Two-class softmax, written so that large logits cannot overflow."""
    d = logit1 - logit0
    return F.when(d >= 0, 1 / (1 + F.exp(-d))).otherwise(F.exp(d) / (1 + F.exp(d)))


def predicted_class(logit0: Column, logit1: Column) -> Column:
    return (logit1 > logit0).cast("int")


def at_threshold(proba: Column, t: Column | float) -> Column:
    """1 if the score reaches the threshold; a missing score (NULL or NaN) does not."""
    return F.when(proba.isNull() | F.isnan(proba), 0).otherwise((proba >= t).cast("int"))


def focal_loss(logit0: Column, logit1: Column, target: Column, gamma: float = fixed.FOCAL_GAMMA,
               alpha: tuple[float, float] | None = None) -> Column:
    """Per-row focal loss of a two-class score."""
    d = F.when(target == 1, logit1 - logit0).otherwise(logit0 - logit1)
    # log softmax of the true class: -log(1 + e^-d), stable on both sides.
    logp = F.when(d >= 0, -F.log1p(F.exp(-d))).otherwise(d - F.log1p(F.exp(d)))
    loss = -F.pow(1 - F.exp(logp), F.lit(float(gamma))) * logp
    if alpha is not None:
        loss = F.when(target == 1, alpha[1]).otherwise(alpha[0]) * loss
    return loss
