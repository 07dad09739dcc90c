"""String, hash and label expressions of the results layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(s: Column) -> Column:
    """Lower case, every other run of characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def label_pairs(label: Column) -> Column:
    """A configuration label such as ``beta=0.5|nprobe=4`` as a map."""
    return F.str_to_map(label, F.lit("\\|"), F.lit("="))


def label_number(label: Column, key: str) -> Column:
    return F.regexp_extract(label, rf"{key}=([0-9]+)", 1).try_cast("long")


def beta_label(beta: Column, nprobe: Column) -> Column:
    return F.format_string("beta=%.4f|nprobe=%d", beta, nprobe)


def strip_zeros(s: Column) -> Column:
    """0.5000 as 0.5, and 1.0000 as 1."""
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def iso_utc(seconds: Column) -> Column:
    """Unix seconds as ISO-8601 in UTC, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    at = F.substring((start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string"), 1, 19)
    return F.concat(F.translate(at, " ", "T"), F.lit("Z"))


def local_display(iso: Column, zone: str) -> Column:
    """An ISO time in UTC as it reads in a time zone."""
    utc = F.regexp_replace(iso, "[TZ]", " ").cast("timestamp_ntz")
    return F.substring(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("string"), 1, 16)


def humane_micros(us: Column) -> Column:
    return F.when(us < 1000, F.format_string("%.0f us", us.cast("double"))).when(us < 1_000_000, F.format_string("%.2f ms", us / 1000.0)).otherwise(F.format_string("%.2f s", us / 1_000_000.0))


def valid_campaign(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9._:-]{1,128}$")


def snapshot_key(name: Column, run: Column) -> Column:
    """An aggregate: 12 hex digits of the SHA-256 of the sorted name=run pairs."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat(name, F.lit("="), run.cast("string")))), "|"), 256), 1, 12)


def tex_escape(s: Column) -> Column:
    """Signs with a meaning in TeX, each by itself, so that what one becomes is not escaped again."""
    # What the signs become.
    becomes = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}
    table = F.create_map(*[F.lit(x) for pair in becomes.items() for x in pair])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")


def fnv1a64(parts: list[bytes]) -> int:
    """FNV-1a over parts, each after its length as eight little-endian bytes."""
    h = 0xCBF29CE484222325
    for part in parts:
        for b in len(part).to_bytes(8, "little") + part:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def machine_id(cpu: str, cores: int, ram_bytes: int) -> str:
    """The first 8 hex digits of FNV-1a over the machine's description."""
    h = 0xCBF29CE484222325
    for b in f"{cpu}\n{cores}\n{ram_bytes}".encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"[:8]
