"""Addresses and network errors by class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_class(ip: Column) -> Column:
    """What an IPv4 address may reach: loopback, private, link-local, reserved, global; invalid for none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.try_cast("int")))
    good = (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p <= 255, F.lit(False)))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    private = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    reserved = (a == 0) | (a >= 224) | ((a == 100) & b.between(64, 127))
    return F.when(~good, "invalid").when(a == 127, "loopback").when(private, "private").when((a == 169) & (b == 254), "link-local").when(reserved, "reserved").otherwise("global")


def error_class(text: Column) -> Column:
    s = F.lower(text)
    return (
        F.when(s.rlike("enotfound|getaddrinfo|name or service not known|nxdomain"), "dns")
        .when(s.rlike("timed? ?out|etimedout"), "timeout")
        .when(s.rlike("econnrefused|connection refused"), "refused")
        .when(s.rlike("certificate|ssl|tls"), "tls")
        .when(s.rlike("econnreset|reset by peer|broken pipe"), "reset")
        .when(s.rlike(r"\b(4\d\d|5\d\d)\b"), "http")
        .otherwise("other")
    )
