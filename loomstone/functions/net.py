"""Column functions over addresses: page URL rule, private networks, viewports, search redirects."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, an IPv6 host in brackets; empty for none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def is_private_host(host: Column) -> Column:
    """Loopback, RFC 1918 and link-local names and addresses."""
    named = host.isin("localhost", "127.0.0.1", "[::1]", "::1", "0.0.0.0")
    return named | host.rlike(r"^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)")


def url_allowed(url: Column, public_only: bool = False) -> Column:
    """https anywhere; http for private hosts only. ``public_only``: both, but never private hosts."""
    scheme, host = url_scheme(url), url_host(url)
    known = scheme.isin("http", "https") & (host != "")
    if public_only:
        return known & ~is_private_host(host)
    return known & ((scheme == "https") | is_private_host(host))


#: Address blocks that are private, reserved, multicast or for documentation (registries of special addresses).
SPECIAL_BLOCKS_4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/3",
)
SPECIAL_BLOCKS_6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")


def is_private_ip(ip: Column) -> Column:
    """Whether an address (IPv4, mapped IPv4, IPv6) lies in a special block: its number against the blocks' ranges."""
    low = F.lower(ip)
    parts = F.split(F.regexp_extract(F.regexp_replace(low, r"^(::ffff:)+", ""), r"^\d{1,3}(\.\d{1,3}){3}$", 0), r"\.")
    number = F.when(F.size(parts) == 4, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("int")))
    blocks = [ipaddress.ip_network(b) for b in SPECIAL_BLOCKS_4]
    special4 = reduce(or_, (number.between(int(b.network_address), int(b.broadcast_address)) for b in blocks))
    # Of IPv6 the first group decides, and the two addresses that have no other.
    first = F.conv(F.regexp_extract(low, "^([0-9a-f]{3,4}):", 1), 16, 10).cast("long")
    wide = [ipaddress.ip_network(b) for b in SPECIAL_BLOCKS_6]
    groups = [(int(b.network_address) >> 112, int(b.broadcast_address) >> 112) for b in wide if b.prefixlen < 128]
    special6 = low.isin(*(str(b.network_address) for b in wide if b.prefixlen == 128)) | F.coalesce(reduce(or_, (first.between(*g) for g in groups)), F.lit(False))
    return F.when(number.isNotNull(), special4).otherwise(special6)


def viewport(text: Column, default: str = "1920x1080", low: int = 200, high: int = 8000) -> Column:
    """Struct (width, height) of ``WxH``; null out of range or malformed, the default for null."""
    text = F.coalesce(text, F.lit(default))
    w, h = (F.regexp_extract(text, r"^\s*(\d{2,5})\s*[xX]\s*(\d{2,5})\s*$", i).try_cast("int") for i in (1, 2))
    return F.when(w.between(low, high) & h.between(low, high), F.struct(w.alias("width"), h.alias("height")))


def percent_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Position in per cent of the page, one decimal, half up."""
    part = lambda v, whole: F.floor(v / whole * 1000 + 0.5) / 10
    return F.struct(part(x, width).alias("x"), part(y, height).alias("y"), part(w, width).alias("w"), part(h, height).alias("h"))


def redirect_target(href: Column) -> Column:
    """The page that a search engine's redirect link leads to, or the link itself."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(href)
