"""IPv4 addresses as numbers (F18), CIDR / netmask / range membership.

All conversions are plain arithmetic on ``split`` parts so they stay inside
whole-stage codegen (no higher-order functions, no UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = 0xFFFFFFFF


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_to_num(ip) -> Column:
    """Dotted quad -> BIGINT; null when the text is not four numeric octets 0..255."""
    return octets_to_num(F.split(_c(ip), r"\."))


def octets_to_num(parts) -> Column:
    """The split parts of a dotted quad -> BIGINT.  On a column of parts each text is split once; inside
    ``ip_to_num`` every octet, test and sum splits it again."""
    parts = _c(parts)
    octs = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    ok = (F.size(parts) == 4)
    for o in octs:
        ok = ok & o.isNotNull() & o.between(0, 255)
    num = octs[0] * 16777216 + octs[1] * 65536 + octs[2] * 256 + octs[3]
    return F.when(ok, num)


def num_to_ip(num) -> Column:
    """BIGINT -> dotted quad (inverse of :func:`ip_to_num` on 0..2^32-1)."""
    n = _c(num).cast("bigint")
    return F.concat_ws(
        ".",
        *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)],
    )


def prefix_mask(prefix_len) -> Column:
    """Netmask of a prefix length as BIGINT (len 0 -> 0, len 32 -> 2^32-1)."""
    if isinstance(prefix_len, int):
        return F.lit((_FULL << (32 - prefix_len)) & _FULL).cast("bigint")
    length = _c(prefix_len)
    return F.lit(1 << 32).cast("bigint") - F.pow(F.lit(2), F.lit(32) - length).cast("bigint")


def network_key(ip_num, prefix_len) -> Column:
    """The network number of ``ip_num`` under ``prefix_len`` (the hashable join key of J7)."""
    return _c(ip_num).bitwiseAND(prefix_mask(prefix_len))


def parse_cidr(cidr: str) -> tuple[int, int]:
    """Parse a literal ``a.b.c.d/len`` parameter into (network number, len)."""
    addr, _, length = cidr.partition("/")
    n = 0
    for part in addr.split("."):
        n = n * 256 + int(part)
    plen = int(length) if length else 32
    mask = (_FULL << (32 - plen)) & _FULL
    return n & mask, plen


def netmask_to_len(mask: str) -> int:
    """``255.255.255.0`` -> 24 (literal parameter)."""
    n = 0
    for part in mask.split("."):
        n = n * 256 + int(part)
    return bin(n).count("1")


def in_cidr(ip_num, cidr: str) -> Column:
    """Membership of a numeric address in a literal CIDR block."""
    net, plen = parse_cidr(cidr)
    mask = (_FULL << (32 - plen)) & _FULL
    return _c(ip_num).bitwiseAND(F.lit(mask)) == F.lit(net)


def in_any_cidr(ip_num, cidrs: list[str]) -> Column:
    cond = F.lit(False)
    for c in cidrs:
        cond = cond | in_cidr(ip_num, c)
    return cond


def in_range(ip_num, lo, hi) -> Column:
    """Address range membership, both ends included (P10)."""
    lo_c = F.lit(lo) if isinstance(lo, int) else (ip_to_num(F.lit(lo)) if isinstance(lo, str) and "." in lo else _c(lo))
    hi_c = F.lit(hi) if isinstance(hi, int) else (ip_to_num(F.lit(hi)) if isinstance(hi, str) and "." in hi else _c(hi))
    return _c(ip_num).between(lo_c, hi_c)
