"""Mail addresses, domains and IP addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

LABEL = r"[A-Za-z0-9_](?:[A-Za-z0-9_\-]{0,61}[A-Za-z0-9_])?"
STRICT_LABEL = LABEL.replace("_", "")
#: Networks that are never sent from, besides those that are private by class.
NOT_ROUTABLE = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
                "::/128", "::1/128", "2001::/32", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8")


def domain_of(address: Column) -> Column:
    """Lower-case part behind the last @, null without one."""
    return F.when(F.instr(address, "@") > 0, F.lower(F.substring_index(address, "@", -1)))


def normalised(address: Column) -> Column:
    """Lower-case plain mailbox local@host of at most 320 characters with a host of at most 254, else empty."""
    low = F.lower(F.trim(address))
    ok = low.rlike(rf"^[^\s@<>(),;:\\\"\[\]]+@{STRICT_LABEL}(?:\.{STRICT_LABEL})*$") & (F.length(low) <= 320) & (F.length(domain_of(low)) <= 253)
    return F.when(F.coalesce(ok, F.lit(False)), low).otherwise("")


#: A local part of dot-separated atoms.
ATOMS = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]++(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]++)*+"


def mailbox(text: Column) -> Column:
    """The address of a single mailbox as it is written, null for none: plain, in angle brackets behind a name, or in the only brackets of a malformed value.

    A dot at the end is left off. A quoted name may hold brackets. Quoted local parts and comments aren't read.
    """
    plain = rf"^({ATOMS}@[^\s@<>(),;:\\\"\[\]]+?)\.?$"

    def of(t: Column) -> Column:
        count = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark)))
        bare = F.regexp_replace(t, r'^"(?:[^"\\]|\\.)*+"\s*+(?=<[^<>]*+>$)', "")
        inside = lambda v: F.trim(F.regexp_extract(v, r"<([^<>]*)>", 1))
        enclosed = F.when(bare.rlike(r"^<[^<>]*+>$"), inside(bare)).when((count("<") == 1) & (count(">") == 1), inside(t))
        found = F.coalesce(F.nullif(F.regexp_extract(t, plain, 1), F.lit("")), F.nullif(F.regexp_extract(enclosed, plain, 1), F.lit("")))
        return F.when(~found.rlike(r"\.$"), found)

    return let(F.trim(text), of)


def canonical_mailbox(text: Column) -> Column:
    """local@host in lower case of a mailbox of at most 320 bytes, at most 254 in all, with a host of letters, digits and hyphens; else empty."""

    def of(address: Column) -> Column:
        host = F.substring_index(address, "@", -1)
        return F.when(is_dns_name(host) & (F.octet_length(address) <= 254), address)

    return F.coalesce(F.when(F.octet_length(F.trim(text)) <= 320, let(F.lower(mailbox(text)), of)), F.lit(""))


def is_dns_name(name: Column, underscore: bool = False) -> Column:
    """Labels of 1 to 63 letters, digits and inner hyphens, 253 characters in all."""
    label = LABEL if underscore else STRICT_LABEL
    return name.rlike(rf"^{label}(?:\.{label})*$") & (F.length(name) <= 253)


def parent_domains(domain: Column) -> Column:
    """The domain and all its parents down to the last label; one of over 253 characters, which is no name of a host, stands alone."""
    parts = F.split(F.when(F.length(domain) <= 253, domain), r"\.")
    return F.when(F.length(domain) > 253, F.array(domain)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def within_domain(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def identity_domain(identity: Column) -> Column:
    """Domain of an authentication identity: what follows the last @, without a final dot, in lower case."""
    return F.lower(F.regexp_replace(F.substring_index(identity, "@", -1), r"\.$", ""))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number (mapped ::ffff: addresses too), null for other text."""
    plain = F.regexp_replace(F.lower(ip), r"^::ffff:", "")
    parts = F.split(plain, r"\.")
    ok = plain.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p.cast("long")))


def ip_key(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address, or of an IPv4 one as ::ffff:a.b.c.d; null for other text.

    A zone behind % doesn't count, and an IPv4 address has one key however it is written. Keys are ordered as
    the addresses are, so networks are ranges of keys.
    """
    hexed = lambda n, digits: F.lower(F.lpad(F.hex(n), digits, "0"))
    v4 = let(ip_number(ip), lambda n: F.when(n.isNotNull(), F.concat(F.lit("0" * 20 + "ffff"), hexed(n, 8))))
    bare = F.lower(F.regexp_replace(ip, "(?<=:.{0,40})%.+$", ""))
    dotted = F.regexp_extract(bare, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    head = F.left(bare, F.length(bare) - F.length(dotted))
    plain = F.when(dotted == "", bare).otherwise(let(ip_number(dotted), lambda n: F.concat(head, hexed(F.shiftright(n, 16), 4), F.lit(":"), hexed(n % 65536, 4))))

    def of(text: Column) -> Column:
        group = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,7}"
        halves = F.split(text, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        wide = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        n = F.size(groups(0)) + F.size(groups(1))
        short = F.contains(text, F.lit("::"))
        ok = F.regexp_like(text, F.lit(rf"^(?:{group})?(?:::(?:{group})?)?$")) & F.when(short, n <= 7).otherwise(n == 8)
        return F.when(ok, F.concat(wide(groups(0)), F.repeat(F.lit("0000"), F.lit(8) - n), wide(groups(1))))

    return F.coalesce(v4, let(plain, of))


def canonical_ip(ip: Column) -> Column:
    """The usual text of an address: dotted for IPv4, mapped or not; for IPv6 lower case with the longest run of zero groups left out."""

    def of(key: Column) -> Column:
        quad = F.concat_ws(".", *[F.conv(F.substring(key, i, 2), 16, 10) for i in (25, 27, 29, 31)])
        groups = F.concat_ws(":", *[F.regexp_replace(F.substring(key, i, 4), "^0{1,3}", "") for i in range(1, 33, 4)])
        out = groups
        for n in range(2, 9):  # the longest run decides, of equal ones the first
            run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?=:|$):?(.*)$"
            out = F.when(F.regexp_like(groups, F.lit(run)), F.regexp_replace(groups, run, "$1::$2")).otherwise(out)
        return F.when(F.startswith(key, F.lit("0" * 20 + "ffff")), quad).when(key.isNotNull(), out)

    return let(ip_key(ip), of)


def network_keys(network: str) -> tuple[str, str]:
    """First and last key of an address or network; an IPv4-mapped one has to be of /96 at least."""
    import ipaddress

    given = ipaddress.ip_interface(network.strip())
    net = given.network
    if given.version == 6 and given.ip.ipv4_mapped and net.prefixlen < 96:
        raise ValueError(f"{network}: an IPv4-mapped network has to be of /96 at least")
    first, last = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        first, last = first + (0xFFFF << 32), last + (0xFFFF << 32)
    return f"{first:032x}", f"{last:032x}"


def canonical_network(network: str) -> str:
    """One text for all ways to write an address or network: masked, and IPv4 where it is mapped."""
    import ipaddress

    first, last = (int(k, 16) for k in network_keys(network))
    bits = 128 - (last - first).bit_length()
    if first >> 32 == 0xFFFF and bits >= 96:
        return f"{ipaddress.IPv4Address(first & 0xFFFFFFFF)}/{bits - 96}"
    return f"{ipaddress.IPv6Address(first)}/{bits}"


def in_networks(ip: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address lies in one of a few networks, IPv4 or IPv6, by ranges of keys."""

    def of(key: Column) -> Column:
        out = F.lit(False)
        for low, high in map(network_keys, networks):
            out = out | key.between(low, high)
        return F.coalesce(out, F.lit(False))

    return let(ip_key(ip), of)


def is_routable(ip: Column) -> Column:
    """Whether an address can be a sender on the open Internet; false for other text."""
    return ip_key(ip).isNotNull() & ~in_networks(ip, NOT_ROUTABLE)


def organisational(domain: Column, suffixes: tuple[str, ...]) -> Column:
    """The public suffix of `domain` with one more label; null where the domain is itself a suffix.

    Suffixes are those given; any other last label counts as a suffix of its own. The longest wins.
    """
    names = parent_domains(F.lower(domain))
    known = F.filter(names, lambda n: n.isin(*suffixes)) if suffixes else F.array().cast("array<string>")
    suffix = F.coalesce(F.get(known, F.lit(0)), F.element_at(names, -1))
    at = F.array_position(names, suffix).cast("int")
    return F.when(at > 1, F.get(names, at - 2))


def aligned(one: Column, two: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether two domains are of one organisation; a domain that is itself a public suffix is of none."""
    clean = lambda d: F.regexp_replace(F.lower(F.trim(d)), r"\.$", "")
    proper = is_dns_name(clean(one), underscore=True) & is_dns_name(clean(two), underscore=True)
    return F.coalesce(proper & (organisational(clean(one), suffixes) == organisational(clean(two), suffixes)), F.lit(False))


def allowed_by_reverse_dns(names: Column, domains: tuple[str, ...]) -> Column:
    """The first confirmed host name of array<struct<hostname, confirmed>> that is a listed domain or below it; null for none."""
    clean = F.transform(F.filter(names, lambda n: F.coalesce(n["confirmed"], F.lit(False))), lambda n: F.regexp_replace(F.lower(F.trim(n["hostname"])), r"\.$", ""))
    listed = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    return F.get(F.filter(clean, lambda h: is_dns_name(h) & F.arrays_overlap(parent_domains(h), listed)), F.lit(0))
