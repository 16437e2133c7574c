"""Column expressions over URLs: admissibility, scope, links, classification."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and address ranges that are never fetched, and URL rules.
INTERNAL_HOSTS = (
    "localhost",
    "localhost.localdomain",
    "ip6-localhost",
    "ip6-loopback",
    "kubernetes",
    "kubernetes.default",
    "kubernetes.default.svc",
    "host.docker.internal",
    "gateway.docker.internal",
)
METADATA_ADDRESSES = ("169.254.169.254", "169.254.170.2", "100.100.100.200", "192.0.0.192", "fd00:ec2::254")
#: first and last address of each IPv4 class, in order of precedence
IPV4_CLASSES = (
    ("unspecified", "0.0.0.0", "0.0.0.0"),
    ("loopback", "127.0.0.0", "127.255.255.255"),
    ("link_local", "169.254.0.0", "169.254.255.255"),
    ("multicast", "224.0.0.0", "239.255.255.255"),
    ("private_range", "0.0.0.0", "0.255.255.255"),
    ("private_range", "10.0.0.0", "10.255.255.255"),
    ("private_range", "172.16.0.0", "172.31.255.255"),
    ("private_range", "192.168.0.0", "192.168.255.255"),
    ("private_range", "192.0.0.0", "192.0.0.7"),
    ("private_range", "192.0.2.0", "192.0.2.255"),
    ("private_range", "198.18.0.0", "198.19.255.255"),
    ("private_range", "198.51.100.0", "198.51.100.255"),
    ("private_range", "203.0.113.0", "203.0.113.255"),
    ("private_range", "240.0.0.0", "255.255.255.255"),
)
IPV6_CLASSES = (
    ("unspecified", "^0{4}(:0{4}){7}$"),
    ("loopback", "^0{4}(:0{4}){6}:0001$"),
    ("link_local", "^fe[89ab]"),
    ("multicast", "^ff"),
    ("private_range", "^(f[cd]|2001:0db8:)"),
)
PRODUCT_BY_PATH = (
    ("/confluence-cloud/", "confluence"),
    ("/jira-service-management-cloud/", "jsm"),
    ("/jira-software-cloud/", "jira"),
    ("/jira-cloud-administration/", "jira"),
    ("/cloud/confluence", "confluence"),
    ("/cloud/jira/service-desk", "jsm"),
    ("/cloud/jira/platform", "jira"),
)
CATEGORY_BY_SEGMENT = (
    ("docs", "user-documentation"),
    ("administration", "administration"),
    ("rest", "rest-api"),
    ("v3", "rest-api"),
    ("platform", "developer"),
    ("service-desk", "developer"),
)
HOW_TO_OPENINGS = ("how to", "create", "add", "delete")

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), _URL, 1))


def authority(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), _URL, 2)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), _URL, 3)


def host(url: Column | str) -> Column:
    """Host in lower case, without user, port and trailing dots."""
    bare = F.regexp_replace(authority(url), "^.*@", "")
    name = F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"[\[\]]", "")), r"\.+$", "")


def port_text(url: Column | str) -> Column:
    bare = F.regexp_replace(authority(url), "^.*@", "")
    return F.regexp_extract(bare, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def segments(url: Column | str) -> Column:
    """Path segments, percent-decoded; empty ones are left out."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    # url_decode turns + into a space, which a path does not mean
    return F.transform(parts, lambda s: F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    number = sum((parts[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), parts[0].cast("long") * 256**3)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _let(value: Column, then) -> Column:
    """``then(value)``, the value being computed once."""
    return F.transform(F.array(value), then)[0]


def ipv6_groups(text: Column) -> Column:
    """The eight groups of four digits of an IPv6 address, in lower case, or null: ``::`` is filled up,
    and an IPv4 address at its end is two groups."""

    def without_tail(t: Column) -> Column:
        hexes = lambda n: F.lower(F.hex(n))
        start = F.regexp_extract(t, r"^(.*:)[\d.]+$", 1)
        joined = lambda n: F.when(n.isNotNull(), F.concat(start, hexes(F.shiftright(n, 16)), F.lit(":"), hexes(n % 65536))).otherwise(t)
        return F.when(F.contains(t, F.lit(".")), _let(ipv4_number(F.regexp_extract(t, r":(\d+(?:\.\d+){3})$", 1)), joined)).otherwise(t)

    def filled(t: Column) -> Column:
        of = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
        halves = lambda h: F.struct(of(h[0]).alias("l"), F.coalesce(of(F.get(h, F.lit(1))), F.array().cast("array<string>")).alias("r"), F.size(h).alias("n"))
        return _let(_let(F.split(t, "::"), halves), padded)

    def padded(h: Column) -> Column:
        gap = 8 - F.size(h["l"]) - F.size(h["r"])
        right_size = F.when(h["n"] == 2, gap >= 1).otherwise((h["n"] == 1) & (gap == 0))
        short = lambda part: F.forall(part, lambda g: F.length(g) <= 4)
        groups = F.concat(h["l"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), h["r"])
        whole = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")
        return F.when(right_size & short(h["l"]) & short(h["r"]), whole)

    plain = lambda t: F.when(t.rlike("^[0-9a-f:]+$") & ~t.rlike(":::|^:[^:]|[^:]:$"), filled(t))
    bare = F.lower(F.regexp_replace(text, "%.*$", ""))  # without a zone
    return F.when(F.contains(text, F.lit(":")), _let(_let(bare, without_tail), plain))


def ip_class(host_: Column | str) -> Column:
    """Why a literal address is refused, or null for names and public addresses.  However an IPv6 address
    is written, and where it stands for an IPv4 address, that one's class counts."""
    metadata = [_number(a) for a in METADATA_ADDRESSES if ":" not in a]

    def by_four(four: Column) -> Column:
        out = F.when(four.isin(*metadata), "cloud_metadata")
        for name, low, high in IPV4_CLASSES:
            out = out.when(four.between(_number(low), _number(high)), name)
        return out

    def by_six(six: Column) -> Column:
        mapped = r"^(?:0{4}:){5}ffff:(.{4}:.{4})$"
        inner = F.conv(F.replace(F.regexp_extract(six, mapped, 1), F.lit(":")), 16, 10).cast("long")
        out = F.when(six.rlike(mapped), _let(inner, by_four)).when(
            six.isin(*[_full(a) for a in METADATA_ADDRESSES if ":" in a]), "cloud_metadata"
        )
        for name, pattern in IPV6_CLASSES:
            out = out.when(six.rlike(pattern), name)
        return out

    host_ = _c(host_)
    return F.when(F.contains(host_, F.lit(":")), _let(ipv6_groups(host_), by_six)).otherwise(_let(ipv4_number(host_), by_four))


def _full(address: str) -> str:
    return ipaddress.IPv6Address(address).exploded


def admissibility(url: Column | str, allowed: Column | str) -> Column:
    """The first reason to refuse a URL, or null; ``allowed`` is an array of hosts."""
    url = _c(url)
    hosts = F.transform(_c(allowed), lambda d: F.regexp_replace(F.lower(F.trim(d)), r"\.+$", ""))
    port = port_text(url)
    number = port.cast("int")
    return (
        F.when(url.isNull() | (url == "") | url.rlike(r"[\n\r\t\x00 ]"), "malformed")
        .when(scheme(url) == "", "not_absolute")
        .when(~scheme(url).isin("http", "https"), "non_web_scheme")
        .when(F.contains(authority(url), F.lit("@")), "embedded_credentials")
        .when((port != "") & (~port.rlike(r"^\d{1,5}$") | (number > 65535)), "malformed")
        .when((port != "") & ~number.isin(80, 443), "disallowed_port")
        .when(host(url) == "", "no_host")
        .when(host(url).isin(*INTERNAL_HOSTS), "not_allowlisted")
        .when(ip_class(host(url)).isNotNull(), ip_class(host(url)))
        .when(~F.array_contains(hosts, host(url)), "not_allowlisted")
    )


def scope_prefix(start_url: Column | str) -> Column:
    """The directory that holds the start page."""
    parts = segments(start_url)
    inside = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(inside) > 0, F.concat(F.lit("/"), F.array_join(inside, "/"), F.lit("/"))).otherwise(
        F.when(F.size(parts) > 0, "//").otherwise("/")
    )


def in_scope(url: Column | str, start_url: Column | str) -> Column:
    """Same host, and below the start page's directory by whole segments."""
    start, got = segments(start_url), segments(url)
    depth = F.greatest(F.size(start) - 1, F.lit(0))
    return (host(url) == host(start_url)) & (F.slice(got, 1, depth) == F.slice(start, 1, depth))


def is_safe_link(url: Column | str) -> Column:
    bare = F.regexp_replace(_c(url), "[\\x00-\\x20\\x7f\u00a0\u2028\u2029\ufeff]", "")
    name = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    relative = (name == "") & ~F.startswith(bare, F.lit("//"))
    return F.coalesce((_c(url) != "") & (relative | name.isin("http", "https", "mailto")), F.lit(False))


def is_external_link(url: Column | str) -> Column:
    return scheme(url).isin("http", "https") | ~F.startswith(_c(url), F.lit("/"))


def page_links(html: Column | str) -> Column:
    """Targets of all anchors, in page order."""
    return F.regexp_extract_all(_c(html), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'>]*)["']"""), 1)


def resolved(href: Column | str, base: Column | str) -> Column:
    """An absolute http(s) URL without fragment, or null; dot segments are removed."""
    href, base = F.trim(_c(href)), _c(base)
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    bare = F.regexp_replace(href, "#.*$", "")
    directory = F.regexp_replace(F.concat(origin, path(base)), "[^/]*$", "")
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), bare))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, bare))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path(base), bare))
        .when(bare == "", F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(directory, bare))
    )
    query = F.regexp_extract(full, r"(\?.*)$", 1)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    raw = F.split(F.regexp_replace(path(full), "^/", ""), "/")
    flat = F.aggregate(raw, F.array().cast("array<string>"), step)
    ends_open = F.element_at(raw, -1).isin(".", "..")
    clean = F.concat(F.lit("/"), F.array_join(flat, "/"), F.when(ends_open & (F.size(flat) > 0), "/").otherwise(""))
    dotted = path(full).rlike(r"(^|/)\.\.?(/|$)")
    out = F.when(dotted, F.concat(scheme(full), F.lit("://"), authority(full), clean, query)).otherwise(full)
    good = (href != "") & scheme(full).isin("http", "https") & (host(full) != "") & ~F.contains(full, F.lit("\\"))
    return F.when(good, out)


def product_of(url: Column | str) -> Column:
    where = F.lower(path(url))
    out = None
    for piece, product in PRODUCT_BY_PATH:
        value = F.struct(F.lit(product).alias("product"), F.lit(0.95).alias("confidence"))
        out = F.when(F.contains(where, F.lit(piece)), value) if out is None else out.when(F.contains(where, F.lit(piece)), value)
    known = host(url).isin("support.atlassian.com", "developer.atlassian.com")
    return out.otherwise(
        F.struct(F.when(known, "jira").otherwise("unknown").alias("product"), F.lit(0.3).alias("confidence"))
    )


def category_of(url: Column | str) -> Column:
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    table = F.create_map(*[F.lit(x) for pair in CATEGORY_BY_SEGMENT for x in pair])
    known = F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull()), F.lit(0))
    as_ = lambda v, c: F.struct(v.alias("category"), F.lit(c).alias("confidence"))
    return (
        F.when(F.size(parts) <= 0, as_(F.lit("root"), 0.3))
        .when(F.array_contains(parts, "rest"), as_(F.lit("rest-api"), 0.95))
        .when(known.isNotNull(), as_(known, 0.6))
        .otherwise(as_(F.lit("general"), 0.3))
    )


def page_type_of(title: Column | str, url: Column | str) -> Column:
    where, name = F.lower(path(url)), F.lower(_c(title))
    as_ = lambda v, c: F.struct(F.lit(v).alias("page_type"), F.lit(c).alias("confidence"))
    opens = F.lit(False)
    for o in HOW_TO_OPENINGS:
        opens = opens | F.startswith(name, F.lit(o))
    return (
        F.when(F.contains(where, F.lit("/rest/")) | F.contains(where, F.lit("/api/")), as_("api_reference", 0.95))
        .when(opens, as_("how_to", 0.6))
        .when(F.contains(name, F.lit("what")) | F.contains(name, F.lit("about")), as_("concept", 0.6))
        .otherwise(as_("guide", 0.3))
    )
