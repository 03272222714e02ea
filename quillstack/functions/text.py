"""Text and identity functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that the ends of a text lose.
EDGE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# White space as browsers have it, for a character class.
WHITE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# Query parameters that do not identify a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "mc_cid", "mc_eid")
# IPv4 ranges that a fetch must not reach, as (first address, prefix length).
PRIVATE_V4 = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("127.0.0.0", 8), ("0.0.0.0", 8), ("100.64.0.0", 10), ("224.0.0.0", 4))
SLUG_LENGTH, HASH_LENGTH, FILENAME_LENGTH = 80, 12, 120


def normalized(text: Column) -> Column:
    """One space for each run of ASCII white space, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(EDGE))


def _each_character_alone(text: Column) -> Column:
    """Whether no character of the text can join another in a cluster: below the combining marks, and no CR LF."""
    return ~text.rlike(r"[^\x00-\u02ff]|\r\n")


def graphemes(text: Column) -> Column:
    """The text's grapheme clusters."""
    single = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.when(_each_character_alone(text), single).otherwise(F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0)))


def grapheme_count(text: Column) -> Column:
    return F.when(_each_character_alone(text), F.length(text)).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"(?s)\X"), F.lit(0))))


def furniture_key(line: Column) -> Column:
    """What makes running headers and footers of different pages equal: digits masked, case and spacing evened out."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, r"\s+", " ")), r"[0-9]+", "#"))


def looks_like_plain_text(source: Column) -> Column:
    return ~F.trim(source).rlike("<[A-Za-z!/]")


def content_id(prefix: str, content: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(content.cast("binary"), 256), 1, HASH_LENGTH))


def domain(url: Column) -> Column:
    """Host in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def clean_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameter, parameters sorted by name."""
    base = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(base, "^[^:]+://([^/?]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_extract(base, r"^[^:]+://[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(base, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    return F.concat(
        scheme, F.lit("://"), domain(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", F.lit("/")).otherwise(path), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)),
    )


def url_slug(url: Column) -> Column:
    """A page's durable id: host and path as words, or a hash of the clean URL where that is long or not plain.

    As the query string is no part of the readable form, pages that differ in it alone share a slug.
    """
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "[./_]+", "-"), "-+", "-")
    host = F.regexp_replace(domain(url), r"\.", "-")
    slug = F.lower(F.when(path == "", host).otherwise(F.concat(host, F.lit("-"), path)))
    return F.when(slug.rlike("^[a-z0-9-]+$") & (F.length(slug) <= SLUG_LENGTH), slug).otherwise(content_id("u-", clean_url(url)))


def file_name(title: Column, fallback: str) -> Column:
    name = F.regexp_replace(F.regexp_replace(title, r"[\x00-\x1f]", ""), r'[/\\<>:"|?*]', "")
    name = F.trim(F.regexp_replace(name, r"\s+", " ")).substr(1, FILENAME_LENGTH)
    reserved = name.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")
    return F.when((F.coalesce(name, F.lit("")) == "") | reserved, F.lit(fallback)).otherwise(name)


def ipv4_number(ip: Column) -> Column:
    """The address as a number, null where it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p.rlike(r"^\d{1,3}$"), p.cast("long")))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p <= 255))
    return F.when(valid, F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))


def is_private_v4(ip: Column) -> Column:
    number = ipv4_number(F.regexp_replace(ip, "(?i)^::ffff:", ""))
    return F.coalesce(_in_private_v4(number), F.lit(False))


def _in_private_v4(number: Column) -> Column:
    hit = F.lit(False)
    for first, bits in PRIVATE_V4:
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split(".")))
        hit = hit | number.between(low, low + (1 << (32 - bits)) - 1)
    return hit


def _once(value: Column, f) -> Column:
    """f(value), with value computed once and not put in each of its places."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv6_groups(ip: Column) -> Column:
    """The eight numbers of an IPv6 address in any of its forms, null where it is none. A zone behind % is left out."""
    low = F.lower(F.regexp_replace(F.trim(ip), "%.*$", ""))
    v4 = ipv4_number(F.regexp_extract(low, r"([0-9.]+)$", 1))
    pair = F.concat(F.lower(F.hex(F.floor(v4 / 65536))), F.lit(":"), F.lower(F.hex(v4 % 65536)))
    plain = F.when(low.rlike(r":[0-9]+(\.[0-9]+){3}$"), F.concat(F.regexp_replace(low, "[0-9.]+$", ""), pair)).otherwise(low)
    halves = F.split(plain, "::")
    groups = lambda half: F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def of(parts: Column) -> Column:
        left, right = groups(F.get(parts, F.lit(0))), groups(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return _once(F.struct(F.size(parts).alias("n"), left.alias("l"), right.alias("r")), filled)

    def filled(p: Column) -> Column:
        missing = 8 - F.size(p["l"]) - F.size(p["r"])
        whole = F.concat(p["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["r"])
        fits = (p["n"] <= 2) & F.when(p["n"] == 2, missing >= 1).otherwise(missing == 0)
        return F.when(fits & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))

    return _once(F.coalesce(halves, F.array(F.lit("-"))), of)


def is_private_address(ip: Column) -> Column:
    """Whether a fetch must not reach an IPv4 or IPv6 address: private, local, link-local or multicast; mapped IPv4 in any form."""

    def private(groups: Column) -> Column:
        at = lambda i: F.get(groups, F.lit(i))
        zero = lambda n: F.forall(F.slice(groups, 1, n), lambda g: g == 0)
        # fc00::/7, fe80::/10 and ff00::/8 by their first group, the loopback address, and what maps IPv4.
        v6 = at(0).between(0xFC00, 0xFDFF) | at(0).between(0xFE80, 0xFEBF) | at(0).between(0xFF00, 0xFFFF) | (zero(7) & (at(7) == 1))
        mapped = zero(5) & (at(5) == 0xFFFF) & _once(at(6) * 65536 + at(7), _in_private_v4)
        return F.coalesce(v6 | mapped, F.lit(False))

    return _once(ipv6_groups(ip), private) | is_private_v4(ip)


# Hosts that give out a machine's credentials.
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata.amazonaws.com")


def fetch_refusal(url: Column, addresses: Column) -> Column:
    """Why a URL may not be fetched, given the addresses its host has; empty if it may."""
    return (
        F.when(~F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)), "ssrf-blocked-scheme")
        .when(domain(url).isin(*METADATA_HOSTS), "ssrf-blocked-metadata")
        .when(F.exists(addresses, is_private_address), "ssrf-blocked-private-ip")
        .otherwise("")
    )


def escape_markdown_line(text: Column) -> Column:
    """A line that starts like a list, heading or quote, made plain: backslashes before a leading run or after a number."""
    run = F.regexp_extract(text, r"^[-+*>#]+", 0)
    escaped = F.concat(F.regexp_replace(run, r"(.)", r"\\$1"), F.substring(text, F.length(run) + 1, F.length(text)))
    return F.when(text.rlike(r"^[0-9]+\."), F.regexp_replace(text, r"^([0-9]+)\.", r"$1\\.")).otherwise(escaped)


def safe_entry_name(name: Column) -> Column:
    """Whether an archive entry stays inside its folder: a running depth over path segments that never falls below zero."""
    decoded = F.try_url_decode(F.regexp_replace(name, r"\+", "%2B"))
    plain = ~name.rlike(r"[\x00-\x1f\\]") & ~name.rlike("^([a-zA-Z]:|/|~)") & decoded.isNotNull() & ~decoded.contains("\\")
    parts = F.filter(F.split(decoded, "/"), lambda s: (s != "") & (s != "."))
    named = F.forall(parts, lambda s: ~s.contains(":") & ~s.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"))
    depth = F.aggregate(parts, F.lit(0), lambda n, s: F.when((n < 0) | ((s == "..") & (n == 0)), F.lit(-1)).when(s == "..", n - 1).otherwise(n + 1))
    return F.coalesce(plain & named & (depth > 0), F.lit(False))
