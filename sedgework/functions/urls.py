"""URL functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    """Host and port, lower case, without credentials."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def host(url: Column) -> Column:
    """Without port and the dots that may end a full name."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r":[0-9]*$", ""), "[.]+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def absolutize(base: Column, href: Column) -> Column:
    """``href`` against ``base`` without its fragment; dot segments stay as they are."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(origin, F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", ""))
    h = defragment(F.trim(href))
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h == "", defragment(base))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .otherwise(F.concat(folder, h))
    )


def http_with_host(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def blocked(url: Column) -> Column:
    """Routes that are never followed: not http, no host, the machine itself, hidden services."""
    h = host(url)
    return ~http_with_host(url) | h.isin("localhost", "::1", "[::1]", "0.0.0.0") | h.startswith("127.") | h.endswith(".localhost") | (h == "onion") | h.endswith(".onion")


def _pairs(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def _decoded(s: Column) -> Column:
    """Blanks for plus signs, and percent codes resolved; a percent sign that begins none stands for itself."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")), s)


def _encoded(s: Column) -> Column:
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parameters(url: Column, blank: bool = True) -> Column:
    """The query as decoded (k, v); without ``blank`` only those that have a value."""
    pairs = _pairs(url) if blank else F.filter(_pairs(url), lambda p: p.rlike("=."))
    return F.transform(pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))


def _normal(where: Column, url: Column, parameters: Column) -> Column:
    """``where``, then the path without what follows a semicolon in its last part, and the parameters sorted and encoded."""
    q = F.array_join(F.transform(F.array_sort(parameters), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(where, F.regexp_replace(path(url), ";[^/]*$", ""), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def _origin(url: Column) -> Column:
    """Scheme, host and port in lower case; credentials are left out of keys."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def route_identity(url: Column) -> Column:
    """Lower scheme and host without the dot at its end, port, path without parameters, query sorted by decoded
    names and values; no fragment.  What has no host or no sound port only loses its fragment."""
    clean = defragment(url)
    port = F.regexp_extract(netloc(clean), r":([^:\]]*)$", 1)
    number = F.regexp_replace(port, "^0+", "")
    sound = (host(clean) != "") & port.rlike("^[0-9]*$") & (F.coalesce(number.try_cast("long"), F.lit(0)) <= 65535) & (F.length(number) <= 5)
    where = F.concat(scheme(clean), F.lit("://"), host(clean), F.when(number == "", "").otherwise(F.concat(F.lit(":"), number)))
    return F.when(sound, _normal(where, clean, _parameters(clean))).otherwise(clean)


def route_key(url: Column) -> Column:
    """Lower scheme and host, path, and the query sorted by decoded names and values, without tracking and cache-busting
    parameters and without a fragment: spellings of one address give one key."""
    tracking = lambda k: F.lower(k).rlike("^(utm_.*|_|cache_bust|cachebuster|timestamp|ts)$")
    clean = defragment(url)
    return _normal(_origin(clean), clean, F.filter(_parameters(clean), lambda p: ~tracking(p["k"])))


def md5_selector(url: Column) -> Column:
    """The first 32 hex digits among md5 parameters, then path segments; lower case, null without any."""
    hexes = "^[0-9a-fA-F]{32}$"
    values = F.transform(F.filter(_pairs(url), lambda p: F.lower(p).startswith("md5=")), lambda p: F.substring(p, 5, 1000))
    return F.lower(F.coalesce(F.get(F.filter(values, lambda v: v.rlike(hexes)), F.lit(0)), F.get(F.filter(F.split(path(url), "/"), lambda v: v.rlike(hexes)), F.lit(0))))


def canonical(url: Column) -> Column:
    """The form that document identities are made of; parameters without a value are dropped."""
    clean = defragment(url)
    return _normal(_origin(clean), clean, _parameters(clean, blank=False))


def folded_title(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[ \t\n\r\f]+", " ")))


def document_identity(url: Column, mirrors: Column, title: Column) -> Column:
    """md5:<hex> from the source or its mirrors, else source-sha256: and 32 digits of the hash of url and title."""
    source = F.coalesce(F.nullif(url, F.lit("")), F.array_min(mirrors), F.lit(""))
    from_mirrors = F.get(F.filter(F.transform(mirrors, md5_selector), lambda m: m.isNotNull()), F.lit(0))
    md5 = F.coalesce(md5_selector(source), from_mirrors)
    digest = F.sha2(F.concat(canonical(source), F.lit("\n"), folded_title(title)), 256)
    return F.when(md5.isNotNull(), F.concat(F.lit("md5:"), md5)).otherwise(F.concat(F.lit("source-sha256:"), F.substring(digest, 1, 32)))


def query_hash(text: Column, version: str) -> Column:
    """SHA-256 of the JSON list of the folded query and a version."""
    return F.sha2(F.concat(F.lit('["'), folded_title(text), F.lit(f'", "{version}"]')), 256)


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def search_url(template: str, text: Column, page: Column) -> Column:
    """``template`` with {query} percent-encoded and {page} filled in."""
    before, _, rest = template.partition("{query}")
    middle, _, after = rest.partition("{page}")
    return F.concat(F.lit(before), F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit(middle), page.cast("string"), F.lit(after))


# The host of main pages, and what the hosts of gateways hold (fixed values).
MAIN_HOST = "library.lol"
GATEWAYS = ("ipfs.io", "cloudflare-ipfs", "gateway.ipfs", "pinata.cloud", "dweb.link")


def route_rank(url: Column) -> Column:
    """Priority of a download route, by its host and path alone: direct file, main page, get.php, gateway, other."""
    p, h = F.lower(F.regexp_replace(path(url), ";[^/]*$", "")), F.regexp_replace(netloc(url), r":[0-9]*$", "")
    gateway = h.rlike("|".join(g.replace(".", "[.]") for g in GATEWAYS)) | p.contains("/ipfs/")
    return F.when(p.endswith(".pdf"), 0).when((h == MAIN_HOST) & p.startswith("/main/"), 1).when(p.contains("get.php"), 2).when(gateway, 3).otherwise(4)
