"""Column functions on urls. Expressions, not a strict parser, so odd urls give a result and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed

SHAPE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, i), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(netloc(url), "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The port as written; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(netloc(url), r"^.*@|\[[^\]]*\]", ""), r":([0-9]+)$", 1)


def effective_port(url: Column) -> Column:
    return F.when(port(url) != "", port(url)).when(scheme(url) == "https", "443").otherwise("80")


def _is_default(url: Column) -> Column:
    return ((scheme(url) == "https") & (port(url) == "443")) | ((scheme(url) == "http") & (port(url) == "80"))


def normal(url: Column) -> Column:
    """No fragment, user or default port; host in lower case; an empty path is ``/``."""
    shown = F.when((port(url) == "") | _is_default(url), F.lit("")).otherwise(F.concat(F.lit(":"), port(url)))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    query = F.when(part(url, 4) == "", "").otherwise(F.concat(F.lit("?"), part(url, 4)))
    return F.concat(scheme(url), F.lit("://"), host(url), shown, path, query)


def same_origin(origin: Column, target: Column) -> Column:
    return scheme(target).isin("http", "https") & (host(target) != "") & (scheme(target) == scheme(origin)) & (host(target) == host(origin)) & (effective_port(target) == effective_port(origin))


def site_key(url: Column) -> Column:
    """Host without a final dot and a leading www."""
    return F.regexp_replace(F.regexp_replace(host(url), r"\.$", ""), r"^www\.", "")


def origin(url: Column) -> Column:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.concat(scheme(full), F.lit("://"), netloc(full))


def join_root(base: Column, href: Column) -> Column:
    """An absolute or root-relative link against its page; null for other shapes, which need a resolver."""
    whole = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/") & ~href.startswith("//"), F.concat(scheme(base), F.lit("://"), netloc(base), href))
    return F.regexp_replace(whole, "#.*$", "")


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` steps; steps above the root are dropped, and a path that ends in one ends in a slash."""
    steps = F.split(path, "/")
    none = F.array().cast("array<string>")

    def step(out: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x))

    kept = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), none, step)
    ends = F.element_at(steps, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def join(base: Column, href: Column) -> Column:
    """A link resolved against its page, without its fragment. An empty link is the page itself."""
    bare = F.regexp_replace(href, "#.*$", "")
    path, query = part(bare, 3), F.when(F.contains(bare, F.lit("?")), F.concat(F.lit("?"), F.regexp_extract(bare, r"\?(.*)$", 1))).otherwise("")
    own = F.regexp_replace(base, "#.*$", "")
    at = F.concat(part(own, 1), F.lit("://"), netloc(own))
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(part(own, 3), "[^/]*$", ""), "^/+", ""))
    same = F.concat(at, part(own, 3), F.when(F.contains(bare, F.lit("?")), query).otherwise(F.when(F.contains(own, F.lit("?")), F.concat(F.lit("?"), part(own, 4))).otherwise("")))
    return (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(F.startswith(bare, F.lit("//")), F.concat(part(own, 1), F.lit(":"), bare)).when(path == "", same)
        .when(F.startswith(path, F.lit("/")), F.concat(at, without_dots(path), query)).otherwise(F.concat(at, without_dots(F.regexp_replace(F.concat(folder, path), "//+", "/")), query))
    )


def asset_kind(url: Column) -> Column:
    path, out = F.lower(part(url, 3)), F.lit("")
    for end, kind in reversed(fixed.ASSETS):
        out = F.when(path.endswith(end), kind).otherwise(out)
    return out


def _octet(h: Column, i: int) -> Column:
    return F.try_element_at(F.split(h, r"\."), F.lit(i)).try_cast("int")


def is_private_v4(h: Column) -> Column:
    """Whether a host is a literal IPv4 address that is not public."""
    a, b, c = (_octet(h, i) for i in (1, 2, 3))
    inner = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | (a >= 240)
    )
    return h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.coalesce(inner, F.lit(False))


def unsafe_reason(url: Column) -> Column:
    """Why a url is not fetched; empty if it may be."""
    h = F.regexp_replace(host(url), r"\.$", "")
    return (
        F.when(~scheme(url).isin("http", "https") | (h == "") | F.contains(netloc(url), F.lit("@")) | url.rlike("#."), "scheme, host, user or fragment")
        .when((port(url) != "") & ~_is_default(url), "port")
        .when((F.length(url) > 2048) | url.rlike("[\r\n\t]"), "length or control character")
        .when((h == "localhost") | h.endswith(".localhost"), "local host")
        .when(is_private_v4(h) | h.rlike(r"^\[(::1?|fc|fd|fe80)"), "address that is not public")
        .otherwise("")
    )
