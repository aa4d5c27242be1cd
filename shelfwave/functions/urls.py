"""URL expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from shelfwave.functions.text import blank_to_null


def absolute(page_url: Column, ref: Column) -> Column:
    """`ref` resolved against the page: full URLs stay, "//host" takes the scheme, "/path" the origin, a query or a
    fragment keeps the page's path, other paths replace the last segment."""
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    no_fragment = F.regexp_replace(page_url, "#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    rooted = F.when(no_query.rlike(r"^[^:]+://[^/]+$"), F.concat(no_query, F.lit("/"))).otherwise(no_query)
    folder = F.regexp_replace(rooted, "[^/]*$", "")
    return (F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref == "", page_url)
            .when(ref.startswith("?"), F.concat(no_query, ref))
            .when(ref.startswith("#"), F.concat(no_fragment, ref))
            .otherwise(F.concat(folder, ref)))


def canonical(url: Column, url_regex: str | None) -> Column:
    """The identity form of a product URL: the regex groups joined and made absolute; the URL itself without a match."""
    if not url_regex:
        return url
    groups = re.compile(url_regex).groups
    path = F.concat(*[F.coalesce(F.regexp_extract(url, url_regex, g), F.lit("")) for g in range(1, groups + 1)]) \
        if groups else F.lit("")
    return F.when(path != "", absolute(url, path)).otherwise(url)


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, percent-decoded."""
    raw = F.regexp_extract(F.regexp_replace(url, "#.*$", ""), rf"[?&]{re.escape(name)}=([^&]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def model_key(url: Column, model_regex: str | None) -> Column:
    """Group 1 of the model regex; NULL without a regex or a match."""
    if not model_regex:
        return F.lit(None).cast("string")
    return F.when(url.rlike(model_regex), F.regexp_extract(url, model_regex, 1))


def domain(value: Column) -> Column:
    """Host of a URL, or a bare domain: lower case, no trailing dot, no leading "www."."""
    host = F.when(value.contains("://"),
                  F.regexp_extract(value, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise(value)
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), r"^www\.", "")


def escaped(text: Column, unsafe: str) -> Column:
    """Percent-encoding over UTF-8 bytes of blanks, control characters, all beyond ASCII and the characters of `unsafe`; what is encoded already stays."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for char in "/?#[]@!$&'()*+,;=:~|\"<>^`{}\\%":
        if char not in unsafe:
            out = F.replace(out, F.lit("%%%02X" % ord(char)), F.lit(char))
    return out


def stored(url: Column, limit: int = 1000) -> Column:
    """The stored form of a product URL: http(s) only, lower-case scheme and host, no default port, "/" after a bare host, path, query and fragment
    percent-encoded by the rules of each (blanks, quotes and other unsafe characters, all bytes of characters beyond ASCII); NULL when invalid or longer
    than `limit`. Line ends and tabs are dropped, blanks around the URL too. Hosts beyond ASCII are kept as they are."""
    clean = F.trim(F.regexp_replace(url, r"[\t\r\n]", ""))
    parts = r"^([hH][tT][tT][pP][sS]?)://([^/?#\\\s]+)([^?#]*)((?:\?[^#]*)?)((?:#.*)?)$"
    part = lambda k: F.regexp_extract(clean, parts, k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.regexp_replace(F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", "")), ":$", "")
    path = F.replace(part(3), F.lit("\\"), F.lit("/"))
    plain = clean.rlike(r"^[\x21\x23-\x26\x28-\x3b\x3d\x3f-\x5b\x5d-\x5f\x61-\x7a\x7c\x7e]*$")  # nothing to encode, as in nearly all
    tail = F.when(plain, F.concat(path, part(4), part(5))).otherwise(F.concat(escaped(path, '"<>`{}'), escaped(part(4), "\"<>'"), escaped(part(5), '"<>`')))
    text = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(F.lit("")), tail)
    return F.when(clean.rlike(parts) & (host != "") & (F.length(text) <= limit), text)


def title_from_url(url: Column) -> Column:
    """Last path segment with "-" as blanks, the title of a page that states none."""
    return F.replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1), F.lit("-"), F.lit(" "))


__all__ = ["absolute", "canonical", "query_value", "model_key", "domain", "stored", "title_from_url", "blank_to_null"]
