"""URL and key normal forms, as columns and as plain Python for Arrow workers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_SPLIT = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?", re.S)


def normalize_url(url: str | None) -> str | None:
    """Scheme and host in lower case; no fragment, default port or trailing `/` (but for the root path).

    The query stays. A text that isn't an absolute URL comes back trimmed.
    """
    if url is None:
        return None
    url = url.strip()
    m = _SPLIT.fullmatch(url)
    if not m:
        return url
    scheme, authority, path, query = m[1].lower(), m[2], m[3], m[4] or ""
    user, at, hostport = authority.rpartition("@")
    host, colon, port = hostport.partition(":") if not hostport.startswith("[") else (hostport, "", "")
    if port and port != DEFAULT_PORTS.get(scheme):
        host += ":" + port
    path = path or "/"
    if not query and path != "/" and path.endswith("/"):
        path = path[:-1]
    return f"{scheme}://{user}{at}{host.lower()}{path}{query}"


def url_col(c: Column) -> Column:
    """normalize_url as built-in expressions; each part is extracted once, so that the code stays small."""
    c = F.trim(c)
    front = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    user = F.regexp_extract(front, r"://(.*@)", 1)
    lower = F.concat(F.lower(F.regexp_extract(front, "^(.*?://)", 1)), user, F.lower(F.regexp_replace(front, "^.*?://(.*@)?", "")))
    site = F.regexp_replace(F.when(user == "", F.lower(front)).otherwise(lower), "^(?:((?:https|wss)://.*):443|((?:http|ws)://.*):80|(ftp://.*):21|(.*):)$", "$1$2$3$4")
    rest = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"^(?=\?|$)", "/")
    return F.when(front != "", F.concat(site, F.regexp_replace(rest, "^([^?]+)/$", "$1"))).otherwise(c)


def host_col(c: Column) -> Column:
    """Host of an absolute URL in lower case, without port or user; null if there is none."""
    h = F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(h != "", h)


def domain_key(c: Column) -> Column:
    """Domain trimmed, in lower case."""
    return F.lower(F.trim(c))


def page_key(c: Column) -> Column:
    """Page without one trailing `/`, unless it is `/`."""
    return F.when(c == "/", c).otherwise(F.regexp_replace(c, "/$", ""))


def query_key(c: Column) -> Column:
    """Query in lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
