"""Addresses: canonical spellings, sites and parameters, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that follow a visitor, carry a session or choose a presentation, never an article.
IDLE_PARAMETERS = (
    r"utm_[^=]*|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|twclid|ttclid|igshid|igsh|mc_[^=]*|_hs[^=]*|hs[a-z]*_[^=]*|mkt_tok|ref|ref_src|ref_url|referrer|"
    r"source|cmpid|cmp|campaign|ito|xtor|at_[^=]*|wt_[^=]*|pk_[^=]*|mtm_[^=]*|piwik_[^=]*|smid|smtyp|spm|scm|icid|ncid|cid|ocid|trk|"
    r"sid|s_cid|session|sessionid|session_id|phpsessid|jsessionid|aspsessionid[^=]*|"
    r"output|print|printable|view|amp|mobile|share|shared"
)
#: Host labels of other presentations of the same site.
SITE_LABELS = r"^(?:(?:www\d?|m|mobile|amp)\.)+(?=[^.]+\.)"
#: Escapes of characters that mean the same unescaped: letters, digits, hyphen, point, underscore, tilde.
_PLAIN_ESCAPES = "4[1-9A-Fa-f]|5[0-9Aa]|6[1-9A-Fa-f]|7[0-9Aa]|3[0-9]|2[DdEe]|5[Ff]|7[Ee]"


def _unescape(part: Column) -> Column:
    """Undoes escapes of characters that need none; all other escapes and plus signs stay, with capital digits."""
    kept = F.regexp_replace(F.regexp_replace(part, f"%(?!{_PLAIN_ESCAPES})", "%25"), r"\+", "%2B")
    return F.when(F.contains(part, F.lit("%")), F.coalesce(F.try_url_decode(kept), part)).otherwise(part)


def address_parts(url: Column) -> dict[str, Column]:
    """host, path and query of an address; empty where absent. White space around the address is ignored."""
    text = F.regexp_replace(url, r"^[\s ​﻿]+|[\s ​﻿]+$", "")
    body = F.regexp_replace(F.regexp_replace(text, r"#.*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_extract(body, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"\.?(?::(?:80|443)?)?$", "")
    return {"host": host, "path": F.regexp_extract(body, r"^[^/?]*([^?]*)", 1), "query": F.regexp_extract(body, r"\?(.*)$", 1)}


def page_parts(url: Column) -> dict[str, Column]:
    """site, path and query of the page that an address names, in one spelling; empty where absent, null for null.

    Ignored are the scheme, the host's letter case, usual ports, labels such as www. or amp., needless escapes, doubled
    and final slashes, a final index.html or amp, the fragment, the order of parameters and IDLE_PARAMETERS. The letter
    case of the path and all other parameters count.
    """
    part = address_parts(url)
    path = F.regexp_replace(_unescape(part["path"]), r"(?i);(?:jsessionid|sid)=[^/]*", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"(?:/(?:index|default)\.html?|/amp)?/?$", "")
    pairs = F.filter(F.split(part["query"], "[&;]"), lambda x: (x != "") & ~F.rlike(x, F.lit(f"(?i)^(?:{IDLE_PARAMETERS})(?:=|$)")))
    return {"site": F.regexp_replace(part["host"], SITE_LABELS, ""), "path": path, "query": F.array_join(F.array_sort(F.transform(pairs, _unescape)), "&")}


def page_address(url: Column) -> Column:
    """page_parts as one address; null for null and blank addresses."""
    part = page_parts(url)
    whole = F.concat(part["site"], part["path"], F.when(part["query"] != "", F.concat(F.lit("?"), part["query"])).otherwise(""))
    return F.when(whole != "", whole)

# Parameters that feed items' addresses lose.
FEED_TRACKING = r"^(?:utm_|fbclid|gclid|mc_|ref$|ref_src|cmpid|ito)"


def feed_address(url: Column) -> Column:
    """The address of a feed item as its key: scheme (https if missing), lower-case host with port, path without its
    parameters behind a semicolon and without final slash, and the query's parameters with a value that aren't FEED_TRACKING,
    in their order, escaped in one way; no fragment."""
    text = F.trim(url)
    scheme = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1), F.lit("")), F.lit("https")))
    body = F.regexp_replace(F.regexp_replace(text, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(body, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(body, r"^[^/?]*([^?]*)", 1), r";[^/]*$", ""), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(body, r"\?(.*)$", 1), "&"), lambda x: F.rlike(x, F.lit(r"^[^=]*=.")))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    escaped = lambda x: F.replace(F.replace(F.url_encode(plain(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name, value = (lambda x: F.regexp_extract(x, r"^([^=]*)", 1)), (lambda x: F.regexp_extract(x, r"^[^=]*=(.*)$", 1))
    kept = F.filter(pairs, lambda x: ~F.rlike(plain(name(x)), F.lit(FEED_TRACKING)))
    query = F.array_join(F.transform(kept, lambda x: F.concat(escaped(name(x)), F.lit("="), escaped(value(x)))), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def domain(url: Column) -> Column:
    """The lower-case host without port and leading www."""
    return F.regexp_replace(F.regexp_replace(address_parts(url)["host"], r":\d+$", ""), r"^www\.", "")


def domain_suffixes(host: Column) -> Column:
    """The host and every suffix of it that begins after a point: what a suffix list can be joined with by equality."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
