"""URLs as column expressions.

The parser is lenient on purpose: a scheme needs no slashes, a port that is no number runs
into the path, and nothing is rejected but empty or over-long text. Everything stays inside
the engine; only decoding and encoding of percent escapes needs Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import ascii_lower

MAX_URL = 16384
MAX_PARAMS = 64
#: Default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}

#: Suffixes of two labels under which domains are registered.
TWO_PART_SUFFIXES = (
    "co.uk", "co.ke", "co.za", "co.in", "co.jp", "co.kr", "co.nz",
    "com.au", "com.br", "com.cn", "com.sg", "com.hk", "com.tw",
    "org.uk", "org.au", "net.au", "ac.uk", "ac.ke",
    "go.ke", "go.jp", "go.kr", "ne.jp", "or.jp", "or.ke",
)

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]{0,29}):(//)?"
IPV4 = r"^[0-9]+(\.[0-9]+){3}$"
IPV6 = r"^\[[0-9a-fA-F:.]*\]"

PARTS = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_ipv4(host: Column) -> Column:
    """Four decimal parts of at most 255; leading zeros are fine."""
    small = F.forall(F.split(host, r"\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return F.when(host.rlike(IPV4), small).otherwise(F.lit(False))


def is_ipv6(host: Column) -> Column:
    return host.rlike(IPV6)


def parsed(url: Column) -> Column:
    """Struct of PARTS; port is -1 where there is none. Null for empty or over-long text."""
    marked = _group(url, SCHEME, 0)
    has_scheme, relative = marked != "", url.startswith("//")

    # Later steps refer to earlier ones, so each is bound.
    def after_scheme(tail: Column) -> Column:
        authority = _group(tail, r"^([^/?#]*)")

        def with_authority(a: Column) -> Column:
            userinfo = _group(a, r"^([^@]*)@")
            hostport = F.when(a.contains("@"), _group(a, r"(?s)^[^@]*@(.*)$")).otherwise(a)

            def with_host(hp: Column) -> Column:
                host = F.when(hp.startswith("["), F.when(hp.contains("]"), _group(hp, r"^(\[[^\]]*\])")).otherwise(hp)).otherwise(_group(hp, r"^([^:]*)"))
                behind = hp.substr(F.length(host) + 1, F.lit(MAX_URL))
                digits = _group(behind, r"^:([0-9]{0,7})")
                number = digits.try_cast("int")
                port = F.when(number.between(1, 65535), number).otherwise(F.lit(-1))
                left = F.when(behind.startswith(":"), behind.substr(F.length(digits) + 2, F.lit(MAX_URL))).otherwise(behind)
                remaining = F.concat(left, tail.substr(F.length(a) + 1, F.lit(MAX_URL)))
                return F.struct(
                    userinfo.alias("userinfo"),
                    host.alias("host"),
                    port.alias("port"),
                    _group(remaining, r"^([^?#]*)").alias("path"),
                    _group(remaining, r"^[^?#]*\?([^#]*)").alias("query"),
                    _group(remaining, r"(?s)^[^#]*#(.*)$").alias("fragment"),
                )

            return bind(hostport, with_host)

        return bind(authority, with_authority)

    tail = F.when(has_scheme, url.substr(F.length(marked) + 1, F.lit(MAX_URL))).otherwise(url.substr(F.lit(3), F.lit(MAX_URL)))
    body = bind(tail, after_scheme)
    scheme = ascii_lower(_group(url, SCHEME))
    bare = F.struct(F.lit("").alias("userinfo"), F.lit("").alias("host"), F.lit(-1).alias("port"), url.alias("path"), F.lit("").alias("query"), F.lit("").alias("fragment"))
    chosen = F.when(has_scheme | relative, body).otherwise(bare)
    whole = bind(chosen, lambda b: F.struct(scheme.alias("scheme"), *(b[k].alias(k) for k in PARTS[1:])))
    return F.when((F.length(url) > 0) & (F.octet_length(url) <= MAX_URL), whole)


def with_url_parts(df, url: str = "url", prefix: str = ""):
    """``df`` with a column per part and with full_host, registrable_domain, tld and subdomain."""
    df = df.withColumn("_p", parsed(F.col(url)))
    for k in PARTS:
        df = df.withColumn(prefix + k, F.col("_p")[k])
    df = df.drop("_p").withColumn("_d", domain_info(F.col(prefix + "host")))
    for k in ("full_host", "registrable_domain", "tld", "subdomain"):
        df = df.withColumn(prefix + k, F.col("_d")[k])
    return df.drop("_d")


def domain_info(host: Column) -> Column:
    """Struct of full_host, registrable_domain, tld, subdomain; null where the host is empty."""

    def of_host(host: Column) -> Column:
        bracket = host.startswith("[")
        full = F.when(bracket, F.when(host.contains("]"), _group(host, r"^\[([^\]]*)\]")).otherwise(host)).otherwise(ascii_lower(host))
        whole = bracket | is_ipv4(ascii_lower(host))
        known = F.struct(full.alias("full"), whole.alias("whole"), F.split(full, r"\.").alias("labels"))
        return F.when(F.length(host) > 0, bind(known, of_labels))

    def of_labels(known: Column) -> Column:
        full, whole, labels = known["full"], known["whole"], known["labels"]
        n = F.size(labels)

        def tail(k: int) -> Column:
            return F.array_join(F.slice(labels, -k, k), ".")

        def head(k: int) -> Column:
            return F.array_join(F.slice(labels, F.lit(1), n - k), ".")

        two = F.when(n >= 3, tail(2).isin(*TWO_PART_SUFFIXES)).otherwise(F.lit(False))
        domain = F.when(whole | (n <= 2), full).when(two & (n >= 4), tail(3)).when(two, full).otherwise(F.when(n >= 2, tail(2)))
        sub = F.when(whole | (n <= 2), F.lit("")).when(two & (n >= 4), head(3)).when(two, F.lit("")).otherwise(F.when(n >= 2, head(2)))
        tld = F.when(whole, F.lit("")).otherwise(F.element_at(labels, -1))
        return F.struct(full.alias("full_host"), domain.alias("registrable_domain"), tld.alias("tld"), sub.alias("subdomain"))

    return bind(host, of_host)


def authority_text(url: Column) -> Column:
    """What stands between :// and the next slash, as it is; null without ://."""
    return F.when(url.contains("://"), _group(url, r"(?s)^.*?://([^/]*)"))


def _behind_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), _group(url, r"(?s)^.*?://(.*)$")).otherwise(url)


def search_host(url: Column) -> Column:
    """The host as searches see it: up to a slash or colon, in lower case, with any userinfo."""
    return ascii_lower(_group(_behind_scheme(url), r"^([^/:]*)"))


def rules_host(url: Column) -> Column:
    """The host as rules see it: without userinfo, up to a colon, slash, ? or #, in lower case."""
    rest = _behind_scheme(url)
    before_slash = _group(rest, r"^([^/]*)")
    bare = F.when(before_slash.contains("@"), _group(rest, r"(?s)^[^@]*@(.*)$")).otherwise(rest)
    return ascii_lower(_group(bare, r"^([^/:?#]*)"))


def rules_path(url: Column) -> Column:
    """The path as rules see it: from the first slash behind host and port, without ? and #."""
    rest = _behind_scheme(url)
    before_slash = _group(rest, r"^([^/]*)")
    bare = F.when(before_slash.contains("@"), _group(rest, r"(?s)^[^@]*@(.*)$")).otherwise(rest)
    return _group(bare, r"^[^/:?#]*(?::[^/?#]*)?(/[^?#]*)")


def clean_path(path: Column) -> Column:
    """Without repeated slashes, . and .. segments; a slash at the end goes."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


_UNRESERVED = re.compile(r"%(2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aAfF]|6[1-9a-fA-F]|7[0-9aAeE])")


@F.pandas_udf(StringType())
def decode_unreserved(texts: pd.Series) -> pd.Series:
    """Escapes of letters, digits and - . _ ~ become these characters; others stay."""
    return texts.str.replace(_UNRESERVED, lambda m: chr(int(m[1], 16)), regex=True)


def normalized(url: Column) -> Column:
    """Struct of PARTS after normalising: lower case, no default port, clean path, no needless escapes."""

    def build(p: Column) -> Column:
        host = ascii_lower(p["host"])
        port = p["port"]
        for scheme, number in DEFAULT_PORTS.items():
            port = F.when((p["scheme"] == scheme) & (p["port"] == number), F.lit(-1)).otherwise(port)
        path = F.when(p["path"] != "", clean_path(p["path"])).otherwise(F.when(host != "", "/").otherwise(""))
        return F.struct(p["scheme"].alias("scheme"), p["userinfo"].alias("userinfo"), host.alias("host"), port.alias("port"), path.alias("path"), p["query"].alias("query"), p["fragment"].alias("fragment"))

    p = parsed(url)
    return F.when(p.isNotNull(), F.element_at(F.transform(F.array(p), build), 1))


def normalize(df, url: str = "url", into: str = "normalized"):
    """``df`` with the normalised URL as text. Rows without an escape never reach Python."""
    df = df.withColumn("_n", normalized(F.col(url)))
    for k in ("path", "query"):
        value = F.col("_n")[k]
        df = df.withColumn(f"_{k}", value)
    need = F.col("_path").contains("%") | F.col("_query").contains("%")
    plain, coded = df.where(~F.coalesce(need, F.lit(False))), df.where(need)
    coded = coded.withColumn("_path", decode_unreserved("_path")).withColumn("_query", decode_unreserved("_query"))
    df = plain.unionByName(coded)
    n = F.col("_n")
    whole = F.struct(n["scheme"].alias("scheme"), n["userinfo"].alias("userinfo"), n["host"].alias("host"), n["port"].alias("port"), F.col("_path").alias("path"), F.col("_query").alias("query"), n["fragment"].alias("fragment"))
    return df.withColumn(into, F.when(n.isNotNull(), reconstruct(whole))).drop("_n", "_path", "_query")


def reconstruct(p: Column) -> Column:
    """The text of a struct of PARTS."""
    some = lambda v, made: F.when(v != "", made).otherwise("")
    return F.concat(
        some(p["scheme"], F.concat(p["scheme"], F.lit("://"))),
        some(p["userinfo"], F.concat(p["userinfo"], F.lit("@"))),
        p["host"],
        F.when(p["port"] > 0, F.concat(F.lit(":"), p["port"].cast("string"))).otherwise(""),
        p["path"],
        some(p["query"], F.concat(F.lit("?"), p["query"])),
        some(p["fragment"], F.concat(F.lit("#"), p["fragment"])),
    )


def percent_decode(c: Column, plus_as_space: bool = True) -> Column:
    """Decoded text; null where an escape is broken or stands for NUL."""
    bad = c.rlike(r"%(?![0-9A-Fa-f]{2})") | c.contains("%00")
    kept = c if plus_as_space else F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.when(~bad, F.when(c.contains("%") | c.contains("+"), F.try_url_decode(kept)).otherwise(c))


def query_params(query: Column) -> Column:
    """Array of (key, value) in order, repeated keys kept, at most MAX_PARAMS; broken escapes stay raw."""
    pairs = F.slice(F.filter(F.split(query, "&"), lambda x: x != ""), 1, MAX_PARAMS)
    decoded = lambda x: F.coalesce(percent_decode(x), x)
    return F.transform(
        pairs,
        lambda x: F.struct(
            decoded(F.when(x.contains("="), _group(x, r"(?s)^([^=]*)=")).otherwise(x)).alias("key"),
            decoded(F.when(x.contains("="), _group(x, r"(?s)^[^=]*=(.*)$")).otherwise("")).alias("value"),
        ),
    )


#: Characters that stay unescaped beside letters, digits and - . _ ~ (fixed values).
KEPT = {"path": "/:@!$&'()*+,;=", "query": "/?:@!$&'()*+,;=", "full": ""}


def percent_encode(c: Column, part: str = "full") -> Column:
    from urllib.parse import quote

    kept = KEPT[part]

    @F.pandas_udf(StringType())
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else quote(t, safe=kept))

    return encode(c)
