r"""Split a URL into scheme, authority, path, query and fragment.

The rules are those of the Python standard library's ``urlparse`` on a URL that
got ``http://`` in front when it has no ``://``: the authority is kept raw (case,
user info, port), path parameters after ``;`` of the last segment are not part
of the path, and an authority with bad brackets makes the URL invalid.
``parse_url`` is not used: it raises on such input and drops port and user info.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemes whose last path segment may carry ;parameters, and
# schemes written with // even when the authority is empty (standard library).
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)
NETLOC_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)
# Characters whose compatibility form contains one of / ? # @ :
UNSAFE_COMPAT = (
    r"[\x{2047}\x{2048}\x{2049}\x{2100}\x{2101}\x{2105}\x{2106}\x{2a74}\x{fe13}"
    r"\x{fe16}\x{fe55}\x{fe56}\x{fe5f}\x{fe6b}\x{ff03}\x{ff0f}\x{ff1a}\x{ff1f}\x{ff20}]"
)


# The generic URI pattern of RFC 3986, appendix B, with a stricter scheme.
SPLIT = (
    r"(?s)\A(?:(\p{Alpha}[\p{Alnum}+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
)


def ipv6_pattern() -> str:
    """IPv6 address grammar of RFC 3986, with an optional %zone."""
    h16 = "[0-9A-Fa-f]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    ls32 = rf"(?:{h16}:{h16}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{h16}:){{6}}{ls32}"]
    for left in range(8):
        head = "" if left == 0 else f"(?:(?:{h16}:){{0,{left - 1}}}{h16})?"
        right = 5 - left
        if right >= 1:
            tail = f"(?:{h16}:){{{right}}}{ls32}"
        else:
            tail = {0: ls32, -1: h16, -2: ""}[right]
        forms.append(f"{head}::{tail}")
    return "(?:" + "|".join(forms) + r")(?:%[^%\]]+)?"


def authority_pattern() -> str:
    """No brackets at all, or the text between the first [ and the next ] is an
    IPv6 or IPvFuture address (the ] may also stand before the [)."""
    host = rf"(?:v[a-fA-F0-9]+\.[^\]]+|{ipv6_pattern()})"
    return (
        rf"\A(?:[^\[\]]*|[^\[]*\[{host}\].*|[^\[\]]*\][^\[]*\[{host})\z"
    )


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("http://"), url))


def strip_unsafe(url: Column) -> Column:
    """Leading control characters and blanks go, tab/CR/LF go everywhere."""
    cleaned = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return F.when(url.rlike(r"[\x00-\x20]"), cleaned).otherwise(url)


def _after(s: Column, head: Column, skip: int) -> Column:
    """What follows `head` and `skip` more characters."""
    return F.substr(s, F.length(head) + skip + 1)


def valid_authority(netloc: Column) -> Column:
    """False for unbalanced brackets, a bracketed host that is no IPv6 or IPvFuture
    address, or characters that turn into delimiters under compatibility mapping."""
    return netloc.rlike(authority_pattern()) & ~netloc.rlike(UNSAFE_COMPAT)


PART_COLUMNS = ("scheme", "netloc", "path", "params", "query", "fragment")


def add_url_parts(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Append the six part columns and ``is_valid_url`` (prefix applies to all).

    One pattern match writes the five groups as lines, which cannot occur in a
    cleaned URL, and a split reads them back. Every part refers to the URL once,
    so a filter that Catalyst pushes down to the scan stays small. A NULL url
    gives empty parts and is not valid.
    """
    p, c = prefix, lambda name: F.col(prefix + name)
    text = F.coalesce(F.col(url), F.lit(""))
    lines = F.regexp_replace(strip_unsafe(with_scheme(text)), SPLIT, "$1\n$2\n$3\n$4\n$5")
    df = df.withColumn(p + "groups", F.split(lines, "\n"))
    df = df.withColumns(
        {
            p + name: F.get(c("groups"), F.lit(i))
            for i, name in enumerate(("rawscheme", "netloc", "fullpath", "query", "fragment"))
        }
    )
    scheme = F.lower(c("rawscheme"))
    takes_params = F.contains(c("fullpath"), F.lit(";")) & scheme.isin(*PARAM_SCHEMES)
    df = df.withColumns(
        {
            p + "scheme": scheme,
            p + "path": F.when(
                takes_params, F.regexp_replace(c("fullpath"), r"(?s);[^/]*\z", "")
            ).otherwise(c("fullpath")),
            p + "is_valid_url": F.col(url).isNotNull() & valid_authority(c("netloc")),
        }
    )
    df = df.withColumn(p + "params", _after(c("fullpath"), c("path"), 1))
    return df.drop(p + "groups", p + "rawscheme", p + "fullpath")


def rebuilt_url(prefix: str = "") -> Column:
    """The URL put together again from its parts (empty ?, # and ; disappear)."""
    c = lambda name: F.col(prefix + name)
    tail = lambda mark, part: F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")
    path = F.concat(c("path"), tail(";", c("params")))
    slashed = F.when((path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    needs_slashes = F.startswith(path, F.lit("//")) | (
        c("scheme").isin(*NETLOC_SCHEMES) & ((path == "") | F.startswith(path, F.lit("/")))
    )
    body = (
        F.when(c("netloc") != "", F.concat(F.lit("//"), c("netloc"), slashed))
        .when(needs_slashes, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    lead = F.when(c("scheme") != "", F.concat(c("scheme"), F.lit(":"))).otherwise("")
    return F.concat(lead, body, tail("?", c("query")), tail("#", c("fragment")))


def _decoded(token: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stays as it is."""
    return F.url_decode(F.regexp_replace(token, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_fields(query: Column) -> Column:
    """array<struct<k, v>> of the decoded fields that have a non-blank value."""
    tokens = F.filter(F.split(query, "&"), lambda t: t.rlike(r"(?s)\A[^=]*=."))
    return F.transform(
        tokens,
        lambda t: F.struct(
            _decoded(F.substring_index(t, "=", 1)).alias("k"),
            _decoded(_after(t, F.substring_index(t, "=", 1), 1)).alias("v"),
        ),
    )


def query_map(query: Column) -> Column:
    """map<key, array<value>> of a query string."""
    fields = query_fields(query)
    keys = F.array_distinct(F.transform(fields, lambda f: f["k"]))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: F.transform(F.filter(fields, lambda f: f["k"] == k), lambda f: f["v"]),
        ),
    )


def longest_field(fields: Column, shortest: bool = False) -> Column:
    """Largest (or smallest) key length + total value length over the keys, 0 if none.

    One fold over the fields sorted by key, so long queries cost n log n.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("k"), F.lit(0).alias("cur"), F.lit(-1).alias("best")
    )

    def pick(acc):
        if shortest:
            return F.when(acc["best"] < 0, acc["cur"]).otherwise(F.least(acc["best"], acc["cur"]))
        return F.greatest(acc["best"], acc["cur"])

    def step(acc, f):
        same = F.coalesce(acc["k"] == f["k"], F.lit(False))
        return F.struct(
            f["k"].alias("k"),
            F.when(same, acc["cur"] + F.length(f["v"]))
            .otherwise(F.length(f["k"]) + F.length(f["v"]))
            .alias("cur"),
            F.when(same | acc["k"].isNull(), acc["best"]).otherwise(pick(acc)).alias("best"),
        )

    return F.aggregate(
        F.array_sort(fields), start, step,
        lambda acc: F.when(acc["k"].isNull(), F.lit(0)).otherwise(pick(acc)),
    )
