"""Storage URL classification and splitting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import bind

# Host suffixes of the storage endpoints.
BLOB_HOST = (r"\.(?:blob\.core\.windows\.net|blob\.core\.usgovcloudapi\.net"
             r"|blob\.core\.chinacloudapi\.cn|blob\.core\.cloudapi\.de)$")
DFS_HOST = (r"\.(?:dfs\.core\.windows\.net|dfs\.core\.usgovcloudapi\.net"
            r"|dfs\.core\.chinacloudapi\.cn|dfs\.core\.cloudapi\.de)$")
ONELAKE_HOST = r"^(?:[a-z0-9-]+-)?onelake\.dfs\.fabric\.microsoft\.com$"
ONELAKE_PRIVATE_HOST = (r"^([0-9a-f]{2})(?:[0-9a-f]{30}|[0-9a-f]{6}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
                        r"\.z\1\.dfs\.fabric\.microsoft\.com$")
NAMED_SCHEMES = ["abs", "wasb", "wasbs", "adls", "abfs", "abfss", "azure", "s3", "gs",
                 "http", "https", "onelake", "ftp"]
PLACEHOLDER_HOST = "<storage_account>.dfs.core.windows.net"


def _with_parts(u: Column, body) -> Column:
    """``body(parts)`` with the URL taken apart once."""
    p = _split(u)
    packed = F.struct(*[v.alias(k) for k, v in p.items()])
    return bind(packed, lambda s: body({k: s[k] for k in p}))


def _split(u: Column) -> dict[str, Column]:
    """Scheme, authority, host and path of a URL, by pattern (no parser errors)."""
    n = F.replace(F.trim(u), F.lit("\\"), F.lit("/"))
    scheme = F.lower(F.regexp_extract(n, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(n, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(n, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
    no_user = F.substring_index(authority, "@", -1)
    host = F.when(no_user.startswith("["), F.lower(F.regexp_extract(no_user, r"^\[([^\]]*)", 1))
                  ).otherwise(F.rtrim(F.lower(F.substring_index(no_user, ":", 1)), F.lit(".")))
    return {"text": n, "scheme": scheme, "authority": authority, "host": host,
            "path": F.btrim(path, F.lit("/"))}


def _is_onelake(host: Column) -> Column:
    return host.rlike(ONELAKE_HOST) | host.rlike(ONELAKE_PRIVATE_HOST)


def url_kind(u: Column) -> Column:
    """``local`` / ``azure`` / ``s3`` / ``onelake`` / ``other``.

    Hosts are matched by whole suffix, so a look-alike host is ``other``.
    """
    return _with_parts(u, lambda p: _kind(u, p))


def _kind(u: Column, p: dict[str, Column]) -> Column:
    s, host = p["scheme"], p["host"]
    web = s.isin("http", "https")
    return (F.when(u.isNull() | (u == ""), F.lit("local"))
            .when((web | (s == "s3")) & p["authority"].contains("@"), F.lit("other"))
            .when(s == "s3", F.when((host != "") & (p["path"] != ""), F.lit("s3")).otherwise("other"))
            .when((web | s.isin("abfs", "abfss")) & _is_onelake(host), F.lit("onelake"))
            .when(s == "azure", F.lit("azure"))
            .when((s.isin("abs", "wasb", "wasbs") | web) & host.rlike(BLOB_HOST), F.lit("azure"))
            .when((s.isin("adls", "abfs", "abfss") | web) & host.rlike(DFS_HOST), F.lit("azure"))
            .when(F.length(s) > 1, F.lit("other"))
            .otherwise(F.lit("local")))


def url_parts(u: Column, file_name: Column) -> Column:
    """``struct(account_host, container, relative_path)`` of a storage URL.

    Parts that cannot be derived are shown as placeholders, so a caller never
    mistakes a local path for a container-relative one.
    """
    return _with_parts(u, lambda p: _parts(p, file_name))


def _parts(p: dict[str, Column], file_name: Column) -> Column:
    s, authority, host, path = p["scheme"], p["authority"], p["host"], p["path"]
    base = F.substring_index(F.replace(file_name, F.lit("\\"), F.lit("/")), "/", -1)
    fallback = F.when(base != "", base).otherwise(F.lit("<file>"))
    first = F.substring_index(path, "/", 1)
    has_rest = path.contains("/")
    rest = F.when(has_rest, F.substring(path, F.length(first) + 2, F.length(path))).otherwise(F.lit(""))
    or_else = lambda c, d: F.when(c != "", c).otherwise(d)
    user = F.substring_index(authority, "@", 1)
    after_user = F.substring(authority, F.length(user) + 2, F.length(authority))
    azure_host = host.rlike(BLOB_HOST) | host.rlike(DFS_HOST)
    own_scheme = ((s.isin("abs", "wasb", "wasbs") & host.rlike(BLOB_HOST))
                  | (s.isin("adls", "abfs", "abfss") & host.rlike(DFS_HOST)))
    web = s.isin("http", "https")
    pack = lambda a, c, r: F.struct(a.alias("account_host"), c.alias("container"),
                                    r.alias("relative_path"))
    # OneLake: the source root ends with the first "Files" segment
    in_files = F.regexp_extract(path, r"(?i)^((?:[^/]+/)*?files)(?:/(.*))?$", 1)
    after_files = F.regexp_extract(path, r"(?i)^((?:[^/]+/)*?files)(?:/(.*))?$", 2)
    # S3: short bucket names become path-style on the public endpoint
    short_bucket = ~host.contains(".") & ~authority.contains(":")
    return (F.when(own_scheme & authority.contains("@"),
                   pack(or_else(after_user, F.lit(PLACEHOLDER_HOST)),
                        or_else(user, F.lit("<container>")), or_else(path, fallback)))
            .when(own_scheme | (web & azure_host),
                  pack(authority, or_else(first, F.lit("<container>")), or_else(rest, fallback)))
            .when((s == "azure") & (authority != ""),
                  pack(F.lit(PLACEHOLDER_HOST), authority, or_else(path, fallback)))
            .when((s.isin("abfs", "abfss") | web) & _is_onelake(host) & (in_files != ""),
                  pack(authority, in_files, or_else(after_files, fallback)))
            .when((s == "s3") & (authority != ""),
                  F.when(short_bucket, pack(F.lit("s3.amazonaws.com"), authority, or_else(path, fallback)))
                  .otherwise(pack(authority, or_else(first, F.lit("<container>")), or_else(rest, fallback))))
            .otherwise(pack(F.lit(PLACEHOLDER_HOST), F.lit("<container>"),
                            F.concat(F.lit("<path>/"), fallback))))


def url_join(base: Column, file_path: Column) -> Column:
    """Folder or file base plus a file's name: a trailing slash marks a folder,
    a last segment with a dot is already the file."""
    name = F.substring_index(F.replace(file_path, F.lit("\\"), F.lit("/")), "/", -1)
    trimmed = F.rtrim(base, F.lit("/"))
    last = F.substring_index(trimmed, "/", -1)
    joined = F.concat(trimmed, F.lit("/"), name)
    return (F.when(base.isNull() | (base == ""), F.lit(None))
            .when(F.coalesce(name, F.lit("")) == "", base)
            .when(base.endswith("/"), joined)
            .when((last == name) | last.contains("."), trimmed)
            .otherwise(joined))


def listable_prefix(c: Column) -> Column:
    """Literal listing prefix before the first wildcard, cut at its last slash."""
    literal = F.regexp_extract(c, r"^([^*?\[]*)", 1)
    return F.when(~c.rlike(r"[*?\[]"), c).otherwise(
        F.regexp_extract(literal, r"^(.*/)", 1))


def valid_account(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike(r"^[a-z0-9]{3,24}$")


def valid_container(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return text.isin("$root", "$web") | (
        text.rlike(r"^[a-z0-9](?:[a-z0-9-]{1,61})[a-z0-9]$") & ~text.contains("--"))


def valid_blob(c: Column) -> Column:
    """Blob path: at most 1024 long and 99 segments, none empty or dotted, no
    backslash or control character.  The empty path (container root) is valid."""
    text = F.coalesce(c, F.lit(""))
    segments = F.split(F.regexp_replace(text, "/$", ""), "/")
    plain = ~text.rlike("[\\\\\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]")
    return (F.length(text) <= 1024) & plain & ((text == "") | (
        (F.size(segments) <= 99) & F.forall(segments, lambda s: ~s.isin("", ".", ".."))))
