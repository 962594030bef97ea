"""Titles, links and storage candidates from raw HTML.

Pages are taken apart with regular expressions inside the row, so no page is
ever split across tasks and only the (small) findings are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import data_extension
from .tokens import bind

# Storage URL shape, virtualisable schemes, storage host shape.
STORAGE_URL = r"(?i)\b((?:abfss|abs|adls|wasbs|https)://[^\s\"'<>()\[\]]+)"
VIRTUAL_SCHEMES = ["abs", "adls", "abfss", "wasbs", "s3", "azure"]
STORAGE_HOST = r"(?i)^https://(?:[^/?#@]*@)?[a-z0-9][a-z0-9-]{1,61}[a-z0-9]\.(blob|dfs)\.core\.windows\.net(?::[0-9]*)?(?:[/?#]|$)"
ANCHOR = r"(?is)<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))[^>]*>(.*?)</a\s*>"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
CODE_BLOCK = r"(?is)<(?:code|pre)\b[^>]*>(.*?)</(?:code|pre)\s*>"
TAG = r"(?s)<[^>]*>"
CODE_TAG = r"(?i)<(?:code|pre)\b"


ENTRY, VALUE = "\u0001", "\u0002"


def _named() -> dict[str, str]:
    from html.entities import html5
    return html5


def _find(key: Column, entries: dict[str, str]) -> Column:
    """Value of a key in a table that is one text in the plan, which is cheaper to plan than a map; null if there is none."""
    text = F.lit(ENTRY + ENTRY.join(k + VALUE + v for k, v in sorted(entries.items())) + ENTRY)
    longest = max(map(len, entries.values())) + 1
    return bind(F.call_function("locate", F.concat(F.lit(ENTRY), key, F.lit(VALUE)), text), lambda at: F.when(
        at > 0, F.substring_index(F.substring(text, at + F.length(key) + 2, F.lit(longest)), ENTRY, 1)))


# Most references of most pages; they need no look into the table.
_USUAL = ("amp;", "lt;", "gt;", "quot;", "nbsp;")
# What numbers 128 to 159 stand for: the Windows characters where there is one.
_WINDOWS = "".join(bytes([n]).decode("cp1252") if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(n) for n in range(128, 160))


def _number(body: Column) -> Column:
    """The character of a numeric reference: a mark for what is none, nothing for control characters and non-characters."""
    hexadecimal = body.rlike("^#[xX]")
    digits = F.regexp_extract(body, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)) \
        .when(hexadecimal, F.conv(digits, 16, 10).try_cast("long")).otherwise(digits.try_cast("long")).cast("long")

    def character(n: Column) -> Column:
        # behind a byte order mark, so that one that is meant is kept
        plain = F.call_function("decode", F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), F.lit("UTF-32"))
        return (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd"))
                .when(n.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS), n.cast("int") - 127, F.lit(1)))
                .when(n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
                      | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE), F.lit("")).otherwise(plain))
    return bind(code, character)


def _name(body: Column) -> Column:
    """The characters of a named reference; old names also count without semicolon, as the longest start of a word."""
    named = _named()
    old = {k: v for k, v in named.items() if not k.endswith(";")}
    start = F.regexp_extract(body, f"^({'|'.join(sorted(old, key=lambda k: (-len(k), k)))})", 1)
    usual = F.lit(None).cast("string")
    for k in _USUAL:
        usual = F.when(body == k, F.lit(named[k])).otherwise(usual)
    by_start = bind(start, lambda s: F.when(s != "", F.concat(_find(s, old), F.substring(body, F.length(s) + 1, F.length(body)))))
    return F.coalesce(usual, _find(body, named), by_start, F.concat(F.lit("&"), body))


def _reference(after: Column) -> Column:
    """Text that follows an ampersand, with the reference it may start with decoded."""
    body = F.regexp_extract(after, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
    return bind(body, lambda b: F.concat(
        F.when(b == "", F.lit("&")).when(b.startswith("#"), _number(b)).otherwise(_name(b)),
        F.substring(after, F.length(b) + 1, F.length(after))))


def decode(c: Column) -> Column:
    """Text with the character references of the HTML standard decoded, inside the JVM.

    A null stays null; an ampersand that starts no reference stays as it is.
    """
    parts = F.transform(F.split(c, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_reference(p)))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def decode_all(c: Column) -> Column:
    """The same for an array of texts."""
    return F.when(F.exists(c, lambda x: x.contains("&")), F.transform(c, lambda x: decode(x))).otherwise(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)


def page_titles(df: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """First ``<title>``, white space collapsed, up to the first ``|``.

    With ``url`` a page without one is called by the last segment of its address, without query and fragment.
    """
    address = F.lit("") if url is None else F.coalesce(F.col(url), F.lit(""))
    titles = df.select(key, raw_title(F.col(html)).alias("t"), address.alias("a"))
    title = F.trim(F.substring_index(collapse(decode(F.col("t"))), "|", 1))
    segment = F.regexp_extract(F.col("a"), r"^[^?#]*?([^/?#]*)/*(?:[?#]|$)", 1)
    return titles.select(key, F.when(F.coalesce(title, F.lit("")) == "", segment).otherwise(title).alias("title"))


def _resolve(href: Column, base: Column) -> Column:
    """Absolute URL of ``href`` on ``base`` without its fragment."""
    ref = F.substring_index(F.trim(href), "#", 1)
    page = F.substring_index(base, "#", 1)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page_path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(page_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    joined = F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    path = F.regexp_extract(joined, r"^([^?]*)", 1)
    query = F.regexp_extract(joined, r"(?s)^[^?]*(.*)$", 1)
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref == "", page)
            .when(ref.startswith("?"), F.concat(root, page_path, ref))
            .otherwise(F.concat(root, _dot_free(path), query)))


def _dot_free(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments (only paths that have them are folded)."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    ends_dir = path.rlike(r"/\.{1,2}$")
    text = F.concat(F.array_join(folded, "/"), F.when(ends_dir, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), text).otherwise(path)


def anchor_texts(html: Column) -> Column:
    """Whole anchors of a page, in document order; comments, scripts and styles hold none."""
    seen = F.when(html.rlike(r"(?i)<!--|<script|<style"), F.regexp_replace(html, UNSEEN, "")).otherwise(html)
    return F.regexp_extract_all(seen, F.lit(ANCHOR), F.lit(0))


def anchors(html: Column) -> Column:
    """``array<struct(href, label)>`` of a page's anchors, taken from the short texts that one pass over the page finds."""
    group = lambda a, i: F.regexp_extract(a, ANCHOR, i)
    return F.transform(anchor_texts(html), lambda a: F.struct(
        F.concat(group(a, 1), group(a, 2), group(a, 3)).alias("href"), group(a, 4).alias("label")))


def page_links(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               host_pattern: str | None = None) -> DataFrame:
    """Distinct links ``(key, pos, url, label)`` of every page, first one kept.

    All links of a page are in its own row, so they are resolved, sorted by URL
    and thinned out there: no rows are exchanged at all.
    """
    found = df.select(key, F.col(url).alias("base"), F.filter(
        F.transform(anchors(F.col(html)), lambda x, i: F.struct(
            i.alias("pos"), x["href"].alias("href"),
            F.regexp_replace(x["label"], TAG, "").alias("label"))), lambda x: x["href"] != "").alias("x"))
    found = found.filter(F.size("x") > 0)
    # references are decoded after the anchors are isolated, on short strings only
    n = F.size("pos")
    decoded = found.select(key, "base", F.col("x.pos").alias("pos"), decode_all(F.concat("x.href", "x.label")).alias("both")) \
        .select(key, "base", "pos", F.slice("both", F.lit(1), n).alias("href"), F.slice("both", n + 1, n).alias("label"))
    links = F.transform(F.arrays_zip("href", "pos", "label"), lambda x: F.struct(
        _resolve(x["href"], F.col("base")).alias("url"), x["pos"].alias("pos"), collapse(x["label"]).alias("label")))
    ordered = decoded.select(key, F.array_sort(links).alias("links"))
    firsts = F.filter(F.col("links"), lambda x, i: (i == 0) | (
        x["url"] != F.try_element_at("links", i)["url"]))
    out = ordered.select(key, F.inline(firsts)).select(key, "pos", "url", "label")
    return out.filter(F.col("url").rlike(host_pattern)) if host_pattern else out


def code_text(html: Column) -> Column:
    """Text of all code and pre blocks, tags removed, one block per line."""
    return F.regexp_replace(F.array_join(F.regexp_extract_all(html, F.lit(CODE_BLOCK), F.lit(1)), "\n"),
                            TAG, "")


def _candidates(text: Column) -> Column:
    """``array<struct(pos, url, scheme, kind, extension, wildcard)>`` named in a text,
    every location once, where it comes first."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(STORAGE_URL), F.lit(1)),
                       lambda u: F.rtrim(u, F.lit(".,;:'\")")))

    def describe(u: Column, all_urls: Column) -> Column:
        scheme, ext, wild = F.lower(F.substring_index(u, "://", 1)), data_extension(u), u.rlike(r"[*?]")
        kind = (F.when((scheme == "https") & ext.isNotNull() & ~wild, F.lit("download"))
                .when((scheme == "https") & (u.rlike(STORAGE_HOST) | ext.isNotNull()), F.lit("folder"))
                .when(scheme.isin(VIRTUAL_SCHEMES), F.lit("virtualise")))
        return F.struct((F.array_position(all_urls, u) - 1).cast("int").alias("pos"), u.alias("url"),
                        scheme.alias("scheme"), kind.alias("kind"), ext.alias("extension"), wild.alias("wildcard"))

    found = bind(urls, lambda us: F.transform(F.array_distinct(us), lambda u: describe(u, us)))
    return F.filter(found, lambda x: x["kind"].isNotNull())


def storage_candidates(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Storage locations named in code blocks, distinct per page:
    ``(key, pos, url, scheme, kind, extension, wildcard)``.  Narrow, like the links."""
    has_code = df.filter(F.col(html).rlike(CODE_TAG))
    text = has_code.select(key, code_text(F.col(html)).alias("t")).select(key, decode(F.col("t")).alias("t"))
    return text.select(key, F.inline(_candidates(F.col("t"))))


def page_kind(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
              catalog_pattern: str | None = None) -> DataFrame:
    """``data`` / ``dataset`` / ``catalog`` / ``rejected`` per page.

    A URL with a data suffix is data itself; a page that names storage locations
    is a dataset page; one that only links on is a catalog.
    """
    code = F.when(F.col(html).rlike(CODE_TAG), code_text(F.col(html)))
    base = df.select(key, F.col(url).alias("url"), F.size(anchor_texts(F.col(html))).alias("links"), code.alias("t"))
    decoded = base.select(key, "url", "links", decode(F.col("t")).alias("t"))
    j = decoded.select(key, "url", F.col("links").cast("long").alias("links"), F.coalesce(
        F.when(F.col("t").isNotNull(), F.size(_candidates(F.col("t")))), F.lit(0)).cast("long").alias("candidates"))
    in_catalog = F.lit(True) if catalog_pattern is None else F.col("url").rlike(catalog_pattern)
    kind = (F.when(data_extension(F.col("url")).isNotNull(), F.lit("data"))
            .when(~in_catalog, F.lit("rejected"))
            .when(F.col("candidates") > 0, F.lit("dataset"))
            .when(F.col("links") > 0, F.lit("catalog")).otherwise(F.lit("rejected")))
    return j.select(key, "links", "candidates", kind.alias("kind"))
