"""Secret redaction, secret findings and name cleaning over any string column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import DATA_EXTENSIONS, text_array
from .tokens import bind

REDACTED = "[redacted]"

# Query keys that make a URL a signed one.
SIGNED_QUERY_KEYS = [
    "sig", "sig_", "skoid", "sktid", "skt", "ske", "sks", "skv", "se", "st",
    "sp", "sv", "sr", "si", "spr", "srt", "ss", "sip", "sdd",
]

# Short redaction list (pattern, replacement), applied in order.
REDACT_RULES = [
    (r"(?i)\b(AccountKey|SharedAccessSignature|SharedAccessKey|Password|Secret)\s*=\s*[^;\s\"']+",
     "$1=[redacted]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [redacted]"),
    (r"\beyJ[A-Za-z0-9\-_]{8,}\.[A-Za-z0-9\-_]{8,}\.[A-Za-z0-9\-_]*", "[redacted]"),
    (r"(?i)([?&](?:sig|skoid|sktid|sks|si)=)[^&\s]*", "$1[redacted]"),
]

# Long redaction list for evidence, applied in order.
FULL_REDACT_RULES = [
    (r"(?i)\b(session\s+(?:tracing\s+)?id|trace\s+id)\b\s*(?:of|[:=])?\s*"
     r"\{?[0-9A-Fa-f]{8}-?(?:[0-9A-Fa-f]{4}-?){3}[0-9A-Fa-f]{12}\}?"
     r"|\bsession\s+id\s*[:=]\s*0x[0-9A-Fa-f]+", "session tracing ID [redacted]"),
    (r"(?i)(\bSECRET\s*=\s*)'[^']*(?:''[^']*)*'", "$1'[redacted]'"),
    (r"(?i)(\b(?:ENCRYPTION\s+BY\s+)?PASSWORD\s*=\s*)'[^']*(?:''[^']*)*'", "$1'[redacted]'"),
    (r"(?i)\b(PWD|Password)\s*=\s*[^;\"'\s]+", "$1=[redacted]"),
    (r"(?i)\b(UID|User\s*ID)\s*=\s*[^;\"'\s]+", "$1=[redacted]"),
    (r"(?i)\b(Server|Data\s*Source)\s*=\s*[^;\"'\s]+", "$1=[redacted]"),
    (r"(?i)\b(sig|se|st|sp|sv|srt|ss|skoid|sktid|spr)=[A-Za-z0-9%\-_:+/.]{4,}", "$1=[redacted]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{20,}", "Bearer [redacted]"),
    (r"\beyJ[A-Za-z0-9._\-]{20,}", "[redacted]"),
    (r"\b[A-Za-z0-9+/]{60,}={0,2}\b", "[redacted]"),
    (r"(?i)\b[A-Za-z0-9\-]+\.database\.windows\.net\b", "[sql-endpoint]"),
    (r"(?i)\b[A-Za-z0-9\-]+\.(?:blob|dfs|file|queue|table)\.core\.windows\.net\b",
     "[storage-endpoint]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "[ip]"),
    (r"\b[A-Za-z]:\\\\?[^\s'\"<>|]{2,}", "[path]"),
    (r"/(?:home|Users)/[^\s'\"<>|]+", "[path]"),
    (r"\\\\[A-Za-z0-9._\-]+\\[^\s'\"<>|]+", "[unc-path]"),
]

# Literals too common to be secrets.
COMMON_LITERALS = [
    "master", "model", "msdb", "tempdb",
    "data", "test", "demo", "main", "temp", "public", "default", "sample",
]
MIN_LITERAL = 4

# Shapes of real secrets (kind, pattern).
SECRET_SHAPES = [
    ("sas_signature", r"(?i)\bsig=[A-Za-z0-9%+/=]{10,}"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{20,}"),
    ("jwt", r"\beyJ[A-Za-z0-9._\-]{20,}"),
    ("storage_account_key", r"\b[A-Za-z0-9+/]{60,}={0,2}\b"),
    ("connection_password", r"(?i)\b(?:PWD|Password)\s*=\s*[^;\s'\"<]{3,}"),
    ("inline_secret", r"(?i)\bSECRET\s*=\s*'(?:\s*|\s*(?:[^'\s<]|'')[^']*(?:''[^']*)*)'"),
    ("inline_password", r"(?i)\bPASSWORD\s*=\s*'(?:\s*|\s*(?:[^'\s<]|'')[^']*(?:''[^']*)*)'"),
]
PLACEHOLDER = r"<[^<>\n]{1,80}>"
# Any text with a finding holds one of these words or such a run, so most text is skipped.
SECRET_WORDS = ["sig=", "bearer", "eyj", "pwd", "password", "secret"]
SECRET_RUN = r"[A-Za-z0-9+/]{60}"

# Shapes of sensitive setting values.
SENSITIVE_SHAPES = [
    r"(?i)\b[a-z][a-z0-9+.-]*://|\bwww\.",
    r"(?i)(?:sig|token|access[_-]?token|accountkey|sharedaccesssignature|password|pwd|secret"
    r"|clientsecret|connectionstring|defaultendpointsprotocol|authorization)\s*=",
    r"(?i)\b(?:Bearer|SharedKey)\s+\S",
    r"\beyJ[\w-]+\.[\w-]+\.[\w-]+\b",
    r"\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{15,}\b",
    r"(?i)(?:^|;)\s*(?:server|data source)\s*=[^;]*;",
]

CONTROL_CHARACTERS = "[\\x00-\\x1f\\x7f\\u0085\\u2028\\u2029]+"


# What a text must contain (in lower case) for the rule to apply at all.
REDACT_HINTS = [["accountkey", "sharedaccess", "password", "secret"], ["bearer"], ["eyj"],
                ["sig=", "skoid=", "sktid=", "sks=", "si="]]
FULL_REDACT_HINTS = [["session", "trace"], ["secret"], ["password"], ["pwd", "password"], ["uid", "user"],
                     ["server", "source"], ["="], ["bearer"], ["eyj"], "long word", [".database.windows.net"],
                     [".core.windows.net"], [f"{d}." for d in range(10)], [":\\"], ["/home/", "/users/"], ["\\\\"]]


def _contains_any(c: Column, words: Sequence[str]) -> Column:
    return _any([c.contains(w) for w in words])


def _has_long_word(c: Column, n: int = 60) -> Column:
    """Some blank-separated word has ``n`` bytes or more: true wherever a run of
    ``n`` characters exists, and far cheaper than searching for the run."""
    return F.exists(F.split(c, " "), lambda w: F.octet_length(w) >= n)


def _apply(c: Column, rules: Sequence[tuple[str, str]], hints: Sequence[Sequence[str] | str]) -> Column:
    """The rules in order.  A plain substring test goes before each pattern: most
    texts hold no secret, and the test costs a fraction of a pattern search."""
    def guarded(low: Column, rule: tuple[str, str], words: Sequence[str] | str):
        hint = _has_long_word(low) if words == "long word" else _contains_any(low, words)
        return lambda x: F.when(hint, F.regexp_replace(x, *rule)).otherwise(x)

    def fold(low: Column) -> Column:
        out = c
        for rule, words in zip(rules, hints):
            out = bind(out, guarded(low, rule, words))
        return out
    return bind(F.lower(c), fold)


def redact(c: Column) -> Column:
    return bind(F.coalesce(c, F.lit("")), lambda text: _apply(text, REDACT_RULES, REDACT_HINTS))


def redact_url(c: Column) -> Column:
    """A signed URL loses its whole query; any other is redacted like text."""
    text = F.coalesce(c, F.lit(""))
    cut = F.instr(text, "?")
    base = F.substring_index(text, "?", 1)
    query = F.when(cut > 0, F.substring(text, cut + 1, F.length(text)))
    keys = F.transform(F.split(query, "&"), lambda kv: F.lower(F.coalesce(
        F.try_url_decode(F.substring_index(kv, "=", 1)), F.substring_index(kv, "=", 1))))
    signed = F.arrays_overlap(keys, text_array(SIGNED_QUERY_KEYS))
    return F.when(F.coalesce(signed, F.lit(False)), F.concat(base, F.lit("?" + REDACTED))).otherwise(
        redact(text))


def mask_tail(c: Column, keep: int = 4) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) <= keep, F.repeat(F.lit("*"), F.length(text))).otherwise(
        F.concat(F.lit("****"), F.right(text, F.lit(keep))))


def redact_full(c: Column, literals: Sequence[str] = (), public_hosts: Sequence[str] = ()) -> Column:
    """Evidence redaction: public hosts are shielded, then caller literals
    (longest first), then the ordered pattern list."""
    usable = sorted({x for x in literals if x and len(x) >= MIN_LITERAL
                     and x.strip().lower() not in COMMON_LITERALS}, key=lambda x: (-len(x), x))
    for i, host in enumerate(public_hosts):
        c = F.regexp_replace(c, "(?i)" + re.escape(host), f"\u0000{i}\u0000")
    for word in usable:
        c = F.regexp_replace(c, "(?i)" + re.escape(word), REDACTED)
    c = bind(c, lambda text: _apply(text, FULL_REDACT_RULES, FULL_REDACT_HINTS))
    for i, host in enumerate(public_hosts):
        c = F.replace(c, F.lit(f"\u0000{i}\u0000"), F.lit(host))
    return c


def secret_findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line and secret kind ``(key, line, kind, excerpt)``; the
    excerpt names the shape and length, never the secret.

    Two narrow maps: a single scan drops the texts and then the lines that
    cannot hold a secret, and only what is left meets the seven patterns.
    """
    hint = lambda c: (bind(F.lower(c), lambda low: _contains_any(low, SECRET_WORDS))
                      | (_has_long_word(c) & c.rlike(SECRET_RUN)))
    hinted = df.filter(hint(F.col(text)))
    lines = (hinted.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw"))
             .filter(hint(F.col("raw"))))
    probe = lines.select(key, (F.col("n") + 1).cast("int").alias("line"),
                         F.regexp_replace("raw", PLACEHOLDER, "<>").alias("probe"))
    shapes = F.array(*[F.struct(F.lit(kind).alias("kind"),
                                F.regexp_extract("probe", pattern, 0).alias("found"))
                       for kind, pattern in SECRET_SHAPES])
    hits = probe.select(key, "line", F.inline(F.filter(shapes, lambda s: s["found"] != "")))
    head = F.substring_index(F.substring("found", 1, 12), "=", 1)
    return hits.select(key, "line", "kind",
                       F.concat(head, F.lit("=<"), F.length("found").cast("string"),
                                F.lit(" chars>")).alias("excerpt"))


def percent_decode(c: Column, times: int = 3) -> Column:
    """Decode %XX up to ``times`` times; text without a percent sign is untouched."""
    decoded = c
    for _ in range(times):
        safe = F.replace(decoded, F.lit("+"), F.lit("%2B"))     # a plus sign is not a blank here
        safe = F.regexp_replace(safe, "%(?![0-9A-Fa-f]{2})", "%25")
        decoded = F.when(decoded.contains("%"), F.coalesce(F.try_url_decode(safe), decoded)).otherwise(decoded)
    return decoded


def sensitive_flag(c: Column) -> Column:
    """True when the text looks like a URL, credential or connection string.

    The one-element array binds the decoded text to a lambda variable, so it is
    computed once for all the patterns.
    """
    test = lambda d: _any([d.rlike(p) for p in SENSITIVE_SHAPES])
    return F.exists(F.array(percent_decode(F.coalesce(c, F.lit("")))), test)


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def clean_name(c: Column, prefix: str = "col_", blank: str = "column_1") -> Column:
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_]", "_")
    return (F.when(clean == "", F.lit(blank))
            .when(clean.rlike("^[0-9]"), F.concat(F.lit(prefix), clean)).otherwise(clean))


def escape_name(c: Column, quote: str = "`") -> Column:
    """Control characters collapse to a blank and the quote is doubled."""
    return F.replace(F.regexp_replace(c, CONTROL_CHARACTERS, " "), F.lit(quote), F.lit(quote * 2))


def table_name(path: Column, prefix: str = "") -> Column:
    """Table name from a path's stem; ``ext_`` / ``stg_`` prefixes keep variants apart."""
    base = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit(prefix), clean_name(stem, "col_", "column_1"))


def base_name(c: Column) -> Column:
    return F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)


def safe_file_name(c: Column, fallback: str = "dataset") -> Column:
    """Flat file name of safe characters, at most 120 long."""
    first = base_name(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n")))
    decoded = base_name(percent_decode(first, times=1))
    clean = F.btrim(F.regexp_replace(decoded, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.substring(F.when(clean == "", F.lit(fallback)).otherwise(clean), 1, 120)


def data_extension(c: Column) -> Column:
    """Supported data suffix of a URL's path or of a plain name, else null."""
    path = F.when(c.contains("://"), F.regexp_extract(
        c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(c)
    alternatives = "|".join(re.escape(e) for e in DATA_EXTENSIONS)
    found = F.regexp_extract(F.lower(path), f"({alternatives})$", 1)
    return F.when(found != "", found)
