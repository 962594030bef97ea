"""Fixed values the results depend on: token lists, type tables, code pages, limits.

Everything here is data, not logic.  Small tables are offered as Spark map
literals (``lookup_column``), so a lookup stays inside whole-stage codegen and
costs no join at all; ``as_table`` gives the same table as a DataFrame for the
callers that want a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tokens that mean "missing" in delimited text (exact, untrimmed).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Boolean tokens (exact, untrimmed).
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# File suffix -> format.
EXTENSION_FORMATS = {
    "txt": "text", "csv": "csv", "tsv": "csv", "dat": "csv",
    "parquet": "parquet", "snappy": "parquet",
    "json": "json", "jsonl": "json", "ndjson": "json",
    "orc": "orc", "rc": "rc", "delta": "delta",
    "xlsx": "excel", "xls": "excel",
}

# Formats a SQL reader can load (spreadsheets cannot be).
LOADABLE_FORMATS = ["csv", "delta", "iceberg", "json", "orc", "parquet", "rc", "text"]

# Suffixes of downloadable data files, tested in this order.
DATA_EXTENSIONS = [
    ".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet", ".snappy",
    ".orc", ".txt", ".xlsx", ".xls",
]

# Encoding name -> Windows code page; anything else is 'ACP'.
ENCODING_CODEPAGES = {
    "utf-8": "65001", "utf-8-sig": "65001",
    "ascii": "1252", "latin-1": "1252", "iso-8859-1": "1252",
    "cp1252": "1252", "windows-1252": "1252",
    "utf-16": "1200", "utf-16-le": "1200", "utf-16-be": "1201",
    "shift_jis": "932", "shift-jis": "932", "sjis": "932", "cp932": "932", "ms932": "932",
    "euc-jp": "20932", "euc_jp": "20932",
    "gbk": "936", "cp936": "936", "gb2312": "936",
    "big5": "950", "cp950": "950",
    "cp1251": "1251", "windows-1251": "1251",
}

# Encoding name -> JVM charset for the Spark readers.
ENCODING_CHARSETS = {
    "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "ascii": "US-ASCII",
    "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1",
    "cp1252": "windows-1252", "windows-1252": "windows-1252",
    "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE",
    "utf-32": "UTF-32",
    "shift_jis": "windows-31j", "cp932": "windows-31j", "euc-jp": "EUC-JP",
    "gbk": "GBK", "gb2312": "GBK", "big5": "Big5",
    "cp1251": "windows-1251", "windows-1251": "windows-1251",
}

# Byte-order marks (hex) with their encoding, 32-bit marks first.
BYTE_ORDER_MARKS = [
    ("FFFE0000", "utf-32"), ("0000FEFF", "utf-32"), ("EFBBBF", "utf-8-sig"),
    ("FFFE", "utf-16"), ("FEFF", "utf-16-be"),
]

# Delimiters that are tried when sniffing, in tie-break order.
SNIFF_DELIMITERS = [",", "\t", ";", "|", ":"]
DELIMITER_NAMES = {",": "comma", "\t": "tab", "|": "pipe", ";": "semicolon", " ": "space"}

# Detected type name -> Spark SQL type.
SPARK_TYPES = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int": "INT", "int64": "BIGINT",
    "uint8": "SMALLINT", "uint16": "INT", "uint32": "BIGINT", "uint64": "DECIMAL(20,0)",
    "half_float": "FLOAT", "halffloat": "FLOAT", "float32": "FLOAT", "float": "DOUBLE",
    "float64": "DOUBLE", "double": "DOUBLE",
    "bool": "BOOLEAN", "boolean": "BOOLEAN",
    "object": "STRING", "str": "STRING", "string": "STRING", "large_string": "STRING",
    "null": "STRING",
    "datetime64[ns]": "TIMESTAMP_NTZ", "datetime64[us]": "TIMESTAMP_NTZ",
    "timestamp[us]": "TIMESTAMP_NTZ", "timestamp[ns]": "TIMESTAMP_NTZ",
    "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "datetime64": "TIMESTAMP_NTZ",
    "date32": "DATE", "date64": "DATE", "date": "DATE",
    "time": "STRING", "time64[us]": "STRING",
    "decimal128": "DECIMAL(38,10)", "decimal256": "STRING",
    "binary": "BINARY", "large_binary": "BINARY", "fixed_size_binary": "BINARY",
    "list": "STRING", "struct": "STRING", "dict": "STRING", "map": "STRING", "union": "STRING",
}

# The same type names on the relational target the reports quote.
TARGET_TYPES = {
    "int64": "BIGINT", "int32": "INT", "int16": "SMALLINT", "int8": "SMALLINT", "int": "INT",
    "uint64": "DECIMAL(20,0)", "uint32": "BIGINT", "uint16": "INT", "uint8": "TINYINT",
    "float64": "FLOAT", "float32": "REAL", "float": "FLOAT", "double": "FLOAT",
    "half_float": "REAL", "halffloat": "REAL",
    "bool": "BIT", "boolean": "BIT",
    "object": "NVARCHAR(MAX)", "str": "NVARCHAR(MAX)", "string": "NVARCHAR(MAX)",
    "large_string": "NVARCHAR(MAX)", "null": "NVARCHAR(MAX)",
    "datetime64[ns]": "DATETIME2(7)", "datetime64[us]": "DATETIME2(6)",
    "timestamp[us]": "DATETIME2(6)", "timestamp[ns]": "DATETIME2(7)",
    "timestamp": "DATETIME2(7)", "timestamptz": "DATETIMEOFFSET(7)", "datetime64": "DATETIME2(7)",
    "date32": "DATE", "date64": "DATE", "date": "DATE",
    "time": "TIME(7)", "time64[us]": "TIME(6)",
    "decimal128": "DECIMAL(38,10)", "decimal256": "NVARCHAR(MAX)",
    "binary": "VARBINARY(MAX)", "large_binary": "VARBINARY(MAX)",
    "fixed_size_binary": "VARBINARY(MAX)",
    "list": "NVARCHAR(MAX)", "struct": "NVARCHAR(MAX)", "dict": "NVARCHAR(MAX)",
    "map": "NVARCHAR(MAX)", "union": "NVARCHAR(MAX)",
}

# Type names whose text is sized from the observed width.
SIZED_TEXT_TYPES = ["object", "str", "string", "large_string", "null"]

# Time unit -> fractional digits.
UNIT_DIGITS = {"s": "0", "ms": "3", "us": "6", "ns": "7"}

# Container type names that are carried as JSON text.
STRUCTURAL_PATTERN = (
    r"^(struct|list|large_list|fixed_size_list|map|union|dense_union|sparse_union"
    r"|dictionary|dict|object\[\])$"
    r"|^(struct|list|large_list|fixed_size_list|map|union|dense_union|sparse_union"
    r"|dictionary)\s*[<(]"
)
DECIMAL_PATTERN = r"^(?:decimal128|decimal256|decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\)$"
TIMESTAMP_PATTERN = r"^(?:timestamp|datetime64)\s*\[\s*(s|ms|us|ns)\s*(?:,\s*(.+?)\s*)?\]$"
TIME_PATTERN = r"^time(?:32|64)?\s*\[\s*(s|ms|us|ns)\s*\]$"

# Catalog type name -> detected type name.
DELTA_TYPES = {
    "boolean": "bool", "byte": "int8", "tinyint": "int8", "short": "int16",
    "smallint": "int16", "integer": "int32", "int": "int32", "long": "int64",
    "bigint": "int64", "float": "float32", "double": "float64", "string": "str",
    "binary": "binary", "date": "date32[day]", "timestamp": "timestamp[us, tz=UTC]",
    "timestamp_ntz": "timestamp[us]", "decimal": "decimal128",
}
ICEBERG_TYPES = {
    "timestamp": "timestamp[us]", "timestamp_ntz": "timestamp[us]",
    "timestamptz": "timestamp[us, tz=UTC]", "timestamp_ns": "timestamp[ns]",
    "timestamptz_ns": "timestamp[ns, tz=UTC]",
    "boolean": "bool", "int": "int32", "long": "int64", "float": "float32",
    "double": "float64", "string": "str", "date": "date", "time": "time64[us]",
    "binary": "binary", "uuid": "str", "fixed": "binary",
    "list": "list", "struct": "dict", "map": "dict",
}

# Limits.
MAX_NUMERIC_TOKEN = 256
MAX_DECIMAL_PRECISION = 38
SAFE_INTEGER = 9007199254740991
MAX_TABLE_COLUMNS = 1024
ENCODING_SAMPLE_BYTES = 64 * 1024
MAGIC_SAMPLE_BYTES = 8192
DIALECT_SAMPLE_CHARS = 4096
MAX_LISTING = 5000
JSON_DOC_BYTES = 32 * 1024 * 1024
JSON_SAMPLE_CHARS = 4 * 1024 * 1024
FULL_SCAN_BYTES = 100 * 1024 * 1024


def sql_text(value: str) -> str:
    """The value as a Spark SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + escaped.replace("\t", "\\t").replace("\n", "\\n") + "'"


def text_array(values) -> Column:
    """Array literal, built in one expression however long the list is."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def text_map(table: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(sql_text(x) for kv in table.items() for x in kv) + ")")


def lookup_column(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of ``key`` in a fixed table; ``default`` (or null) when absent."""
    found = F.try_element_at(text_map(table), key)
    return found if default is None else F.coalesce(found, default)


def as_table(spark: SparkSession, table: dict[str, str], key: str, value: str) -> DataFrame:
    """The fixed table as a DataFrame (always driver-local and tiny)."""
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} string")


def with_lookup(df: DataFrame, table: dict[str, str], key: str, out: str,
                default: str | None = None) -> DataFrame:
    """Left lookup of ``key`` in a fixed table; unmatched keys get ``default``."""
    fallback = None if default is None else F.lit(default)
    return df.withColumn(out, lookup_column(table, F.col(key), fallback))
