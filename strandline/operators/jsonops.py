"""JSON columns: shredding, entries, paths, edits, framing and export."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import MARK, exact_text, is_tagged, parse_document, parse_exact, parse_tagged
from ..functions.tokens import bind

# Entry type codes: 0 null, 1 string, 2 number, 3 bool, 4 array, 5 object.


def entry_type(value: Column) -> Column:
    return type_code(F.schema_of_variant(value))


def type_code(t: Column) -> Column:
    """Entry type code of a variant's type."""
    return (F.when(t == "VOID", F.lit(0)).when(t == "STRING", F.lit(1)).when(t == "BOOLEAN", F.lit(3))
            .when(t.startswith("ARRAY"), F.lit(4)).when(t.startswith("OBJECT"), F.lit(5))
            .otherwise(F.lit(2)))


def json_path(name: str) -> str:
    """Path of a top-level key: ``$.k`` for plain names, quoted otherwise."""
    plain = name.isascii() and name.replace("_", "a").isalnum() and not name[:1].isdigit()
    return f"$.{name}" if plain else '$."' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def spark_path(name: str) -> str:
    """The same path as Spark's variant functions spell it."""
    plain = name.isascii() and name.replace("_", "a").isalnum() and not name[:1].isdigit()
    if plain:
        return f"$.{name}"
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def _parts(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """``(keep..., key, value, text, type)`` of the entries of variant ``col``; ``value`` still has its number tags,
    ``text`` is exact.  Without entries no row."""
    rows = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(col).outer()))
    key = F.coalesce(F.replace("key", F.lit(MARK + MARK), F.lit(MARK)), F.col("pos").cast("string"))
    typed = rows.select(*keep, key.alias("key"), "pos", "value", F.schema_of_variant("value").alias("t"),
                        F.col("value").try_cast("string").alias("s"))
    kind = F.when(F.col("t") == "STRING", F.when(is_tagged(F.col("s")), 2).otherwise(1)) \
        .when(F.col("t").isNotNull(), type_code(F.col("t")))
    return typed.select(*keep, "key", "pos", "value", exact_text(F.col("t"), F.col("s")).alias("text"), kind.alias("type"))


def apply_json(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """Lateral apply: every top-level entry of every document as a row
    ``(keep..., pos, key, value, type)``; numbers keep the text they were written with."""
    v = df.select(*keep, parse_exact(F.col(col)).alias("v"), F.json_object_keys(col).alias("names"))
    rows = _parts(v, "v", [*keep, "names"])
    # a variant keeps its keys sorted; the position is the one in the text
    pos = F.coalesce(F.array_position("names", F.col("key")).cast("int") - 1, F.col("pos"))
    return rows.select(*keep, pos.alias("pos"), "key", F.col("text").alias("value"), "type")


def json_entries(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """``(keep..., key, value, type)`` without a schema; none for what is no JSON."""
    return apply_json(df, col, keep).drop("pos")


def _at(c: Column, path: str) -> Column:
    """Variant at a path, numbers tagged; null for text that is no JSON."""
    return F.try_variant_get(parse_tagged(c), path, "variant")


def json_expand(df: DataFrame, col: str, keep: Sequence[str], path: str = "$") -> DataFrame:
    """Entries of the nested column at ``path``: ``(keep..., parent_key, child_key, child_value)``."""
    parents = _parts(df.select(*keep, _at(F.col(col), path).alias("v")), "v", keep).filter(F.col("type").isin(4, 5))
    nested = parents.select(*keep, F.col("key").alias("parent_key"), F.col("value").alias("v"))
    return _parts(nested, "v", [*keep, "parent_key"]).select(
        *keep, "parent_key", F.col("key").alias("child_key"), F.col("text").alias("child_value"))


def is_json(c: Column) -> Column:
    """1 for a valid object or array, 0 for anything else."""
    t = F.schema_of_variant(parse_document(c))
    return F.when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit(1)).otherwise(F.lit(0))


def json_valid(c: Column) -> Column:
    ok = is_json(c)
    return F.struct(ok.alias("is_valid_json"),
                    F.when(ok == 1, F.lit("Valid")).otherwise(F.lit("Invalid")).alias("status"))


def json_path_exists(c: Column, key: str) -> Column:
    """True when the key is present, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def json_set(c: Column, key: str, value: Column) -> Column:
    """Object with ``key`` set; a null value removes the key.  The key moves last."""
    m = F.from_json(c, "map<string,variant>")
    rest = F.map_filter(m, lambda k, _: k != key)
    added = F.map_concat(rest, F.create_map(F.lit(key), value.cast("variant")))
    return F.to_json(F.when(value.isNull(), rest).otherwise(added))


def _nested(t: Column) -> Column:
    return t.startswith("ARRAY") | t.startswith("OBJECT")


def json_value(c: Column, path: str) -> Column:
    """Scalar at a path as text, numbers as written; objects and arrays give null."""
    return bind(_at(c, path), lambda v: bind(F.schema_of_variant(v), lambda t: F.when(
        ~(_nested(t) | (t == "VOID")), exact_text(t, v.try_cast("string")))))


def json_query(c: Column, path: str) -> Column:
    """Object or array at a path as JSON text, numbers as written; scalars give null."""
    return bind(_at(c, path), lambda v: bind(F.schema_of_variant(v), lambda t: F.when(_nested(t), exact_text(t, F.to_json(v)))))


def shred(df: DataFrame, col: str, schema: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """Typed projection of documents; a column declared as string keeps nested JSON text."""
    return df.select(*keep, F.from_json(col, schema).alias("d")).select(*keep, "d.*")


def shred_profiled(df: DataFrame, col: str, columns: Sequence[dict], keep: Sequence[str] = (),
                   max_columns: int | None = None) -> DataFrame:
    """Typed projection by a profile's columns (``name, spark_type, safe``); refused
    (entries are the way then) when the evidence does not carry it, or a target's ``max_columns`` is passed."""
    if not columns or (max_columns and len(columns) > max_columns) or not all(c["safe"] for c in columns):
        raise ValueError("typed projection is not safe for these documents; use json_entries")
    fields = ", ".join("`" + c["name"].replace("`", "``") + "` " + c["spark_type"] for c in columns)
    return shred(df, col, fields, keep)


def insert_scalars(docs: DataFrame, columns: Sequence[dict], table: str) -> DataFrame:
    """Append the scalar columns only; nested ones are left out."""
    names = [c["name"] for c in columns if c.get("nesting", "scalar") == "scalar"]
    out = docs.select([F.col(f"`{n}`") for n in names])
    spark = docs.sparkSession
    if spark.catalog.tableExists(table):
        out.writeTo(table).append()
    else:
        out.writeTo(table).using("parquet").create()
    return spark.table(table)


def lines_to_array(df: DataFrame, group: str, col: str, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Lines of a group as one array document ``(group, part, parts, n_lines, document)``.

    The order of lines is free.  A group larger than ``max_bytes`` comes as
    several parts, each a valid array, so no task ever holds an unbounded group;
    every line is in exactly one part.  Copies of a line are counted first and
    dealt out over the parts, and a part follows from the line alone, so a task
    that runs again places its lines as before.
    """
    line = F.regexp_replace(col, "\r", "")
    clean = df.select(group, line.alias("line")).filter(F.trim("line") != "")
    sizes = clean.groupBy(group).agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    parts = sizes.select(group, F.ceil(F.col("bytes") / max_bytes).cast("int").alias("parts"))
    copies = clean.groupBy(group, "line").agg(F.count(F.lit(1)).alias("n"))
    p, n = F.col("parts"), F.col("n")
    dealt = copies.join(parts, group).select(
        group, "line", "n", "parts", F.explode(F.sequence(F.lit(0), F.least(n, p).cast("int") - 1)).alias("j"))
    share = F.floor(n / F.least(n, p)) + F.when(F.col("j") < n % F.least(n, p), 1).otherwise(0)
    placed = dealt.select(group, "line", "parts", share.cast("int").alias("k"),
                          F.pmod(F.xxhash64("line") + F.col("j"), p).cast("int").alias("part"))
    repeated = F.flatten(F.collect_list(F.array_repeat("line", F.col("k"))))
    return placed.groupBy(group, "part", "parts").agg(
        F.sum("k").cast("long").alias("n_lines"),
        F.concat(F.lit("["), F.array_join(repeated, ","), F.lit("]")).alias("document"))


def rows_to_json(df: DataFrame, cols: Sequence[str] | None = None, include_nulls: bool = False,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Each row as a JSON object; nulls are left out unless asked for."""
    names = list(cols or df.columns)
    opts = {"ignoreNullFields": "false" if include_nulls else "true"}
    return df.select(*keep, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), opts).alias("json"))


def rows_to_json_root(df: DataFrame, root: str, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``{"root":[...]}`` as ordered fragments ``(seq, key, fragment)``.

    The document is the concatenation of the fragments in ``(seq, key)`` order.
    It is never built as one value, so its size is not limited by a task; ``key``
    must be unique.
    """
    first = df.agg(F.min(key)).scalar()
    names = list(cols or df.columns)
    body = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))
    comma = F.when(F.col(key) == first, F.lit("")).otherwise(F.lit(","))
    rows = df.select(F.lit(1).alias("seq"), F.col(key).alias("key"), F.concat(comma, body).alias("fragment"))
    name = json.dumps(root, ensure_ascii=False)
    ends = df.sparkSession.createDataFrame(
        [(0, "{" + name + ":["), (2, "]}")], "seq int, fragment string")
    return rows.unionByName(ends.withColumn("key", F.lit(None).cast(df.schema[key].dataType)))


def write_json_root(df: DataFrame, root: str, key: str, path: str) -> None:
    """The same document as sorted part files; their concatenation is the JSON."""
    (rows_to_json_root(df, root, key).orderBy("seq", "key").select("fragment").write.text(path))


def first_row_json(df: DataFrame, order: str) -> DataFrame:
    return rows_to_json(df.orderBy(order).limit(1))


def preview_json(docs: DataFrame, n: int, order: str, doc: str = "doc") -> DataFrame:
    """Previewed documents over the union of their keys; absent keys are null.

    Keys come in order of first appearance among the ``n`` previewed documents.
    """
    top = docs.orderBy(order).limit(max(1, n))
    entries = apply_json(top, doc, [order])
    keys = [r["key"] for r in entries.groupBy("key").agg(F.min(F.struct(order, "pos")).alias("p"))
            .orderBy("p").collect()]            # keys of at most n previewed rows
    m = F.from_json(F.col(doc), "map<string,string>")
    return top.select(order, *[m[k].alias(k) for k in keys]).orderBy(order)
