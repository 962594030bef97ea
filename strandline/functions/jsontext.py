"""JSON text: strict parsing on top of the variant functions, and exact number literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import bind

MARK = "\u0001"
# Stands behind a document while it is parsed.
END = "end of the document"
# Numbers whose text the JSON functions would rewrite: fractions, exponents, very long ones.
LOSSY_NUMBER = r"[0-9](?:\.|[eE])|[0-9]{18}"
# A tagged number inside the JSON text of a nested value.
TAGGED_INSIDE = r'"\\u0001(-?[0-9][0-9.eE+-]*)"'
# Up to the next number outside strings (possessive, so linear and without recursion).
NEXT_NUMBER = r'\G((?:[^"\d-]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?\d[\d.eE+-]*+)'


def parse_document(doc: Column, source: Column | None = None) -> Column:
    """Variant of a document, null unless the whole text is one JSON value.

    The variant parser stops after the first value and ignores what follows, so
    the text is parsed as the first of an array's two elements: the second, a text that
    the document does not hold, is found only if the document is one value.  ``source`` is what
    the document was made from by tagging numbers.
    """
    ended = F.try_parse_json(F.concat(F.lit("["), doc, F.lit(f',"{END}"]')))
    one = bind(ended, lambda w: F.when(F.try_variant_get(w, "$[1]", "string") == END, F.try_variant_get(w, "$[0]", "variant")))
    return F.when((doc if source is None else source).contains(END), _parse_wrapped(doc)).otherwise(one)


def _parse_wrapped(doc: Column) -> Column:
    """``parse_document`` by two wrappers: text that closes an array early needs a bracket, and then an object must hold it too."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]")))
    no_bracket = ~doc.contains("]")
    in_object = F.try_parse_json(F.concat(F.lit('{"a":'), doc, F.lit("}"))).isNotNull()
    return bind(wrapped, lambda w: F.when(
        F.try_variant_get(w, "$[1]", "variant").isNull() & (no_bracket | in_object),
        F.try_variant_get(w, "$[0]", "variant")))


def needs_tags(doc: Column) -> Column:
    return doc.rlike(LOSSY_NUMBER) | doc.contains("\\u0001") | doc.contains(MARK)


def tag_numbers(doc: Column) -> Column:
    """Document whose numbers are strings with a mark in front, so that the JSON
    functions keep their exact text (``1.2300``, ``1e-7``).

    Only documents that hold such a number are rewritten.  A string that starts
    with the mark itself gets a second one, which ``exact_text`` takes off again.
    """
    return F.when(needs_tags(doc), _tagged(doc)).otherwise(doc)


def _tagged(doc: Column) -> Column:
    doubled = F.replace(F.replace(doc, F.lit("\\u0001"), F.lit("\\u0001\\u0001")),
                        F.lit(MARK), F.lit("\\u0001\\u0001"))
    return F.regexp_replace(doubled, NEXT_NUMBER, "$1\"\\\\u0001$2\"")


def parse_exact(doc: Column) -> Column:
    """``parse_document`` with tagged numbers.  Text that only the tags would make valid (``1.2.3``) stays null."""
    return F.when(needs_tags(doc), F.when(F.try_parse_json(doc).isNotNull(), parse_document(_tagged(doc), doc))) \
        .otherwise(parse_document(doc))


def parse_tagged(doc: Column) -> Column:
    """Variant of the first value of a text with tagged numbers, null if there is none without the tags."""
    return F.when(needs_tags(doc), F.when(F.try_parse_json(doc).isNotNull(), F.try_parse_json(_tagged(doc)))) \
        .otherwise(F.try_parse_json(doc))


def is_tagged(text: Column) -> Column:
    return text.startswith(MARK) & ~text.startswith(MARK + MARK)


def exact_text(t: Column, text: Column) -> Column:
    """Text of a value of variant type ``t`` without tags."""
    nested = F.replace(F.regexp_replace(text, TAGGED_INSIDE, "$1"), F.lit("\\u0001\\u0001"), F.lit("\\u0001"))
    return (F.when((t == "STRING") & text.contains(MARK), F.when(
                is_tagged(text), F.substring(text, F.lit(2), F.length(text)))
                .otherwise(F.replace(text, F.lit(MARK + MARK), F.lit(MARK))))
            .when((t != "STRING") & text.contains("\\u0001"), nested).otherwise(text))
