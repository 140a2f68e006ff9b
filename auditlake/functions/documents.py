"""JSON documents as VARIANT values."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_document(rows: DataFrame, text: str, alias: str) -> DataFrame:
    """Adds the JSON value of an expression; NULL unless the whole text is one
    JSON value.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    the text is parsed once, as the first item of a list that ends with the text's own
    digest. A text that holds several values, or closes the list itself, leaves something else in
    the second place. Repeated keys make a document unreadable.
    """
    staged = rows.selectExpr("*", f"{text} AS _text").selectExpr("*", "sha2(_text, 256) AS _digest")
    listed = staged.selectExpr("*", """try_parse_json(concat('[', _text, ',"', _digest, '"]')) AS _list""")
    whole = "try_variant_get(_list, '$[1]', 'string') = _digest"
    value = f"IF({whole}, try_variant_get(_list, '$[0]', 'variant'), NULL) AS {alias}"
    return listed.selectExpr(*rows.columns, value)
