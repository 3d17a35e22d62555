"""Metadata in XML as columns."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_fields(text: Column, paths: Mapping[str, str]) -> list[Column]:
    """A string column for each XPath; where a path has no match, or the text is null, null."""
    # the text is parsed once for each: a 1 stands before the value of a path that has a match
    marked = {n: F.xpath_string(text, F.lit(f"concat(substring('1', 1, number(boolean({p}))), string({p}))")) for n, p in paths.items()}
    return [F.get(F.split(v, "^1", 2), F.lit(1)).alias(n) for n, v in marked.items()]


def xml_list(text: Column, path: str) -> Column:
    """All values of an XPath (text nodes or attributes), in document order."""
    return F.xpath(text, F.lit(path))


def _value(e: ET.Element, namespaces: bool):
    """Of an element: its text, or a mapping of attributes (@name), children and #text; nothing for an empty one."""
    name = (lambda tag: tag) if namespaces else (lambda tag: tag.rpartition("}")[2])
    out: dict = {}
    for child in e:
        out.setdefault(name(child.tag), []).append(_value(child, namespaces))
    out = {k: v[0] if len(v) == 1 else v for k, v in out.items()}
    out |= {f"@{name(k)}": v for k, v in e.attrib.items()}
    text = (e.text or "").strip()
    if not out:
        return text if e.text else None
    return out | {"#text": text} if text else out


def xml_variant(text: Column, namespaces: bool = False) -> Column:
    """The whole tree as a variant: {root: value}, elements by name, repeats as arrays, attributes as @name, text beside them as
    #text; all leaves are strings.  Null or empty text is null, broken XML an error."""

    @F.pandas_udf("string")
    def tree(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return None
            root = ET.fromstring(t)
            return json.dumps({root.tag if namespaces else root.tag.rpartition("}")[2]: _value(root, namespaces)})

        return texts.map(one)

    return F.parse_json(tree(text))


def xml_root(text: Column) -> Column:
    """The name of the root element."""
    return F.xpath_string(text, F.lit("name(/*)"))
