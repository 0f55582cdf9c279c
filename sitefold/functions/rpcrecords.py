"""Records of plain XML-RPC answers, decoded in Arrow batches.

Spark's XML parser and its functions take long over bodies made of small tags. Here whole tags are replaced by the brackets
of JSON, so what comes out is JSON if and only if the tags nest, and is read by a JSON parser. Only lists of records in which
everything is as usual are decoded. For any other answer, readable or not, the result is NULL, and the XML parser of
``sources/rpc`` decides what it holds: attributes, comments, CDATA, references by number, blank scalars, ``nil``, carriage returns.
"""

from __future__ import annotations

import json
import re
import sys
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefold.functions.rpcvalues import NUMBER_TYPES, SCALAR_TYPES, TEXT_TYPES

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

RECORDS = "ARRAY<ARRAY<STRUCT<name: STRING, text: STRING, nested: STRING>>>"
_MEMBER = pa.struct([("name", pa.string()), ("text", pa.string()), ("nested", pa.string())])

# First characters of scalars while they are JSON strings, by kind. A body that holds one isn't plain.
_TEXT, _NUMBER, _BOOLEAN = "\ue000", "\ue001", "\ue002"
_ALL, _TEXTS, _NUMBERS = ("|".join(map(re.escape, types)) for types in (SCALAR_TYPES, TEXT_TYPES, NUMBER_TYPES))
_KEPT = r"((?!\s+<)[^<]*)"
_ODD = re.compile(rf"[\r{_TEXT}-{_BOOLEAN}\ufffe\uffff]|&(?!(?:lt|gt|quot|apos|amp);)|\]\]>")
_HEAD = re.compile(r"\A\s*(?:<\?xml version=[^<>]*\?>\s*)?<methodResponse><params><param>(?=<value><array>)")
_TAIL = re.compile(r"</value></param></params></methodResponse>\s*\Z")
_BLANKS = ((re.compile(rf">\s+(?=<(?!/(?:value|name|{_ALL})>))"), ">"), (re.compile(rf"(</(?:struct|array|{_ALL})>)\s+(?=</value>)"), r"\1"))
_SCALARS = (
    (re.compile(rf"<value><({_TEXTS})>{_KEPT}</\1></value>"), rf'"{_TEXT}\2"'),
    (re.compile(rf"<name>{_KEPT}</name>"), r'"\1":'),
    (re.compile(rf"<value>{_KEPT}</value>"), rf'"{_TEXT}\1"'),
    (re.compile(rf"<value><({_NUMBERS})>(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)</\1></value>"), rf'"{_NUMBER}\2"'),
    (re.compile(rf"<value><({_NUMBERS})>([^<\s]*)</\1></value>"), rf'"{_TEXT}\2"'),
    (re.compile(r"<value><boolean>([^<\s]*)</boolean></value>"), rf'"{_BOOLEAN}\1"'),
)
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("</value><value>", "</value>,<value>"))
_BRACKETS = (
    ("</member><member>", ","),
    ("<value><struct><member>", "{"),
    ("</member></struct></value>", "}"),
    ("<value><array><data>", "["),
    ("</data></array></value>", "]"),
    ("\n", "\\n"),
    ("\t", "\\t"),
)
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '\\"'), ("&apos;", "'"), ("&amp;", "&"))


def _replaced(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for found, put in pairs:
        text = text.replace(found, put)
    return text


def _json(value: str | tuple | list) -> str:
    """JSON of a value: records are tuples of their members, lists are lists, scalars are marked strings."""
    if isinstance(value, tuple):
        return "{" + ",".join([f"{encode_basestring(name)}:{_json(inner)}" for name, inner in value]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_json(inner) for inner in value]) + "]"
    if value[0] == _NUMBER:
        return value[1:]
    if value[0] == _BOOLEAN:
        return "true" if value[1:] in ("1", "true") else "false"
    return encode_basestring(value[1:])


def plain_records(body: str) -> list[list[tuple[str, str, str | None]]] | None:
    """Members of every record of an answer, or None where the answer isn't a list of records, or not a plain one."""
    if "<!" in body or _ODD.search(body):
        return None
    for blank, put in _BLANKS:
        body = blank.sub(put, body)
    head, tail = _HEAD.match(body), _TAIL.search(body, len(body) - 100 if len(body) > 100 else 0)
    if head is None or tail is None:
        return None
    text = _replaced(body[head.end() : tail.start() + len("</value>")], _ESCAPES)
    for scalar, put in _SCALARS:
        text = scalar.sub(put, text)
    text = _replaced(text, _BRACKETS)
    if "<" in text:
        return None
    try:
        records = json.loads(_replaced(text, _ENTITIES), object_pairs_hook=tuple)
        if not isinstance(records, list) or not all(isinstance(record, tuple) for record in records):
            return None
        return [[(n, v[1:], None) if isinstance(v, str) else (n, "", _json(v)) for n, v in record] for record in records] or None
    except (ValueError, RecursionError):
        return None


def _decoded(bodies: pa.Array) -> pa.Array:
    answers = [plain_records(body.as_py()) if body.is_valid else None for body in bodies]
    records = [record for answer in answers for record in answer or ()]
    columns = list(zip(*[member for record in records for member in record], strict=True)) or [(), (), ()]
    members = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(_MEMBER))

    def lists(values: pa.Array, sizes: list[int], missing: list[bool] | None = None) -> pa.Array:
        ends = [0]
        for size in sizes:
            ends.append(ends[-1] + size)
        mask = pa.array(missing, pa.bool_()) if missing else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)

    inner = lists(members, [len(record) for record in records])
    return lists(inner, [len(answer or ()) for answer in answers], [answer is None for answer in answers])


def records_of(body: Column) -> Column:
    """Members of every record of a plain answer as (name, text, nested), ``nested`` being JSON; NULL for other ones."""

    @F.arrow_udf(RECORDS)
    def decode(bodies: pa.Array) -> pa.Array:
        return _decoded(bodies)

    return decode(body)
