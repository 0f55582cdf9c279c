"""Nested XML-RPC values of any depth as JSON text.

The tags of XML-RPC stand for the brackets of JSON, so a value is turned by replacing tags, without recursion and whatever
its depth. This needs a text in which every ``<`` begins a tag: bodies are protected before they are parsed, so that what
the parser returns of a nested value is escaped still.
"""

from __future__ import annotations

from functools import reduce

from sitefold.functions.sqltext import bind, lit

# The types of scalars.
TEXT_TYPES = ("string", "dateTime.iso8601", "base64")
NUMBER_TYPES = ("int", "i4", "i8", "double")
SCALAR_TYPES = (*TEXT_TYPES, *NUMBER_TYPES, "boolean")

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_CDATA, _CDATA_END = "<![CDATA[", "]]>"


def _replaced(value: str, pairs: dict[str, str]) -> str:
    return reduce(lambda text, pair: f"replace({text}, {lit(pair[0])}, {lit(pair[1])})", pairs.items(), value)


def _rewritten(value: str, patterns: list[tuple[str, str]]) -> str:
    return reduce(lambda text, pair: f"regexp_replace({text}, {lit(pair[0])}, {lit(pair[1])})", patterns, value)


def protected_sql(body: str) -> str:
    """A body whose texts are escaped once more and hold no CDATA, so that one parse leaves them escaped."""

    def without_cdata(text: str) -> str:
        inside = _replaced(f"substring_index(p, {lit(_CDATA_END)}, 1)", {"&": "&amp;", "<": "&lt;", ">": "&gt;"})
        rest = f"substring(p, length(substring_index(p, {lit(_CDATA_END)}, 1)) + {len(_CDATA_END) + 1})"
        pieces = f"transform(split({text}, {lit(r'<!\[CDATA\[')}, -1), (p, i) -> CASE WHEN i = 0 THEN p ELSE concat({inside}, {rest}) END)"
        return f"CASE WHEN contains({text}, {lit(_CDATA)}) THEN array_join({pieces}, '') ELSE {text} END"

    # References to markup by number would be resolved by the parser; all other ones may be.
    named = [(r"&#(?:0*60|[xX]0*3[cC]);", "&lt;"), (r"&#(?:0*62|[xX]0*3[eE]);", "&gt;"), (r"&#(?:0*38|[xX]0*26);", "&amp;")]
    return bind(body, lambda text: _rewritten(f"({without_cdata(text)})", [*named, (r"&(lt|gt|quot|apos|amp);", r"&amp;$1;")]))


def unescaped_sql(text: str) -> str:
    """A protected text as it is meant."""
    return bind(text, lambda value: f"CASE WHEN contains({value}, '&') THEN {_replaced(value, _ENTITIES)} ELSE {value} END")


def json_text_sql(value: str) -> str:
    """JSON of a nested value as the parser returned it: ``<struct>`` or ``<array>`` with all that is in it.

    Integers and floating-point numbers that JSON can't print alike become strings; times and base64 are strings.
    """
    scalars, texts, numbers = ("|".join(t.replace(".", r"\.") for t in types) for types in (SCALAR_TYPES, TEXT_TYPES, NUMBER_TYPES))
    tags = _rewritten(
        value,
        [
            (r"<([A-Za-z0-9.]+)\s[^>]*>", "<$1>"),
            # Blanks between tags, but none that are a whole text.
            (rf"(?<=>)(?<!<value>)\s+(?=</value>)|(?<=>)\s+(?=<(?!/(?:value|name|{scalars})>))", ""),
        ],
    )
    escaped = _replaced(tags, {"\\": "\\\\", '"': '\\"', "&quot;": '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"})
    typed = _rewritten(
        escaped,
        [
            (r"<value>([^<]*)</value>", r'<value>"$1"</value>'),
            (rf"<(?:{texts})>([^<]*)</[^>]*>", r'"$1"'),
            (rf"<(?:{numbers})>\s*(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\s*</[^>]*>", "$1"),
            (rf"<(?:{numbers})>([^<]*)</[^>]*>", r'"$1"'),
            (r"<boolean>\s*(?:1|true)\s*</boolean>", "true"),
            (r"<boolean>[^<]*</boolean>", "false"),
            (r"<name>([^<]*)</name>", r'"$1":'),
        ],
    )
    brackets = {
        "<nil></nil>": "null",
        "</value><value>": "</value>,<value>",
        "</member><member>": ",",
        "<struct>": "{",
        "</struct>": "}",
        "<array><data>": "[",
        "</data></array>": "]",
        "<array></array>": "[]",
        "<value>": "",
        "</value>": "",
        "<member>": "",
        "</member>": "",
        "&lt;": "<",
        "&gt;": ">",
        "&apos;": "'",
        "&amp;": "&",
    }
    return _replaced(typed, brackets)
