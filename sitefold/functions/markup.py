"""HTML to Markdown and front-matter text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column

from sitefold.functions.sqltext import column, lit, text

# Tag replacements, in the order in which they apply. Tags with
# attributes, links and images stay as they are.
TAG_REPLACEMENTS = (
    ("<h1>", "# "),
    ("</h1>", "\n\n"),
    ("<h2>", "## "),
    ("</h2>", "\n\n"),
    ("<h3>", "### "),
    ("</h3>", "\n\n"),
    ("<h4>", "#### "),
    ("</h4>", "\n\n"),
    ("<h5>", "##### "),
    ("</h5>", "\n\n"),
    ("<h6>", "###### "),
    ("</h6>", "\n\n"),
    ("<strong>", "**"),
    ("</strong>", "**"),
    ("<b>", "**"),
    ("</b>", "**"),
    ("<em>", "*"),
    ("</em>", "*"),
    ("<i>", "*"),
    ("</i>", "*"),
    ("<p>", ""),
    ("</p>", "\n\n"),
    ("<br>", "\n"),
    ("<br/>", "\n"),
    ("<br />", "\n"),
    ("<ul>", ""),
    ("</ul>", "\n"),
    ("<ol>", ""),
    ("</ol>", "\n"),
    ("<li>", "- "),
    ("</li>", "\n"),
    ("<code>", "`"),
    ("</code>", "`"),
    ("<pre>", "```\n"),
    ("</pre>", "\n```"),
)
# Unicode white space trimmed from both ends.
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _swap(value: str, old: str, new: str) -> str:
    return f"replace({value}, {lit(old)}, {lit(new)})"


# Text in which removing one tag would complete another, so that the order of
# the replacements shows.
_NESTED = lit(r"<[/a-z1-6 ]{0,8}<(?:p|ul|ol)>")


def _in_turn(html: str) -> str:
    return reduce(lambda value, pair: _swap(value, *pair), TAG_REPLACEMENTS, html)


def _at_once(html: str) -> str:
    """One pass: what follows each ``<`` up to the next ``>`` is looked up in the table of tags.

    Tags cannot overlap and no replacement contains an angle bracket, so this
    equals replacing in turn unless a removed tag stands inside another.
    """
    # Short tags first: they are frequent, and a map is searched from its start. A piece without ``>`` has the empty tag.
    tags = sorted(TAG_REPLACEMENTS, key=lambda pair: len(pair[0]))
    pairs = ", ".join(f"{lit(old[1:])}, {lit(new)}" for old, new in tags)
    end = "locate('>', piece)"
    swapped = f"concat(try_element_at(map({pairs}), substring(piece, 1, {end})), substring(piece, {end} + 1))"
    return (
        f"array_join(transform(split({html}, '<'), (piece, i) -> CASE WHEN i = 0 THEN piece "
        f"WHEN {end} > {len(tags[-1][0]) - 1} THEN concat('<', piece) ELSE coalesce({swapped}, concat('<', piece)) END), '')"
    )


def html_to_markdown_sql(html: str) -> str:
    source = text(html)
    replaced = f"CASE WHEN {source} RLIKE {_NESTED} THEN {_in_turn(source)} ELSE {_at_once(source)} END"
    return f"btrim({_swap(replaced, chr(10) * 3, chr(10) * 2)}, {lit(WHITE_SPACE)})"


def yaml_text_sql(value: str) -> str:
    quoted = _swap(text(value), '"', '\\"')
    return _swap(_swap(quoted, "\n", "\\n"), "\r", "\\r")


def html_to_markdown(html: str) -> Column:
    """The tag replacements as if made in turn, one pass over triple line ends, then trimmed."""
    return column(html_to_markdown_sql(html))


def yaml_text(value: str) -> Column:
    """Quotes and line ends escaped; backslashes and tabs stay."""
    return column(yaml_text_sql(value))
