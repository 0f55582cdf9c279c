"""URL validity, parts and path containment."""

from __future__ import annotations

from pyspark.sql import Column

from sitefold.functions.sqltext import bind, column, lit, text

# Addresses without escapes and special hosts, which need no further check. The
# group is the path.
_PLAIN = lit(
    r"\A[A-Za-z][A-Za-z0-9+.\-]*://[A-Za-z0-9.\-]*(?::[0-9]*)?((?:/[^\x00-\x1f\x7f%?#]*)?)(?:[?#][^\x00-\x1f\x7f%]*)?\z"
)
# In an address that is plain but for valid escapes below its host, the path lies between host and query.
_ESCAPE = lit(r"%[0-9A-Fa-f]{2}")
_PLAIN_PATH = lit(r"\A[^:]*://[^/?#]*([^?#]*)")
_PLAIN_HOST = lit(r"\A[^:]*://([^:/?#]*)")
_SCHEME = lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*:")
_BEFORE_QUERY = lit(r"(?s)\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?([^?#]*)")
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_USER = r"(?:(?:[A-Za-z0-9\-._~!$&'()*+,;=:@]|%[0-9A-Fa-f]{2})*@)?"
_HOST_CHAR = r"""(?:[A-Za-z0-9\-._~!$&'()*+,;=<>"\[\]]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])"""
_AUTHORITY = lit(
    r"\A" + _USER + r"(?:\[[^\]/]*\](?::[0-9]*)?|(?:" + _HOST_CHAR + r"|:)*:[0-9]*|" + _HOST_CHAR + r"*)\z"
)


def _rest(url: str) -> str:
    """What follows the scheme, up to the query."""
    return f"regexp_extract({url}, {_BEFORE_QUERY}, 1)"


def _has_authority(url: str, rest: str) -> str:
    return f"(startswith({rest}, '//') AND ({url} RLIKE {_SCHEME} OR NOT startswith({rest}, '///')))"


def _authority(rest: str) -> str:
    return f"regexp_extract({rest}, {lit(r'\A//([^/]*)')}, 1)"


def _unescape(value: str) -> str:
    return f"CASE WHEN contains({value}, '%') THEN try_url_decode(replace({value}, '+', '%2B')) ELSE {value} END"


def _raw_path(url: str, rest: str) -> str:
    return (
        f"CASE WHEN {_has_authority(url, rest)} THEN regexp_replace({rest}, {lit(r'\A//[^/]*')}, '') "
        f"WHEN {url} RLIKE {_SCHEME} AND NOT startswith({rest}, '/') THEN '' ELSE {rest} END"
    )


def _checked(url: str, rest: str) -> str:
    return (
        f"(NOT {url} RLIKE {lit(r'[\x00-\x1f\x7f]')} AND NOT startswith({url}, ':')"
        f" AND NOT {url} RLIKE {lit('(?s)#.*' + _BAD_ESCAPE)}"
        f" AND NOT ({_raw_path(url, rest)}) RLIKE {lit(_BAD_ESCAPE)}"
        f" AND (NOT {_has_authority(url, rest)} OR {_authority(rest)} RLIKE {_AUTHORITY})"
        f" AND NOT (NOT startswith({rest}, '/') AND NOT {url} RLIKE {_SCHEME}"
        f" AND contains(substring_index({rest}, '/', 1), ':')))"
    )


def is_valid_url_sql(url: str) -> str:
    address = text(url)
    return f"({address} RLIKE {_PLAIN} OR {bind(_rest(address), lambda rest: _checked(address, rest))})"


def url_path_sql(url: str) -> str:
    address = text(url)

    def path(rest: str) -> str:
        return f"CASE WHEN {_checked(address, rest)} THEN {bind(_raw_path(address, rest), _unescape)} END"

    return (
        f"CASE WHEN {address} RLIKE {_PLAIN} THEN regexp_extract({address}, {_PLAIN}, 1) "
        # Hosts and schemes hold no ``_``, so an escape there is left to the whole check.
        f"WHEN contains({address}, '%') AND regexp_replace({address}, {_ESCAPE}, '_') RLIKE {_PLAIN} "
        f"THEN {bind(f'regexp_extract({address}, {_PLAIN_PATH}, 1)', _unescape)} "
        f"ELSE {bind(_rest(address), path)} END"
    )


def url_host_sql(url: str) -> str:
    address = text(url)

    def server(name: str) -> str:
        return (
            f"CASE WHEN startswith({name}, '[') THEN regexp_extract({name}, {lit(r'\A\[([^\]]*)\]')}, 1) "
            f"ELSE {_unescape(f'substring_index({name}, {lit(':')}, 1)')} END"
        )

    def host(rest: str) -> str:
        named = f"CASE WHEN {_has_authority(address, rest)} THEN {_authority(rest)} ELSE '' END"
        return f"CASE WHEN {_checked(address, rest)} THEN {bind(f'substring_index({named}, {lit('@')}, -1)', server)} END"

    return (
        f"CASE WHEN {address} RLIKE {_PLAIN} THEN regexp_extract({address}, {_PLAIN_HOST}, 1) "
        f"ELSE {bind(_rest(address), host)} END"
    )


def is_valid_url(url: str) -> Column:
    """Whether the text parses as a URL reference (RFC 3986, plain spaces in paths allowed)."""
    return column(is_valid_url_sql(url))


def url_path(url: str) -> Column:
    """Decoded path of a URL; NULL where the URL does not parse."""
    return column(url_path_sql(url))


def url_host(url: str) -> Column:
    """Host without user, port and brackets; NULL where the URL does not parse."""
    return column(url_host_sql(url))


def resolved_sql(names: str, dropped: tuple[str, ...]) -> str:
    """An array of path segments with ``..`` resolved, never above the top, and others dropped."""
    skipped = ", ".join(lit(name) for name in dropped)
    return (
        f"aggregate({names}, CAST(array() AS ARRAY<STRING>), (done, name) -> CASE WHEN name IN ({skipped}) THEN done "
        f"WHEN name = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) ELSE concat(done, array(name)) END)"
    )


def is_inside(path: str, folder: str, working_dir: str = "/") -> Column:
    """Whether a path, once cleaned, lies in a folder. Relative paths start at ``working_dir``."""

    def cleaned(value: str) -> str:
        absolute = f"CASE WHEN startswith({value}, '/') THEN {value} ELSE concat({lit(working_dir + '/')}, {value}) END"
        return resolved_sql(f"split({absolute}, '/')", ("", "."))

    def check(pair: str) -> str:
        depth = f"size({pair}.folder)"
        return (
            f"(slice({pair}.path, 1, {depth}) = {pair}.folder AND "
            f"NOT coalesce(startswith(try_element_at({pair}.path, {depth} + 1), '..'), false))"
        )

    both = f"named_struct('path', {cleaned(text(path))}, 'folder', {cleaned(text(folder))})"
    return column(bind(both, check))
