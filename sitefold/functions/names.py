"""Folder, file and domain names."""

from __future__ import annotations

from pyspark.sql import Column

from sitefold.functions.links import url_path_sql
from sitefold.functions.sqltext import bind, column, lit, text

# Characters that may not stand in a name, and the name used
# when nothing is left.
FOLDER_FORBIDDEN = '/\\:*?"<>| '
FILE_FORBIDDEN = '/\\:*?"<>|'
SLUG_FORBIDDEN = "/\\:"
EMPTY_FOLDER = "category"
EMPTY_DOMAIN = "wordpress-site"
FILE_NAME_BYTES = 200

# Extension by media type.
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "video/mp4": ".mp4",
    "video/avi": ".avi",
    "video/mov": ".mov",
    "video/wmv": ".wmv",
    "video/flv": ".flv",
    "video/webm": ".webm",
    "audio/mp3": ".mp3",
    "audio/wav": ".wav",
    "audio/ogg": ".ogg",
    "application/pdf": ".pdf",
    "text/plain": ".txt",
    "application/zip": ".zip",
}
DEFAULT_EXTENSION = ".bin"


def replace_each_sql(value: str, characters: str, by: str) -> str:
    return f"translate({value}, {lit(characters)}, {lit(by * len(characters))})"


def _hyphened(value: str) -> str:
    return f"regexp_replace({replace_each_sql(text(value), FOLDER_FORBIDDEN, '-')}, '-+', '-')"


def folder_name_sql(value: str) -> str:
    return f"coalesce(nullif(btrim({_hyphened(value)}, '-'), ''), {lit(EMPTY_FOLDER)})"


def domain_name_sql(value: str) -> str:
    dotted = lit(r"(?s)\A(.+)(\.[^.]*)\z")

    def trimmed(name: str) -> str:
        stem = f"btrim(regexp_extract({name}, {dotted}, 1), '-')"
        whole = f"CASE WHEN {name} RLIKE {dotted} THEN concat({stem}, regexp_extract({name}, {dotted}, 2)) ELSE {name} END"
        return f"coalesce(nullif(btrim({whole}, '-'), ''), {lit(EMPTY_DOMAIN)})"

    return bind(_hyphened(value), trimmed)


def markdown_file_name_sql(slug: str, record_id: str) -> str:
    stem = f"coalesce(nullif({slug}, ''), concat('post-', {record_id}))"
    return f"concat({replace_each_sql(stem, SLUG_FORBIDDEN, '-')}, '.md')"


def file_name_sql(value: str) -> str:
    def shortened(clean: str) -> str:
        ending = f"regexp_extract({clean}, {lit(r'(?s)(\.[^.]*)\z')}, 1)"
        room = f"greatest({FILE_NAME_BYTES} - octet_length({ending}), 0)"
        stem = f"substring({clean}, 1, length({clean}) - length({ending}))"
        kept = f"make_valid_utf8(CAST(substring(encode({stem}, 'UTF-8'), 1, {room}) AS STRING))"
        cut = f"concat(regexp_replace({kept}, {lit('�+' + chr(92) + 'z')}, ''), {ending})"
        return f"CASE WHEN octet_length({clean}) > {FILE_NAME_BYTES} THEN {cut} ELSE {clean} END"

    return bind(replace_each_sql(value, FILE_FORBIDDEN, "_"), shortened)


def base_name_sql(path: str) -> str:
    """Last element of a path: ``.`` for an empty path, ``/`` for slashes only."""
    bare = f"rtrim('/', {path})"
    return f"CASE WHEN {path} = '' THEN '.' WHEN {bare} = '' THEN '/' ELSE substring_index({bare}, '/', -1) END"


def mime_extension_sql(mime_type: str) -> str:
    pairs = ", ".join(f"{lit(k)}, {lit(v)}" for k, v in MIME_EXTENSIONS.items())
    return f"coalesce(try_element_at(map({pairs}), {text(mime_type)}), {lit(DEFAULT_EXTENSION)})"


def _with_id(media_id: str, name: str) -> str:
    return f"concat({media_id}, '_', {file_name_sql(name)})"


def media_file_name_sql(media_id: str, url: str, mime_type: str) -> str:
    generated = f"concat('media_', {media_id}, {mime_extension_sql(mime_type)})"

    def named(path: str) -> str:
        return bind(
            base_name_sql(path),
            lambda base: _with_id(media_id, f"CASE WHEN {base} IN ('.', '/') THEN {generated} ELSE {base} END"),
        )

    return bind(url_path_sql(url), named)


def size_file_name_sql(media_id: str, size_url: str, url: str, mime_type: str) -> str:
    def named(path: str) -> str:
        own = media_file_name_sql(media_id, url, mime_type)
        return f"CASE WHEN {path} IS NULL THEN {own} ELSE {_with_id(media_id, base_name_sql(path))} END"

    return bind(url_path_sql(size_url), named)


def folder_name(value: str) -> Column:
    """Forbidden characters as single hyphens, none at the ends; never empty."""
    return column(folder_name_sql(value))


def domain_name(value: str) -> Column:
    """As a folder name, with hyphens before the last dot trimmed too."""
    return column(domain_name_sql(value))


def markdown_file_name(slug: str, record_id: str) -> Column:
    return column(markdown_file_name_sql(slug, record_id))


def file_name(value: str) -> Column:
    """Replace forbidden characters and keep at most 200 bytes, extension included.

    The cut falls on a character boundary: a character of several bytes is
    dropped whole rather than split.
    """
    return column(file_name_sql(value))


def mime_extension(mime_type: str) -> Column:
    return column(mime_extension_sql(mime_type))


def media_file_name(media_id: str, url: str, mime_type: str) -> Column:
    """Local file name of a media item, from its URL or else its id and type."""
    return column(media_file_name_sql(media_id, url, mime_type))


def size_file_name(media_id: str, size_url: str, url: str, mime_type: str) -> Column:
    """Local file name of one size of a media item; the item's own where the URL is broken."""
    return column(size_file_name_sql(media_id, size_url, url, mime_type))
