"""Storage that tasks read and write file by file."""

from __future__ import annotations

import re

# Schemes that the tasks' file systems know, by the name that the file system library has for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def store_uri(folder: str) -> str:
    """The folder as a URI of the file system library; an absolute path is a local or mounted one."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", folder)
    if scheme and scheme[1] not in SCHEMES:
        raise ValueError(f"tasks can't reach files of {scheme[1]}://; only those of {', '.join(SCHEMES)}")
    if not scheme and not folder.startswith("/"):
        raise ValueError(f"not an absolute path: {folder}")
    return f"{SCHEMES[scheme[1]]}://{folder[scheme.end() :]}" if scheme else f"file://{folder}"
