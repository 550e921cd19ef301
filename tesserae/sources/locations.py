"""Where tasks open single files: Arrow's file systems, for URIs as Spark users write them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs

#: What tells a task how to open a URI: the file system and the path in it. Any other function of this kind may be given instead.
Opener = Callable[[str], tuple[fs.FileSystem, str]]
#: Arrow's names of schemes that it knows otherwise.
ARROWS = {"s3a": "s3", "s3n": "s3"}


def open_at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path in it.

    Spark's names of S3 (``s3a``, ``s3n``) are Arrow's ``s3``; ``dbfs:/x`` is the mount ``/dbfs/x``; ``file:/x`` and a bare path are local
    (a mount, on a cluster). Schemes that Arrow doesn't have raise ``ValueError``, which names the function that can be given for them.
    """
    scheme, rest = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", uri, re.DOTALL).groups()
    path = re.sub("/+$", "", rest) or "/"
    match (scheme or "file").lower():
        case "file":
            # Spark takes these paths as they are, without percent signs' meaning in URIs
            return fs.LocalFileSystem(), re.sub("^/+", "/", path)
        case "dbfs":
            return fs.LocalFileSystem(), "/dbfs/" + path.strip("/")
        case other:
            try:
                return fs.FileSystem.from_uri(f"{ARROWS.get(other, other)}:{path}")
            except (ValueError, NotImplementedError) as e:
                raise ValueError(f"no file system for {other}: give a function that opens {other}:// URIs") from e
