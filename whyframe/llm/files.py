"""Binary files at a URI that every executor sees.

``file:`` URIs and bare paths are opened directly, other schemes through
pyarrow's file systems. Files appear under their name only when they are
complete, so a task that is run again, or twice at once, leaves one whole file.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


@contextmanager
def writing(uri: str):
    """A binary file to write; it gets its name when the block ends without an error."""
    part = f"{uri}.{uuid.uuid4().hex}.part"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(part), "wb") as f:
            yield f
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(part)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        yield f
    store.move(name, name.removesuffix(part[len(uri) :]))


def reading(uri: str):
    """A seekable binary file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)
