"""Binary files in the cluster's shared folder, by any path Arrow can open."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A name no other attempt of the same task uses; a manifest of finished tasks says which count."""
    store, place = opened(folder)
    store.create_dir(place, recursive=True)
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
