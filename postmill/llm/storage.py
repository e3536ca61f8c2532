"""Files that tasks write and read themselves: through temporary names, on any store that Arrow knows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of ``uri``; a path without a scheme is a folder that all machines mount."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


@contextmanager
def committed(folder: str, name: str) -> Iterator:
    """A stream into a temporary file, which gets its name only once it is complete.

    A task that is run twice writes the same bytes under another temporary name; the later rename replaces the earlier.
    """
    system, base = located(folder)
    place = f"{base}/_temporary-{uuid4().hex}"
    system.create_dir(base, recursive=True)
    with system.open_output_stream(place) as stream:
        yield stream
    system.move(place, f"{base}/{name}")


def opened(folder: str, name: str):
    system, base = located(folder)
    return system.open_input_file(f"{base}/{name}")
