"""Files in the cluster's shared folder, written and range-read by tasks through Arrow's file systems.

Written under a name of their own for each attempt and closed before their name leaves the task, so a task that is run
again after a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, suffix: str, parts) -> str:
    """The parts as one new file; returns its URI."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    with system.open_output_stream(f"{path}/{name}") as out:
        for part in parts:
            out.write(part)
    return f"{folder}/{name}"


def open_file(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)


def delete_file(uri: str) -> None:
    system, path = place(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
