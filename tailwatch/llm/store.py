"""Byte streams in shared folders: local paths and file: addresses, and whatever else pyarrow's file systems reach."""

from __future__ import annotations

import re

from pyarrow import fs


def located(address: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:/*", "/", address)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(address)


def make_folder(address: str) -> None:
    system, path = located(address)
    system.create_dir(path, recursive=True)


def create(address: str):
    system, path = located(address)
    return system.open_output_stream(path)


def open_ranges(address: str):
    """A file for reads at any place, and its size."""
    system, path = located(address)
    file = system.open_input_file(path)
    return file, file.size()
