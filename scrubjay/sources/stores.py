"""Files under addresses with a scheme (file://, hdfs://, s3a://, gs://, abfss://), by the file systems of Arrow.

Every task opens the store itself, so no executor needs the files on its own disk and no bytes pass through the driver. Names are
taken as they are: an address is scheme, authority and plain name, not percent-encoded. Names that begin with a dot or an underscore
are files like others, which Spark's own readers would leave out without a word.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePosixPath
from typing import NamedTuple

from pyarrow import fs

from ..functions.paths import SUFFIXES

ABSENT = "no such file or directory"
#: Other names of a scheme.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def is_address(path: str) -> bool:
    return "://" in path


@lru_cache
def opened(prefix: str) -> tuple[fs.FileSystem, str]:
    """(file system, its path of the root) of scheme://authority."""
    scheme, rest = prefix.split("://", 1)
    system, root = fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{rest}/")
    return system, root.rstrip("/")


class Place(NamedTuple):
    system: fs.FileSystem
    path: str  # in the system
    prefix: str
    root: str

    def address(self, path: str) -> str:
        """The address of another path of the same store."""
        return f"{self.prefix}/{path[len(self.root) :].lstrip('/')}"

    @property
    def on_disk(self) -> bool:
        return isinstance(self.system, fs.LocalFileSystem)


def located(address: str) -> Place:
    scheme, rest = address.split("://", 1)
    authority, _, key = rest.partition("/")
    prefix = f"{scheme}://{authority}"
    system, root = opened(prefix)
    key = key.rstrip("/")
    return Place(system, f"{root}/{key}" if key else root or "/", prefix, root)


def in_order(found: list[fs.FileInfo]) -> list[str]:
    """Paths of the files among what was found, sorted by folder and name."""
    return sorted((f.path for f in found if f.type == fs.FileType.File), key=lambda p: p.split("/"))


def rooted(address: str, recursive: bool) -> Iterator[tuple[str, str, str | None]]:
    """(root, file, error) of an address: a file as named, whatever its suffix; a folder's files by suffix, sorted."""
    address = address.rstrip("/")
    place = located(address)
    kind = place.system.get_file_info(place.path).type
    if kind == fs.FileType.Directory:
        for child in in_order(place.system.get_file_info(fs.FileSelector(place.path, recursive=recursive))):
            if PurePosixPath(child).suffix.lower() in SUFFIXES:
                yield address, place.address(child), None
    else:
        yield address.rpartition("/")[0], address, None if kind == fs.FileType.File else ABSENT


def names(folder: str) -> list[str]:
    """Addresses of the files in a folder, sorted; none where there is no such folder."""
    place = located(folder)
    return [place.address(p) for p in in_order(place.system.get_file_info(fs.FileSelector(place.path, allow_not_found=True)))]


def real(address: str) -> str:
    """Where an address leads through symbolic links, which only disks have."""
    place = located(address)
    return place.address(os.path.realpath(place.path)) if place.on_disk else address


def size(address: str) -> int:
    place = located(address)
    if place.on_disk:
        return os.stat(place.path).st_size if os.path.isfile(place.path) else 0
    return place.system.get_file_info(place.path).size or 0


def read(address: str) -> bytes:
    place = located(address)
    if place.on_disk:
        with open(place.path, "rb") as file:
            return file.read()
    with place.system.open_input_stream(place.path) as stream:
        return stream.read()


def write_on_disk(path: str, part: str, data: bytes, mode_from: str | None) -> None:
    """The same by the calls of the system, which take a small part of the time."""
    create = lambda: os.open(part, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    try:
        handle = create()
    except FileNotFoundError:
        os.makedirs(os.path.dirname(part), exist_ok=True)
        handle = create()
    try:
        with open(handle, "wb", buffering=0) as out:
            left = memoryview(data)
            while left:
                left = left[out.write(left) :]
        source = located(mode_from).path if mode_from and is_address(mode_from) else mode_from
        if source and os.path.exists(source):
            shutil.copymode(source, part)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write(address: str, data: bytes, mode_from: str | None = None) -> None:
    """Write beside the destination, then move over it; nothing is left behind on failure.

    On disks the mode of mode_from is kept. A store that doesn't move over a file has the old one deleted first, the new one
    being whole beside it by then.
    """
    place = located(address)
    system, (folder, _, name) = place.system, place.path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    if place.on_disk:
        return write_on_disk(place.path, part, data, mode_from)
    system.create_dir(folder, recursive=True)
    try:
        with system.open_output_stream(part) as out:
            out.write(data)
        try:
            system.move(part, place.path)
        except OSError:
            if system.get_file_info(place.path).type != fs.FileType.File:
                raise
            system.delete_file(place.path)
            system.move(part, place.path)
    except BaseException:
        if system.get_file_info(part).type == fs.FileType.File:
            system.delete_file(part)
        raise
