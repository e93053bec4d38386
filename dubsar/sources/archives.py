"""Members of zip archives as a data source: one partition for each group of members.

The driver reads an archive's directory, at its end; tasks read only the ranges of their own
members, so neither an archive's size nor the number of its members bounds what can be read
(zip64 too), and no row is larger than a member. Files are reached by path or by pyarrow.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members, as they are when unpacked, that one task reads.
GROUP = 64 << 20
_HEADER = struct.Struct("<4s22xHH")


def opened(uri: str) -> BinaryIO:
    """A file that can be read anywhere in it."""
    at = urlsplit(uri)
    if at.scheme in ("", "file"):
        return open(unquote(at.path) if at.scheme else uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def reached(uri: str) -> bool:
    """Whether opened() knows the kind of store."""
    if urlsplit(uri).scheme in ("", "file"):
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001  every store has its own errors
        return False
    return True


@dataclass
class Member:
    name: str
    at: int
    packed: int
    method: int
    crc: int


@dataclass
class Members(InputPartition):
    archive: str
    members: list[Member]


def unpacked(file: BinaryIO, member: Member) -> bytes:
    """A member's bytes, read from where its header lies."""
    file.seek(member.at)
    mark, name, extra = _HEADER.unpack(file.read(_HEADER.size))
    if mark != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {member.at}")
    file.seek(member.at + _HEADER.size + name + extra)
    packed = file.read(member.packed)
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"{member.name}: packing method {member.method}")
    out = zlib.decompress(packed, -zlib.MAX_WBITS) if member.method == zipfile.ZIP_DEFLATED else packed
    if zlib.crc32(out) != member.crc:
        raise zipfile.BadZipFile(f"{member.name}: checksum differs")
    return out


class _Reader(DataSourceReader):
    def __init__(self, archives: list[str], containing: str, ending: str, group: int) -> None:
        self.archives, self.containing, self.ending, self.group = archives, containing, ending, group

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for archive in self.archives:
            with opened(archive) as f, zipfile.ZipFile(f) as z:
                asked = [i for i in z.infolist() if i.filename.endswith(self.ending) and self.containing in i.filename]
            size = self.group
            for i in sorted(asked, key=lambda i: i.header_offset):
                if size + i.file_size > self.group:
                    out.append(Members(archive, []))
                    size = 0
                out[-1].members.append(Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC))
                size += i.file_size
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple[str, str]]:
        if not partition.members:
            return
        with opened(partition.archive) as f:
            for m in partition.members:
                yield m.name, unpacked(f, m).decode("utf-8", "replace")


class ZipMembers(DataSource):
    """Options: archives (paths or URIs, one a line), containing and ending (of a member's name), group (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "doc string, json string"

    def reader(self, schema) -> _Reader:
        return _Reader([a for a in self.options.get("archives", "").split("\n") if a], self.options.get("containing", ""), self.options.get("ending", ".json"), int(self.options.get("group", GROUP)))
