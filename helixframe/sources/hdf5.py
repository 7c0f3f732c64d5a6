"""The part of the HDF5 file format that single-cell files use: what is in a file, slices of its arrays, and writing them.

Read: superblocks of all versions, object headers of both, groups as symbol tables or compact links, numbers, enumerations,
fixed and variable strings, contiguous, compact and chunked arrays behind a B-tree of version 1, deflate, shuffle and
checksums. Arrays that only the newest writers make (other chunk indexes, dense links) raise. Only the parts of a file that
a slice asks for are read, at their offsets, from any store that pyarrow opens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

MAGIC = b"\x89HDF\r\n\x1a\n"
NOWHERE = 2**64 - 1
#: Numbers of header messages.
SPACE, KIND, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, MORE, SYMBOLS = 1, 3, 5, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3


class Unsupported(ValueError):
    """The file uses a part of the format that is not read here."""


def opened(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(at)


def _eight(n: int) -> int:
    return -(-n // 8) * 8


@dataclass
class Kind:
    """An element type: numpy's, or text of fixed (width) or variable size; labels of an enumeration by value."""

    size: int
    number: np.dtype | None = None
    text: str | None = None
    labels: dict[int, str] = field(default_factory=dict)

    @property
    def spark(self) -> str:
        if self.labels and set(self.labels.values()) <= {"FALSE", "TRUE"}:
            return "boolean"
        return "string" if self.text or self.labels else "double" if self.number.kind == "f" else "long"


def _kind(b: bytes) -> tuple[Kind, int]:
    """(the type, the bytes that its message takes)."""
    cls, version, bits, size = b[0] & 15, b[0] >> 4, int.from_bytes(b[1:4], "little"), struct.unpack_from("<I", b, 4)[0]
    order = ">" if bits & 1 else "<"
    if cls == 0:
        return Kind(size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")), 12
    if cls == 1:
        return Kind(size, np.dtype(f"{order}f{size}")), 20
    if cls == 3:
        return Kind(size, text="fixed"), 8
    if cls == 8:
        base, used = _kind(b[8:])
        at, names = 8 + used, []
        for _ in range(bits & 0xFFFF):
            end = b.index(b"\0", at)
            names.append(b[at:end].decode())
            at = end + 1 if version >= 3 else at + _eight(end + 1 - at)
        values = np.frombuffer(b, base.number, len(names), at)
        return Kind(size, base.number, labels=dict(zip(values.tolist(), names, strict=True))), at + values.nbytes
    if cls == 9 and bits & 15 == 1:
        return Kind(size, text="variable"), 8 + _kind(b[8:])[1]
    raise Unsupported(f"type class {cls}")


def _space(b: bytes) -> tuple[int, ...]:
    version, rank = b[0], b[1]
    return struct.unpack_from(f"<{rank}Q", b, 8 if version == 1 else 4)


@dataclass
class Array:
    """An array of a file; slices are along its first axis."""

    file: File
    shape: tuple[int, ...]
    kind: Kind
    layout: bytes
    filters: list[int]
    attributes: dict

    def chunk(self) -> tuple[int, ...] | None:
        """The shape of a chunk, of arrays that have them."""
        b = self.layout
        return struct.unpack_from(f"<{b[2] - 1}I", b, 11) if b[0] == 3 and b[1] == 2 else None

    def slice(self, start: int, stop: int) -> np.ndarray:
        start, stop = max(0, start), min(stop, self.shape[0]) if self.shape else 1
        inner = self.shape[1:]
        width = int(np.prod(inner, dtype=np.int64)) * self.kind.size
        b, rows = self.layout, max(0, stop - start)
        if b[0] != 3:
            raise Unsupported(f"layout of version {b[0]}")
        if b[1] == 0:
            raw = b[4 : 4 + struct.unpack_from("<H", b, 2)[0]][start * width : stop * width]
        elif b[1] == 1:
            at = struct.unpack_from("<Q", b, 2)[0]
            raw = bytes(rows * width) if at == NOWHERE else self.file.read(at + start * width, rows * width)
        else:
            raw = self._chunked(start, stop, inner)
        return self._values(raw, (rows, *inner) if self.shape else ())

    def _chunked(self, start: int, stop: int, inner: tuple[int, ...]) -> bytes:
        size, tree = self.chunk(), struct.unpack_from("<Q", self.layout, 3)[0]
        unit = np.dtype(f"V{self.kind.size}")
        out = np.zeros((max(0, stop - start), *inner), unit)
        if tree == NOWHERE:
            return out.tobytes()
        for at, place, nbytes, skipped in self.file.chunks(tree, len(self.shape), start, stop, size[0]):
            raw = self.file.read(at, nbytes)
            for k in reversed(range(len(self.filters))):
                raw = raw if skipped >> k & 1 else self._undone(self.filters[k], raw)
            block = np.frombuffer(raw, unit, int(np.prod(size))).reshape(size)
            low, high = max(start, place[0]), min(stop, place[0] + size[0])
            rest = tuple(slice(p, min(p + s, n)) for p, s, n in zip(place[1:], size[1:], inner, strict=True))
            out[(slice(low - start, high - start), *rest)] = block[(slice(low - place[0], high - place[0]), *(slice(0, r.stop - r.start) for r in rest))]
        return out.tobytes()

    def _undone(self, number: int, raw: bytes) -> bytes:
        if number == DEFLATE:
            return zlib.decompress(raw)
        if number == SHUFFLE:
            n = len(raw) // self.kind.size
            return np.frombuffer(raw, np.uint8, n * self.kind.size).reshape(self.kind.size, n).T.tobytes() + raw[n * self.kind.size :]
        if number == CHECKSUM:
            return raw[:-4]
        raise Unsupported(f"filter {number}")

    def _values(self, raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
        if self.kind.text == "variable":
            flat = np.array([self.file.heaped(*struct.unpack_from("<IQI", raw, k)) for k in range(0, len(raw), 16)], object)
            return flat.reshape(shape)
        if self.kind.text:
            n = self.kind.size
            return np.array([raw[k : k + n].split(b"\0")[0].rstrip(b" ").decode() for k in range(0, len(raw), n)], object).reshape(shape)
        return np.frombuffer(raw, self.kind.number).reshape(shape)


class File:
    """A file that is open for reading."""

    def __init__(self, path: str) -> None:
        self.source = opened(path)
        self._heaps: dict[int, dict[int, bytes]] = {}
        head = self.read(0, 96)
        if head[:8] != MAGIC:
            raise Unsupported(f"{path} is no HDF5 file")
        version = head[8]
        if version < 2:
            if (head[13], head[14]) != (8, 8):
                raise Unsupported("offsets of other than 8 bytes")
            self.root = struct.unpack_from("<Q", head, 64 + (4 if version == 1 else 0))[0]
        else:
            self.root = struct.unpack_from("<Q", head, 36)[0]

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def read(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at)

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        """(number, body) of the messages of an object's header."""
        head, out = self.read(at, 64), []
        if head[:4] == b"OHDR":
            flags = head[5]
            first = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            blocks = [(at + first + width, int.from_bytes(head[first : first + width], "little"))]
            prefix, new = (6 if flags & 4 else 4), True
        else:
            blocks, prefix, new = [(at + 16, struct.unpack_from("<I", head, 8)[0])], 8, False
        while blocks:
            place, size = blocks.pop(0)
            b, k = self.read(place, size), 0
            if new and b[:4] == b"OCHK":
                b, k = b[:-4], 4
            while k + prefix <= len(b):
                number, n, shared = (b[k], *struct.unpack_from("<HB", b, k + 1)) if new else struct.unpack_from("<HHB", b, k)
                body = b[k + prefix : k + prefix + n]
                if shared & 2 and number:
                    raise Unsupported("shared messages")
                if number == MORE:
                    blocks.append(struct.unpack_from("<QQ", body))
                elif number:
                    out.append((number, body))
                k += prefix + n
        return out

    def members(self, at: int) -> dict[str, int]:
        """Names of a group's members and where their headers are."""
        out = {}
        for number, b in self.messages(at):
            if number == SYMBOLS:
                tree, heap = struct.unpack_from("<QQ", b)
                names = self.read(struct.unpack_from("<Q", self.read(heap, 32), 24)[0], struct.unpack_from("<Q", self.read(heap, 32), 8)[0])
                self._symbols(tree, names, out)
            elif number == LINK:
                flags, k = b[1], 2
                kind = b[k] if flags & 8 else 0
                k += bool(flags & 8) + (8 if flags & 4 else 0) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(b[k : k + width], "little")
                name = b[k + width : k + width + n].decode()
                if kind == 0:
                    out[name] = struct.unpack_from("<Q", b, k + width + n)[0]
            elif number == 2:
                k = 2 + (8 if b[1] & 1 else 0)
                if struct.unpack_from("<Q", b, k)[0] != NOWHERE:
                    raise Unsupported("dense links")
        return out

    def _symbols(self, tree: int, names: bytes, out: dict[str, int]) -> None:
        head = self.read(tree, 24)
        level, used = head[5], struct.unpack_from("<H", head, 6)[0]
        body = self.read(tree + 24, 16 * used + 8)
        for k in range(used):
            child = struct.unpack_from("<Q", body, 16 * k + 8)[0]
            if level:
                self._symbols(child, names, out)
                continue
            n = struct.unpack_from("<H", self.read(child, 8), 6)[0]
            entries = self.read(child + 8, 40 * n)
            for e in range(n):
                name, at = struct.unpack_from("<QQ", entries, 40 * e)
                out[names[name : names.index(b"\0", name)].decode()] = at

    def chunks(self, tree: int, rank: int, start: int, stop: int, height: int) -> Iterator[tuple[int, tuple[int, ...], int, int]]:
        """(where, place, bytes, mask of skipped filters) of chunks with rows in [start, stop); `height` is theirs."""
        head = self.read(tree, 24)
        level, used, width = head[5], struct.unpack_from("<H", head, 6)[0], 8 + 8 * (rank + 1)
        body = self.read(tree + 24, (width + 8) * used + width)
        keys = [struct.unpack_from(f"<II{rank}Q", body, (width + 8) * k) for k in range(used + 1)]
        for k in range(used):
            first, after = keys[k][2], keys[k + 1][2]
            child = struct.unpack_from("<Q", body, (width + 8) * k + width)[0]
            if level and first < stop and (after + height > start or k == used - 1):
                yield from self.chunks(child, rank, start, stop, height)
            elif not level and first < stop and first + height > start:
                yield child, keys[k][2:], keys[k][0], keys[k][1]

    def heaped(self, n: int, heap: int, index: int) -> str:
        """A variable string."""
        if not n or heap in (0, NOWHERE):
            return ""
        if heap not in self._heaps:
            size = struct.unpack_from("<Q", self.read(heap, 16), 8)[0]
            b, k, found = self.read(heap, size), 16, {}
            while k + 16 <= size:
                i, _, _, length = struct.unpack_from("<HHIQ", b, k)
                if not i:
                    break
                found[i] = b[k + 16 : k + 16 + length]
                k += 16 + _eight(length)
            if len(self._heaps) > 64:
                self._heaps.clear()
            self._heaps[heap] = found
        return self._heaps[heap][index][:n].split(b"\0")[0].decode()

    def _attribute(self, b: bytes) -> tuple[str, object]:
        version, (name, kind, space) = b[0], struct.unpack_from("<HHH", b, 2)
        at, pad = (9 if version == 3 else 8), (_eight if version == 1 else int)
        label = b[at : at + name].split(b"\0")[0].decode()
        at += pad(name)
        k = _kind(b[at : at + kind])[0]
        shape = _space(b[at + pad(kind) : at + pad(kind) + space])
        at += pad(kind) + pad(space)
        n = int(np.prod(shape, dtype=np.int64)) * k.size
        value = Array(self, shape, k, b"", [], {})._values(b[at : at + n], shape)
        return label, value.item() if value.ndim == 0 else value

    def attributes(self, at: int) -> dict:
        out = {}
        for number, b in self.messages(at):
            if number == ATTRIBUTE:
                try:
                    name, value = self._attribute(b)
                except Unsupported:  # references and the like say nothing about counts
                    continue
                out[name] = value
        return out

    def find(self, path: str) -> int | None:
        """Where the header of an object is; None if there is none of that name."""
        at = self.root
        for name in filter(None, path.split("/")):
            at = self.members(at).get(name)
            if at is None:
                return None
        return at

    def array(self, path: str) -> Array:
        at = self.find(path)
        if at is None:
            raise KeyError(path)
        found = dict(self.messages(at))
        if LAYOUT not in found:
            raise KeyError(f"{path} is no array")
        return Array(self, _space(found[SPACE]), _kind(found[KIND])[0], found[LAYOUT], self._filters(found.get(FILTERS)), self.attributes(at))

    def is_array(self, at: int) -> bool:
        return LAYOUT in dict(self.messages(at))

    @staticmethod
    def _filters(b: bytes | None) -> list[int]:
        out, k = [], 0
        if b:
            version, k = b[0], 8 if b[0] == 1 else 2
            for _ in range(b[1]):
                number, k = struct.unpack_from("<H", b, k)[0], k + 2
                name = 0
                if version == 1 or number >= 256:
                    name, k = struct.unpack_from("<H", b, k)[0], k + 2
                values = struct.unpack_from("<HH", b, k)[1]
                k += 4 + (_eight(name) if version == 1 else name) + 4 * values + (4 if version == 1 and values % 2 else 0)
                out.append(number)
        return out


#: Children of a node of a chunk index, entries of a leaf of a group.
_CHILDREN, _ENTRIES = 64, 128


def _message(number: int, body: bytes) -> bytes:
    body = body.ljust(_eight(len(body)), b"\0")
    return struct.pack("<HHB3x", number, len(body), 0) + body


def _kind_message(dtype: np.dtype | int) -> bytes:
    """Of a number, or of a text of so many bytes of UTF-8."""
    if isinstance(dtype, int):
        return struct.pack("<B3BI", 0x13, 0x11, 0, 0, dtype)
    if dtype == np.bool_:
        names = b"FALSE".ljust(8, b"\0") + b"TRUE".ljust(8, b"\0")
        return struct.pack("<B3BI", 0x18, 2, 0, 0, 1) + struct.pack("<B3BIHH", 0x10, 8, 0, 0, 1, 0, 8) + names + b"\0\1"
    n = dtype.itemsize
    if dtype.kind == "f":
        e, m = (8, 23) if n == 4 else (11, 52)
        return struct.pack("<B3BIHHBBBBI", 0x11, 0x20, 8 * n - 1, 0, n, 0, 8 * n, m, e, 0, m, 127 if n == 4 else 1023)
    return struct.pack("<B3BIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, n, 0, 8 * n)


class Writer:
    """Writes groups and arrays of one axis, chunk by chunk, into a local file or any that can be written in order and
    patched at its head at the end."""

    def __init__(self, out, chunk: int = 65_536) -> None:
        self.out, self.at, self.chunk = out, 0, chunk
        self._put(bytes(96))

    def _put(self, b: bytes) -> int:
        at = self.at
        b = b.ljust(_eight(len(b)), b"\0")
        self.out.write(b)
        self.at += len(b)
        return at

    def array(self, parts: Iterator[np.ndarray], dtype: np.dtype | int, attributes: dict | None = None) -> int:
        """Where the header of an array is, whose values come in parts; texts as bytes of at most `dtype` bytes."""
        unit = np.dtype(f"S{dtype}") if isinstance(dtype, int) else np.dtype(dtype).newbyteorder("<")
        held, keys, n = [], [], 0

        def flush(block: np.ndarray) -> None:
            nonlocal n
            full = np.zeros(self.chunk, unit)
            full[: len(block)] = block
            raw = np.ascontiguousarray(full).view(np.uint8).reshape(self.chunk, unit.itemsize).T.tobytes()
            raw = zlib.compress(raw, 4)
            keys.append((len(raw), n, self._put(raw)))
            n += len(block)

        for part in parts:
            held.append(np.asarray(part).astype(unit))
            while sum(map(len, held)) >= self.chunk:
                every = np.concatenate(held)
                flush(every[: self.chunk])
                held = [every[self.chunk :]]
        if sum(map(len, held)):
            flush(np.concatenate(held))
        tree = self._tree(keys, n) if keys else NOWHERE
        messages = [
            _message(SPACE, struct.pack("<BBB5xQQ", 1, 1, 1, n, max(n, 1))),
            _message(KIND, _kind_message(dtype)),
            _message(FILL, struct.pack("<4B", 2, 3, 0, 0)),
            _message(LAYOUT, struct.pack("<BBBQII", 3, 2, 2, tree, self.chunk, unit.itemsize)),
            _message(FILTERS, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHI4x", SHUFFLE, 0, 0, 1, unit.itemsize) + struct.pack("<HHHHI4x", DEFLATE, 0, 0, 1, 4)),
        ]
        return self._header(messages, attributes)

    def _tree(self, keys: list[tuple[int, int, int]], n: int) -> int:
        level = 0
        while True:
            nodes, size = [], 24 + (_CHILDREN + 1) * 24 + _CHILDREN * 8
            for k in range(0, len(keys), _CHILDREN):
                own = keys[k : k + _CHILDREN]
                last = keys[k + _CHILDREN][1] if k + _CHILDREN < len(keys) else n
                right = self.at + _eight(size) if k + _CHILDREN < len(keys) else NOWHERE
                left = nodes[-1][2] if nodes else NOWHERE
                b = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(own), left, right)
                b += b"".join(struct.pack("<IIQQQ", nbytes, 0, at, 0, child) for nbytes, at, child in own) + struct.pack("<IIQQ", 0, 0, last, 0)
                nodes.append((own[0][0], own[0][1], self._put(b.ljust(size, b"\0"))))
            if len(nodes) == 1:
                return nodes[0][2]
            keys, level = nodes, level + 1

    def _header(self, messages: list[bytes], attributes: dict | None) -> int:
        messages = messages + [_message(ATTRIBUTE, self._attribute(k, v)) for k, v in (attributes or {}).items()]
        body = b"".join(messages)
        return self._put(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def _attribute(self, name: str, value) -> bytes:
        label = name.encode() + b"\0"
        if isinstance(value, str):
            raw = value.encode() or b"\0"
            kind, shape = _kind_message(len(raw)), ()
        else:
            x = np.asarray(value, np.int64)
            raw, kind, shape = x.tobytes(), _kind_message(np.dtype(np.int64)), x.shape
        space = struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)
        pad = lambda b: b.ljust(_eight(len(b)), b"\0")
        return struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + pad(label) + pad(kind) + pad(space) + raw

    def group(self, members: dict[str, int], attributes: dict | None = None) -> int:
        """Where the header of a group is."""
        tree, heap = self._table(members)
        return self._header([_message(SYMBOLS, struct.pack("<QQ", tree, heap))], attributes)

    def _table(self, members: dict[str, int]) -> tuple[int, int]:
        names, offsets = b"\0" * 8, {}
        for name in sorted(members, key=str.encode):
            offsets[name] = len(names)
            names += (name.encode() + b"\0").ljust(_eight(len(name.encode()) + 1), b"\0")
        segment = self._put(names)
        heap = self._put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), 1, segment))
        ordered, children = list(offsets), []
        for k in range(0, len(ordered), _ENTRIES):
            own = ordered[k : k + _ENTRIES]
            leaf = struct.pack("<4sBxH", b"SNOD", 1, len(own)) + b"".join(struct.pack("<QQI4x16x", offsets[x], members[x], 0) for x in own)
            children.append((self._put(leaf.ljust(8 + 40 * _ENTRIES, b"\0")), offsets[own[-1]]))
        if len(children) > 32:
            raise ValueError("too many members of a group")
        b = struct.pack("<4sBBHQQ", b"TREE", 0, 0, len(children), NOWHERE, NOWHERE) + struct.pack("<Q", 0)
        b += b"".join(struct.pack("<QQ", child, last) for child, last in children)
        return self._put(b.ljust(24 + 33 * 8 + 32 * 8, b"\0")), heap

    def head(self, root: int) -> bytes:
        """The bytes at the start of the finished file."""
        return MAGIC + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, _ENTRIES // 2, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, self.at, NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
