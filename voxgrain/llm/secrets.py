"""Secrets by patterns, in a text and in everything that is encoded inside it.

The patterns give the base spans. A worklist then starts with the text itself. Of every layer the
escapes of addresses and of Unicode are resolved, base64 runs are decoded and compressed data is
unpacked; each result is a further layer that is searched with the same patterns and unwrapped in
its turn, until no layer gives a new one. A layer that has been at the same place before is not
unwrapped again, so data that unpacks to itself comes to an end. Every layer knows for each of its
characters which characters of the outer text it came from, so a find has a span there.
"""

from __future__ import annotations

import binascii
import bz2
import io
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxgrain.llm.common import small, text_values

KINDS = ("assign", "access", "hex")

# The base patterns. Shorter runs than those of ACCESS and HEX are no finds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

# An escaped escape sign is resolved with what it begins, however often it was escaped.
ADDRESS_ESCAPES = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(
    r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}"
    r"|&(?:amp;)*(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|quot|apos|lt|gt);|[！-～]"
)
NAMED = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}

# The shortest data that can hold a find is 32 alike digits compressed to 11 bytes, so 15 letters.
RUN = re.compile(r"[A-Za-z0-9+/_-]{15,}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{60,80}\r?\n)+[A-Za-z0-9+/_-]+")
URL_LETTERS = str.maketrans("-_", "+/")
# Bytes that are UTF-8 text, as long as the shortest find.
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}){14,}")

PIECE = 16 << 20
OVERLAP = 64 << 10
STEP = 64 << 10
"""Unpacked data is looked at in pieces of so many bytes that share an overlap and are read in steps, so memory is bounded."""


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the patterns per kind, leftmost first, not overlapping."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


@dataclass
class Layer:
    """Text or bytes, and for each character or byte where it came from in the outer text."""

    content: str | bytes
    path: tuple[str, ...] = ()
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def located(self) -> Layer:
        if self.starts is None:
            self.starts = np.arange(len(self.content))
            self.ends = self.starts + 1
        return self

    def part(self, content: str | bytes, name: str, first: np.ndarray, last: np.ndarray) -> Layer:
        """A layer whose units came from the units ``first`` to ``last`` (inclusive) of this one."""
        here = self.located()
        return Layer(content, (*self.path, name) if name else self.path, here.starts[first], here.ends[last])

    def key(self) -> tuple:
        data = self.content if isinstance(self.content, bytes) else self.content.encode("utf-8", "surrogatepass")
        return xxhash.xxh3_128_digest(data), type(self.content), int(self.starts[0]), int(self.ends[-1])


def _from_bytes(codes: Sequence[str]) -> list[tuple[str, int, int]]:
    """(character, first, last) of bytes written as escapes that end in two digits; Latin-1 where it is not UTF-8."""
    data = bytes(int(code[-2:], 16) for code in codes)
    edges = np.concatenate([[0], np.cumsum([len(code) for code in codes])]).tolist()
    try:
        chars = data.decode()
    except UnicodeDecodeError:
        return [(c, edges[i], edges[i + 1]) for i, c in enumerate(data.decode("latin-1"))]
    found, at = [], 0
    for c in chars:
        size = len(c.encode())
        found.append((c, edges[at], edges[at + size]))
        at += size
    return found


def _address(escape: str) -> list[tuple[str, int, int]]:
    return _from_bytes(["%" + code for code in escape.split("%")[1:]])


def _character(number: int, width: int) -> list[tuple[str, int, int]]:
    if number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
        return []
    return [(chr(number), 0, width)]


def _unicode(escape: str) -> list[tuple[str, int, int]]:
    if escape.startswith("\\x"):
        return _from_bytes(["\\x" + code for code in escape.split("\\x")[1:]])
    if escape[:2] in ("\\u", "\\U") and escape[2] != "{" and escape[1] == "u":
        units = [int(escape[i + 2:i + 6], 16) for i in range(0, len(escape), 6)]
        found, i = [], 0
        while i < len(units):
            pair = i + 1 < len(units) and 0xD800 <= units[i] < 0xDC00 <= units[i + 1] < 0xE000
            number = 0x10000 + ((units[i] - 0xD800) << 10) + (units[i + 1] - 0xDC00) if pair else units[i]
            size = 2 if pair else 1
            # Half of a pair by itself stays as it is written.
            found += [(c, 6 * i, 6 * (i + size)) for c, _, _ in _character(number, 6)] or [(c, 6 * i + k, 6 * i + k + 1) for k, c in enumerate(escape[6 * i:6 * i + 6])]
            i += size
        return found
    if escape.startswith("\\"):
        return _character(int(escape[2:].strip("{}"), 16), len(escape))
    if escape.startswith("&"):
        body = escape[1:-1].rpartition(";")[2]
        if body[0] != "#":
            return [(NAMED[body], 0, len(escape))]
        return _character(int(body[2:], 16) if body[1] in "xX" else int(body[1:]), len(escape))
    return [(chr(ord(escape) - 0xFEE0), 0, 1)]


def resolved(layer: Layer, name: str, escapes: re.Pattern, decode: Callable) -> Iterator[Layer]:
    """The layer with all ``escapes`` resolved, if it has any."""
    text, parts, first, last, at = layer.content, [], [], [], 0
    for m in escapes.finditer(text):
        got = decode(m[0])
        if not got:
            continue
        parts += [text[at:m.start()], "".join(c for c, _, _ in got)]
        plain = np.arange(at, m.start())
        first += [plain, np.array([m.start() + a for _, a, _ in got])]
        last += [plain, np.array([m.start() + b - 1 for _, _, b in got])]
        at = m.end()
    if at:
        rest = np.arange(at, len(text))
        yield layer.part("".join([*parts, text[at:]]), name, np.concatenate([*first, rest]), np.concatenate([*last, rest]))


class _Members:
    """Reads the members of a compressed stream a step at a time."""

    def __init__(self, make: Callable, data: bytes):
        self.make, self.member, self.rest = make, make(), data

    def read(self, size: int) -> bytes:
        if self.member.eof:
            self.rest, self.member = self.member.unused_data, self.make()
            if not self.rest:
                return b""
        found = self.member.decompress(self.rest, size)
        self.rest = getattr(self.member, "unconsumed_tail", b"")
        return found or (self.read(size) if self.member.eof else b"")


def unpacker(data: bytes):
    """(name, reader) of compressed data, by its first bytes; else None."""
    if data[:2] == b"\x1f\x8b":
        return "gzip", _Members(lambda: zlib.decompressobj(31), data)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return "zlib", _Members(zlib.decompressobj, data)
    if data[:3] == b"BZh":
        return "bzip2", _Members(bz2.BZ2Decompressor, data)
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", _Members(lzma.LZMADecompressor, data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
    return None


def unpacked(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, piece) of what compressed data holds; damaged data gives what comes before the damage."""
    kind = unpacker(data)
    if not kind:
        return
    name, stream = kind
    held, new, more = bytearray(), 0, True
    while more:
        try:
            step = stream.read(STEP)
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
            step = b""
        more = bool(step)
        held += step
        new += len(step)
        if new and (new >= PIECE or not more):
            yield name, bytes(held)
            held, new = held[-OVERLAP:], 0


def _readable(layer: Layer) -> Iterator[Layer]:
    """The stretches of UTF-8 text in a layer of bytes."""
    for m in READABLE.finditer(layer.content):
        try:
            text = m[0].decode()
        except UnicodeDecodeError:
            text = m[0].decode("latin-1")
            sizes = np.ones(len(text), np.int64)
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        ends = m.start() + np.cumsum(sizes)
        yield layer.part(text, "", ends - sizes, ends - 1)


def _decoded(layer: Layer) -> Iterator[Layer]:
    """Layers of bytes, of each base64 run; a run may begin amid other letters, so from each of four places."""
    text = layer.content
    runs = [(m[0], np.arange(*m.span())) for m in RUN.finditer(text)]
    for m in WRAPPED.finditer(text):
        places = np.array([i for i in range(*m.span()) if text[i] not in "\r\n"])
        runs.append((m[0].replace("\r", "").replace("\n", ""), places))
    for run, places in runs:
        letters = run.translate(URL_LETTERS)
        for shift in range(4):
            cut = letters[shift:]
            cut = cut[:-1] if len(cut) % 4 == 1 else cut
            data = binascii.a2b_base64(cut + "=" * (-len(cut) % 4))
            if unpacker(data) or READABLE.search(data):
                byte = np.arange(len(data))
                yield layer.part(data, "base64", places[shift + byte * 4 // 3], places[shift + ((byte + 1) * 4 + 2) // 3 - 1])


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """All layers that lie directly inside this one."""
    if isinstance(layer.content, bytes):
        whole = np.zeros(1, np.int64)
        for name, piece in unpacked(layer.content):
            here = layer.part(piece, name, whole, whole)
            yield Layer(piece, here.path, np.broadcast_to(layer.starts[0], len(piece)), np.broadcast_to(layer.ends[-1], len(piece)))
        yield from _readable(layer)
    else:
        yield from resolved(layer, "url", ADDRESS_ESCAPES, _address)
        yield from resolved(layer, "unicode", UNICODE_ESCAPES, _unicode)
        yield from _decoded(layer)


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[int, int, str, str]]]:
    """(base spans, all finds as (start, end, kind, layers)) of a text.

    ``layers`` names what was unwrapped on the way, outermost first, and is empty for base spans. A
    find in a layer that lies within a base span of its kind is that span.
    """
    base = base_spans(text)
    found = {(k, *s): "" for k in KINDS for s in base[k]}
    work = deque([Layer(text)])
    seen = set()
    while work:
        for layer in unwrapped(work.popleft()):
            key = layer.key()
            if key in seen:
                continue
            seen.add(key)
            work.append(layer)
            if isinstance(layer.content, bytes):
                continue
            for kind, spans in base_spans(layer.content).items():
                for a, b in spans:
                    start, end = int(layer.starts[a]), int(layer.ends[b - 1])
                    if not any(x <= start and end <= y for x, y in base[kind]):
                        found.setdefault((kind, start, end), ">".join(layer.path))
    order = sorted((a, KINDS.index(k), b, k, path) for (k, a, b), path in found.items())
    return base, [(a, b, k, path) for a, _, b, k, path in order]


def listed(finds: Sequence[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, _ in finds)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans, finds) per row of ``docs``.

    Counts and ``base`` are of the patterns' spans, ``spans`` are all: kind:start:end in code points,
    by start and then kind, joined by commas. ``finds`` is an array of (start, end, kind, layers).
    Null texts are empty. Repeated rows and null keys stay. Other columns are not read, whatever
    their names. Texts of any length are held by one task at a time; what they unpack to is looked
    at in pieces of 16 MB that overlap by 64 KB. An empty table gives no rows.
    """
    entry = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()),
        T.StructField("layers", T.StringType()),
    ])
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("finds", T.ArrayType(entry)),
    ])
    inner = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("layers", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            results = [find(t) for t in text_values(batch.column(1))]
            counts = [pa.array([len(base[k]) for base, _ in results], pa.int64()) for k in KINDS]
            bases = [listed([f for f in finds if not f[3]]) for _, finds in results]
            rows = [[dict(zip(("start", "end", "kind", "layers"), f)) for f in finds] for _, finds in results]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(bases, pa.string()), pa.array([listed(f) for _, f in results], pa.string()), pa.array(rows, inner)],
                names=schema.fieldNames(),
            )

    return docs.select(key, text).mapInArrow(look, schema)
