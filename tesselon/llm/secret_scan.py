"""Secret scanning through encoded layers.

A text is the first layer of a worklist. Each layer is scanned with the three
kinds of pattern; then every line of it that holds percent (URL) escapes, Unicode
escapes or character references, decoded in place with the text around them, and
every stretch that decodes from base64, also one wrapped over lines, becomes a further
layer, and so does data inside base64 or percent escapes that is compressed (gzip, zlib,
raw deflate, bzip2, xz), until no new layer appears. No pattern spans lines. A layer whose
content was seen on the way to it, or at the same place, is not entered again, so cycles
end. The worklist goes depth first and takes the next layer of a text only when it is done
with the one before, and keeps hashes of the texts it has seen, so at any time one layer of
each depth is held, whatever a text unfolds to. A layer knows which stretches of the layer before it its stretches came from, so a
finding in any layer maps, layer by layer, to a span of the original text.

Kinds, leftmost and non-overlapping in each layer: assign (a secret's name, ``:`` or
``=``, a value of 12 characters or more), access (a key of 18 or more) and hex (16 or
more). Spans are of the whole match, in code points, the end exclusive.

Whether a text may hold anything at all is decided for a whole batch on its bytes;
only such texts reach the patterns. Texts are read whole and no layer is dropped:
bytes that are not UTF-8 are read as Latin-1, each by itself. Compressed data unfolds
as a stream through all its members and as far as it is intact, wherever its header
stands (raw deflate has none and is tried on whole stretches). Each PIECE bytes of it are
a layer, which begins OVERLAP bytes or more before the end of the one before: at a space,
or else in step with the run of base64 there. Only compressed data inside a run of base64
that is itself longer than that isn't unfolded beyond its first piece. A layer takes a few
bytes for each of its characters; one escape takes 32 bytes more.

Defined results: a null text is empty and has no spans; equal spans of one kind
found in several layers count once among the added ones; findings that start together
are ordered by kind, then end; repeated rows repeat; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import io
import lzma
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.common import bounded, free_name, table
from tesselon.llm.text import buffers, parts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

LINE = re.compile(r"[^\n]+")
URL_RUN, URL_ONE, URL_MANY = re.compile(r"[^\s<>\"]+"), re.compile(r"%[0-9A-Fa-f]{2}"), re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
REFERENCE_ONE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,31});")
BASE64_MIN = 22
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % BASE64_MIN)
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)+={0,2}" % BASE64_MIN)
PIECE, OVERLAP = 16 << 20, 1 << 20
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")


def matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding in one layer."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _stream(data: memoryview, at: list[int], raw: bool = False):
    """What one compressed member unfolds to, in chunks as far as it is intact; at[0]
    becomes the place after it, if it ends."""
    i, made = 0, 0
    try:
        if data[:1] in (b"B", b"\xfd"):
            d = bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
            while not d.eof and (i < len(data) or not d.needs_input):
                chunk = data[i : i + 4096] if d.needs_input else b""
                i += len(chunk)
                if got := d.decompress(chunk, 1 << 20):
                    yield got
        else:
            d = zlib.decompressobj(-15 if raw else 31 if data[0] == 0x1F else 15)
            while not d.eof and (i < len(data) or d.unconsumed_tail):
                chunk = d.unconsumed_tail or data[i : i + 4096]
                i += 0 if d.unconsumed_tail else len(chunk)
                if got := d.decompress(chunk, 1 << 20):
                    yield got
            while not d.eof:  # nothing more to feed, but output may be held back
                made = d.decompress(b"", 1 << 20)
                if not made:
                    break
                yield made
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return
    if d.eof:
        at[0] = min(i, len(data)) - len(d.unused_data)


def _deflated(data: bytes) -> bool:
    """Whether bytes without a header are raw deflate, as a whole."""
    at = [0]
    return sum(map(len, _stream(memoryview(data), at, True))) > 0 and at[0] == len(data)


def _unpacked(data: bytes):
    """Texts that the compressed members in some bytes unfold to."""
    view, start = memoryview(data), 0
    if data and not PACKED.search(data) and _deflated(data):
        yield from _pieces(view, [0], True)
        return
    while start < len(data):
        if start == 0 and len(data) > 2 and data[0] & 0x0F == 8 and (data[0] << 8 | data[1]) % 31 == 0:
            low = 0
        elif m := PACKED.search(data, start):
            low = m.start()
        else:
            return
        after = [low]
        yield from _pieces(view, after, False)
        start = after[0]


def _pieces(view: memoryview, after: list[int], raw: bool):
    """Texts of the members that follow each other from after[0] on, which are one
    stream; after[0] becomes the place behind them."""
    held, low = bytearray(), after[0]
    while True:
        at = [0]
        for got in _stream(view[low:], at, raw):
            held += got
            if len(held) >= PIECE:
                yield _text(bytes(held))
                cut = len(held) - OVERLAP
                space = max(held.rfind(c, 1, cut) for c in (b" ", b"\n", b"\t", b"\r"))
                if space <= len(held) // 2:
                    other = np.flatnonzero(~_SIXTY[np.frombuffer(bytes(held[:cut]), np.uint8)])
                    space = cut - (cut - (int(other[-1]) + 1 if len(other) else 0)) % 4
                del held[:space]
        low += at[0] or 1
        if raw or not at[0] or not PACKED.match(view, low):
            break
    after[0] = low
    if held:
        yield _text(bytes(held))


def _text(data: bytes) -> str:
    """As _read, without the places."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", lambda m: chr(ord(m[0]) - 0xDC00), data.decode("utf-8", "surrogateescape"))


def _read(data: bytes) -> tuple[str, np.ndarray | None]:
    """(text, the place after each character if there are others than ASCII) of bytes;
    those that are not UTF-8 are Latin-1."""
    if data.isascii():
        return data.decode("ascii"), None
    text = data.decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = (points >= 0xDC80) & (points <= 0xDCFF)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    if odd.any():
        width[odd] = 1
        text = np.where(odd, points - 0xDC00, points).astype(np.uint32).tobytes().decode("utf-32-le")
    return text, np.cumsum(width, dtype=np.int32 if len(data) < 1 << 31 else np.int64)


class Places:
    """Which stretches of a source the stretches of a decoded text came from: step source
    characters for each character, or all of the stretch for any of it where step is 0."""

    def __init__(self):
        self.low, self.start, self.end, self.step = array("q"), array("q"), array("q"), array("b")

    def add(self, low: int, start: int, end: int, step: int) -> None:
        self.low.append(low)
        self.start.append(start)
        self.end.append(end)
        self.step.append(step)

    def span(self, a: int, z: int) -> tuple[int, int]:
        i, j = bisect_right(self.low, a) - 1, bisect_right(self.low, z - 1) - 1
        return self.start[i] + self.step[i] * (a - self.low[i]), self.start[j] + self.step[j] * (z - self.low[j]) if self.step[j] else self.end[j]


class Base64Places:
    """The same for a text that was base64; index holds the places of its characters in
    a wrapped source."""

    def __init__(self, ends: np.ndarray | None, size: int, index: np.ndarray | None):
        self.ends, self.size, self.index = ends, size, index

    def span(self, a: int, z: int) -> tuple[int, int]:
        if self.ends is not None:
            a, z = int(self.ends[a - 1]) if a else 0, int(self.ends[z - 1])
        a, z = a * 8 // 6, min(self.size, (z * 8 - 1) // 6 + 1)
        return (a, z) if self.index is None else (int(self.index[a]), int(self.index[z - 1]) + 1)


class _Decoding:
    """A text that is decoded in place, from left to right."""

    def __init__(self, source: str):
        self.source, self.out, self.places, self.n, self.at = source, io.StringIO(newline=""), Places(), 0, 0

    def put(self, text: str, start: int, end: int, step: int) -> None:
        """Text for a stretch of the source; what stands before it is copied."""
        if start > self.at:
            self.places.add(self.n, self.at, start, 1)
            self.n += self.out.write(self.source[self.at : start])
        if text:
            self.places.add(self.n, start, end, step)
            self.n += self.out.write(text)
        self.at = end

    def done(self) -> tuple[str, Places]:
        self.put("", len(self.source), len(self.source), 0)
        return self.out.getvalue(), self.places


def _percent(part: str) -> tuple[str, Places]:
    d = _Decoding(part)
    for m in URL_MANY.finditer(part):
        text, ends = _read(bytes.fromhex(m[0].replace("%", "")))
        if ends is None:
            d.put(text, m.start(), m.end(), 3)
            continue
        low = 0
        for ch, high in zip(text, ends.tolist(), strict=True):
            d.put(ch, m.start() + 3 * low, m.start() + 3 * high, 0)
            low = high
    return d.done()


def _percent_bytes(part: str) -> bytes:
    out, at = bytearray(), 0
    for m in URL_MANY.finditer(part):
        out += part[at : m.start()].encode() + bytes.fromhex(m[0].replace("%", ""))
        at = m.end()
    return bytes(out + part[at:].encode())


def _escapes(part: str, one: re.Pattern) -> tuple[str, Places]:
    d = _Decoding(part)
    high = None  # the first half of a character that is written as two escapes
    for m in one.finditer(part):
        raw, start = m[0], m.start()
        if raw[0] == "&":
            got = html.unescape(raw)
        else:
            code = int(raw[2:].strip("{}"), 16)
            got = chr(code) if code <= 0x10FFFF else raw
            if high is not None:
                if 0xDC00 <= code <= 0xDFFF and high[2] == start:
                    got, start = chr(0x10000 + ((high[0] & 0x3FF) << 10) + (code & 0x3FF)), high[1]
                else:
                    d.put("\ufffd", high[1], high[2], 0)
                high = None
            if len(got) == 1 and 0xD800 <= ord(got) <= 0xDBFF:
                high = (code, start, m.end())
                continue
            if len(got) == 1 and 0xDC00 <= ord(got) <= 0xDFFF:
                got = "\ufffd"
        d.put(got, start, m.end(), 0)
    if high is not None:
        d.put("\ufffd", high[1], high[2], 0)
    return d.done()


def _base64(part: str):
    body = part.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _base64_layers(at: int, part: str, index: np.ndarray | None = None, size: int | None = None):
    """Layers of a run of base64 that stands at a place; index and size are those of the
    wrapped stretch that it was taken from."""
    data, end = _base64(part), at + (size or len(part))
    if data is not None:
        for plain in _unpacked(data):
            yield at, end, plain, None
        text, ends = _read(data)
        yield at, end, text, Base64Places(ends, len(part.rstrip("=")), index)
        if len(text.encode()) == len(data) and text.isprintable():
            return
    if index is None and re.search(r"[/_-]", part):
        for m in re.finditer(r"[A-Za-z0-9+]{%d,}={0,2}" % BASE64_MIN, part):
            if m[0] != part:
                yield from _base64_layers(at + m.start(), m[0])


def _wrapped_layers(at: int, part: str):
    lines = part.split("\n")
    size = [len(x.strip()) for x in lines]
    if any(n != size[0] for n in size[:-1]) or size[-1] > size[0] + 2:
        return
    solid = ~np.isin(np.frombuffer(part.encode("ascii"), np.uint8), list(b" \t\r\n"))
    yield from _base64_layers(at, "".join(part.split()), np.flatnonzero(solid).astype(np.int32), len(part))


def _runs_with(one: re.Pattern, run: re.Pattern, text: str):
    """The runs of a text that hold an escape, each once, in time linear in the text."""
    if one.search(text):
        for m in run.finditer(text):
            if one.search(m[0]):
                yield m


def layers(text: str):
    """(start, end, decoded text, places) of each decodable stretch; places are
    relative to start, or None where only the stretch is known."""
    for m in _runs_with(URL_ONE, URL_RUN, text):
        for plain in _unpacked(_percent_bytes(m[0])):
            yield m.start(), m.end(), plain, None
    for m in _runs_with(URL_ONE, LINE, text):
        yield m.start(), m.end(), *_percent(m[0])
    for one in (UNICODE_ONE, REFERENCE_ONE):
        for m in _runs_with(one, LINE, text):
            yield m.start(), m.end(), *_escapes(m[0], one)
    for m in BASE64.finditer(text):
        yield from _base64_layers(m.start(), m[0])
    for m in WRAPPED.finditer(text):
        yield from _wrapped_layers(m.start(), m[0])


class _Layer:
    """A text and the stretch of the layer above that it was decoded from."""

    def __init__(self, text: str, above: _Layer | None = None, low: int = 0, high: int = 0, places=None):
        self.text, self.above, self.low, self.high, self.places = text, above, low, high, places

    def origin(self, a: int, z: int) -> tuple[int, int]:
        """The span of the original text that [a, z) came from."""
        layer = self
        while layer.above is not None:
            if layer.places is None:
                a, z = layer.low, layer.high
            else:
                a, z = layer.places.span(a, z)
                a, z = a + layer.low, z + layer.low
            layer = layer.above
        return a, z


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans of the text itself, spans added by decoding), both sorted."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda x: (x[1], rank[x[0]], x[2])
    base = sorted(matches(text), key=order)
    known, added = set(base), set()
    first = _digest(text)
    work = [(_Layer(text), frozenset([first]), layers(text))]
    entered: set[tuple[int, int, bytes]] = set()
    while work:
        layer, seen, rest = work[-1]
        for a, z, plain, places in rest:
            if not plain or plain == layer.text[a:z] or (name := _digest(plain)) in seen:
                continue
            place = (*layer.origin(a, z), name)
            if place in entered:
                continue
            entered.add(place)
            below = _Layer(plain, layer, a, z, places)
            for kind, i, j in matches(plain):
                span = (kind, *below.origin(i, j))
                if span not in known:
                    added.add(span)
            work.append((below, seen | {name}, layers(plain)))
            break
        else:
            work.pop()
    return base, sorted(added, key=order)


def _digest(text: str) -> bytes:
    """What stands for a layer's text where texts are only compared."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True
_SIXTY = np.zeros(256, bool)
_SIXTY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"%\\&")] = True
_NAMES = (b"passw", b"secret", b"token", b"api", b"akia")


def _runs(member: np.ndarray, least: int, offsets: np.ndarray) -> np.ndarray:
    """Where runs of at least so many members end (exclusive); a run that goes on
    into further texts also ends at the end of each text before."""
    gaps = np.concatenate([[-1], np.flatnonzero(~member), [len(member)]])
    long = np.diff(gaps) > least
    low, high = gaps[:-1][long] + 1, gaps[1:][long]
    a, z = np.searchsorted(offsets, low, side="right"), np.searchsorted(offsets, high, side="left")
    inner = [offsets[i:j] for i, j in zip(a[a < z], z[a < z], strict=True)]
    return np.concatenate([high, *inner])


def suspects(column) -> np.ndarray:
    """Indices of texts that may hold a finding or a decodable stretch; a text
    that is left out can't."""
    raw, offsets = buffers(column)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = [_runs(_HEXES[raw], 16, offsets), _runs(_SIXTY[raw], BASE64_MIN, offsets), np.flatnonzero(_MARKS[raw]) + 1]
    low = raw.tobytes().lower()
    for word in _NAMES:
        at = low.find(word)
        while at >= 0:
            ends.append([at + 1])
            # the rest of this text need not be searched
            k = int(np.searchsorted(offsets, at, side="right"))
            at = low.find(word, max(at + 1, int(offsets[k]) if k < len(offsets) else len(low)))
    places = np.concatenate([np.asarray(x, np.int64) for x in ends]) - 1
    return np.unique(np.searchsorted(offsets, places, side="right") - 1)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def scan_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with base_spans and added_spans, arrays of
    struct<kind, start, end> in code points."""
    bounded(docs)
    spans = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    empty, own = docs.select(*keep).schema, free_name("text", [*keep, "base_spans", "added_spans"])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in empty] + [f"base_spans {spans}", f"added_spans {spans}"])

    def run(batches):
        for b in parts(batches, own):
            col = b.column(own)
            base: list = [[] for _ in range(len(col))]
            more: list = [[] for _ in range(len(col))]
            for i in suspects(col):
                x, y = scan(col[int(i)].as_py() or "")
                base[i] = [{"kind": k, "start": a, "end": z} for k, a, z in x]
                more[i] = [{"kind": k, "start": a, "end": z} for k, a, z in y]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, kind), pa.array(more, kind)], names=[*keep, "base_spans", "added_spans"])

    return docs.select(*keep, F.col("text").alias(own)).mapInArrow(run, schema)


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask (overlapping spans by one);
    all columns stay as they are but for text. Null texts stay null."""
    bounded(docs)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for b in parts(batches, "text"):
            at = b.schema.get_field_index("text")
            col = b.column(at)
            texts = None
            for i in suspects(col):
                text = col[int(i)].as_py() or ""
                base, more = scan(text)
                spans = sorted((a, z) for _, a, z in [*base, *more])
                if not spans:
                    continue
                texts = texts if texts is not None else col.to_pylist()
                out, done = [], 0
                low, high = spans[0]
                for a, z in [*spans[1:], (len(text) + 1, len(text) + 1)]:
                    if a < high:
                        high = max(high, z)
                        continue
                    out += [text[done:low], mask]
                    done, low, high = high, a, z
                texts[i] = "".join([*out, text[done:]])
            cols = [b.column(k) for k in range(b.num_columns)]
            if texts is not None:
                cols[at] = pa.array(texts, col.type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_documents(docs, ["doc_id"])
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        text(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )
