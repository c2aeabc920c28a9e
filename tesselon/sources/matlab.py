"""MATLAB level-5 files: numeric, logical, char, cell and struct arrays.

The format is the published one: a 128-byte header, then tagged elements, some of them
zlib-compressed. Nothing in a file is executed, so executors can read it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the file format: element types of numbers, and array classes.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED, _TEXT = 14, 15, {16: "utf-8", 17: "utf-16", 18: "utf-32"}
_CELL, _STRUCT, _CHAR = 1, 2, 4


class _Reader:
    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def element(self) -> tuple[int, bytes]:
        """(type, content) of the next element; the padding after it is skipped."""
        kind, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if kind >> 16:  # a small element: size and content share the tag
            kind, size = kind & 0xFFFF, kind >> 16
            body = self.data[self.at + 4 : self.at + 4 + size]
            self.at += 8
            return kind, body
        body = self.data[self.at + 8 : self.at + 8 + size]
        self.at += 8 + (size if kind == _COMPRESSED else size + -size % 8)
        return kind, body

    def more(self) -> bool:
        return self.at + 8 <= len(self.data)

    def numbers(self) -> np.ndarray:
        kind, body = self.element()
        if kind in _TEXT:
            return np.array([ord(c) for c in body.decode(_TEXT[kind])])
        return np.frombuffer(body, self.order + _NUMBERS[kind])


def _array(body: bytes, order: str):
    """(name, value) of a matrix element."""
    r = _Reader(body, order)
    if not body:
        return "", np.zeros((0, 0))
    flags = int(r.numbers()[0])
    shape = tuple(int(x) for x in r.numbers())
    name = bytes(r.numbers().astype("u1")).decode()
    kind = flags & 0xFF
    if kind == _CELL:
        out = np.empty(shape, object).ravel(order="F")
        for i in range(len(out)):
            out[i] = _array(r.element()[1], order)[1]
        return name, out.reshape(shape, order="F")
    if kind == _STRUCT:
        width = int(r.numbers()[0])
        raw = bytes(r.numbers().astype("u1"))
        fields = [raw[i : i + width].split(b"\0")[0].decode() for i in range(0, len(raw), width)]
        items = [{f: _array(r.element()[1], order)[1] for f in fields} for _ in range(int(np.prod(shape)))]
        return name, items[0] if len(items) == 1 else items
    real = r.numbers()
    if kind == _CHAR:
        rows = real.reshape(shape, order="F") if real.size else np.zeros((0, 0))
        text = ["".join(chr(int(c)) for c in row) for row in rows]
        return name, text[0] if len(text) == 1 else text
    if flags & 0x0800:
        real = real + 1j * r.numbers()
    return name, real.reshape(shape, order="F")


def load(content: bytes) -> dict:
    """Variables of a level-5 file by name."""
    order = "<" if content[126:128] == b"IM" else ">"
    r, out = _Reader(content[128:], order), {}
    while r.more():
        kind, body = r.element()
        if kind == _COMPRESSED:
            kind, body = _Reader(zlib.decompress(body), order).element()
        if kind == _MATRIX:
            name, value = _array(body, order)
            out[name] = value
    return out


def read_matlab(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, cell, i, j, value of a numeric variable, or of every numeric array in a cell
    variable (cell: its place in column order, 0 for a plain array) (S7)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                v = load(content)[name]
                cells = list(v.ravel(order="F")) if isinstance(v, np.ndarray) and v.dtype == object else [v]
                for c, a in enumerate(cells):
                    a = np.atleast_2d(np.asarray(a, float))
                    i, j = np.indices(a.shape)
                    yield pd.DataFrame({"path": p, "cell": c, "i": i.ravel(), "j": j.ravel(), "value": a.ravel()})

    return files.mapInPandas(run, "path string, cell long, i long, j long, value double")
