"""Arrays that tasks write to the shared folder and workers map into memory.

A file holds several named arrays: a line of JSON with their names, types, lengths and
places, then their bytes, each from a multiple of 8 on. A file that a worker needs and
can't see is an error, never an empty array. Where the shared folder is a store that
can't be mapped, a worker copies the files that it uses to unnamed temporary ones.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict

import numpy as np

from tesselon.llm.common import local_path

#: Files that a worker keeps mapped.
OPEN = 4096


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file of the folder; a repeated task writes the same file."""
    head, at, parts = [], 0, []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        pad = -a.nbytes % 8
        head.append([k, a.dtype.str, len(a), at])
        parts += [a.tobytes(), b"\0" * pad]
        at += a.nbytes + pad
    line = json.dumps(head).encode()
    data = b"".join([line, b" " * (-(len(line) + 1) % 8), b"\n", *parts])
    local = local_path(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        with open(path := f"{local}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(path, f"{local}/{name}")
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{at}/{name}") as f:
            f.write(data)


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    local = local_path(folder)
    if local is not None:
        data = np.memmap(f"{local}/{name}", np.uint8, "r")
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        held = tempfile.TemporaryFile()
        with store.open_input_stream(f"{at}/{name}") as f:
            while chunk := f.read(1 << 24):
                held.write(chunk)
        held.flush()
        data = np.memmap(held, np.uint8, "r")
    end = data[: 1 << 16].tobytes().index(b"\n") + 1
    out = {}
    for k, dtype, n, at in json.loads(data[:end].tobytes()):
        out[k] = np.frombuffer(data, dtype, n, end + at) if n else np.zeros(0, dtype)
    return out


class Files:
    """The mapped files of a folder."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()

    def __reduce__(self):  # what is mapped is not sent
        return Files, (self.folder,)

    def __getitem__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.held:
            self.held.move_to_end(name)
        else:
            self.held[name] = mapped(self.folder, name)
            if len(self.held) > OPEN:
                self.held.popitem(last=False)
        return self.held[name]


def ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0]+1, ... (n[0] of them), at[1], ..."""
    before = np.cumsum(n) - n
    return np.repeat(at - before, n) + np.arange(int(n.sum()))


def by_shard(shard: np.ndarray):
    """(shard, places of its entries) of every shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    for a, z in zip(new.tolist(), [*new[1:].tolist(), len(s)], strict=True):
        yield int(s[a]), order[a:z]


class HashArray:
    """Sorted 64-bit keys as a directory of buckets by the top bits and 32 more bits of
    each key: 4.5 bytes a key. A key that is not held is taken for one with chance
    BUCKET / 2**32."""

    BUCKET = 8

    @classmethod
    def arrays(cls, keys: np.ndarray) -> dict[str, np.ndarray]:
        bits = min(32, max(1, (len(keys) // cls.BUCKET).bit_length()))
        top = (keys >> np.uint64(64 - bits)).astype(np.int64)
        return {"edge": np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32), "rest": (keys >> np.uint64(32 - bits)).astype(np.uint32)}

    @classmethod
    def find(cls, held: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not held."""
        edge, rest = held["edge"], held["rest"]
        bits = (len(edge) - 1).bit_length() - 1
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        want = (keys >> np.uint64(32 - bits)).astype(np.uint32)
        at, end = edge[bucket].astype(np.int64), edge[bucket + 1].astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at, end, want = at[open_], end[open_], want[open_]
        while len(open_):
            now = rest[at]
            hit = now == want
            out[open_[hit]] = at[hit]
            go = np.flatnonzero((now < want) & (at + 1 < end))
            open_, at, end, want = open_[go], at[go] + 1, end[go], want[go]
        return out


def small_counts(name: str, n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as one byte each; those of 255 and more also with their places."""
    many = np.flatnonzero(n >= 255)
    return {name: np.minimum(n, 255).astype(np.uint8), f"{name}_at": many.astype(np.uint32), f"{name}_n": n[many].astype(np.int64)}


def counts_at(held: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The counts at some places, 0 at -1."""
    out = np.zeros(len(at), np.int64)
    some = np.flatnonzero(at >= 0)
    if len(some):
        got = held[name][at[some]].astype(np.int64)
        big = np.flatnonzero(got == 255)
        if len(big):
            got[big] = held[f"{name}_n"][np.searchsorted(held[f"{name}_at"], at[some][big])]
        out[some] = got
    return out
