"""Plain files in the session's shared folder, reached by the same address from every machine."""

from __future__ import annotations

import json
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, parts: list[bytes]) -> None:
    """Write a file under another name, then move it in place, so readers see it whole."""
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.part") as out:
        for part in parts:
            out.write(part)
    system.move(f"{path}.part", path)


def mapped(uri: str) -> pa.Buffer:
    """A file's bytes: memory-mapped where its folder is mounted, read otherwise."""
    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with system.open_input_file(path) as f:
        return f.read_buffer()


def as_array(buffer: pa.Buffer, dtype: str, offset: int, count: int) -> np.ndarray:
    return np.frombuffer(buffer, dtype=dtype, count=count, offset=offset)


def packed(meta: dict, arrays: dict[str, np.ndarray]) -> list[bytes]:
    """File parts: a head in JSON, then flat arrays, each at a multiple of eight bytes."""
    at, index = 0, {}
    for name, x in arrays.items():
        index[name] = (x.dtype.str, at, len(x))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(meta | {"index": index}).encode()
    head += b" " * (-len(head) % 8)
    return [len(head).to_bytes(8, "little"), head, *[part for x in arrays.values() for part in (x.tobytes(), bytes(-x.nbytes % 8))]]


def unpacked(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Head and arrays of a file of packed(); arrays are views of its mapped bytes."""
    buffer = mapped(uri)
    size = int.from_bytes(buffer[:8].to_pybytes(), "little")
    meta = json.loads(buffer[8 : 8 + size].to_pybytes())
    return meta, {name: as_array(buffer, dtype, 8 + size + at, n) for name, (dtype, at, n) in meta.pop("index").items()}
