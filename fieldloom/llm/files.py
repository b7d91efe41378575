"""Small files in the shared folder, written whole and read by memory map."""

from __future__ import annotations

import io
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow.fs


def put(uri: str, name: str, data: bytes) -> None:
    """Write a file beside its place, then move it there, so that a repeated or parallel task does no harm."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None) as f:
        f.write(data)
    fs.move(tmp, f"{path}/{name}")


def put_array(uri: str, name: str, x: np.ndarray) -> None:
    f = io.BytesIO()
    np.save(f, x)
    put(uri, f"{name}.npy", f.getvalue())


class Arrays:
    """Memory-mapped arrays of a folder, opened when asked for. Where the folder is remote, a file is fetched once per worker."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, pyarrow.fs.LocalFileSystem)
        self.have: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.have:
            path = f"{self.path}/{name}.npy"
            if not self.local:
                fd, copy = tempfile.mkstemp(suffix=".npy")
                with self.fs.open_input_stream(path) as src, os.fdopen(fd, "wb") as dst:
                    shutil.copyfileobj(src, dst)
                path = copy
            self.have[name] = np.load(path, mmap_mode="r")
            if not self.local:
                os.unlink(path)  # the map keeps the data
        return self.have[name]
