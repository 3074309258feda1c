"""Arrays in files of the shared folder that the driver and the tasks map instead of holding them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import SparkSession

from tideline.session import ensure_shared_dir

#: Tables of weights of more bytes than this (as doubles) are mapped.
LEAST = 1 << 27


class Mapped(np.memmap):
    """A mapped file; the whole of it is pickled as its name and opened again for reading."""

    def __reduce__(self):
        mapped = getattr(self, "_mmap", None)
        if mapped is not None and self.flags.c_contiguous and self.nbytes == len(mapped):
            return _opened, (str(self.filename), self.dtype.str, self.shape)
        return np.asarray(self).__reduce__()


def _opened(path: str, dtype: str, shape: tuple[int, ...]) -> Mapped:
    return Mapped(path, dtype=dtype, mode="r", shape=shape)


class Room:
    """A folder for mapped arrays, removed with :meth:`remove` or when the driver ends."""

    def __init__(self, shared: str):
        self.folder = tempfile.mkdtemp(prefix="tables-", dir=shared)
        os.chmod(self.folder, 0o777)
        self.made = 0
        atexit.register(self.remove)

    def remove(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def array(self, shape: tuple[int, ...], dtype=np.float32) -> np.ndarray:
        """Zeros of this shape; an empty array isn't mapped, as an empty file can't be."""
        if not np.prod(shape):
            return np.zeros(shape, dtype=dtype)
        self.made += 1
        return Mapped(f"{self.folder}/{self.made}", dtype=dtype, mode="w+", shape=tuple(shape))


def room_for(spark: SparkSession, size: int) -> Room | None:
    """A room for tables of ``size`` bytes; None where they are small, or where the shared folder has no path (they are held then)."""
    if size <= LEAST:
        return None
    place = urlparse(ensure_shared_dir(spark))
    return Room(unquote(place.path)) if place.scheme in ("", "file") else None


def rows_of(room: Room | None, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """Zeros, held or mapped; mapped numbers are single precision."""
    if room is None:
        return np.zeros(shape, dtype=dtype)
    dtype = np.dtype(dtype)
    return room.array(shape, np.float32 if dtype == np.float64 else dtype)


def discard(array: np.ndarray) -> None:
    """Remove a mapped array's file; those who have it open keep it."""
    if isinstance(array, Mapped):
        os.unlink(array.filename)
