"""Small parts that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `chars` bytes of text each, so that work space stays bounded."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            size += n + 64
            if size >= chars:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system. Workers live on after a task and would hold what its work space took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_text(f: Callable[[list[str | None]], Any], kind: str, chars: int = 300_000) -> Callable[[Column], Column]:
    """The function of a text column that `f` computes from lists of texts, some `chars` bytes of text at once. kind: double or string."""
    type_ = {"double": pa.float64(), "string": pa.string()}[kind]

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            done = [pa.array(f(piece.column(0).to_pylist()), type_) for piece in slices([batch], chars)]
            yield pa.concat_arrays(done) if done else pa.array([], type_)

    return run


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


class Recent:
    """A bounded memory of keys and their values in two generations.

    When the younger one has more than `limit` keys, `age` forgets the older and the younger takes its place; a key that
    is used again comes back to the young. So what is used often stays, and 2 * `limit` keys and those of one batch are
    held at most.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict = {}
        self.before: dict = {}

    def age(self) -> None:
        """To be called before each batch."""
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}

    def unknown(self, keys: set) -> set:
        """Those of the keys without a value. All others are in `now` until it ages."""
        missing = keys.difference(self.now)
        if self.before:
            again = [k for k in missing if k in self.before]
            self.now.update(zip(again, map(self.before.__getitem__, again), strict=True))
            missing.difference_update(again)
        return missing
