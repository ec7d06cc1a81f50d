"""Fill-in-middle examples over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` bytes, each with the number of units and code
points before it (a unit is a run of ASCII letters or any other single character).  To cut a text at a unit, the
one frame that holds the cut is found in the cumulative counts and decompressed; whole frames go into the
output as they are.  Digests and the way back read the frames in order, one at a time, and what has to wait for its
turn waits compressed, so that past the given text itself a row never takes more than its compressed size and
a frame.  All work is row-local: no shuffle, and a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, per_batch

FRAME = 16_384  # bytes of text in a frame
SEED = 1
PLAIN_FROM = 90  # of 100 draws, those left as they are
SUFFIX_FIRST = 20  # of 100 draws of the rest, those that begin with the suffix
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

FRAMES = T.ArrayType(
    T.StructType(
        [
            T.StructField("data", T.BinaryType()),
            T.StructField("units", T.LongType()),  # that start before the frame
            T.StructField("chars", T.LongType()),  # that start before the frame
            T.StructField("inside", T.BooleanType()),  # the byte before it is a letter
        ]
    )
)
STORE = T.StructType(
    [
        T.StructField("n_units", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("marked", T.BooleanType()),  # one of the marks stands in the text
        T.StructField("frames", FRAMES),
    ]
)


def starts(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a unit, and which a code point."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    point = (raw & 0xC0) != 0x80
    unit = letter.copy()
    unit[1:] &= ~letter[:-1]
    if inside and len(unit):
        unit[0] = False
    return unit | (point & ~letter), point


def stored(data: bytes, compressor: zstandard.ZstdCompressor, size: int = FRAME) -> dict:
    """The frames of one text with their cumulative counts."""
    frames, units, chars, inside = [], 0, 0, False
    for at in range(0, len(data), size):
        part = data[at : at + size]
        unit, point = starts(part, inside)
        frames.append({"data": compressor.compress(part), "units": units, "chars": chars, "inside": inside})
        units, chars, inside = units + int(unit.sum()), chars + int(point.sum()), bool(_LETTER[part[-1]])
    return {"n_units": units, "n_chars": chars, "marked": any(m in data for m in MARKS.values()), "frames": frames}


class Seekable:
    """A stored text that is decompressed where it is cut."""

    def __init__(self, store: dict):
        self.frames, self.n, self.n_chars = store["frames"], store["n_units"], store["n_chars"]
        self.before = [f["units"] for f in self.frames]
        self.decompressor = zstandard.ZstdDecompressor()

    def cut(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points ahead of it) where a unit starts, or the end of the text."""
        if unit >= self.n:
            return len(self.frames), 0, self.n_chars
        k = int(np.searchsorted(self.before, unit, "right")) - 1
        frame = self.frames[k]
        unit_at, point = starts(self.decompressor.decompress(frame["data"]), frame["inside"])
        at = int(np.flatnonzero(unit_at)[unit - frame["units"]])
        return k, at, frame["chars"] + int(point[:at].sum())

    def part(self, a: tuple[int, int, int], b: tuple[int, int, int], compressor: zstandard.ZstdCompressor) -> Iterator[bytes]:
        """Frames of the text between two cuts; only the cut ones are written anew."""
        for k in range(a[0], min(b[0] + 1, len(self.frames))):
            lo, hi = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
            if hi == 0:
                continue
            if lo == 0 and hi is None:
                yield self.frames[k]["data"]
                continue
            piece = self.decompressor.decompress(self.frames[k]["data"])[lo:hi]
            if piece:
                yield compressor.compress(piece)


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit draws of a row id (null: the word null)."""
    digest = sha256(f"{seed}:{'null' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def transformed(key: object, store: dict, compressor: zstandard.ZstdCompressor) -> tuple[str, int | None, int | None, list[bytes]]:
    """Form, code points of prefix and middle (None if plain), and the output as frames."""
    h1, h2, h3, h4 = draws(key)
    text = Seekable(store)
    if not text.frames or store["marked"] or h3 % 100 >= PLAIN_FROM:
        return "plain", None, None, [f["data"] for f in text.frames]
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    a, b = map(text.cut, sorted((h1 % (text.n + 1), h2 % (text.n + 1))))
    ends = {"prefix": ((0, 0, 0), a), "middle": (a, b), "suffix": (b, (len(text.frames), 0, text.n_chars))}
    out = []
    for name in ORDERS[form]:
        out.append(compressor.compress(MARKS[name]))
        out += text.part(*ends[name], compressor)
    return form, a[2], b[2] - a[2], out


def opened(frames: Iterable[bytes]) -> Iterator[bytes]:
    decompressor = zstandard.ZstdDecompressor()
    return (decompressor.decompress(f) for f in frames)


def sections(chunks: Iterable[bytes], names: Iterable[str]) -> Iterator[tuple[str, bytes]]:
    """(section, bytes) in stream order; marks are found wherever the chunks are cut."""
    todo, held, name = list(names), b"", ""
    for chunk in chunks:
        held += chunk
        while todo and (k := held.find(MARKS[todo[0]])) >= 0:
            if k:
                yield name, held[:k]
            name = todo.pop(0)
            held = held[k + len(MARKS[name]) :]
        wait = len(MARKS[todo[0]]) - 1 if todo else 0
        if len(held) > wait:
            yield name, held[: len(held) - wait]
            held = held[len(held) - wait :]
    if held:
        yield name, held


def restored(form: str, frames: Iterable[bytes], compressor: zstandard.ZstdCompressor) -> Iterator[bytes]:
    """The text again, from the output and its form alone; the suffix waits compressed."""
    if form == "plain":
        yield from opened(frames)
        return
    waiting = []
    for name, piece in sections(opened(frames), ORDERS[form]):
        if name == "suffix":
            waiting.append(compressor.compress(piece))
        else:
            yield piece
    yield from opened(waiting)


def _digest(chunks: Iterable[bytes]) -> str:
    sha = sha256()
    for chunk in chunks:
        sha.update(chunk)
    return sha.hexdigest()


def store(df: DataFrame, text: str = "text", column: str = "stored", keep: list[str] | None = None, size: int = FRAME) -> DataFrame:
    """``keep`` (all but the text) and ``column``: the text as frames with cumulative counts.

    Null and empty texts have no frames.  Repeated rows stay; a column of the same name is replaced.
    """

    def worker() -> Callable:
        compressor = zstandard.ZstdCompressor(level=1)
        return lambda values: [[stored(v or b"", compressor, size) for v in values]]

    keep = [c for c in df.columns if c != text] if keep is None else keep
    (raw,) = fresh(df, "_raw")
    return per_batch(df.withColumn(raw, F.col(text).cast("binary")), raw, [T.StructField(column, STORE)], worker, keep)


def infill(df: DataFrame, id_column: str = "doc_id", column: str = "stored") -> DataFrame:
    """The rows of a store with ``n, form, prefix_chars, middle_chars, output`` (zstandard frames) for the stored text.

    A null id draws like the word null; columns of these names are replaced, the others stay.
    """

    def worker() -> Callable:
        compressor = zstandard.ZstdCompressor(level=1)

        def work(values):
            rows = [(v["s"]["n_units"], *transformed(v["id"], v["s"], compressor)) for v in values]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]

        return work

    fields = [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.ArrayType(T.BinaryType())),
    ]
    (given,) = fresh(df, "_both")
    both = df.withColumn(given, F.struct(F.col(id_column).alias("id"), F.col(column).alias("s")))
    return per_batch(both, given, fields, worker, [c for c in df.columns if c != column])


def restore(df: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``infill`` with the exact text rebuilt from ``output`` and ``form`` in their place."""

    def worker() -> Callable:
        compressor = zstandard.ZstdCompressor(level=1)
        return lambda values: [[b"".join(restored(v["form"], v["output"], compressor)).decode() for v in values]]

    (given,) = fresh(df, "_both")
    keep = [c for c in df.columns if c not in ("output", "form")]
    return per_batch(df.withColumn(given, F.struct("form", "output")), given, [T.StructField(column, T.StringType())], worker, keep)


def with_digests(df: DataFrame) -> DataFrame:
    """The rows of ``infill`` with ``output_sha256`` and ``restored_sha256`` instead of ``output``."""

    def worker() -> Callable:
        compressor = zstandard.ZstdCompressor(level=1)
        return lambda values: [
            [_digest(opened(v["output"])) for v in values],
            [_digest(restored(v["form"], v["output"], compressor)) for v in values],
        ]

    (given,) = fresh(df, "_both")
    fields = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    both = df.withColumn(given, F.struct("form", "output"))
    return per_batch(both, given, fields, worker, [c for c in df.columns if c != "output"])


def op13(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    return with_digests(infill(store(documents, keep=["doc_id"])))
