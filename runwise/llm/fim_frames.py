"""Fill-in-middle on seekable compressed frames.

A text is stored as independent zstandard frames of whole units with cumulative unit, byte and character counts, so
a unit number is found by bisection and one frame is decompressed to cut inside it.  The transformed text is
never built: its parts are ranges of the stored bytes, streamed frame by frame in the order of the form, and
written as frames of their own.  The restored text is read back from those output frames alone: the three marks
are searched in the stream, then prefix, middle and suffix are streamed in their order.

Units are the tokens of ``UNIT``; a unit is a word with the white space before it, and white space at the end of the
text is a unit.  Cuts, form and marks are fixed by the contract (``plan``).

Defined results: a null or empty text has no frames, no units and the form plain; null ids hash as the text
``null`` after the seed; repeated rows each keep their own row; an empty table gives an empty table; a very long text is
many frames, of which one is in memory at a time, and a unit longer than a frame is a frame of its own; input columns
other than ``doc_id`` and ``text`` aren't read by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwise.llm.common import discard, map_batches, written

# Fixed values of the contract.
UNIT = rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
PLAIN_FROM, SPM_BELOW = 50, 80

FRAME_UNITS = 2048
LEVEL = 3

# One frame: units, bytes and characters before it, its own counts, and the compressed bytes.
FRAME = "struct<unit:bigint,byte:bigint,char:bigint,n_units:bigint,n_bytes:bigint,n_chars:bigint,data:binary>"
STORE = f"n bigint, n_bytes bigint, n_chars bigint, marked boolean, frames array<{FRAME}>"
CUT = ("n bigint, form string, prefix_chars bigint, middle_chars bigint, "
       "output array<struct<n_bytes:bigint,data:binary>>, output_sha256 string")
RESTORED = "restored_sha256 string"

_BLOCK = re.compile(rb"(?:[ \t-\r]*[^ \t-\r]+){1,%d}|[ \t-\r]+" % FRAME_UNITS)
_UNIT = re.compile(UNIT)


def characters(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(raw.decode("utf-8", "surrogatepass"))


def n_units(block: bytes) -> int:
    """Units of a block: its words, or one when it is white space only."""
    return len(block.split()) or 1


def blocks(raw: bytes) -> Iterator[bytes]:
    """The text in blocks of whole units, at most ``FRAME_UNITS`` in each."""
    for m in _BLOCK.finditer(raw):
        yield m.group()


def to_frames(raw: bytes, compressor) -> list[dict]:
    """Independent frames with the counts of everything before them."""
    out, unit, byte, char = [], 0, 0, 0
    for block in blocks(raw):
        u, c = n_units(block), characters(block)
        out.append({"unit": unit, "byte": byte, "char": char, "n_units": u, "n_bytes": len(block), "n_chars": c,
                    "data": compressor.compress(block)})
        unit, byte, char = unit + u, byte + len(block), char + c
    return out


def marked(raw: bytes) -> bool:
    return PREFIX in raw or SUFFIX in raw or MIDDLE in raw


def seek(frames: list[dict], unit: int, decompressor) -> tuple[int, int]:
    """(bytes, characters) before a unit; only the frame that holds the cut is decompressed, and none at a frame's edge."""
    if unit <= 0 or not frames:
        return 0, 0
    k = bisect_right([f["unit"] for f in frames], unit) - 1
    f, inside = frames[k], unit - frames[k]["unit"]
    if inside == 0:
        return f["byte"], f["char"]
    if inside >= f["n_units"]:
        return f["byte"] + f["n_bytes"], f["char"] + f["n_chars"]
    block = decompressor.decompress(f["data"], max_output_size=f["n_bytes"])
    for i, m in enumerate(_UNIT.finditer(block)):
        if i == inside - 1:
            return f["byte"] + m.end(), f["char"] + characters(block[:m.end()])
    raise AssertionError("unit counts don't fit the frame")


def stream(frames: list[dict], start: int, end: int, decompressor) -> Iterator[bytes]:
    """The stored bytes from ``start`` to ``end``, a frame at a time."""
    if start >= end:
        return
    k = bisect_right([f["byte"] for f in frames], start) - 1
    while k < len(frames) and frames[k]["byte"] < end:
        f = frames[k]
        block = decompressor.decompress(f["data"], max_output_size=f["n_bytes"])
        yield block[max(0, start - f["byte"]):end - f["byte"]]
        k += 1


def plan(doc_id, n: int, has_mark: bool) -> tuple[str, int, int]:
    """(form, units of the prefix, units of prefix and middle)."""
    name = "null" if doc_id is None else str(doc_id)
    hexed = hashlib.sha256(f"{SEED}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if n == 0 or has_mark or h3 % 100 >= PLAIN_FROM:
        return "plain", a, b
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def ordered(form: str, frames: list[dict], a: int, b: int, end: int, decompressor) -> Iterator[bytes]:
    """The transformed text as a stream; a and b are the byte offsets of the cuts."""
    part = {"p": (0, a), "m": (a, b), "s": (b, end)}
    order = {"plain": [(b"", (0, end))], "psm": [(PREFIX, part["p"]), (SUFFIX, part["s"]), (MIDDLE, part["m"])],
             "spm": [(SUFFIX, part["s"]), (PREFIX, part["p"]), (MIDDLE, part["m"])]}[form]
    for mark, (start, stop) in order:
        if mark:
            yield mark
        yield from stream(frames, start, stop, decompressor)


def packed(chunks: Iterator[bytes], compressor, digest, size: int = 1 << 16) -> list[dict]:
    """A stream as frames of about ``size`` bytes; its bytes also go into the digest."""
    out, held, length = [], [], 0

    def flush():
        block = b"".join(held)
        if block:
            out.append({"n_bytes": len(block), "data": compressor.compress(block)})

    for chunk in chunks:
        digest.update(chunk)
        held.append(chunk)
        length += len(chunk)
        if length >= size:
            flush()
            held, length = [], 0
    flush()
    return out


def transform(doc_id, n: int, n_bytes: int, n_chars: int, has_mark: bool, frames: list[dict], tools) -> tuple:
    """One stored text to its output frames, in the order of ``CUT``."""
    compressor, decompressor = tools
    form, a, b = plan(doc_id, n, has_mark)
    digest = hashlib.sha256()
    if form == "plain":
        return n, form, None, None, packed(ordered(form, frames, 0, 0, n_bytes, decompressor), compressor, digest), digest.hexdigest()
    (a_byte, a_char), (b_byte, b_char) = seek(frames, a, decompressor), seek(frames, b, decompressor)
    output = packed(ordered(form, frames, a_byte, b_byte, n_bytes, decompressor), compressor, digest)
    return n, form, a_char, b_char - a_char, output, digest.hexdigest()


def find_marks(output: list[dict], marks: tuple, decompressor) -> list[int]:
    """Byte offsets of the marks, each searched after the one before, with one frame and a few bytes in memory."""
    found, tail, before = [], b"", 0
    for f in output:
        window = tail + decompressor.decompress(f["data"], max_output_size=f["n_bytes"])
        start = before - len(tail)
        at = 0
        while len(found) < len(marks):
            at = window.find(marks[len(found)], at)
            if at < 0:
                break
            found.append(start + at)
            at += len(marks[len(found) - 1])
        before += f["n_bytes"]
        tail = window[-2:] if len(window) >= 2 else window
    return found


def restore(form: str, output: list[dict], decompressor) -> Iterator[bytes]:
    """The original text, streamed from the output frames and the form alone."""
    frames, at = [], 0
    for f in output:
        frames.append({**f, "byte": at})
        at += f["n_bytes"]
    if form == "plain":
        yield from stream(frames, 0, at, decompressor)
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    x, y, z = find_marks(frames, (first, second, MIDDLE), decompressor)
    ranges = {first: (x + 3, y), second: (y + 3, z), MIDDLE: (z + 3, at)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from stream(frames, *ranges[mark], decompressor)


def _tools():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def store(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns and the stored text of every row (``STORE``)."""
    def make():
        compressor, _ = _tools()

        def apply(batch):
            out = []
            for value in batch.column(text).to_pylist():
                raw = (value or "").encode("utf-8", "surrogatepass")
                frames = to_frames(raw, compressor)
                last = frames[-1] if frames else None
                out.append((last["unit"] + last["n_units"] if last else 0, len(raw),
                            last["char"] + last["n_chars"] if last else 0, marked(raw), frames))
            return zip(*out)

        return apply

    return map_batches(docs, make, STORE, keep or [c for c in docs.columns if c != text], [text])


def cut(stored: DataFrame, keep: list[str], key: str = "doc_id") -> DataFrame:
    """The kept columns, the form, the cuts and the output frames of every stored text (``CUT``)."""
    def make():
        tools = _tools()

        def apply(batch):
            cols = [batch.column(c).to_pylist() for c in (key, "n", "n_bytes", "n_chars", "marked", "frames")]
            return zip(*(transform(*row, tools) for row in zip(*cols)))

        return apply

    return map_batches(stored, make, CUT, keep, [key, "n", "n_bytes", "n_chars", "marked", "frames"])


def rebuilt(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the digest of the text rebuilt from form and output frames."""
    def make():
        _, decompressor = _tools()

        def apply(batch):
            digests = []
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist()):
                digest = hashlib.sha256()
                for chunk in restore(form, output, decompressor):
                    digest.update(chunk)
                digests.append(digest.hexdigest())
            return [digests]

        return apply

    return map_batches(outputs, make, RESTORED, keep, ["form", "output"])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns.  The store is written once and read by the later steps; nothing is shuffled."""
    stored = written(store(docs.select(F.col("doc_id"), F.col("text")), ["doc_id"]), "frames")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    out = written(rebuilt(cut(stored, ["doc_id"]), columns), "fim")
    discard(stored)
    return out
