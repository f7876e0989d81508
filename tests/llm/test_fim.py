"""Op 12 against plain string slicing, and exact round trips."""

import hashlib
import random
import re

import zstandard
from conftest_llm import frame, prose

from runwise.llm import fim_frames as ff

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(i, t):
    t = t or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, n, "plain", None, None, digest(t), digest(t))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return (i, n, "spm", len(p), len(m), digest("<S>" + s + "<P>" + p + "<M>" + m), digest(t))
    return (i, n, "psm", len(p), len(m), digest("<P>" + p + "<S>" + s + "<M>" + m), digest(t))


def check(spark, rows):
    got = sorted((tuple(r) for r in ff.report(frame(spark, [(i, t, "en") for i, t in rows])).collect()), key=str)
    assert got == sorted((plain(i, t) for i, t in rows), key=str)
    return got


def test_random_texts(llm):
    rng = random.Random(3)
    pieces = ["a", "é", "😀", " ", "\n", "\t\r", "<", "P>", "<P", "<S", ">", "S>M", "\x0b", "\x0c", " ", "\x1c", "word", "<M"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(800)]
    forms = {r[2] for r in check(llm, rows)}
    assert forms == {"plain", "psm", "spm"}


def test_odd_and_long_rows(llm, odd_rows):
    long = [(100 + k, prose(k, 9000) + " \n" * (k % 2) + "x" * 200_000 * (k % 3)) for k in range(8)]
    check(llm, [(i, t) for i, t, _ in odd_rows] + long + [(200, " " * 300_000), (201, "<P> a")])
    assert ff.report(frame(llm, [])).count() == 0


def test_every_cut_is_found_by_decompressing_one_frame():
    text = "é\t" + prose(4, 5000) + "  "
    units = UNIT.findall(text)
    raw = text.encode()
    frames = ff.to_frames(raw, zstandard.ZstdCompressor())
    assert len(frames) >= 3 and frames[-1]["unit"] + frames[-1]["n_units"] == len(units)

    class Counting:
        n = 0

        def decompress(self, data, max_output_size):
            Counting.n += 1
            return zstandard.ZstdDecompressor().decompress(data, max_output_size=max_output_size)

    for cut in [*range(0, len(units), 97), ff.FRAME_UNITS, ff.FRAME_UNITS - 1, ff.FRAME_UNITS + 1, len(units)]:
        Counting.n = 0
        before = "".join(units[:cut])
        assert ff.seek(frames, cut, Counting()) == (len(before.encode()), len(before))
        assert Counting.n <= 1


def test_any_range_streams_from_the_frames():
    raw = prose(4, 6000).encode()
    frames = ff.to_frames(raw, zstandard.ZstdCompressor())
    rng = random.Random(1)
    for _ in range(50):
        a, b = sorted(rng.choices(range(len(raw) + 1), k=2))
        assert b"".join(ff.stream(frames, a, b, zstandard.ZstdDecompressor())) == raw[a:b]


def test_marks_that_span_output_frames_are_found():
    for size in range(1, 9):
        whole = b"<S>suf<P>p<<M>mid"
        blocks = [whole[k:k + size] for k in range(0, len(whole), size)]
        output = [{"n_bytes": len(b), "data": zstandard.ZstdCompressor().compress(b)} for b in blocks]
        assert b"".join(ff.restore("spm", output, zstandard.ZstdDecompressor())) == b"p<midsuf"


def test_output_is_the_transformed_text(llm):
    docs = llm.createDataFrame([(i, prose(i, 50)) for i in range(60)], "doc_id long, text string")
    for r in ff.cut(ff.store(docs, ["doc_id", "text"]), ["doc_id", "text"]).collect():
        out = b"".join(zstandard.ZstdDecompressor().decompress(f.data, max_output_size=f.n_bytes) for f in r.output)
        assert hashlib.sha256(out).hexdigest() == r.output_sha256 == plain(r.doc_id, r.text)[5]
