"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

Encoding.  A token sequence is the BPE encoding of its bytes exactly if each token encodes
to itself and each adjacent pair of tokens encodes to that pair.  So a piece of text is read
byte by byte by a nondeterministic transducer: a hypothesis is a list of tokens so far and a
node of the vocabulary's trie for the token in progress.  A subset of hypotheses is one
determinised state; states and transitions are made only when a text first needs them.
Tokens on which all hypotheses agree are emitted at once, so the lookahead is bounded by the
longest token.

Decoding.  An incremental UTF-8 machine keeps at most three bytes of an unfinished
character; its transitions on whole tokens are tabulated as they are met.

Defined results: a null text encodes like the empty one (no ids, empty text); an ill-formed
byte sequence decodes to U+FFFD; repeated rows each give a row.
"""

from __future__ import annotations

import base64
import codecs
import sys
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwise.llm.common import kept_by_worker, map_texts

# Tables that a worker keeps are cleared beyond these sizes; results don't depend on them.
MAX_STATES = 180_000
MAX_PAIRS = 400_000
MAX_PIECES = 300_000
# Tokens that may wait for agreement at the end of a piece before what is agreed is given out.
HELD_BACK = 16
MAX_DECODE_ENTRIES = 200_000

ROOT = 0


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: per line a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}


class Transducer:
    """Merges compiled into a lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spelling = {r: t for t, r in ranks.items()}
        self.children: list[dict[int, int]] = [{}]  # by node: byte -> node
        self.token_at: list[int] = [-1]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[int, int]] = {}  # the merge that makes each longer token
        for token, rank in ranks.items():
            ids, last = self.merge(token)
            if ids != [rank]:
                continue  # unreachable by merges; only a piece equal to it gets it
            if last:
                self.made[rank] = last
            node = ROOT
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.children.append({})
                node = nxt
            self.token_at[node] = rank
        self.clear()

    def merge(self, piece: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """Plain merging by lowest rank, for single tokens only: the ids, and the last pair merged."""
        parts = [piece[k:k + 1] for k in range(len(piece))]
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            last = (self.ranks[parts[at]], self.ranks[parts[at + 1]])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], last

    def joins(self, a: int, b: int) -> bool:
        """Whether the pair of tokens encodes to itself.

        Merges happen in the order of rank.  Undo them from the latest on, on the side of the
        boundary that was made last: if the parts that then touch would have merged earlier
        than what was undone, the boundary would not have survived.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._touch(a, b)
        return known

    def _touch(self, left: int, right: int) -> bool:
        spelling, ranks, made = self.spelling, self.ranks, self.made
        until = None  # rank of the merge undone last; on a tie the left one comes first
        strict = True
        while True:
            both = ranks.get(spelling[left] + spelling[right])
            if both is not None and (until is None or both < until or (both == until and not strict)):
                return False
            of_left, of_right = made.get(left), made.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                until, strict, left = left, True, of_left[1]
            else:
                until, strict, right = right, False, of_right[0]

    def clear(self) -> None:
        start = (-1, (((), ROOT),))
        self.states = [start]
        self.index = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state << 8 | byte
        self.rest: list[tuple[int, ...]] = [()]
        self.met: set[int] = set()  # transitions met once: only the second time makes a state of it

    def step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The determinised transition, made on first use: next state and tokens emitted."""
        last, hypotheses = self.states[at]
        alive, done = [], None
        for pending, node in hypotheses:  # by start, the earliest first
            child = self.children[node].get(byte)
            if child is None:
                continue
            alive.append((pending, child))
            token = self.token_at[child]
            if token >= 0 and done is None:
                before = pending[-1] if pending else last
                if before < 0 or self.joins(before, token):
                    done = pending + (token,)
        alive.append((done, ROOT))  # each prefix has one encoding
        shortest = min([len(p) for p, _ in alive])
        agreed = 0
        while agreed < shortest and all([p[agreed] == done[agreed] for p, _ in alive]):
            agreed += 1
        out = done[:agreed]
        state = (out[-1], tuple([(p[agreed:], n) for p, n in alive])) if agreed else (last, tuple(alive))
        to = self.index.get(state)
        if to is None:
            to = self.index[state] = len(self.states)
            self.states.append(state)
            self.rest.append(done[agreed:])
        move = self.moves[at << 8 | byte] = (to, out)
        return move

    def finish(self, at: int, rest: bytes) -> list[int]:
        """The tokens for the rest of a piece, by the hypotheses alone, without new states.

        What all hypotheses agree on is given out whenever ``HELD_BACK`` tokens have gathered, so each byte costs the
        same however long the piece is.
        """
        last, alive = self.states[at]
        children, token_at, pairs, joins = self.children, self.token_at, self.pairs, self.joins
        out: list[int] = []
        for byte in rest:
            on, done = [], None
            for pending, node in alive:
                child = children[node].get(byte)
                if child is not None:
                    on.append((pending, child))
                    if done is None:
                        token = token_at[child]
                        if token >= 0:
                            before = pending[-1] if pending else last
                            if before >= 0:
                                good = pairs.get((before, token))
                                if good is None:
                                    good = joins(before, token)
                            if before < 0 or good:
                                done = (*pending, token)
            on.append((done, ROOT))
            alive = on
            if len(done) >= HELD_BACK:
                agreed, shortest = 0, min([len(p) for p, _ in alive])
                while agreed < shortest and all([p[agreed] == done[agreed] for p, _ in alive]):
                    agreed += 1
                if agreed:
                    out += done[:agreed]
                    last = done[agreed - 1]
                    alive = [(p[agreed:], n) for p, n in alive]
        out += alive[-1][0]
        return out

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES or len(self.met) > 4 * MAX_STATES:
            self.clear()
        ids: list[int] = []
        at, moves, met = 0, self.moves, self.met
        for k, byte in enumerate(piece):
            key = at << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in met:
                    met.add(key)
                    ids += self.finish(at, piece[k:])
                    return ids
                move = self.step(at, byte)
            at, out = move
            if out:
                ids += out
        ids += self.rest[at]
        return ids


class _Packed(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers, through the transducer.

    Two generations: when the younger is full it becomes the older one, which is asked
    before a piece is encoded anew; so frequent pieces stay.
    """

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = array("I", self.fst.encode(piece.encode("utf-8", "surrogatepass")))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Utf8Stream:
    """Incremental decoder: feed token ids one by one, get the characters they complete."""

    def __init__(self, spelling: dict[int, bytes]):
        self.spelling = spelling
        self.table: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.entries = 0

    def move(self, pending: bytes, token: int) -> tuple[str, bytes]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        machine.setstate((pending, 0))
        text = machine.decode(self.spelling[token])
        found = (text, machine.getstate()[0])
        self.entries += 1
        if self.entries > MAX_DECODE_ENTRIES:
            self.table, self.entries = {b"": {}}, 1
        self.table.setdefault(pending, {})[token] = found
        return found

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        pending = b""
        for token in ids:
            row = self.table.get(pending)
            found = row.get(token) if row is not None else None
            text, pending = found or self.move(pending, token)
            yield text
        if pending:
            yield "�"


def coder(content: bytes) -> tuple[Transducer, _Packed, Utf8Stream]:
    """The coder of a rank file, made once per worker process."""
    import hashlib

    def make():
        fst = Transducer(parse_ranks(content))
        return fst, _Packed(fst), Utf8Stream(fst.spelling)
    return kept_by_worker(__name__, hashlib.sha256(content).digest(), make)


def shipped_ranks(spark: SparkSession, path: str):
    """A rank file as a broadcast variable: a vocabulary of fixed size, under 1 MB here."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def pack(texts: list[str | None], pieces, packed: _Packed) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    return [b"".join(map(packed.__getitem__, pieces.findall(t or ""))) for t in texts]


def unpack(rows: list[bytes | None], stream: Utf8Stream) -> list[str]:
    """The texts that packed ids spell."""
    out = []
    for raw in rows:
        ids = array("I", raw or b"")
        if sys.byteorder == "big":
            ids.byteswap()
        out.append("".join(stream.decode(ids)))
    return out


def encode(docs: DataFrame, ranks, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and ``keep``), n_tokens and ids (little-endian unsigned 32-bit integers)."""
    def make():
        import regex

        pieces, packed = regex.compile(pattern), coder(ranks.value)[1]

        def apply(texts):
            ids = pack(texts, pieces, packed)
            return [len(x) // 4 for x in ids], ids
        return apply
    return map_texts(docs, make, "n_tokens bigint, ids binary", keep or ["doc_id"])


def decode(encoded: DataFrame, ranks, keep: list[str]) -> DataFrame:
    """``keep`` and the text that the ids spell, through the streaming machine."""
    def make():
        stream = coder(ranks.value)[2]
        return lambda rows: [unpack(rows, stream)]
    return map_texts(encoded, make, "decoded string", keep, text="ids")


def round_trip(docs: DataFrame, ranks, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Encoded ids and the text decoded from them, in one worker per task."""
    def make():
        import regex

        pieces = regex.compile(pattern)
        _, packed, stream = coder(ranks.value)

        def apply(texts):
            ids = pack(texts, pieces, packed)
            return [len(x) // 4 for x in ids], ids, unpack(ids, stream)
        return apply
    return map_texts(docs, make, "n_tokens bigint, ids binary, decoded string", keep or ["doc_id"])


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoded and decoded again: token count and the digests of both."""
    both = round_trip(docs, shipped_ranks(docs.sparkSession, path), pattern)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
