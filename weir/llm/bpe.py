"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are walked as a trie: sorted, so that a depth-first walk visits every shared prefix once.
Each node keeps one state, the last token of the encoding of the bytes down to it. The state of a node follows from those
above it: it is the one vocabulary entry that ends there and may stand after the last token of the node where it starts.
Two tokens may stand side by side if merging their joined bytes gives just these two again; a list of tokens is the
encoding of its bytes if and only if all its neighbours may. Walking the states back gives a word's tokens.

Null and empty texts have no tokens. Rows, ties and repeated rows are handled each on its own; other columns pass through, but for those named
as the new ones, in any case, which are replaced.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE_BYTES, added, column, slices, texts_of, with_columns

#: Fixed value: the published pattern that splits text into words before the merges of this family of vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: So many last bytes of a node tell which entries may end there.
_ENDING = 4
#: Entries that may end at a node: length, id (-1: more bytes decide) and which tokens it may follow.
Ends = tuple[tuple[int, int, dict[int, bool]], ...]
#: About so many bytes of memory go with a pair, an ending and a chunk that are kept; longer chunks (in characters) are not.
_PAIR_BYTES, _END_BYTES, _CHUNK_BYTES, LONGEST_KEPT = 60, 400, 300, 64
#: Texts taken at a time, unless their bytes bound them first: the more words at once, the more prefixes they share.
ROWS = 1536
#: Signs that are no letters, numbers or white space, and no apostrophe.
_SIGNS = frozenset(".,;:!?)")
#: Where other white space is, or blanks and line ends meet, splitting at these is not enough.
_OTHER_SPACE, _MEETING = re.compile(r"[^\S \n]"), ("  ", " \n", "\n ", "\n\n")


def _byte_alphabet() -> dict[str, int]:
    """Character for byte, as byte-level vocabularies write them: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    """The vocabulary and merges of a byte-level BPE tokenizer file, and what is known of it and of the chunks of text met so far.

    What is kept of texts is bounded by ``keep`` bytes: chunks with their tokens, endings with their entries, and pairs. Chunks
    longer than ``LONGEST_KEPT`` are never kept, so neither many nor long ones can fill a worker.
    """

    def __init__(self, path: str, keep: int = 48 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        raw = {name: bytes(alphabet[c] for c in name) for name in vocab}
        self.id_of = {raw[name]: i for name, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for name, i in vocab.items():
            self.bytes_of[i] = raw[name]
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.long_ends: dict[bytes, list[int]] = {}
        for n, end in sorted({(len(x), x[-_ENDING:]) for x in self.id_of if len(x) > _ENDING}, reverse=True):
            self.long_ends.setdefault(end, []).append(n)
        # the rank at which two tokens merge, and the pair that an entry is merged from (its first merge)
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at = [-1] * size
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            both = vocab[a + b]
            self.rank[vocab[a], vocab[b]] = rank
            if both not in self.halves:
                self.halves[both], self.made_at[both] = (vocab[a], vocab[b]), rank
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = [self._is_whole(t) for t in range(size)]
        self.follows: list[dict[int, bool]] = [{} for _ in range(size)]
        self.ending: dict[bytes, Ends] = {}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.max_pairs, self.max_ends, self.max_chunk_bytes = keep // 4 // _PAIR_BYTES, keep // 4 // _END_BYTES, keep // 2
        self.n_pairs = self.chunk_bytes = 0
        line_end = self.id_of[b"\n"]
        self.line_end = (self._packed([line_end]), self.bytes_of[line_end])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _is_whole(self, t: int) -> bool:
        """Merging the bytes of the entry gives the entry: it is a byte, or its halves are whole and may stand side by side but for their own merge."""
        if t not in self.halves:
            return len(self.bytes_of[t]) == 1
        a, b = self.halves[t]
        return self._stay_apart(a, b, self.made_at[t])

    def _stay_apart(self, a: int, b: int, until: int) -> bool:
        """No merge of a rank below ``until`` joins the bytes of two whole tokens across their border.

        What stands left and right of the border before a merge is undone step by step: the later of the two merges that made
        the tokens is taken back, which leaves its half at the border, and only merges earlier than it can have come first.
        """
        made, halves, rank = self.made_at, self.halves, self.rank.get
        while True:
            if (r := rank((a, b))) is not None and r < until:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:
                until, a = made[a], halves[a][1]
            else:
                # of equal merges the left one is done first, so one across the border is before b's own of the same rank
                until, b = made[b] + 1, halves[b][0]

    def _may_follow(self, a: int, b: int) -> bool:
        if self.n_pairs >= self.max_pairs:
            for known in self.follows:
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.follows[b][a] = self._stay_apart(a, b, 1 << 60)
        return known

    def _ends(self, end: bytes) -> Ends:
        """Length, id and known predecessors of the entries that may end with these last bytes, longest first; id -1 if more bytes decide."""
        if len(self.ending) >= self.max_ends:
            self.ending.clear()
        long = [(n, -1, {}) for n in self.long_ends.get(end, ())]
        short = [(len(end) - k, t, self.follows[t]) for k in range(len(end)) if (t := self.id_of.get(end[k:])) is not None and self.whole[t]]
        known = self.ending[end] = (*long, *short)
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Each distinct word's tokens."""
        out: dict[bytes, list[int]] = {}
        last: list[int] = []  # by node from the root down to the current one
        above = b""
        id_of, ending, follows, whole, bytes_of = self.id_of, self.ending, self.follows, self.whole, self.bytes_of
        for w in sorted(set(words)):
            shared, most = 0, min(len(above), len(w))
            if above[:most] == w[:most]:
                shared = most
            else:
                while above[shared] == w[shared]:
                    shared += 1
            del last[shared:]
            for end in range(shared + 1, len(w) + 1):
                tail = w[end - _ENDING : end] if end > _ENDING else w[:end]
                for n, t, known in ending.get(tail) or self._ends(tail):
                    start = end - n
                    if t < 0:
                        if start < 0 or (t := id_of.get(w[start:end], -1)) < 0 or not whole[t]:
                            continue
                        known = follows[t]
                    if not start:
                        last.append(t)
                        break
                    if (ok := known.get(last[start - 1])) is None:
                        ok = self._may_follow(last[start - 1], t)
                    if ok:
                        last.append(t)
                        break
            ids, end = [], len(w)
            while end:
                t = last[end - 1]
                ids.append(t)
                end -= len(bytes_of[t])
            ids.reverse()
            out[w] = ids
            above = w
        return out

    def _learn(self, chunks: Iterable[str]) -> list[tuple[bytes, bytes]]:
        """Packed tokens, and the bytes that these stand for, of distinct chunks: each is encoded, and its tokens decoded, once.

        A chunk that starts with a line end is this and what starts a line; any other comes after a blank.
        """
        out: list[tuple[bytes, bytes] | None] = [self.chunks.get(c) for c in chunks]
        parts: list[tuple[int, str, list[bytes]]] = []
        for k, c in enumerate(chunks):
            if out[k] is None:
                own = c[1:] if c[:1] == "\n" else " " + c
                # most chunks are letters, with a sign behind them or not: what the pattern would cut is plain then
                if c.isalpha():
                    parts.append((k, c, [own.encode()]))
                elif c[-1:] in _SIGNS and c[:-1].isalpha():
                    parts.append((k, c, [own[:-1].encode(), c[-1].encode()]))
                else:
                    parts.append((k, c, [x.encode() for x in SPLIT.findall(own)]))
        done = self.encode_words(x for _, _, xs in parts for x in xs)
        bytes_of, (end_ids, end_raw) = self.bytes_of, self.line_end
        packed = {x: (self._packed(ids), b"".join([bytes_of[t] for t in ids])) for x, ids in done.items()}
        for k, c, xs in parts:
            made = packed[xs[0]] if len(xs) == 1 else (b"".join([packed[x][0] for x in xs]), b"".join([packed[x][1] for x in xs]))
            out[k] = made = (end_ids + made[0], end_raw + made[1]) if c[:1] == "\n" else made
            if len(c) <= LONGEST_KEPT:
                self.chunk_bytes += _CHUNK_BYTES + len(c) + len(made[0]) + len(made[1])
                self.chunks[c] = made
                if self.chunk_bytes > self.max_chunk_bytes:
                    self.chunks.clear()
                    self.chunk_bytes = 0
        return out

    def _unevenly(self, text: str) -> tuple[bytes, bytes]:
        """The same for a text that blanks and line ends alone don't cut, or that holds special tokens."""
        made: list[tuple[bytes, bytes]] = []
        for part in self.special_at.split(text) if self.special_at else [text]:
            if part in self.special:
                t = self.special[part]
                made.append((self._packed([t]), self.bytes_of[t]))
            else:
                words = SPLIT.findall(part)
                distinct = list(dict.fromkeys(words))
                # a word with a blank in front is a chunk; any other stands at the start of a line for this purpose
                known = dict(zip(distinct, self._learn([w[1:] if w[:1] == " " and len(w) > 1 and not w[1].isspace() else "\n" + w for w in distinct])))
                cut = {w: x if w[:1] == " " and len(w) > 1 and not w[1].isspace() else (x[0][4:], x[1][1:]) for w, x in known.items()}
                made.extend(map(cut.__getitem__, words))
        return b"".join([x[0] for x in made]), b"".join([x[1] for x in made])

    def round_trip(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Each text's tokens, packed, and the bytes that these stand for.

        Texts are cut at blanks and before line ends, which no word crosses, and the distinct chunks numbered; a text is the
        sequence of its chunks' tokens. A line end put in front of each text makes its first chunk like any other.
        """
        other, uneven = _OTHER_SPACE.search, (*_MEETING, *self.special)
        even = [not (any(x in t for x in uneven) or other(t)) for t in texts]
        lead = pa.array(["\n" + t if e else "" for t, e in zip(texts, even)], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(lead, "\n", " \n"), " ")
        coded = pc.dictionary_encode(cut.flatten())
        made = self._learn(coded.dictionary.to_pylist())
        ids_of, raw_of = [x[0] for x in made], [x[1] for x in made]
        codes, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()
        ids, raw = [], []
        for k, t in enumerate(texts):
            if even[k]:
                own = codes[ends[k] + 1 : ends[k + 1]].tolist()
                ids.append(b"".join([ids_of[c] for c in own])[4:])
                raw.append(b"".join([raw_of[c] for c in own])[1:])
            else:
                x, y = self._unevenly(t)
                ids.append(x)
                raw.append(y)
        return ids, raw

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.round_trip(texts)[0]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> TrieBpe:
    """One per worker process and file."""
    return TrieBpe(path)


def _mapped(df: DataFrame, fields: list[tuple[str, T.DataType]], drop: list[str], make: Callable[[pa.RecordBatch], dict[str, pa.Array]], rows: int, size: int = SLICE_BYTES) -> DataFrame:
    schema = added(df.schema, *fields, drop=drop)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows, size):
            yield with_columns(b, arrow, make(b))

    return df.mapInArrow(run, schema)


def _strings(raw: list[bytes]) -> pa.Array:
    """UTF-8 as strings; bytes that are none become U+FFFD."""
    try:
        return pa.array(raw, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """Adds ``ids``: the tokens of the whole text as packed little-endian unsigned 32-bit integers (binary; empty for null).

    ``tokenizer`` is the path of a byte-level BPE file; every executor must have it. A column already named ``ids`` is replaced,
    whatever its case.
    """
    return _mapped(df, [(ids, T.BinaryType())], [text] if drop_text else [], lambda b: {ids: pa.array(load(tokenizer).encode(texts_of(column(b, text))), pa.binary())}, ROWS)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the packed tokens ``ids`` stand for ('' for null); bytes that are no UTF-8 become U+FFFD."""
    return _mapped(df, [(text, T.StringType())], [], lambda b: {text: pa.array([load(tokenizer).decode(x or b"") for x in column(b, ids).to_pylist()], pa.string())}, ROWS)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", drop_text: bool = False, rows: int = ROWS, size: int = SLICE_BYTES) -> DataFrame:
    """``encode`` and ``decode`` in one pass: the tokens of each distinct word are decoded along with its encoding.

    ``rows`` and ``size`` (bytes) bound the texts taken at a time: more share more, and take more memory.
    """

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        packed, raw = load(tokenizer).round_trip(texts_of(column(b, text)))
        return {ids: pa.array(packed, pa.binary()), decoded: _strings(raw)}

    return _mapped(df, [(ids, T.BinaryType()), (decoded, T.StringType())], [text] if drop_text else [], make, rows, size)
