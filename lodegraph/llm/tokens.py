"""Encoding whole corpora with a public byte-level BPE tokenizer, as a streaming transducer.

A text is fed in blocks. Two facts make tokens stable before the text ends:

* A pre-token never spans certain places: before white space that follows something else, and between letters, digits and
  other signs (but after an apostrophe, where contractions are cut by their own rule). What stands left of the last such
  place in the buffer is encoded and emitted.
* Within one endless pre-token the encoding of each prefix is that of a shorter prefix plus one token: the one whose pair with
  the token before it is stable under the merges. A later token starts at most L bytes before the end of what was read, L being
  the longest token: that is the merge list's sufficient lookahead. So the tokens that all prefixes of the last L bytes have in
  common are stable and are emitted, and memory stays constant.

Null and empty texts have the defined result: an empty list of ids. Rows are not merged: repeated rows come out repeatedly."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import spread
from .common import small_batches

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 10
_PLACE = regex.compile(r"(?<=\P{White_Space})\p{White_Space}|(?<=\p{L})[^\p{L}]|(?<=\p{N})[^\p{N}]|(?<=[^\p{White_Space}\p{L}\p{N}'])[\p{L}\p{N}]", regex.REVERSE)
_PRETOKEN = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_SPACE = regex.compile(r"\p{White_Space}")
_RUNS = [(regex.compile(f"[{x}]"), regex.compile(f"[^{x}]")) for x in (r"\p{L}", r"\p{N}", r"\p{White_Space}")]
_RUNS.append((regex.compile("."), regex.compile(r"[\p{L}\p{N}\p{White_Space}]")))


class Vocabulary:
    def __init__(self, path: str = DEFAULT_TOKENIZER) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.suffixes = {t[i:] for t in self.ranks for i in range(len(t))}
        self.fast = tiktoken.Encoding("lodegraph", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        key = (before, token)
        if key not in self._pairs:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            want = [self.ranks[t] for t in key if t]
            self._pairs[key] = list(self.fast._encode_single_piece(before + token)) == want
        return self._pairs[key]


@lru_cache(maxsize=4)
def vocabulary(path: str = DEFAULT_TOKENIZER) -> Vocabulary:
    return Vocabulary(path)


class PieceStream:
    """The tokens of one pre-token whose bytes come bit by bit."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.v, self.held, self.base = vocab, bytearray(), 0
        self.back = [0]  # for each prefix of what is held: the length of its last token; 0 at the start
        self.first = b""  # the token before what is held

    def feed(self, data: bytes) -> list[int]:
        v, held, back = self.v, self.held, self.back
        for byte in data:
            held.append(byte)
            p = len(held)
            most, sizes, n = min(v.longest, p), [], 1
            tail = bytes(held[p - most :])
            while n <= most and (end := tail[most - n :]) in v.suffixes:  # no longer token ends here once this is no token's end
                if end in v.ranks and (back[p - n] or p == n):
                    sizes.append(n)
                n += 1
            for n in reversed(sizes):
                q = p - n
                before = bytes(held[q - back[q] : q]) if q else self.first
                if v.follows(before, tail[most - n :]):
                    back.append(n)
                    break
            else:
                back.append(0)  # no prefix of the text ends its tokens here
        return self._emit() if len(held) >= 4 * v.longest else []

    def _emit(self) -> list[int]:
        """Emits what all prefixes that a later token may follow have in common."""
        p = len(self.held)
        live = {q for q in range(max(0, p - self.v.longest), p + 1) if q == 0 or self.back[q]}
        while len(live) > 1:
            q = max(live)
            live.remove(q)
            live.add(q - self.back[q])
        (common,) = live
        out = self._tokens(common)
        if common:
            self.first = bytes(self.held[common - self.back[common] : common])
            del self.held[:common]
            self.back = [0, *self.back[common + 1 :]]
        return out

    def _tokens(self, p: int) -> list[int]:
        out = []
        while p > 0:
            out.append(self.v.ranks[bytes(self.held[p - self.back[p] : p])])
            p -= self.back[p]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._tokens(len(self.held))
        self.__init__(self.v)
        return out


class StreamEncoder:
    """feed(text) returns the ids that have become stable, finish() the rest."""

    def __init__(self, vocab: Vocabulary, block: int = BLOCK) -> None:
        self.v, self.block, self.buf = vocab, block, ""
        self.piece: PieceStream | None = None
        self.ends, self.white, self.skip = None, False, 0

    def feed(self, text: str) -> list[int]:
        self.buf += text
        out: list[int] = []
        while len(self.buf) > self.block:
            if self.piece is not None:
                out += self._inside(len(self.buf) - 1)
            elif m := _PLACE.search(self.buf):
                out += self.v.fast.encode_ordinary(self.buf[: m.start()])
                self.buf = self.buf[m.start() :]
            elif (m := _PRETOKEN.match(self.buf)).end() < len(self.buf) - 2:
                out += self.v.fast.encode_ordinary(m[0])
                self.buf = self.buf[m.end() :]
            else:
                self._begin(m[0])
        return out

    def _begin(self, start: str) -> None:
        self.piece, kind = PieceStream(self.v), start[-1]
        self.ends = next(other for one, other in _RUNS if one.match(kind))
        self.white, self.skip = bool(_SPACE.match(kind)), int(start[0] == " ")

    def _inside(self, limit: int) -> list[int]:
        """Streams an endless pre-token up to where it ends, or to ``limit``. The last white space before a word is not
        part of a run of white space."""
        m = self.ends.search(self.buf, self.skip)
        cut = m.start() - self.white if m else limit
        out = self.piece.feed(self.buf[:cut].encode())
        self.buf, self.skip = self.buf[cut:], 0
        if m:
            out += self.piece.finish()
            self.piece = None
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.piece is not None:
            out += self._inside(len(self.buf))
            if self.piece is not None:
                out += self.piece.finish()
                self.piece = None
        rest, self.buf = self.buf, ""
        return out + (self.v.fast.encode_ordinary(rest) if rest else [])


class StreamDecoder:
    """feed(ids) returns the text that has become whole; a character whose bytes come in several tokens waits for the last."""

    def __init__(self, vocab: Vocabulary, errors: str = "strict") -> None:
        self.v, self.state = vocab, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.v.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(text: str | None, vocab: Vocabulary, block: int = BLOCK) -> np.ndarray:
    """The ids of a text; of null and of the empty text none."""
    if not text:
        return np.empty(0, np.int32)
    s, out = StreamEncoder(vocab, block), []
    for i in range(0, len(text), block):
        out.append(np.array(s.feed(text[i : i + block]), np.int32))
    return np.concatenate([*out, np.array(s.finish(), np.int32)])


def _encoder(path: str, with_ids: bool, ids_at_once: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts, start, held, n = batch.column(batch.num_columns - 1), 0, [], 0
            for i in range(len(texts)):
                held.append(encode(texts[i].as_py(), vocab))
                n += len(held[-1])
                if n >= ids_at_once or i == len(texts) - 1:
                    sizes = np.fromiter(map(len, held), np.int32, len(held))
                    keys = [batch.column(k).slice(start, len(held)) for k in range(batch.num_columns - 1)]
                    if with_ids:
                        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                        last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))
                    else:
                        last = pa.array(sizes)
                    yield pa.RecordBatch.from_arrays([*keys, last], names=[*batch.schema.names[:-1], "ids" if with_ids else "n_tokens"])
                    start, held, n = i + 1, [], 0

    return run


def encode_corpus(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(keys..., ids array<int>): the ids of each row's text, without special tokens. No shuffle; other columns are not read."""
    small_batches(docs.sparkSession)
    df = spread(docs.select(*keys, text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(_encoder(tokenizer, True), f"{schema}, ids array<int>")


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(keys..., n_tokens int), as encode_corpus but with the number of ids only."""
    small_batches(docs.sparkSession)
    df = spread(docs.select(*keys, text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(_encoder(tokenizer, False), f"{schema}, n_tokens int")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            same = []
            for t in batch.column(batch.num_columns - 1):
                text, decoder = t.as_py() or "", StreamDecoder(vocab)
                ids = encode(text, vocab).tolist()
                back = [decoder.feed(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
                same.append("".join(back) + decoder.finish() == text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(same, pa.bool_())], names=[*batch.schema.names[:-1], "same"])

    return run


def round_trips(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(keys..., same): whether each text comes back from its ids through the decoder; a null text as the empty one."""
    small_batches(docs.sparkSession)
    df = spread(docs.select(*keys, text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(_round_trip(tokenizer), f"{schema}, same boolean")
