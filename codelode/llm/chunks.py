"""Texts cut where no tokenizer looks across, so that equal chunks are encoded once per batch."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from codelode.llm.hashing import text_bytes

#: Bytes of a text made of chunks, and how many such texts go to a library at a time: what it returns is far larger than the ids.
TEXT, FEW = 1 << 11, 1 << 6
#: Chunks longer than this are cut further where the vocabulary allows, into parts of about half of it.
LONG_CHUNK = 1 << 16

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Next-to-last bytes of white characters beyond ASCII and of the sign that pieces write for a space.
_DOUBT = np.zeros(256, bool)
_DOUBT[[0x80, 0x81, 0x96, 0x9A, 0xC2]] = True


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``limit`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that is not empty."""
    full = np.diff(offsets) > 0
    moved = offsets + np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(moved[-1]), 32, np.uint8)
    at = np.ones(len(out), bool)
    at[moved[:-1][full]] = False
    out[at] = data
    return out, moved


def cut(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and the rows' bounds among the chunks: before a separator byte that follows no white character.

    Splitters with white-space rules end a match before such a byte, and no piece of the vocabulary holds it after another character.
    """
    begins = np.zeros(len(data), bool)
    if len(data) > 1:
        doubt = np.zeros(len(data), bool)
        doubt[2:] = (data[1:-1] >= 128) & _DOUBT[data[:-2]]
        begins[1:] = separators[data[1:]] & ~_WHITE[data[:-1]] & ~doubt[1:]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each chunk's text among the distinct ones, and those texts."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = texts.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def flat(encode: Callable[[list[str]], list[list[int]]], size: np.ndarray, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the chunks in order, and how many each has; ``size`` says how many bytes an id stands for.

    Chunks that may stand next to each other go as one text of about ``TEXT`` bytes, whose ids are dealt to them by bytes.  Where the
    bytes do not add up to the chunks, those are encoded one by one.
    """
    data, offsets = text_bytes(chunks)
    if not len(chunks):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    last, ends = offsets[1:] - 1, offsets[1:]
    before = data[np.maximum(last - 1, 0)]
    closed = ~_WHITE[data[last]] & ~((data[last] >= 128) & _DOUBT[before])
    opens = _WHITE[data[offsets[:-1]]]
    firsts = np.append(True, ~closed[:-1] | ~opens[1:] | (np.diff(offsets[:-1] // TEXT) != 0))
    firsts = np.append(np.flatnonzero(firsts), len(chunks))
    raw, ids, reached = data.tobytes(), [], []
    for low in range(0, len(firsts) - 1, FEW):
        some = firsts[low : low + FEW + 1].tolist()
        texts = [raw[offsets[x] : offsets[y]].decode() for x, y in zip(some, some[1:])]
        for x, y, coded in zip(some, some[1:], encode(texts)):
            coded = np.array(coded, np.int32)
            at = offsets[x] + np.cumsum(size[coded])
            hit = np.minimum(np.searchsorted(at, ends[x:y]), max(0, len(at) - 1))
            if not len(at) or at[-1] != offsets[y] or (at[hit] != ends[x:y]).any():
                single = [np.array(c, np.int32) for c in encode([raw[offsets[k] : offsets[k + 1]].decode() for k in range(x, y)])]
                coded, at = np.concatenate(single), np.repeat(ends[x:y], [len(c) for c in single])
            ids.append(coded)
            reached.append(at)
    counts = np.diff(np.searchsorted(np.concatenate(reached), ends, "right"), prepend=0)
    return np.concatenate(ids), counts


def give_back() -> None:
    """Return freed memory to the machine; between blocks, since large arrays leave holes that a worker would keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


class Bytes:
    """Byte-level pair encoding from a ``.json`` file of ``tokenizers``."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        first = said.get("pre_tokenizer") or {}
        added = [t["content"] for t in said.get("added_tokens", [])]
        #: White space ends a word here; other rules than this one are not cut at all.
        self.divides = (
            said.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
            and not first.get("add_prefix_space") and not any(c.isspace() for t in added for c in t)
        )
        self.separators = np.zeros(256, bool)
        self.separators[[9, 10, 11, 12, 13, 32]] = self.divides

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def counts(self, chunks: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def token_bytes(self) -> list[bytes]:
        """What each id stands for; the byte alphabet prints a byte as itself where that is visible, else from U+0100 on."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in visible}
        letter.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))})
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        out = []
        for i in range(size):
            token = self.tokenizer.id_to_token(i) or ""
            out.append(bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode())
        return out


class Pieces:
    """Sentence pieces from a ``.model`` file; a chunk starts with the space that the library puts before a text, or with another separator."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.raw = {i: self.model.is_byte(i) for i in ids}
        self.pieces = [self.model.id_to_piece(i) for i in ids]
        inner: set[tuple[str, str]] = set()
        for i in ids:
            if not self.raw[i] and not self.model.is_control(i) and not self.model.is_unknown(i):
                inner.update(zip(self.pieces[i], self.pieces[i][1:]))
        self.pairs = np.array(sorted(ord(a) << 32 | ord(b) for a, b in inner), np.int64)
        #: Tokens may not be cut where they would look across; only identity models without odd settings are cut.
        self.divides = self.model.encode("a  b", out_type=str)[0].startswith("▁") and self.model.decode(self.model.encode("a  b\n")) == "a  b\n"
        self.separators = np.zeros(256, bool)
        self.separators[32] = self.divides and not any(b == "▁" and a != "▁" for a, b in inner)
        for byte in (9, 10, 11, 12, 13):
            self.separators[byte] = self.divides and not any(chr(byte) in p for p in inner)
        #: What stands between two texts without touching either.
        self.fence = "\n" if self.separators[10] else ""

    def _parts(self, chunk: str) -> list[str]:
        """A long chunk cut between characters that no piece holds next to each other."""
        points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.int64)
        free = np.flatnonzero(~np.isin(points[:-1] << 32 | points[1:], self.pairs) & (points[:-1] != 32) & (points[1:] != 32)) + 1
        parts, low = [], 0
        while low < len(chunk):
            at = int(np.searchsorted(free, low + LONG_CHUNK // 2))
            high = int(free[at]) if at < len(free) else len(chunk)
            parts.append(chunk[low:high])
            low = high
        return parts

    def encode(self, chunks: list[str]) -> list[list[int]]:
        # The library puts a space first: one that is there is taken away, else a fence keeps it apart (two tokens, skipped).
        bare = [len(c) > 1 and c[0] == " " for c in chunks]
        long = [k for k, c in enumerate(chunks) if len(c) > LONG_CHUNK and self.fence]
        texts = [c[1:] if b else self.fence + c for c, b in zip(chunks, bare)]
        for k in long:
            texts[k] = ""
        out = [ids if b else ids[2:] for ids, b in zip(self.model.encode(texts, num_threads=1), bare)]
        for k in long:
            parts = self._parts(chunks[k])
            head = bare[k]
            texts = [parts[0][1:] if head else self.fence + parts[0], *[self.fence + p for p in parts[1:]]]
            coded = self.model.encode(texts, num_threads=1)
            out[k] = [i for n, ids in enumerate(coded) for i in ids[0 if head and not n else 2 :]]
        return out

    def counts(self, chunks: list[str]) -> list[int]:
        return [len(ids) for ids in self.encode(chunks)]

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.raw[i] else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


def counter(path: str) -> tuple[Callable[[list[str]], list[int]], np.ndarray, bool]:
    """How to count tokens as the file's library does by default, where texts may be cut, and whether they get a space first."""
    if path.endswith(".model"):
        pieces = Pieces(path)
        if pieces.divides:
            return pieces.counts, pieces.separators, True
        return lambda texts: [len(t) for t in pieces.model.encode(texts, num_threads=1)], np.zeros(256, bool), False
    whole = Bytes(path, plain_specials=False)
    return whole.counts, whole.separators, False
