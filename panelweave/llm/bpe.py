"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A byte-level tokenizer splits a text by a pattern, maps the bytes of each piece to printable
characters and merges those. Pieces are independent of each other, so each worker merges a piece
once: the text of a batch is cut into pieces with NumPy, pieces that the worker knows are looked up,
and only new ones go through the tokenizers library. The characters' classes (letter, number,
space) come from the engine whose results count, once, on the driver; ``Vocabulary`` with them is
broadcast (its file is refused beyond ``MAX_VOCABULARY`` bytes).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import record_batch, slices

#: The pattern that GPT-2's published vocabulary is used with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same, as it is also written.
SHORT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY = 64 << 20
#: Bytes of text that a worker cuts into pieces at a time (a longer text is cut alone).
PIECE_BYTES = 2 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for
    themselves, the others, in order, for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token, in the order of ranks: what is left of the token's bytes
    when all merges of lower rank are done is its two parts."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i, (x, y) in enumerate(pairwise(parts)) if (r := ranks.get(x + y, rank)) < rank]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizers JSON (of a rank file: without added tokens), and the class of each code point."""

    model: str
    classes: bytes

    @classmethod
    def from_ranks(cls, path: str, pattern: str = PATTERN) -> Vocabulary:
        """A tiktoken rank file; classes as tiktoken's own pattern engine has them. Another ``pattern``
        than the one that ``cuts`` follows is refused."""
        import tiktoken

        if pattern not in (PATTERN, SHORT_PATTERN):
            raise ValueError(f"texts are not cut by {pattern}")

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _file(path).splitlines())}
        chars = byte_characters()
        name = lambda b: "".join(chars[x] for x in b)
        model = {"type": "BPE", "vocab": {name(b): r for b, r in ranks.items()}, "merges": [[name(x), name(y)] for x, y in _merges(ranks)]}
        single = {bytes([i]): i for i in range(256)}

        def members(pattern: str) -> str:
            e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            return bytes(e.encode_ordinary(_every_character())).decode()

        return cls(_json(model), _classes(members))

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizers JSON of the byte-level kind; classes as the tokenizers library has them.

        Its added tokens are kept: the library finds them in a text whatever ``add_special_tokens`` is.
        Those that take in blanks, only match whole words or normalized text are refused."""
        from tokenizers import Regex, pre_tokenizers

        def members(pattern: str) -> str:
            split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            return "".join(x for x, _ in split.pre_tokenize_str(_every_character()))

        whole = json.loads(_file(path))
        if not _plain(whole):
            raise ValueError(f"{path} does not cut texts by the byte-level pattern alone")
        added = whole.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has an added token that is not matched literally")
        return cls(_json(whole["model"], added), _classes(members))

    @cached_property
    def tokens(self) -> list[bytes]:
        """Bytes of each id, the characters mapped back."""
        back = {c: b for b, c in enumerate(byte_characters())}
        whole = json.loads(self.model)
        vocab, added = whole["model"]["vocab"], {t["id"]: t["content"] for t in whole["added_tokens"]}
        out = [b""] * (max([*vocab.values(), *added], default=-1) + 1)
        for t, i in vocab.items():
            out[i] = bytes(back[c] for c in t)
        for i, t in added.items():
            out[i] = t.encode()
        return out


def _plain(whole: dict) -> bool:
    """Whether a tokenizers JSON cuts texts as ``cuts`` does: the byte-level pattern, nothing before it."""
    pre = whole.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(byte_level) and not whole.get("normalizer")


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return data


def _json(model: dict, added: list[dict] | None = None) -> str:
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added or [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}, "model": model})


def _every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _classes(members) -> bytes:
    table = np.zeros(0x110000, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        table[np.frombuffer(members(pattern).encode("utf-32-le"), np.uint32)] = code
    return table.tobytes()


def cuts(codes: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces begin in ``codes`` (code points of texts laid end to end, which
    begin at ``starts``)."""
    n = len(codes)
    cls = classes[codes]
    first = np.zeros(n, bool)  # of a text
    first[starts[starts < n]] = True
    run = first.copy()  # of a run of one class
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    last = np.ones(n, bool)
    last[:-1] = run[1:]  # of its run
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]  # of its text
    cut = run
    # the last space of a run goes its own way if something other follows in the text
    tail = space & last & ~ends
    cut = cut | tail
    # a blank in that place opens the next piece instead
    blank = np.flatnonzero(tail & (codes == 32))
    cut[blank + 1] = False
    # 's 't 'm 'd 're 've 'll where a piece begins at the apostrophe
    at = np.flatnonzero((codes == 39) & cut)
    at = at[at + 1 < n]
    if len(at):
        at = at[~first[at + 1]]
        one = codes[at + 1]
        two = np.where((at + 2 < n) & ~first[np.minimum(at + 2, n - 1)], codes[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit, size = at[short | long], np.where(short, 2, 3)[short | long]
        cut[hit + 1] = False
        after = hit + size
        # what follows is a new piece, unless it is one already
        cut[after[after < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts; keeps the ids of pieces as little-endian uint32, in two
    generations of up to ``limit`` pieces each."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.model)
        self.model = self.tokenizer.model
        self.classes = np.frombuffer(vocabulary.classes, np.uint8)
        self.characters = str.maketrans(dict(enumerate(byte_characters())))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # the longest of those that begin at one place
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Pieces of all texts, and the number of pieces before each text and after the last."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        at = cuts(codes, starts, self.classes)
        bounds = [*at.tolist(), len(codes)]
        return [whole[i:j] for i, j in pairwise(bounds)], [*np.searchsorted(at, starts).tolist(), len(at)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian uint32."""
        texts = [t or "" for t in texts]
        if not self.split:
            return self._ordinary(texts)
        # what lies between added tokens is a text of its own; every second part is an added token
        parts = [self.split(t) for t in texts]
        ids = iter(self._ordinary([x for p in parts for x in p[::2]]))
        return [b"".join(array("I", [self.added[x]]).tobytes() if i % 2 else next(ids) for i, x in enumerate(p)) for p in parts]

    def _ordinary(self, texts: list[str]) -> list[bytes]:
        pieces, at = self.pieces(texts)
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older, tokenize, characters = self.known, self.older, self.model.tokenize, self.characters
        for p in set(pieces).difference(known):
            if (e := older.get(p)) is None:
                mapped = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(characters)
                e = array("I", [t.id for t in tokenize(mapped)]).tobytes()
            known[p] = e
        got = list(map(known.__getitem__, pieces))
        return [b"".join(got[i:j]) for i, j in pairwise(at)]

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """Code points ``[start, end)`` that each id of a text touches; an id that holds part of a
        character's bytes has that whole character."""
        out: list[tuple[int, int]] = []
        place = 0
        for i, part in enumerate(self.split(text) if text and self.split else [text or ""]):
            if i % 2:
                out.append((place, place + len(part)))
                place += len(part)
                continue
            pieces, _ = self.pieces([part])
            for p, e in zip(pieces, self.tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True):
                out += [(place + i, place + j) for i, j in e.offsets]
                place += len(p)
        return out


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes of ids; a character split over ids is whole again as bytes are joined first."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def _worker(value: Vocabulary, cache: dict = {}) -> Encoder:  # noqa: B006  one encoder for each worker and vocabulary
    key = hashlib.sha1(value.model.encode()).digest()
    if key not in cache:
        cache.clear()
        cache[key] = Encoder(value)
    return cache[key]


_ENCODED = pa.schema([("ids", pa.binary())])


def with_ids(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (columns ``doc_id, text``) -> ``doc_id, n_tokens, ids, decoded`` with ids as
    ``array<int>`` and decoded as binary. Null and empty texts have no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        encoder, tokens = _worker(shared.value), shared.value.tokens
        for batch in slices(batches, PIECE_BYTES):
            ids = [np.frombuffer(x, "<u4") for x in encoder(batch.column(1).to_pylist())]
            yield record_batch(schema, doc_id=batch.column(0).cast(pa.int64()), n_tokens=[len(x) for x in ids], ids=[x.view(np.int32) for x in ids], decoded=[decode(x, tokens) for x in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    ids_sha256 is over the ids as little-endian uint32, decoded_sha256 over the bytes that decoding
    the ids gives. A null text is encoded as the empty text; a null ``doc_id`` stays null; repeated
    rows each have their own row; other columns of ``docs`` play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder, tokens, sha = _worker(shared.value), shared.value.tokens, hashlib.sha256
        for batch in slices(batches, PIECE_BYTES):
            ids = encoder(batch.column(1).to_pylist())
            yield record_batch(
                schema,
                doc_id=batch.column(0).cast(pa.int64()),
                n_tokens=[len(x) // 4 for x in ids],
                ids_sha256=[sha(x).hexdigest() for x in ids],
                decoded_sha256=[sha(decode(np.frombuffer(x, "<u4"), tokens)).hexdigest() for x in ids],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def load_ranks(path: str, pattern: str = PATTERN, cache: dict = {}) -> Vocabulary:  # noqa: B006  building merges takes a second
    if (path, pattern) not in cache:
        cache[path, pattern] = Vocabulary.from_ranks(path, pattern)
    return cache[path, pattern]
