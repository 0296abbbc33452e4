"""Byte-level BPE with the ranks of a vocabulary file: encoding by the tokenizers library, decoding by the byte table."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import CHUNK_BYTES, chunks, give_back

#: What the splitting pattern calls white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Every match of the splitting pattern lies in one of these: it never goes on from another character into white space.
PARTS = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+")
#: White space to Python and no white space to the pattern.
NO_WHITE = "\x1c\x1d\x1e\x1f"
#: New parts that the library gets as one text; its time grows faster than the text.
JOINED = 64
#: Parts and ids that a worker keeps at most between batches.
KEPT_PARTS, KEPT_IDS = 200_000, 2_000_000


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The pair whose merge gives the token: what is left of its bytes when every merge of a lower rank is done.

    Where merging by rank makes the token anywhere in a text, it is from this pair, as no merge crossed its ends and so
    the same ones were done inside; hence the pairs, in the order of ranks, give the same ids as the ranks do. None for
    a token that merges never make (a whole match of the pattern may still be one)."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


class Vocabulary:
    """What workers are sent: the library's tokenizer as JSON, and the bytes of every id in one row."""

    def __init__(self, file: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, letters = read_ranks(file), byte_letters()
        as_text = lambda token: "".join([letters[b] for b in token])
        merges = [last_merge(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
        bpe = models.BPE({as_text(t): r for t, r in ranks.items()}, [(as_text(a), as_text(b)) for a, b in filter(None, merges)], ignore_merges=True)
        tokenizer = Tokenizer(bpe)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.json = tokenizer.to_str()
        back = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes([back[c] for c in t]) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        size = max(tokens, default=-1) + 1
        self.lengths = np.fromiter((len(tokens.get(i, b"")) for i in range(size)), np.int64, size)
        self.known = np.fromiter((i in tokens for i in range(size)), bool, size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)


def gather(rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the rows, in order, and where each row's items begin (and the last one's end)."""
    n = lengths[rows]
    upto = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    return np.repeat(begins[rows] - upto[:-1], n) + np.arange(upto[-1]), upto


class Encoder:
    """Encodes texts; a part seen before is looked up. What it keeps is bounded in parts and ids."""

    def __init__(self, v: Vocabulary) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.sizes = Tokenizer.from_str(v.json), v.lengths
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.empty(0, np.int32)
        self.lengths, self.begins = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        """The library gets parts as long texts: where a part that begins with white space follows one that ends without,
        no match crosses. What is a part's own is told by the bytes of its ids; so are the places of its characters."""
        joins = [p for p in parts if p[0].isspace() and not p[-1].isspace() and p[0] not in NO_WHITE and p[-1] not in NO_WHITE]
        alone = set(parts).difference(joins)
        order = [*joins, *alone]
        texts = ["".join(joins[i : i + JOINED]) for i in range(0, len(joins), JOINED)] + list(alone)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.int32, sum(map(len, got)))
        whole = np.frombuffer("".join(order).encode("utf-8"), np.uint8)
        chars = np.fromiter(map(len, order), np.int64, len(order))
        character = np.cumsum((whole & 0xC0) != 0x80) - 1
        begins = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))
        first = np.cumsum(chars) - chars
        token = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        bounds = np.searchsorted(token, begins[np.append(first, chars.sum())])
        counts = np.diff(bounds)
        self.number.update(zip(order, range(len(self.number), len(self.number) + len(order)), strict=True))
        self.lengths = np.concatenate([self.lengths, counts])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, (character[token] - np.repeat(first, counts)).astype(np.int32)])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the place in its text at which each token begins, and the bounds of each text."""
        split = [PARTS.findall(t) for t in texts]
        flat = [p for parts in split for p in parts]
        if len(self.number) > KEPT_PARTS or len(self.ids) > KEPT_IDS:
            self._forget()
        new = set(flat).difference(self.number)
        if new:
            self._learn(list(new))
        part = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        at, upto = gather(part, self.begins, self.lengths)
        of_text = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(list(map(len, split)), out=of_text[1:])
        chars = np.fromiter(map(len, flat), np.int64, len(flat))
        before = np.cumsum(chars) - chars
        before -= np.repeat(before[np.minimum(of_text[:-1], max(len(flat) - 1, 0))] if len(flat) else np.zeros(len(texts), np.int64), np.diff(of_text))
        return self.ids[at], (self.starts[at] + np.repeat(before, np.diff(upto))).astype(np.int32), upto[of_text]


def decode_ids(v: Vocabulary, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the ids, and after each id the number of whole characters so far: a character that several ids share
    counts with the last of them. Bytes that are no character's count as one each. Ids outside the vocabulary are an
    error."""
    if len(ids) and not (ids.min() >= 0 and ids.max() < len(v.known) and v.known[ids].all()):
        raise ValueError("ids outside the vocabulary")
    at, upto = gather(ids, v.begins, v.lengths)
    out = v.bytes[at]
    whole = out.tobytes()
    try:
        whole.decode("utf-8")
        # a character ends where the next byte begins another one
        ends = np.append((out[1:] & 0xC0) != 0x80, True) if len(out) else np.empty(0, bool)
    except UnicodeDecodeError:
        ends = np.zeros(len(out), bool)
        place = 0
        while place < len(whole):
            n = next((n for n in (1, 2, 3, 4) if _is_character(whole[place : place + n])), 1)
            place += n
            ends[place - 1] = True
    counted = np.concatenate([[0], np.cumsum(ends)])
    return whole, counted[upto[1:]].astype(np.int32)


def _is_character(b: bytes) -> bool:
    try:
        return len(b.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def _free(columns: Sequence[str], name: str) -> str:
    """The name, longer by underscores until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _schema(fields: Sequence, added: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{c}` {t}" for c, t in added.items())])


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", starts: str | None = "starts", packed: str | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """The rows of `docs` with the ids of the text column (array of int) added, as merging by the ranks of the file inside
    each match of the pattern gives them; no special tokens. The file is read on the driver.

    starts: a name for the places (in characters) at which tokens begin; packed: a name for the ids as little-endian
    unsigned 32-bit numbers in one binary value. carry: the columns of `docs` that come along, all if None.

    Null and empty texts have no tokens; texts of any length are encoded whole; equal rows stay; an empty table gives no
    rows; columns of the added names are replaced. What a worker keeps between batches is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(rank_file, pattern))  # a vocabulary, whatever the table's size
    added = {ids: "array<int>"} | ({starts: "array<int>"} if starts else {}) | ({packed: "binary"} if packed else {})
    taken = {a.lower() for a in added}
    kept = [f for f in docs.schema if f.name.lower() not in taken and (carry is None or f.name in carry)]
    rows = docs.select(*[docs[f"`{f.name}`"] for f in kept], docs[f"`{text}`"].alias(_free(docs.columns, "text to encode")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for begin, end in chunks(batch.column(len(kept)), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                flat, places, bounds = encoder.encode([t or "" for t in part.column(len(kept)).to_pylist()])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x))  # noqa: B023, E731
                new = [lists(flat)] + ([lists(places)] if starts else [])
                if packed:
                    new.append(pa.array([flat[i:j].astype("<u4").tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()))
                yield pa.record_batch([*part.columns[: len(kept)], *new], names=[*(f.name for f in kept), *added])
            give_back()
        del encoder
        give_back()

    return rows.mapInArrow(run, _schema(kept, added))


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded", text: str | None = None, ends: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids added (binary).

    text: a name for them as text, where U+FFFD stands for bytes that are no character; ends: a name for the number of
    whole characters up to the end of each token, so that a token which ends inside a character adds none.

    Null ids give null; ids outside the vocabulary are an error; columns of the added names are replaced."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(rank_file, pattern))
    added = {decoded: "binary"} | ({text: "string"} if text else {}) | ({ends: "array<int>"} if ends else {})
    taken = {a.lower() for a in added}
    kept = [f for f in tokens.schema if f.name.lower() not in taken]
    rows = tokens.select(*[tokens[f"`{f.name}`"] for f in kept], tokens[f"`{ids}`"].alias(_free(tokens.columns, "ids to decode")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                got = [decode_ids(v, np.asarray(x.values, np.int64)) if x.is_valid else (None, None) for x in part.column(len(kept))]
                new = [pa.array([b for b, _ in got], pa.binary())]
                new += [pa.array([None if b is None else b.decode("utf-8", "replace") for b, _ in got], pa.string())] if text else []
                new += [pa.array([e for _, e in got], pa.list_(pa.int32()))] if ends else []
                yield pa.record_batch([*part.columns[: len(kept)], *new], names=[*(f.name for f in kept), *added])
            give_back()

    return rows.mapInArrow(run, _schema(kept, added))
