"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, give_back

SPACE = "▁"
#: Words with their ids that a worker keeps, and the characters and ids of all of them; of more, the most used half stays.
CACHE_WORDS, CACHE_SIZE = 80_000, 1_600_000
#: Characters that are indexed at once, and the length from which a word is relaxed by itself.
WORK_CHARS, LONG_WORD = 1 << 17, 64
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 1 << 19
#: Pairs of pieces with the answer are kept in a table of so many places; a new pair takes the place of another.
_ID_BITS, _SLOT_BITS = 22, 20


def _search(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The first place in each sorted range [lo, hi) of the values that is not below what is wanted there."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = open_ & (values[np.minimum(mid, len(values) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


class Vocabulary:
    """What a BPE model file holds, read once on the driver and sent to the workers; its size is the model's."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "  ﬁ A\t b "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
        self.size, self.unknown = sp.vocab_size(), sp.unk_id()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            else:
                self.id[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        # no piece goes on past a space that follows other characters: words can be encoded one by one
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.longest = max(map(len, self.id))
        self._read_merges()

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives the piece when its characters are merged alone; None if merging doesn't give it."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            r = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            at = min(range(len(r)), key=r.__getitem__)
            if r[at] == np.inf:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def _read_merges(self) -> None:
        """By id: the rank as a whole number (0 for characters) and both parts of the last merge (-1 for characters); which
        ids `Codec._all_fit` can judge by them, as their merges come in the order of ranks that no other piece has; and
        the rank of every pair of pieces that would merge, by the pair's key."""
        long = [p for p in self.id if len(p) > 1]
        levels = {r: i + 1 for i, r in enumerate(sorted({self.rank[p] for p in long}))}
        shared = Counter(self.rank[p] for p in long)
        self.order, self.parts, self.plain = np.zeros(self.size, np.int64), np.full((2, self.size), -1, np.int64), np.zeros(self.size, bool)
        for p in sorted(self.id, key=len):  # parts before what they make
            i = self.id[p]
            if len(p) == 1:
                self.plain[i] = True
                continue
            self.order[i] = levels[self.rank[p]]
            merge = self.last_merge(p)
            if merge and all(x in self.id for x in merge):
                self.parts[:, i] = a, b = [self.id[x] for x in merge]
                self.plain[i] = shared[self.rank[p]] == 1 and self.plain[a] and self.plain[b] and self.order[i] > max(self.order[a], self.order[b])
        pairs = sorted((self.id[p[:i]] << _ID_BITS | self.id[p[i:]], self.order[self.id[p]]) for p in long for i in range(1, len(p)) if p[:i] in self.id and p[i:] in self.id)
        self.pair_keys, self.pair_order = (np.array([x[i] for x in pairs], np.int64) for i in (0, 1))

    def decode(self, ids: list[int]) -> str:
        """The text of token ids. The space that encoding puts in front goes; the block that stands for a space in
        pieces (U+2581) reads as a space; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


class Numbers(dict[str, int]):
    """Numbers of words; a word that has none gets the next one."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Encodes batches of texts with one vocabulary.

    The distinct words of a batch are concatenated and indexed in a suffix array, sorted as deep as the longest piece.
    Every piece is looked up by binary search for both ends of its range; the suffixes in the range are its
    occurrences, and each is an edge of the text from its start to its end. Edges are sorted by position in the word and relaxed
    in that order: a position's entry is the last piece of the encoding of the text up to it. An edge from a settled
    position may end there if no merge across the seam of the last piece and the new one would come first. Merges
    depend on their neighbours only, so a text whose neighbours all agree in this way is merged as it would be in whole,
    and exactly one edge into each position passes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        pieces = sorted(self.v.id)
        self.piece_ids = np.array([self.v.id[p] for p in pieces], np.int32)
        self.lengths = np.array(list(map(len, pieces)), np.int32)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        alphabet = np.unique(letters)
        #: The number of a character (by its code) among those that pieces have, in their order; 0 for others.
        self.symbol = np.zeros(sys.maxunicode + 2, np.int32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        row = np.repeat(np.arange(len(pieces)), self.lengths)
        #: Symbols of all pieces, a column for each.
        self.columns = np.zeros((self.v.longest, len(pieces)), np.int32)
        self.columns[np.arange(len(letters)) - (np.cumsum(self.lengths) - self.lengths)[row], row] = self.symbol[letters]
        self.single = np.zeros(len(alphabet) + 1, bool)
        self.single[self.columns[0, self.lengths == 1]] = True
        self.text_of = {i: p for p, i in self.v.id.items()}
        self.slot_keys, self.slot_fits = np.full(1 << _SLOT_BITS, -1, np.int64), np.zeros(1 << _SLOT_BITS, bool)
        self.words_of = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)").findall
        self.edges_of: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.chars = 0
        self.ids, self.counts, self.begins, self.used = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))

    def _forget_rare(self) -> None:
        """Keeps the half of the words that texts have used most, less those that are used once, and bounds their sizes."""
        words = list(self.number)
        size = np.fromiter(map(len, words), np.int64, len(words)) + self.counts
        order = np.argsort(-self.used, kind="stable")[: CACHE_WORDS // 2]
        order = order[(self.used[order] > 1) & (np.cumsum(size[order]) <= CACHE_SIZE // 2)]
        n = self.counts[order]
        at = np.repeat(self.begins[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.ids, self.counts, self.used = self.ids[at], n, self.used[order] // 2
        self.begins = np.cumsum(n) - n
        self.number = Numbers((words[i], k) for k, i in enumerate(order.tolist()))
        self.chars = sum(map(len, self.number))

    def merge(self, text: str, seam: int = 0) -> list[str] | None:
        """The pieces of a short text by merging the best-ranked neighbours, leftmost first; None as soon as a merge
        crosses the place `seam`."""
        parts, left, rank = list(text), seam, self.v.rank
        ranks = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < np.inf:
            at = ranks.index(best)
            if at == left - 1:  # the last part before the seam with the first behind it
                return None
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], np.inf)
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], np.inf)
        return parts

    def _sides(self, piece: str) -> tuple[frozenset[str], frozenset[str]]:
        """What stands at the left and at the right end of a piece while it is merged."""
        got = self.edges_of.get(piece)
        if got is None:
            parts, left, right, rank = list(piece), {piece[0]}, {piece[-1]}, self.v.rank
            while len(parts) > 1:
                r = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
                at = min(range(len(r)), key=r.__getitem__)
                if r[at] == np.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                left.add(parts[0])
                right.add(parts[-1])
            if len(self.edges_of) > self.v.size:
                self.edges_of.clear()
            got = self.edges_of[piece] = (frozenset(left), frozenset(right) if len(parts) == 1 else frozenset())
        return got

    def _string(self, token: int) -> str:
        return self.text_of[token] if token < self.v.size else chr(token - self.v.size)

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token can stand behind another, or (before < 0) at a text's start."""
        piece = self._string(token)
        left, right = self._sides(piece)
        if not right:  # merging its characters does not give the piece
            return False
        if before < 0:
            return True
        prior = self._string(before)
        if not any(a + b in self.v.rank for a in self._sides(prior)[1] for b in left):
            return True
        return self.merge(prior + piece, len(prior)) is not None

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ends, starts and tokens of all edges. Code 0 stands between words.

        A suffix ends with its word, and before a character that no piece has. Its first characters, as deep as the longest
        piece, are packed into a few numbers, which sort the array and are what the binary searches compare; numbers after
        the first are compared where that is equal.
        """
        n, longest = len(codes), self.v.longest
        symbol = self.symbol[codes]
        used = np.bincount(symbol, minlength=len(self.single)) > 0
        used[0] = True
        number = np.cumsum(used) - 1
        bits = max(int(number[-1]).bit_length(), 1)
        width = min(62 // bits, longest)  # characters of one number
        stops = np.append(np.flatnonzero(symbol == 0), n)
        size = np.repeat(stops, np.diff(stops, prepend=-1))[:n] - np.arange(n)
        padded = np.append(number[symbol], np.zeros(width, np.int64))
        one = np.zeros(n, np.int64)
        for j in range(width):
            one <<= np.int64(bits)
            one |= padded[j : j + n]
        over = np.maximum(width - size, 0) * bits
        one = one >> over << over
        suffixes = np.argsort(one)
        first = one[suffixes]
        same = first[1:] == first[:-1]
        tied = np.append(same, False) | np.append(False, same)
        tied = np.flatnonzero(tied & (first & ((1 << bits) - 1) > 0))
        if len(tied) and width < longest:
            of = suffixes[tied]
            suffixes[tied] = of[np.lexsort([*(self._packed(one, size, of, i) for i in reversed(range(width, longest, width))), first[tied]])]
        possible = np.flatnonzero((used | (np.arange(len(used)) == 0))[self.columns].all(axis=0))
        length = self.lengths[possible]
        piece = np.append(number[self.columns[:, possible]], np.zeros((width, len(possible)), np.int64), axis=0)
        lo, hi = np.zeros(len(possible), np.int64), np.full(len(possible), n, np.int64)
        for at in range(0, longest, width):
            live = np.flatnonzero((length > at) & (lo < hi))
            low = np.zeros(len(live), np.int64)
            for j in range(width):
                low = low << np.int64(bits) | piece[at + j, live]
            high = low + (np.int64(1) << (np.maximum(width - (length[live] - at), 0) * np.int64(bits)))
            if at == 0:
                lo[live], hi[live] = np.searchsorted(first, low), np.searchsorted(first, high)
                continue
            sorted_ = self._packed(one, size, suffixes, at)
            lo[live], hi[live] = (_search(sorted_, lo[live], hi[live], want) for want in (low, high))
        count = hi - lo
        of = np.repeat(np.arange(len(count), dtype=np.int32), count)
        start = suffixes.astype(np.int32)[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(of))]
        strange = np.flatnonzero((codes > 0) & ~self.single[symbol])
        joined = ((start + length[of], strange + 1), (start, strange), (self.piece_ids[possible][of], self.v.size + codes[strange] - 1))
        return tuple(np.append(x, y.astype(np.int32)) for x, y in joined)

    @staticmethod
    def _packed(one: np.ndarray, size: np.ndarray, suffixes: np.ndarray, at: int) -> np.ndarray:
        """The numbers of the suffixes from their character `at` on; 0 for those that end before."""
        return np.where(size[suffixes] > at, one[np.minimum(suffixes + at, len(one) - 1)], 0)

    def _all_fit(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`_fits` of many pairs: looked up in a table of recent pairs, and each other one asked once."""
        keys = before.astype(np.int64) << np.int64(_ID_BITS) | tokens
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)
        out = self.slot_fits[slots]
        miss = np.flatnonzero(self.slot_keys[slots] != keys)
        if len(miss):
            out[miss] = self._judge(before[miss].astype(np.int64), tokens[miss].astype(np.int64))
            self.slot_keys[slots[miss]], self.slot_fits[slots[miss]] = keys[miss], out[miss]
        return out

    def _judge(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`_fits` of many pairs at once, from the last state of both sides back to their characters.

        Both sides are merged in the order of ranks. So of the two, the one of higher rank (of equal ones the right one) came
        last, and before it stood there in its parts. A merge across the seam would have come before that one if its rank
        is lower, or equal and the one undone is at the right. Pairs that can't be judged so are asked one by one."""
        v = self.v
        inside = (tokens < v.size) & (before < v.size)
        out, live = np.zeros(len(tokens), bool), np.flatnonzero(inside)
        live = live[v.plain[tokens[live]] & ((before[live] < 0) | v.plain[before[live]])]
        slow = np.ones(len(tokens), bool)
        slow[live], out[live] = False, True
        live = live[before[live] >= 0]
        left, right, limit = before[live], tokens[live], np.full(len(live), np.iinfo(np.int64).max)
        while len(live) and len(v.pair_keys):
            keys = left << np.int64(_ID_BITS) | right
            at = np.minimum(np.searchsorted(v.pair_keys, keys), len(v.pair_keys) - 1)
            crossed = (v.pair_keys[at] == keys) & (v.pair_order[at] < limit)
            out[live[crossed]] = False
            a, b = v.order[left], v.order[right]
            go = np.flatnonzero(~crossed & ((a > 0) | (b > 0)))
            live, left, right, a, b = live[go], left[go], right[go], a[go], b[go]
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)
            left, right = np.where(undo_left, v.parts[1, left], left), np.where(undo_left, right, v.parts[0, right])
        slow = np.flatnonzero(slow)
        if len(slow):
            asked, inverse = np.unique(before[slow] << np.int64(_ID_BITS) | tokens[slow], return_inverse=True)
            got = [self._fits(k >> _ID_BITS, k & ((1 << _ID_BITS) - 1)) for k in asked.tolist()]
            out[slow] = np.array(got, bool)[inverse]
        return out

    def _ids(self, word: np.ndarray, tokens: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of strange characters in their places, and their number by word; tokens come by word."""
        strange = np.flatnonzero(tokens >= self.v.size)
        if len(strange):
            bytes_of = [[self.v.byte.get(x, self.v.unknown) for x in chr(t - self.v.size).encode()] for t in tokens[strange].tolist()]
            n = np.ones(len(tokens), np.int64)
            n[strange] = list(map(len, bytes_of))
            word, tokens, was = np.repeat(word, n), np.repeat(tokens, n), np.repeat(tokens >= self.v.size, n)
            tokens[was] = [x for b in bytes_of for x in b]
        return tokens.astype(np.int32), np.bincount(word, minlength=n_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each behind a space, in one array, and their number by word."""
        codes = np.frombuffer((SPACE + f"\x00{SPACE}".join(words)).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes + 1) - 1
        codes[ends[:-1]] = 0
        end, start, token = self._edges(codes)
        begins = ends - sizes
        free, first = -2, -1
        last, back = np.full(len(codes) + 1, free, np.int32), np.zeros(len(codes) + 1, np.int32)
        last[begins] = first
        # all words at once, by the place in the word where an edge ends
        most = int(sizes.max())
        word_start = np.zeros(len(codes) + 1, np.int64)
        word_start[:-1] = np.repeat(begins, sizes + 1)[: len(codes)]
        place = (end - word_start[start]).astype(np.uint16)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(1, most + 2))
        end, start, token = end[order], start[order], token[order]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                e, s, t = end[a:b], start[a:b], token[a:b]
                ok = last[s] != free
                ok[ok] = self._all_fit(last[s[ok]], t[ok])
                last[e[ok]], back[e[ok]] = t[ok], s[ok]
        # back from the ends, a token of every word at a time
        at, word, found = ends.copy(), np.arange(len(words)), []
        while len(word):
            found.append((word, last[at]))
            at = back[at]
            more = at > begins[word]
            at, word = at[more], word[more]
        steps = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        word, tokens = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((-steps, word))
        return self._ids(word[order], tokens[order], len(words))

    def _encode_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """As `_encode_words`, for one word: the text is indexed piece by piece, each with the end of the one before,
        so that what is held at once besides a few numbers a character is bounded; edges are relaxed one by one."""
        free, reach = -2, self.v.longest
        last, back = np.full(len(word) + 1, free, np.int32), np.zeros(len(word) + 1, np.int32)
        last[0] = -1
        asked: dict[int, bool] = {}
        for low in range(0, len(word), WORK_CHARS):
            base = max(low - reach, 0)
            codes = np.frombuffer(word[base : low + WORK_CHARS].encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            end, start, token = self._edges(codes)
            new = np.flatnonzero(end + base > low)
            new = new[np.argsort(end[new], kind="stable")]
            # the state behind the piece's first place, as a list, which single steps read faster than an array
            state, link = last[base : base + len(codes) + 1].tolist(), back[base : base + len(codes) + 1].tolist()
            for i in range(0, len(new), 1 << 15):
                part = new[i : i + (1 << 15)]
                for e, s, t in zip(end[part].tolist(), start[part].tolist(), token[part].tolist(), strict=True):
                    before = state[s]
                    if before == free:
                        continue
                    key = before << _ID_BITS | t
                    fits = asked.get(key)
                    if fits is None:
                        if len(asked) > CACHE_WORDS:
                            asked.clear()
                        fits = asked[key] = self._fits(before, t)
                    if fits:
                        state[e], link[e] = t, s + base
            last[base : base + len(codes) + 1], back[base : base + len(codes) + 1] = state, link
        at, tokens = len(word), []
        while at > 0:
            tokens.append(int(last[at]))
            at = int(back[at])
        return self._ids(np.zeros(len(tokens), np.int64), np.array(tokens[::-1], np.int64), 1)

    def _learn(self, new: list[str]) -> None:
        """Encodes words that are not kept, so many characters at a time, and keeps their ids."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        order = np.argsort(sizes > LONG_WORD, kind="stable")
        n_short, upto = int((sizes <= LONG_WORD).sum()), np.cumsum(sizes[order])
        words, got, at = [new[i] for i in order.tolist()], [], 0
        while at < n_short:
            to = min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORK_CHARS, side="right")) + 1, n_short)
            got.append(self._encode_words(words[at:to]))
            at = to
        got += [self._encode_long(SPACE + w) for w in words[n_short:]]
        in_order = np.concatenate([n for _, n in got])
        counts, begins = np.zeros((2, len(new)), np.int64)
        counts[order], begins[order] = in_order, np.cumsum(in_order) - in_order + len(self.ids)
        self.ids = np.concatenate([self.ids, *(x for x, _ in got)])
        self.counts, self.begins = np.append(self.counts, counts), np.append(self.begins, begins)
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.chars += int(sizes.sum())

    def _split(self, text: str) -> list[str]:
        """The words of a text, each without the one space that stands before it."""
        if not text:
            return []
        if not self.v.by_word:
            return [text.replace(" ", SPACE)]
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return self.words_of(SPACE + text.replace(" ", SPACE))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the texts' bounds in it."""
        parts = [self._split(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        if len(self.number) > CACHE_WORDS or len(self.ids) + self.chars > CACHE_SIZE:
            self._forget_rare()
        known = len(self.number)
        word = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > known:
            self._learn(list(islice(reversed(self.number), len(self.number) - known))[::-1])
        self.used += np.bincount(word, minlength=len(self.used))
        n = self.counts[word]
        upto = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = self.ids[np.repeat(self.begins[word] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(list(map(len, parts)), out=bounds[1:])
        return ids, upto[bounds]


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = None, round_trip: str | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """The rows of `docs` with the token ids of the text column added (array of int), as the model's own library gives
    them. If `decoded` is a name, the text that `decode` would give is added too; if `round_trip` is one, whether that
    is the text (null is empty), the block that stands for a space read as one. Both are found in the same pass.
    carry: the columns of `docs` that come along, all if None; without the text, texts need not come back.

    Null and empty texts have no tokens; texts of any length are encoded whole; rows are encoded one by one; columns
    of the added names are replaced; an empty table gives no rows. What a worker keeps of words and pairs is bounded
    in bytes and goes with its task."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    added = {ids: "array<int>"} | ({decoded: "string"} if decoded else {}) | ({round_trip: "boolean"} if round_trip else {})
    rows = docs.drop(*added) if carry is None else docs.select(*dict.fromkeys([*carry, text]))
    kept = [f for f in rows.schema if f.name not in added and (carry is None or f.name in carry)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{c}` {t}" for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for begin, end in chunks(batch.column(text), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                texts = [t or "" for t in part.column(text).to_pylist()]
                flat, bounds = codec.encode(texts)
                new = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))]
                if decoded or round_trip:
                    got = [codec.v.decode(flat[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                    new += [pa.array(got, pa.string())] if decoded else []
                    new += [pa.array([g == t.replace(SPACE, " ") for g, t in zip(got, texts, strict=True)], pa.bool_())] if round_trip else []
                yield pa.record_batch([*(part.column(f.name) for f in kept), *new], names=[*(f.name for f in kept), *added])
            give_back()
        del codec
        give_back()

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text of the ids added. Null ids give null; ids outside the vocabulary are an error; see
    `encode` for the rest."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(model_file))
    rows = tokens.drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{text}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                got = [None if x is None else shared.value.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(got, pa.string())], names=[*part.schema.names, text])

    return rows.mapInArrow(run, schema)


def digest(ids: str) -> F.Column:
    return F.sha2(F.col(ids).cast("string"), 256)
