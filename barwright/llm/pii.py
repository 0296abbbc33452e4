"""Personal data: generators propose overlapping spans, boosted trees judge them, a calibrated threshold selects."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .words import chunks, mix

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().\-/]{0,2}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_GAP = re.compile(r"[^0-9]+")
_ON = re.compile(r"[^0-9A-Za-z]{1,3}[0-9]|[0-9]")
_IP_DOT = re.compile(r"[0-9] ?(?:\[\.\]|\(\.\)|[\[(]dot[\])]|\bdot\b|\. [0-9]| \.)", re.IGNORECASE)
_IP_RUN = re.compile(r"(?<![0-9])[0-9]{1,4}+(?: ?(?:\[\.\]|\(\.\)|[\[(]dot[\])]|\bdot\b|\.) ?[0-9]{1,4}+){3,}", re.IGNORECASE)
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\bat\b) ?", re.IGNORECASE)
_DOT = re.compile(r"\(dot\)|\[dot\]|\bdot\b", re.IGNORECASE)
_SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]++)+", re.IGNORECASE)
#: What stands before "at", read backwards, and the most characters of it.
_SPOKEN_LOCAL = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.| ?\)tod\( ?| ?\]tod\[ ?| tod )[A-Za-z0-9_%+-]++)*", re.IGNORECASE)
LOCAL_CHARS = 400
_PHRASE = re.compile(r"\b([A-Za-z]{1,30}) ([A-Za-z]{1,30}) ([A-Za-z]{1,30})\b")
#: How an address is spelled: what stands for the @, what for each dot of the domain, what for each dot before the @.
STYLES = ((" (at) ", " (dot) ", "."), (" [at] ", " [dot] ", "."), (" at ", " dot ", "."), (" at ", " dot ", " dot "), ("(at)", "(dot)", "(dot)"), (" AT ", " DOT ", "."))
#: Generic top-level domains.
TLDS = frozenset("com org net edu gov mil int info biz name pro app dev io".split())

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ with the run of local characters before it (from the last match on) and a dotted name behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules, by kind, then start."""
    if not _ANY.search(text):
        return []
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _spoken(text: str) -> list[Span]:
    """Each "at" with a local part before it (from the last match on) and a name with spelled dots behind it."""
    out, last = [], 0
    for m in _AT.finditer(text):
        domain = _SPOKEN_DOMAIN.match(text, m.end()) if m.start() >= last else None
        local = _SPOKEN_LOCAL.match(text[max(last, m.start() - LOCAL_CHARS) : m.start()][::-1]) if domain else None
        if local:
            out.append(("email", m.start() - local.end(), domain.end()))
            last = domain.end()
    return out


def _numbers(text: str) -> Iterator[Span]:
    """Every run of consecutive groups of digits that has 7 to 19 digits in all."""
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i, (b, _) in enumerate(groups):
            n = 0
            b -= text[b - 1 : b] == "("
            for c, e in groups[i : i + 19]:
                n += e - c
                if n > 19:
                    break
                if 7 <= n <= 15:
                    yield "phone", b, e
                if n >= 13:
                    yield "card", b, e


def _spaced_ips(text: str) -> list[Span]:
    """Every four numbers in a row with spelled, bracketed or spaced dots between them."""
    if not _IP_DOT.search(text):
        return []
    out = []
    for m in _IP_RUN.finditer(text):
        parts = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        out += [("ip", parts[i][0], parts[i + 3][1]) for i in range(len(parts) - 3)]
    return out


def proposals(text: str) -> Iterator[Span]:
    """Spans that may be personal data, overlapping: runs of groups of digits, four numbers with odd dots, and addresses
    spelled with "at" and "dot"."""
    yield from _numbers(text)
    yield from _spaced_ips(text)
    if _DOT.search(text):
        yield from _spoken(text)


#: Words that say what a number is, by stem.
_CUES = ("tel", "phone", "call", "fax", "mobil", "card", "visa", "pay", "mail", "contact", "id", "order", "isbn", "token", "date", "version")


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its surroundings."""
    kind, b, e = span
    s = text[b:e]
    digits = "".join(c for c in s if c.isdigit())
    groups = [len(g) for g in _GROUP.findall(s)] or [0]
    before, after = text[max(0, b - 1) : b], text[e : e + 1]
    near = text[max(0, b - 40) : b].lower()
    context = text[max(0, b - 20) : b] + text[e : e + 20]
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), s.count(")"), s[:1] == "(",
        luhn(digits) if 13 <= len(digits) <= 19 else -1, len(set(digits)), digits[:1] == "0",
        before.isalnum(), after.isalnum(), before in "\"'=#", sum(c.isdigit() for c in context),
        digits[:2] == "00", before == "+", len(set(_GAP.findall(s))), _more(text, e), _more(text[b - 4 : b][::-1], 0),
        *(cue in near for cue in _CUES),
    ]


def ip_features(text: str, span: Span) -> list[float]:
    """Format of four numbers with odd dots and their surroundings."""
    _, b, e = span
    s = text[b:e]
    parts, gaps = [int(g) for g in _GROUP.findall(s)], _GAP.findall(s)
    near = text[max(0, b - 40) : b].lower()
    return [
        max(parts), min(parts), parts[0], sum(len(g) > 1 and g[0] == "0" for g in _GROUP.findall(s)), len(set(gaps)), len(gaps[0]),
        "(" in s or "[" in s, "dot" in s.lower(), s.count(" "), _more(text, e), _more(text[max(0, b - 8) : b][::-1], 0),
        *(cue in near for cue in ("ip", "host", "addr", "server", "login", "from", "ver", "section")),
    ]


def _more(text: str, at: int) -> bool:
    """Whether more digits follow, one or two marks on."""
    return bool(_ON.match(text, at))


def spoken_features(text: str, span: Span) -> list[float]:
    """Format of a spelled address and what stands before it."""
    _, b, e = span
    s = text[b:e]
    at = next(m for m in _AT.finditer(s) if m.start() and _SPOKEN_DOMAIN.fullmatch(s, m.end()))
    local, dots = s[: at.start()], [m[0] for m in _DOT.finditer(s, at.end())]
    last = re.split(r"[ \])]", s)[-1].lower()
    near = text[max(0, b - 40) : b].lower()
    return [
        len(local), sum(c.isdigit() for c in local), sum(c in "._%+-" for c in local), len(_DOT.findall(local)),
        "(" in at[0] or "[" in at[0], sum(len(d) > 3 for d in dots), len(dots), len(last), last in TLDS, last.isalpha(), s.count(" "), "@" in near,
        *(cue in near for cue in ("mail", "contact", "write", "reach", "send")),
    ]


@dataclass(frozen=True)
class Settings:
    """fit_docs: about so many documents (picked by a hash of the id) and at most fit_rows of the examples of each kind made
    from them are learnt from, whatever the input's size. precision: what each kind's added spans must reach on examples
    of documents held out from the fit, least_probability what the trees must say of any."""

    fit_docs: int = 20_000
    fit_rows: int = 40_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    precision: float = 0.99
    least_probability: float = 0.5
    least_positives: int = 20


class Trees:
    """Gradient-boosted trees for yes or no, on features cut into bins."""

    def __init__(self, s: Settings, x: np.ndarray, y: np.ndarray) -> None:
        self.depth = s.depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, s.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        mean = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start, self.rate, self.trees = np.log(mean / (1 - mean)), s.rate, []
        score = np.full(len(y), self.start)
        f, width = x.shape[1], s.bins + 1
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << s.depth) - 1, np.int64), np.full((1 << s.depth) - 1, width, np.int64)
            for level in range(s.depth):
                first, n = (1 << level) - 1, 1 << level
                at = ((node[:, None] * f + np.arange(f)) * width + binned).reshape(-1)
                g, h = (np.bincount(at, np.repeat(v, f), n * f * width).reshape(n, f, width).cumsum(axis=2) for v in (grad, hess))
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                best = gain.reshape(n, -1).argmax(axis=1)
                feature[first : first + n], cut[first : first + n] = best // width, best % width
                node = node * 2 + (binned[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaf_g, leaf_h = np.bincount(node, grad, 1 << s.depth), np.bincount(node, hess, 1 << s.depth)
            leaf = leaf_g / (leaf_h + 1)
            score += s.rate * leaf[node]
            self.trees.append((feature, cut, leaf))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned, score, rows = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (binned[rows, feature[at]] > cut[at])
            score += self.rate * leaf[node]
        return 1 / (1 + np.exp(-score))


class Judge(NamedTuple):
    """Trees, the least probability at which a proposal is taken, and what that gave on held-out documents."""

    trees: Trees
    threshold: float
    precision: float
    recall: float


#: Proposals judged at once.
BLOCK = 20_000
#: What proposes spans, for which kinds, and what describes them.
GENERATORS = ((_numbers, ("card", "phone"), features), (_spaced_ips, ("ip",), ip_features), (_spoken, ("email",), spoken_features))


class Selector:
    """A judge for each kind; None where nothing could be learnt."""

    def __init__(self, judges: dict[str, Judge | None]) -> None:
        self.judges = judges

    def _likely(self, texts: list[str]) -> Iterator[tuple[float, int, Span]]:
        for generate, kinds, describe in GENERATORS:
            if not any(self.judges.get(k) for k in kinds):
                continue
            all_ = ((i, s) for i, t in enumerate(texts) if t and (generate is not _spoken or _DOT.search(t)) for s in generate(t))
            while block := list(islice(all_, BLOCK)):
                x = np.array([describe(texts[i], s) for i, s in block], float)
                for kind in kinds:
                    judge, of = self.judges.get(kind), np.array([s[0] == kind for _, s in block])
                    if judge is None or not of.any():
                        continue
                    at, p = np.flatnonzero(of), judge.trees.probability(x[of])
                    for j in np.flatnonzero(p >= judge.threshold).tolist():
                        yield float(p[j]), *block[at[j]]

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """For each text the proposals taken: the likeliest first, of equal ones the longest, none that overlaps another or a base span."""
        out: list[list[Span]] = [[] for _ in texts]
        taken: dict[int, bytearray] = {}
        for _, i, (kind, b, e) in sorted(self._likely(texts), key=lambda x: (-x[0], x[2][1] - x[2][2], x[2][1])):
            if i not in taken:
                taken[i] = bytearray(len(texts[i]))
                for _, x, y in base[i]:
                    taken[i][x:y] = b"\1" * (y - x)
            if 1 not in taken[i][b:e]:
                taken[i][b:e] = b"\1" * (e - b)
                out[i].append((kind, b, e))
        return out


def _disguises(kind: str, span: str) -> list[str]:
    """Forms of a base span that the fixed rules don't match, and, as they fail where other numbers follow, its own."""
    groups = _GROUP.findall(span)
    if kind == "ip":
        return [dot.join(groups) for dot in (" . ", "[.]", "(.)", "[dot]", "(dot)", " dot ", " [.] ", ". ")]
    if kind == "card":
        digits = "".join(groups)
        return [gap.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for gap in (".", "/", "  ", "--", " ", "-", "")]
    if kind == "phone":
        digits = "".join(groups)
        groups = groups if len(groups) > 1 else [digits[:2], digits[2:5], *re.findall(".{1,4}", digits[5:])]
        national = [*(gap.join(groups[1:]) for gap in ("-", ".", " ")), f"({groups[1]}) {'-'.join(groups[2:])}".strip("- "), f"0{' '.join(groups[1:])}"] if len("".join(groups[1:])) >= 8 else []
        return [*national, span, f"+{' '.join(groups)}", *(f"{lead}{gap.join(groups)}" for lead in ("00", "") for gap in (" ", "-", ".", "/")), f"({groups[0]}) {'-'.join(groups[1:])}", f"00{groups[0]} ({groups[1]}) {' '.join(groups[2:])}".strip()]
    local, _, domain = span.partition("@")
    short = (re.findall(r"[A-Za-z]+", local) or [local])[0], ".".join(domain.split(".")[-2:])
    return [a.replace(".", inner) + at + d.replace(".", dot) for (a, d), (at, dot, inner) in product(((local, domain), short), STYLES)]


def _lookalikes(kind: str, rng: np.random.Generator) -> list[str]:
    """Strings that the generators propose and that are no personal data."""
    n = lambda low, high: str(int(rng.integers(low, high)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    if kind == "ip":
        parts = [n(0, 30) for _ in range(5)]
        return [" . ".join([n(256, 1000), *parts[:3]]), " dot ".join(parts), "[.]".join([*parts[:2], n(300, 999), parts[3]]), f"{parts[0]}. {parts[1]}. {parts[2]}. {n(1900, 2030)}", ". ".join(parts), f"{parts[0]}. {parts[1]}. {n(400, 999)}. {parts[3]}"]
    if kind == "card":
        k = int(rng.integers(13, 20))
        bad = next(d for d in (digits(k) for _ in iter(int, 1)) if not luhn(d))
        return [*(gap.join(bad[i : i + 4] for i in range(0, k, 4)) for gap in (".", "/", "  ", "--")), f"b{digits(15)}e", f"{digits(16)}af0", f"0x{digits(14)}"]
    if kind == "phone":
        y, m, d = n(1900, 2030), f"{int(rng.integers(1, 13)):02}", f"{int(rng.integers(1, 29)):02}"
        return [f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{y}-{n(1900, 2030)}", " ".join(n(1, 99) for _ in range(5)), digits(8), digits(12), f"{n(1, 9)}.{digits(7)}", f"978-{n(0, 9)}-{digits(2)}-{digits(6)}-{n(0, 9)}", f"{y}-{m}-{d} 12.30.{m}", f"c{digits(11)}d", f"{digits(9)}e1b", f"a7{digits(14)}"]
    return []


def _make_examples(kind: str, generate, describe, doc_id: int, text: str) -> Iterator[tuple[list[float], bool]]:
    """What is proposed around each base span of the text once it is written in a form that the fixed rules don't match:
    right if it is that span and of its kind. Wrong are other proposals, look-alikes in its place, and what the text itself
    has besides base spans. Labels so rest on how an example was made, and not on the rules' own answers. For addresses also words
    of the text spelled as one."""
    base = base_spans(text)
    mine = [s for s in base if s[0] == kind]
    rng = np.random.default_rng(doc_id % (1 << 62))

    def beside() -> str:
        return ".".join(map(str, rng.integers(0, 256, 4))) if rng.random() < 0.3 else " ".join(map(str, rng.integers(0, 3000, int(rng.integers(1, 4)))))

    def around(b: int, e: int, middle: str, right: bool) -> Iterator[tuple[list[float], bool]]:
        before, after = text[max(0, b - 60) : b], text[e : e + 60]
        if kind != "email":  # other numbers may stand beside it
            before += f"{beside()} " if rng.random() < 0.25 else ""
            after = (f" {beside()}" if rng.random() < 0.25 else "") + after
        new, low, high = before + middle + after, len(before), len(before) + len(middle)
        for s in generate(new):
            if s[0] == kind and s[1] < high and s[2] > low:
                yield describe(new, s), right and min(s[2], high) - max(s[1], low) >= 0.9 * max(s[2] - s[1], high - low)

    for other, b, e in base:
        for form in _disguises(other, text[b:e]):
            yield from around(b, e, form, other == kind)
        if kind != "email":
            for form in (form for k in KINDS for form in _lookalikes(k, rng)):
                yield from around(b, e, form, False)
    for s in generate(text) if mine and kind != "email" else ():
        if s[0] == kind and not any(x[1] < s[2] and s[1] < x[2] for x in base):
            yield describe(text, s), False
    if kind == "email":
        step = max(1, len(text) // (8 * len(mine) + 1))
        for k in range(8 * len(mine)):
            m = _PHRASE.search(text, k * step, k * step + 400)
            if m:
                at, dot, _ = STYLES[2 + 3 * ((doc_id + k) % 2)]
                yield from around(m.start(), m.end(), m[1] + at + m[2] + dot + m[3], False)


def _examples(kind: str):
    generate, describe = next((g, d) for g, kinds, d in GENERATORS if kind in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                all_ = ((i, *xy) for i, t in zip(part.column("doc_key").to_pylist(), part.column("text").to_pylist(), strict=True) for xy in _make_examples(kind, generate, describe, i, t))
                while block := list(islice(all_, BLOCK)):
                    ids, x, y = zip(*block, strict=True)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], names=["doc_key", "x", "y"])

    return run


def _judge(sample: DataFrame, kind: str, settings: Settings) -> Judge | None:
    got = sample.mapInArrow(_examples(kind), "doc_key long, x array<double>, y boolean")
    got = got.orderBy("doc_key", F.xxhash64("x"), "x", "y").limit(settings.fit_rows).toArrow()
    y, ids = got.column("y").to_numpy().astype(float), got.column("doc_key").to_numpy()
    hold = mix(ids.view(np.uint64)) % np.uint64(4) == 0
    if y[~hold].sum() < settings.least_positives or y[hold].sum() < settings.least_positives or (y[~hold] == 1).all():
        return None
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    trees = Trees(settings, x[~hold], y[~hold])
    p = trees.probability(x[hold])
    order = np.argsort(-p, kind="stable")
    ranked, right = p[order], np.cumsum(y[hold][order])
    share = right / np.arange(1, len(order) + 1)
    last = np.append(np.diff(ranked) != 0, True)  # ties fall together
    good = np.flatnonzero((share >= settings.precision) & (ranked >= settings.least_probability) & last)
    if not len(good):
        return None
    at = good[-1]
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return Judge(trees, max(float(ranked[at] + below) / 2, settings.least_probability), float(share[at]), float(right[at] / right[-1]))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Selector:
    """Learns by kind from base spans of a sample, rewritten into forms that the fixed rules don't match, and from
    look-alikes; sets each threshold on documents that the trees haven't seen. Ids of any type will do: a hash of them
    picks the sample, which is written once."""
    rows = docs.where("doc_id is not null and text is not null")
    n = rows.count()
    rank = F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 20))
    sample = rows.where(rank < min(1 << 20, int((1 << 20) * settings.fit_docs / max(n, 1)) + 1)).where(F.col("text").rlike("[0-9@]"))
    sample = Scratch(docs.sparkSession, "pii").keep(sample.select(F.xxhash64("doc_id").alias("doc_key"), "text"), "sample")
    return Selector({k: _judge(sample, k, settings) for k in KINDS})


SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, base_spans and spans (arrays of kind, start and end in code points, by kind, then start) by row.

    base_spans are those of the fixed rules; spans holds them and those that the trees add. Whole texts are searched;
    null texts have no spans; null ids and repeated rows are searched like others; other columns are ignored; an empty
    table gives no rows. With too few examples to learn from nothing is added.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column("text")):
                part = batch.slice(begin, end - begin)
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [_sorted(base_spans(t)) for t in texts]
                added = shared.value.added(texts, base)
                lists = [pa.array([[{"kind": k, "start": b, "end": e} for k, b, e in s] for s in spans], _SPAN) for spans in (base, [_sorted(b + a) for b, a in zip(base, added, strict=True)])]
                yield pa.record_batch([*part.columns, *lists], names=["doc_id", "text", "base_spans", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, base_spans {SPAN}, spans {SPAN}")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text of the result of `find`, each span replaced by its kind in brackets; of overlapping spans the
    earliest, then longest, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind']}]"]
                        at = s["end"]
                out.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, text string")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
