"""Token ids against the library's, and round trips."""

import time

import numpy as np
import pytest
import sentencepiece

from barwright.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Vocabulary(MODEL))


def test_ids_equal_the_library(codec, library):
    rng = np.random.default_rng(9)
    atoms = ["the", "ing", "a", "  ", " ", "\n", "\t", "ü", "é", "ß", "日", "本", "語", "😀", "\x00", "▁", "1", "23", ".", "<s>", "tion", "un", "Hello", "мир", "аа", "́", "aaaa", "ab", "　", "𝒳"]
    texts = ["".join(rng.choice(atoms, int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += ["", "ab" * 150_000, "日" * 2000 + "the" * 99_000, " ", " " * 77, "a" * 500, "the" * 300, "x" * 3000, "ab " * 999, "▁" * 40, "".join(map(chr, range(1, 3000)))]
    for i in range(0, len(texts), 700):
        part = texts[i : i + 700]
        ids, bounds = codec.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(part, num_threads=1)
    for t in texts:
        ids = library.encode(t)
        assert codec.v.decode(ids) == library.decode(ids) == t.replace("▁", " ")


def test_edge_cases(spark, codec):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, " x "), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as ids")
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted(map(str, ((r.doc_id, r.decoded) for r in got))) == sorted(map(str, ((i, t or "") for i, t in rows)))
    at_once = pieces.encode(df, MODEL, decoded="decoded").collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    slim = pieces.encode(df, MODEL, round_trip="same", carry=["doc_id"])
    assert slim.columns == ["doc_id", "ids", "same"] and slim.where("same").count() == len(rows)
    assert sorted(map(str, slim.select("doc_id", "ids").collect())) == sorted(map(str, (r for r in pieces.encode(df, MODEL).select("doc_id", "ids").collect())))
    assert pieces.encode(df.where("false"), MODEL).count() == 0


def test_words_without_end_take_linear_time(codec, library):
    word = lambda n: "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(n))
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        ids, _ = codec.encode([word(n)])
        took.append(time.perf_counter() - began)
        assert ids.tolist() == library.encode(word(n))
    assert took[1] < 10 * took[0] + 1


def test_what_is_kept_is_bounded(library):
    codec, rng = pieces.Codec(pieces.Vocabulary(MODEL)), np.random.default_rng(3)
    for _ in range(12):
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**9, 20_000)) + " the same words", "the same words"]
        ids, bounds = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(texts, num_threads=1)
        assert len(codec.number) <= pieces.CACHE_WORDS + 40_000 and len(codec.edges_of) <= codec.v.size + 1


def _made_up(rng) -> pieces.Vocabulary:
    """A vocabulary of few characters, with ranks in any order and some of them equal."""
    v = object.__new__(pieces.Vocabulary)
    words = ["▁", "a", "b", "c", *{"".join(rng.choice(["a", "b", "c", "▁", "d"], int(rng.integers(2, 6)))) for _ in range(60)}]
    v.id, v.size, v.unknown, v.byte = {w: i for i, w in enumerate(words)}, len(words), 0, {}
    ranks = rng.permutation(len(words)) if rng.random() < 0.5 else np.sort(rng.integers(0, 40, len(words)))
    v.rank = {w: float(r) for w, r in zip(sorted(words, key=len), ranks)}
    v.by_word, v.longest = False, max(map(len, words))
    v._read_merges()
    return v


def test_pairs_at_once_equal_pairs_that_are_merged(codec):
    rng = np.random.default_rng(4)
    plain = 0
    for c, n in [(codec, 6000), *((pieces.Codec(_made_up(rng)), 1500) for _ in range(40))]:
        stands = [i for p, i in c.v.id.items() if c._fits(-1, i)] + [c.v.size + ord(x) for x in "d日😀"]
        before, tokens = rng.choice([-1, *stands], n), rng.choice(list(c.v.id.values()) + stands[-3:], n)
        # pairs out of one piece, too: drawn ones hardly ever merge
        cuts = [(c.v.id[p[:i]], c.v.id[p[i:]]) for p in list(c.v.id)[:3000] for i in range(1, len(p)) if p[:i] in c.v.id and p[i:] in c.v.id and c._fits(-1, c.v.id[p[:i]])]
        before, tokens = (np.append(x, [q[k] for q in cuts]).astype(np.int64) for k, x in enumerate((before, tokens)))
        got = c._judge(before, tokens)
        assert got.tolist() == [c._fits(b, t) for b, t in zip(before.tolist(), tokens.tolist())]
        plain += c.v.plain.sum() if c is not codec else 0
    assert codec.v.plain.sum() > 31_000 and plain > 100


def test_made_up_vocabularies_are_merged_as_in_whole():
    rng = np.random.default_rng(6)
    for _ in range(30):
        c = pieces.Codec(_made_up(rng))
        texts = ["".join(rng.choice(["a", "b", "c", " ", "d"], int(rng.integers(1, 30)))) for _ in range(40)]
        ids, bounds = c.encode(texts)
        for t, i, j in zip(texts, bounds, bounds[1:]):
            merged = c.merge("▁" + t.replace(" ", "▁"), -1)
            assert ids[i:j].tolist() == [c.v.id.get(p, c.v.unknown) for p in merged]


def test_new_words_are_not_merged_pair_by_pair(library, monkeypatch):
    asked = []
    fits = pieces.Codec._fits
    monkeypatch.setattr(pieces.Codec, "_fits", lambda self, b, t: asked.append((b, t)) or fits(self, b, t))
    codec, rng = pieces.Codec(pieces.Vocabulary(MODEL)), np.random.default_rng(5)
    letters = list("etaoinshrdlucmfwypvbgkjqxz")
    texts = [" ".join("".join(rng.choice(letters, int(n))) for n in rng.integers(1, 12, 500)) for _ in range(20)]
    ids, bounds = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(texts, num_threads=1)
    assert len(asked) < 100  # one for every new pair before


def test_spaces_in_all_places(codec, library):
    texts = ["", " ", "  ", "a", " a", "a ", "a b", "a  b", "  a b", "a b  ", "a \n b", "▁", "a▁b", "▁a", "a▁ b", " ▁", "\x00", "a\x00 b\x00", "x" * 65, "x" * 64, "a " + "x" * 64 + " b"]
    for part in ([t] for t in texts), [texts], [texts[::-1]]:
        for p in part:
            ids, bounds = codec.encode(p)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == library.encode(p, num_threads=1)
