import base64
import random

import pytest
import tiktoken

from shelfmark.llm.pieces import LIMIT, OVERLAP, cuts, split_texts
from shelfmark.llm.tokens import TOKENIZER, PerfectHash, encode, encoder, read_ranks


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = " \t\nAaeéøßя日本語'sx019٣…“’  \u0085\x1ć😀-—_<|>"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    return out + ["<|endoftext|>", "a" * 5000, "don't  we'll\n\n\n x", " ", "\n", "x" * 3 + " " * 400 + "y", "Ⅲ ½ ²"]


def test_ids_equal_the_library(reference):
    enc, ts = encoder(TOKENIZER), texts()
    ids, at, per, words = enc.encode(ts)
    for k, t in enumerate(ts):
        assert ids[at[k] : at[k + 1]].tolist() == reference.encode_ordinary(t), t
    assert per.sum() == len(ids) and words[-1] == len(per)


def test_perfect_hash():
    keys = [f"k{n}".encode() for n in range(5000)]
    h = PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(5000)) and (h.find([b"x", b"k5000", b""]) == -1).all()
    assert sorted(h.key_at.tolist()) == list(range(5000))
    assert len(read_ranks(TOKENIZER)) == 50256


def test_encode_rows(spark, reference):
    rows = [(1, "Hello world", 0), (2, None, 1), (3, "", 2), (3, "Hello world", 3), (4, "<|endoftext|>", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect())
    hello = reference.encode_ordinary("Hello world")
    assert got == sorted([(1, hello), (2, []), (3, []), (3, hello), (4, reference.encode_ordinary("<|endoftext|>"))])
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def long_text(seed, n=900):
    rng = random.Random(seed)
    return "".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice([" ", " ", " ", ", ", ". ", ".\n\n"]) for _ in range(n))


def test_pieces(spark, reference):
    ts = [long_text(1), "short", "", None, "x" * 9000, "語" * 3000, long_text(2, 4000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(ts)], "doc_id long, text string, n_pieces int")
    rows = {}
    for r in split_texts(df, "doc_id", "text").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == {0, 1, 4, 5, 6}
    for k, ps in rows.items():
        ps.sort(key=lambda r: r.piece_no)
        whole = reference.encode_ordinary(ts[k])
        assert [p.piece_no for p in ps] == list(range(1, ps[0].n_pieces + 1)) and ps[-1].token_end == len(whole)
        back = list(ps[0].ids)
        for a, b in zip(ps, ps[1:]):
            assert b.token_start == a.token_end - OVERLAP and a.ids[-OVERLAP:] == b.ids[:OVERLAP]
            back += b.ids[OVERLAP:]
        assert back == whole and all(p.n_tokens == len(p.ids) <= LIMIT for p in ps)
        assert (len(ps) > 1) == (len(whole) > LIMIT)
    assert "".join(p.text for p in rows[1]) == "short"
    assert {r.doc_id for r in split_texts(df, "doc_id", "text", only_split=True).collect()} == {k for k, p in rows.items() if len(p) > 1}


def test_cuts_are_natural_and_edits_stay_local():
    enc, t = encoder(TOKENIZER), long_text(3, 9000)

    def own(x):
        ids, _, per, _ = enc.encode([x])
        at = cuts(ids, enc.pre_tokens(x), per)
        return [tuple(ids[a:b]) for a, b in zip([0, *at], [*at, len(ids)])], at

    a, at = own(t)
    b, _ = own(t[: len(t) // 2] + " new words " + t[len(t) // 2 :])
    assert len(set(a) - set(b)) <= 3
    raw = b"".join({v: k for k, v in enc.ranks.items()}[i] for i in enc.encode([t])[0][: at[0]].tolist()).decode()
    assert raw.rstrip()[-1] in ".,"
    for bad in ({"limit": 10, "overlap": 10}, {"minimum": 0}, {"overlap": -1}):
        with pytest.raises(ValueError):
            split_texts(None, "a", "b", **bad)
