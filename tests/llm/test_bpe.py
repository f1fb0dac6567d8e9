import random
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(PATH)


@cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def public():
    return library()


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.packed(text), dtype="<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="aeinst hr'dlu.\n  \t01", max_size=300))
def test_equals_public_library_and_decodes(text):
    encoder = bpe.encoder(PATH)
    got = ids(encoder, text)
    assert got == library().encode(text, add_special_tokens=False).ids
    assert encoder.decoded(got) == text


def test_special_spellings_are_text(ours, public):
    text = "a <|endoftext|> b"
    assert ids(ours, text) == public.encode(text, add_special_tokens=False).ids and 50256 not in ids(ours, text)


def test_long_pretokens_stream(ours, public):
    rnd = random.Random(0)
    for text in ("".join(rnd.choice("abcdeilmnorstu") for _ in range(30_000)), "x" * 20_000, "ab" * 9_000, "é" * 8_000, " " * 9_000 + "a", "1" * 7_000, "=-" * 6_000):
        assert ids(ours, text) == public.encode(text, add_special_tokens=False).ids


def test_stream_keeps_a_window(ours):
    seen = 0

    def data():
        nonlocal seen
        for b in b"abcdefgh" * 20_000:
            seen += 1
            yield b

    done, most = 0, 0
    for t in ours.merges.stream(data()):
        most = max(most, seen - done)
        done += len(ours.merges.bytes_of[t])
    assert done == seen and most <= ours.merges.lookahead + bpe.WINDOW


def test_lookahead_suffices(ours):
    """Tokens that end the lookahead before a cut are the same with whatever follows."""
    rnd = random.Random(1)
    m = ours.merges
    for _ in range(60):
        text = bytes(rnd.choice(b"etaoinshrdlu") for _ in range(900))
        whole = m.merge([m.byte_id[b] for b in text])
        cut = rnd.randint(m.lookahead + 1, 800)
        part = m.merge([m.byte_id[b] for b in text[:cut]])
        at = 0
        for a, b in zip(part, whole):
            at += len(m.bytes_of[a])
            if at > cut - m.lookahead:
                break
            assert a == b


def test_long_text(ours, public, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 100)
    text = "some words, 42 of them\n\n  indented it's fine " * 50
    assert ids(ours, text) == public.encode(text, add_special_tokens=False).ids


def test_frame(spark, public):
    texts = [None, "", "  ", "hello world", "hello world", "日本語 🙂", "x" * 5000]
    df = spark.createDataFrame([(i, t, 5, "n") for i, t in enumerate(texts)] + [(None, "a", 1, "n")], "doc_id long, text string, ids int, n_tokens string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text", PATH).collect()}
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)} | {None: public.encode("a").ids}
    counts = bpe.count_tokens(df, ["doc_id"], "text", PATH).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {k: len(v) for k, v in got.items()}
    assert all(r.same for r in bpe.roundtrip(df, "doc_id", "text", PATH).collect())
    assert bpe.encode(df.limit(0), "doc_id", "text", PATH).count() == 0
