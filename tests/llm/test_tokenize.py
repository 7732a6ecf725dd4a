"""Encodings against a second implementation of the tokenizer, on texts short and long."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from drawloom.llm import tokenize


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids if s else []


def texts():
    rnd = random.Random(11)
    out = ["", " ", "a", "<|endoftext|> x", "it's  WE'LL\r\n\t x  ", "ﬁnal 👩‍🔬 naïve  الجلسة", "  \n\n  ", "x" * 5000, "ab" * 3000, "0123456789" * 900, " " * 4000 + "z", "\n" * 3000, "=" * 7000]
    for n in (200, 2000, 9000):
        out += ["".join(rnd.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "the ing and", "é漢字🎲", "01", "-=", "aA1 .\n", " \t\n")]
    return out


def test_trees_agree_with_plain_encoding(plain):
    for long_run in (16, 64, 1024):
        e = tokenize.Encoder(tokenize.default_vocabulary(), long_run)
        for t in texts():
            assert e.encode(t) == plain(t), (long_run, t[:40])


GAPS = ["", " ", "  ", "\n", "\n\n", "\r\n\r\n", " \n\n", "\t", "\t ", "\n ", "\u00a0", "\u2003\n", "\x1c", "'", "'s", " 'll"]


def around_runs(size):
    """White space and signs before and after runs of letters, digits, signs and white space."""
    runs = ["a" * size, "ab" * (size // 2), "7" * size, "=-" * (size // 2), " " * size, "\n" * size, "é" * size, "漢" * size, "\x1c" * size]
    return [f"foo{a}{r}{b}" for r in runs for a in GAPS for b in (*GAPS, " bar", "\n\nbar", "1", "\n\n" + "b" * size)]


def test_line_ends_before_long_runs(plain):
    e = tokenize.Encoder(tokenize.default_vocabulary())
    assert e.encode("foo\n\n" + "a" * 2000) == plain("foo\n\n" + "a" * 2000)
    for size in (8, 63, 64, 65, 130, 1100):
        for t in around_runs(size):
            assert e.encode(t) == plain(t), t[:40]
    assert e.trees > 5_000 and e.joins > e.trees


def test_parts_of_any_size_give_the_same(plain):
    e = tokenize.Encoder(tokenize.default_vocabulary(), 16)
    rnd = random.Random(5)
    for piece in (16, 50, 200, 4096):
        every = around_runs(90) + ["".join(rnd.choice(GAPS + ["word", "two words", "x" * 30, "12", "…", "a" * 300]) for _ in range(60)) for _ in range(60)] + texts()
        for t in every if piece in (50, 4096) else every[::7]:
            parts = list(tokenize.cut_text(t, piece, e.cut))
            assert b"".join(r for _, r, _ in parts).decode() == t
            assert tokenize.join_parts(e, [(n, tokenize.encode_part(e, r, ends)) for n, r, ends in parts]) == plain(t), (piece, t[:40])


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab1é漢.'s \n\r\t\x1c\u00a0"), max_size=300), st.integers(8, 40), st.integers(4, 60))
def test_any_text(plain, t, long_run, piece):
    e = tokenize.encoder(None, long_run)
    assert e.encode(t) == plain(t)
    assert tokenize.join_parts(e, [(n, tokenize.encode_part(e, r, x)) for n, r, x in tokenize.cut_text(t, piece, e.cut)]) == plain(t)


def test_every_white_space_sign_is_cut_alike(plain):
    e = tokenize.encoder()
    for c in [chr(i) for i in range(0x3100) if chr(i).isspace() or i < 33]:
        t = f"a{c}{c}b{c}" + "x" * 99
        assert e.encode(t) == plain(t), hex(ord(c))


def test_encode_over_tasks(spark, plain):
    rows = [(i, t) for i, t in enumerate([*texts(), None, "word and another, word " * 400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (300, 1 << 18):
        got = {r.doc_id: r.ids for r in tokenize.encode(df, "doc_id", "text", long_run=64, piece_chars=piece).collect()}
        assert got == {i: plain(t) for i, t in rows}
    n = {r.doc_id: r.n_tokens for r in tokenize.encode(df, "doc_id", "text", count_only=True, piece_chars=300).collect()}
    assert n == {i: len(plain(t)) for i, t in rows}


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string")
    assert [r.ids for r in tokenize.encode(df, "doc_id", "text").collect()] == [[31642], [31642]]
    assert tokenize.encode(df.where("false"), "doc_id", "text").count() == 0
