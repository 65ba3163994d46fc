"""Token tables and packing against whole-text encoding and plain bin packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabkit.llm import packing, tokens
from tabkit.llm.queries import BYTE_BPE
from tabkit.sources.workspace import new_path

TEXTS = ["one two three", None, "", "  lead", "trail  ", "it's 12.5% of l'été  à\n\n x\ty", "<|endoftext|> a", "x <|endoftext|>", "b<|endoftext|><|endoftext|>c  <|endoftext|>\n<|endof text|>", "été à la",
         "one two three", "\n", "a" * 5000, "word " * 3000, "😀 x  y z", "\r\n a \r\n"]
EXTRA = "doc_id long, text string, ids string, part string, length string, start string, base string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE_BPE)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(open(BYTE_BPE, encoding="utf-8").read())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé1 \n\t  ñ!.#😀Z")), max_size=40), min_size=1, max_size=6))
def test_pieces_encode_as_the_whole(tokenizer, encoder, texts):
    texts = [*texts, *(t.replace("#", "<|endoftext|>") for t in texts)]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table(spark, tokenizer, encoding):
    rows = [(i, t, *["x"] * 5) for i, t in enumerate(TEXTS)] + [(3, "again", *["x"] * 5), (None, "no id", *["x"] * 5)]
    path = new_path(spark, "tokens")
    tokens.write_token_table(spark.createDataFrame(rows, EXTRA), path, BYTE_BPE, 0, encoding=encoding)
    got = sorted(map(tuple, tokens.token_digest(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    want = sorted((crc(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows))
    assert sorted(r[3] for r in got) == want
    some = tokens.read_tokens(spark, path, 2, 4).select("doc_id", "n_tokens")
    assert sorted(r[0] for r in some.collect()) == [2, 3, 3, 4]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    path = new_path(spark, "tokens")
    tokens.write_token_table(nothing, path, BYTE_BPE, 0)
    assert tokens.token_digest(spark, path).count() == 0
    assert packing.pack(nothing, new_path(spark, "pieces"), BYTE_BPE, 2).count() == 0


def test_pack(spark, tokenizer):
    rows = [(i, t, *["x"] * 5) for i, t in enumerate(TEXTS)] + [(3, "again", *["x"] * 5), (None, "no id", *["x"] * 5)]
    path = new_path(spark, "pieces")
    places = packing.pack(spark.createDataFrame(rows, EXTRA).repartition(3), path, BYTE_BPE, 2, capacity=64)
    got = places.collect()
    for text in {10: TEXTS[10], 11: TEXTS[11], 1: ""}.items():
        ids = tokenizer.encode(text[1], add_special_tokens=False).ids + [2]
        mine = sorted((r for r in got if r["doc_id"] == text[0]), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 64)))
        assert [r["length"] for r in mine][1:] == [64] * (len(mine) - 1)
        for r in mine:
            assert r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    whole = packing.sequences(spark.read.parquet(path), places).collect()
    assert len(whole) == len(by) and sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=200))
def test_best_two_fit_is_a_packing(lengths):
    counts = np.bincount(lengths, minlength=41)
    plan = packing.best_two_fit(counts, 40)
    length = np.repeat(np.arange(41), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.place(length, number)
    order = np.lexsort((offset, sequence))
    ends = {}
    for s, o, n in zip(sequence[order], offset[order], length[order]):
        assert ends.get(s, 0) == o
        ends[s] = o + n
    assert max(ends.values()) <= 40 and len(ends) == plan.sequences
    bins = []                                               # first fit, longest first
    for n in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(40 - n)
        else:
            bins[at] -= n
    assert plan.sequences <= max(len(bins), -(-11 * sum(lengths) // (9 * 40)) + 1)


def test_two_fit_beats_greedy():
    """Greedy fills 6 + 3 of 10; the pair 2 + 2 fits the gap with 3 in full."""
    plan = packing.best_two_fit(np.bincount([6, 3, 2, 2], minlength=11), 10)
    sequence, _ = plan.place(np.array([6, 2, 2]), np.array([0, 0, 1]))
    assert len(set(sequence)) == 1


def test_words_of_earlier_blocks_are_not_encoded_again(monkeypatch):
    """An encoder keeps the ids of words; forgetting them changes nothing."""
    with open(BYTE_BPE, encoding="utf-8") as f:
        definition = f.read()
    blocks = [pa.array(x) for x in (["one two three", None, "two one"], ["three two one", "", "one four"], [], ["four one"], ["two\nthree"])]
    plain = [tokens.Encoder(definition, split=False).encode(b) for b in blocks]
    for kept in (1 << 20, 2):
        monkeypatch.setattr(tokens, "KEPT", kept)
        encoder, asked = tokens.Encoder(definition), []
        real = encoder._distinct
        monkeypatch.setattr(encoder, "_distinct", lambda pieces, real=real, asked=asked: asked.extend(pieces.to_pylist()) or real(pieces))
        for block, (ids, counts) in zip(blocks, plain):
            got = encoder.encode(block)
            assert got[0].tolist() == ids.tolist() and got[1].tolist() == counts.tolist()
        assert (len(asked) == len(set(asked))) == (kept > 2)
