"""Pieces of texts: encoded joined and once, told apart by their bytes, forgotten when the pool is full."""

import random

import numpy as np
from tokenizers import Tokenizer

import public_tokenizers
from larder.llm import token_output
from larder.llm.pretokens import JOINED, PiecePool

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pool(pieces=1 << 20):
    with open(PATH, encoding="utf-8") as f:
        own = token_output._encoder(f.read())
    return PiecePool(own.encode, own.n_bytes, own.whole, pieces)


def test_pieces_are_encoded_joined_and_once():
    seen, mine = [], pool()
    encode, mine.encode = mine.encode, lambda texts: (seen.extend(texts), encode(texts))[1]
    words = [f"w{i}é" for i in range(5000)]
    rnd = random.Random(3)
    for _ in range(3):
        texts = [" ".join(["x", *rnd.sample(words, len(words))]) for _ in range(4)]
        assert len(mine.texts(texts)) == 4
    # the first words of the texts, and the 5,000 pieces in strings of JOINED; before: each piece by itself
    assert len(seen) == 3 * 4 + -(-len(words) // JOINED)


def test_odd_pieces_equal_the_tokenizer_while_the_pool_forgets():
    own, mine, rnd = Tokenizer.from_file(PATH), pool(50), random.Random(5)
    odd = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "x\n  b", "\n ", "　 b", "  \n  ", "<|endoftext|>", "é ñ", "日本 y", "don't 's",
           "\x1c x", "\x85 q", "0 1 22", "\0", "a", "b", "\t", "\n", "z" * 90]
    for _ in range(60):
        texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(12))) for _ in range(30)] + [""]
        want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert mine.texts(texts) == want
    assert mine.texts([]) == []
    assert len(mine.pieces) <= 50


def test_ids_that_do_not_add_up_are_encoded_one_by_one():
    mine = pool()
    right = mine.texts(["one two three", "four  five"])
    wrong = PiecePool(mine.encode, np.zeros_like(mine.n_bytes), mine.whole)
    assert wrong.texts(["one two three", "four  five"]) == right
