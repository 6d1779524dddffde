"""Texts are cut where a pre-token starts, so that a word is encoded once whatever signs follow it."""

import random
import re

import pytest

from caseflow.llm.tokens import LETTERS, WordEncoder, tokenizer

ODD = ["a", "Z", "é", "漢", "Дом", "ƻ", "́", "'s", "'", "'re", ".", ",.", "<|", "|>", "9", "²", "½", "_", "’", " ", "  ", "\n", "\n\n", "\t", "\r\n",
       "\x85", "\x1c", "\x01", "　", "​", "😀", "word", "them", "<|endoftext|>"]


def odd_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD[:-1] if i % 4 else ODD, k=rng.randint(0, 12))) for i in range(n)]


def fresh(ids: bool) -> WordEncoder:
    enc = WordEncoder(None, ids=ids)
    enc.cache, enc.heads = {}, {}
    return enc


def test_words_are_encoded_once_whatever_signs_follow():
    words, signs = [f"word{c}" for c in "abcdefgh"], [",", ".", "!", ")", ";", "?"]
    texts = ["x " + " ".join(w + s for w in words for s in signs), "x " + "\n".join(w + s for w in words for s in signs) + "."]
    for ids in (True, False):
        enc = fresh(ids)
        enc(texts)
        assert len(enc.cache) <= 2 * len(words) + len(signs) + 2  # with and without the space, signs, line ends


def test_every_letter_of_a_run_is_one_for_the_tokenizer():
    letters = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{LETTERS}]", c)]
    assert len(letters) > 800
    assert len(tokenizer(None).pre_tokenizer.pre_tokenize_str(" " + "".join(letters))) == 1


@pytest.mark.parametrize("seed", range(3))
def test_odd_parts_are_encoded_as_in_the_text(seed):
    tok, texts = tokenizer(None), odd_texts(seed, 4000)
    want = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    ids, count = fresh(True), fresh(False)
    assert ["".join(ids.parts(t)) for t in texts] == texts
    for k in range(0, len(texts), 500):
        got = [b"".join(x) for x in ids(texts[k:k + 500])]
        assert [[int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] for raw in got] == want[k:k + 500]
        assert [sum(x) for x in count(texts[k:k + 500])] == list(map(len, want[k:k + 500]))


def test_other_pre_tokenizers_are_cut_at_spaces_only():
    enc = fresh(True)
    enc.byte_level = False
    assert enc.parts("one, two.\nthree  four") == ["one,", " two.\nthree  four"]
