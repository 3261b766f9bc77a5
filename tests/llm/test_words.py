"""Ids of whole texts against the plain tokenizer call, on random mixtures of awkward characters."""

import random
import struct

import public_tokenizers
from tokenizers import Tokenizer

from playerday.llm.packing import WordEncoder

ALPHABET = "aAbzZéÉÀßÿŸ×÷ñÑİΣς'’sS09.,!<|>endoftext \n\t́\x1c漢🙂"


def test_ids_equal_the_plain_call_while_the_cache_overflows():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, dice = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(dice.choice(ALPHABET) for _ in range(dice.randint(0, 30))) for _ in range(5000)]
    texts += [None, "", "x <|endoftext|> y", "<|STARTOFTEXT|>", "ÀÉ Naïve foo, bar's"]
    found = list(WordEncoder(path, most_words=500).all_ids(texts, block=1000))
    assert len(found) == len(texts)
    for text, ids in zip(texts, found):
        wanted = plain.encode(text or "", add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(wanted)}I", *wanted), text
