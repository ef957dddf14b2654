"""Texts without blanks: long words of languages, and long pieces of the tokenizer."""

import random
import time

import numpy as np
import pytest
import tiktoken

from marginalia.llm import bpe, langid

SCHEMA = "doc_id long, text string, lang string"


def test_long_words_are_cut_between_characters():
    rnd = random.Random(3)
    for kinds in ("aé語😀", "語", "a"):
        text = "".join(rnd.choice(kinds) for _ in range(5000))
        runs = langid._words(text)
        assert b"".join(runs) == text.encode() and max(map(len, runs)) <= langid.LONG_WORD
        assert all(len(r) > langid.LONG_WORD - 4 for r in runs[:-1]) and [r.decode() for r in runs]
    assert langid._words("one two") == [b"one", b"two"] and langid._words("x" * 128) == [b"x" * 128] and langid._words("") == []


def test_languages_without_blanks(spark):
    rnd = random.Random(4)
    letters = {"zh": [chr(c) for c in range(0x4E00, 0x4F00)], "th": [chr(c) for c in range(0x0E01, 0x0E2E)]}
    say = lambda k, n: "".join(rnd.choice(letters[k]) for _ in range(n))
    rows = [(i, say(k, 400), k) for i, k in enumerate(["zh", "th"] * 40)] + [(1000, say("zh", 1_700_000), None)]  # 5 MB
    began = time.time()
    found = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert time.time() - began < 120
    assert found[1000].lang_pred == "zh" and np.mean([found[i].lang_pred == k for i, _, k in rows[:-1]]) == 1


@pytest.mark.parametrize("kinds", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "語言文字", "z"])
def test_long_pieces(spark, kinds):
    rnd = random.Random(len(kinds))
    texts = ["".join(rnd.choice(kinds) for _ in range(n)) for n in (bpe.LONG_PIECE - 1, bpe.LONG_PIECE + 1, 3000, 300_000)]
    ranks = bpe.Bpe(bpe.default_path(), bpe.default_pattern()).ranks
    plain = tiktoken.Encoding("plain", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    began = time.time()
    found = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert time.time() - began < 60
    for row in found:
        assert np.frombuffer(row["ids"], "<u4").tolist() == plain.encode_ordinary(texts[row["doc_id"]])
