"""Folds over many distinct words at once against the heap, one word at a time, and against any rank file."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest

from tallymark.llm import byte_bpe


@pytest.mark.parametrize("own", [False, True])
def test_fold_equals_the_heap(tmp_path, own):
    rng, path = random.Random(3), P.path("byte_bpe_50k.tiktoken")
    if own:  # ranks in no order of training: a merge may open a lower one
        made = list({bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(120)})
        rng.shuffle(made)
        path = tmp_path / "ranks"
        path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % i for i, w in enumerate([*[bytes([b]) for b in range(256)], *made])))
    ranks = byte_bpe.Ranks(str(path))
    words = ["", "a", "aaaa", "aaaaa", "abababab", "é中文", "a" * 64] + ["".join(rng.choices("abc" if own else "etaoin shrdlu", k=rng.randrange(1, 30))) for _ in range(3000)]
    flat, lengths = byte_bpe.fold(words, np.array(ranks.single, np.int32), byte_bpe.Pairs(ranks))
    ends = np.cumsum(lengths)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [ranks.merged(w.encode()) for w in words]
    assert [len(x) for x in byte_bpe.fold([], np.array(ranks.single, np.int32), byte_bpe.Pairs(ranks))] == [0, 0]
