"""Unigram token counts against the same recurrence per word."""

from __future__ import annotations

import math
import re

import pytest
from sentencepiece import SentencePieceProcessor

from tidewatch.llm import token_counts as T
from tidewatch.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def scores():
    sp, out = SentencePieceProcessor(model_file=PATH), {}
    for r in range(sp.get_piece_size()):
        if not (sp.is_control(r) or sp.is_unknown(r) or sp.is_byte(r) or sp.is_unused(r)):
            out.setdefault(sp.id_to_piece(r).encode(), -math.log(r + 2))
    return out


def count(token: bytes, scores: dict) -> int:
    best = [(0.0, 0)]
    longest = max(map(len, scores))
    for end in range(1, len(token) + 1):
        top, n = best[-1][0] + T.BYTE_SCORE, best[-1][1] + 1
        for w in range(1, min(end, longest) + 1):
            s = scores.get(token[end - w : end])
            if s is not None and best[end - w][0] + s >= top:
                top, n = best[end - w][0] + s, best[end - w][1] + 1
        best.append((top, n))
    return best[-1][1]


def test_counts_of_hard_documents(docs, hard, scores, monkeypatch):
    monkeypatch.setattr(T, "TRIE_BYTES", 4096)
    rows = [(i, t) for i, t in hard if i not in (11, 20, 21)]
    known: dict[bytes, int] = {}

    def total(text):
        words = WORD.findall((text or "").encode())
        return len(words), sum(known.setdefault(w, 0) or known.update({w: count(T.MARK + w, scores)}) or known[w] for w in words)

    few = docs.filter("doc_id is null or doc_id not in (11, 20, 21)")
    got = sorted((r.doc_id or -99, r.n_pretokens, r.n_tokens) for r in T.token_counts(few, PATH).collect())
    assert got == sorted((i or -99, *total(t)) for i, t in rows)


def test_trie_solves_prefixes_and_long_words(scores):
    words = [b"", b"a", b"ab", b"abc", b"abcd", "é☃".encode(), b"x" * 5000, b"the", b"there", b"\x00"]
    tokens = [T.MARK + w for w in words]
    assert T.solve(tokens, T.pieces(PATH)).tolist() == [count(t, scores) for t in tokens]
    assert T.solve([], T.pieces(PATH)).tolist() == []


def test_long_texts_and_none(docs, nothing):
    got = {r.doc_id: r.n_pretokens for r in T.token_counts(docs.filter("doc_id in (11, 20)"), PATH).collect()}
    assert got == {11: 1, 20: 250_000}
    assert T.token_counts(nothing, PATH).collect() == []
