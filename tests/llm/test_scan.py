"""The vectorised readers against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from tidewatch.llm import scan
from tidewatch.llm.memo import KeyTable, Memo

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_words_of_all_texts(hard):
    texts = [t for _, t in hard]
    data, offsets = scan.utf8(pa.chunked_array([texts[:3], texts[3:]], pa.string()))
    for i, j in scan.groups(offsets):
        w = scan.words(data, offsets[i : j + 1])
        got = [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        want = [x for t in texts[i:j] for x in WORD.findall((t or "").encode())]
        assert got == want
        assert np.diff(w.first).tolist() == [len(WORD.findall((t or "").encode())) for t in texts[i:j]]


def test_keys_follow_the_bytes_across_pieces():
    text = b"a" * (scan.CHUNK - 3) + b" Hello wOrld hello " + b"b" * (scan.CHUNK + 9) + b" hello"
    data, offsets = scan.utf8(pa.array([text.decode()]))
    w = scan.words(data, offsets)
    exact = scan.segment_keys(data, w.start, w.end)
    low = scan.segment_keys(data, w.start, w.end, scan.LOWER)
    assert len(w.start) == 6
    assert exact[3] == exact[5] != exact[1]
    assert low[1] == low[3] == low[5]
    alone, _ = scan.utf8(pa.array(["b" * (scan.CHUNK + 9)]))
    assert scan.segment_keys(alone, np.array([0]), np.array([len(alone)]))[0] == exact[4]


def test_an_empty_batch():
    data, offsets = scan.utf8(pa.array([], pa.string()))
    assert list(scan.groups(offsets)) == []
    data, offsets = scan.utf8(pa.array([None, ""], pa.string()))
    w = scan.words(data, offsets)
    assert len(w.start) == 0 and w.first.tolist() == [0, 0, 0]


def test_windows_stay_within_a_text():
    data, offsets = scan.utf8(pa.array(["a b c d", "c d", "b c d"]))
    w = scan.words(data, offsets)
    grams, at = scan.windows(scan.segment_keys(data, w.start, w.end), w.doc, 3)
    assert at.tolist() == [0, 1, 6] and grams[1] == grams[2] != grams[0]


def test_key_table_holds_and_forgets():
    table = KeyTable(100)
    keys = np.arange(100).astype(np.uint64) * np.uint64(table.size)  # all meet in one slot
    assert (table.find(keys) == -1).all()
    slots = table.add(keys)
    assert len(set(slots)) == 100 and (table.find(keys) == slots).all()
    assert not table.room(1)
    memo, asked = Memo(10, np.int64), []

    def solve(at):
        asked.append(len(at))
        return at * 10

    k = np.array([5, 6, 5, 7], np.uint64)
    assert memo.look_up(k, solve).tolist() == [0, 10, 0, 30]
    assert memo.look_up(k, solve).tolist() == [0, 10, 0, 30] and asked == [3]
    many = np.arange(50).astype(np.uint64)
    assert memo.look_up(many, lambda at: at).tolist()[8:] == list(range(8, 50))
