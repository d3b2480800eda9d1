"""Token ids: round trip, keyed access, and the encoder against the library alone."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewatch.llm import token_output as T
from tidewatch.llm.queries import vocabulary
from tidewatch.llm.scan import mix, utf8

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_cuts_as_the_tokenizer_does(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "KNOWN_UNITS", 300)  # forgets now and then
    r = random.Random(2)
    texts = ["", " ", "a  b", "\n\na", "don't 's x's", "12 34a!b", None, "a b  c", "\r\n x\r\ny", " \x0b\x0c z",
             "\x1ca \x1c b", "<|endoftext|>", "x <|endoftext|> y", "日本 語", "ends in space ", "x" * 3000]
    texts += ["".join(r.choice("ab 1.\n\t'é ") for _ in range(r.randrange(14))) for _ in range(3000)]
    encode = T.Encoder(PATH)
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        data, offsets = utf8(pa.array(part, pa.string()))
        ids, sizes = encode(data, offsets)
        want = [x.ids for x in tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_encoder_gives_the_tokenizer_few_units_at_once(tokenizer):
    """What the tokenizer makes of a batch is held apart from the ids, and its memory stays with the worker."""
    import os

    encode, sizes = T.Encoder(PATH), []
    inner = encode.tokenizer

    class Told:
        def encode_batch_fast(self, texts, **options):
            sizes.append(len(texts))
            return inner.encode_batch_fast(texts, **options)

    encode.tokenizer = Told()
    text = " ".join(f"unit{k:x}" for k in range(5000))
    data, offsets = utf8(pa.array([text, "", text + " more"]))
    ids, n = encode(data, offsets)
    assert max(sizes) <= 1024 and sum(sizes) >= 5000
    assert ids.tolist() == [i for t in (text, "", text + " more") for i in tokenizer.encode(t, add_special_tokens=False).ids]
    assert n[1] == 0 and n.sum() == len(ids)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_index_is_minimal_perfect_and_refuses_foreign_keys():
    keys = mix(np.arange(20_000).astype(np.uint64))
    levels, slot = T.build_index(keys)
    assert sorted(slot) == list(range(20_000))
    index = T.Index(T.Index.pack(keys, np.arange(20_000) % 7, np.arange(20_000) * 3, np.arange(20_000) + 1))
    held, shard, offset, size = index.find(keys)
    assert held.all() and offset.tolist() == [3 * k for k in range(20_000)]
    assert shard.tolist() == [k % 7 for k in range(20_000)] and size[-1] == 20_000
    foreign, *_ = index.find(mix(np.arange(20_000, 120_000).astype(np.uint64)))
    assert foreign.mean() < 1e-3
    none, *_ = T.Index(T.Index.pack(keys[:0], keys[:0], keys[:0], keys[:0])).find(keys[:5])
    assert not none.any()


def test_round_trip_of_hard_documents(spark, docs, hard, tokenizer, tmp_path):
    rows = [(i, t) for i, t in hard if i not in (20, 21)]
    few = docs.filter("doc_id is null or doc_id not in (20, 21)")
    output = T.write(few, str(tmp_path / "ids"), PATH)
    got = [tuple(r) for r in T.documents_of(output).collect()]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(got) == Counter(want)
    # The shards one after the other are the whole sequence.
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "ids" / "ids").glob("*.bin")))
    assert len(raw) == 2 * start
    # By key: copies of an id, and keys that no document has.
    keys = spark.createDataFrame([(16, 0), (16, 1), (16, 2), (None, 1), (77, 0)], "doc_id long, copy long")
    found = {(r.doc_id, r.copy, r.n_tokens) for r in output.read(keys).collect()}
    assert {(i, c) for i, c, _ in found} == {(16, 0), (16, 1), (None, 1)}


def test_no_documents(nothing, tmp_path):
    assert T.documents_of(T.write(nothing, str(tmp_path / "none"), PATH)).collect() == []
