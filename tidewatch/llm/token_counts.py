"""Unigram token counts by dynamic programming over a trie that pre-tokens share.

A pre-token is a word with the piece vocabulary's word mark before it. Its tokens are those of the
segmentation with the highest sum of piece scores. The best sum for a prefix does not depend on
what follows, so the distinct pre-tokens of a batch are put in a trie, level by level, and every
node is solved once from its ancestors; the node a pre-token ends at holds its token count. Counts
of pre-tokens stay known within a worker. The pass over the documents needs no shuffle.

Piece scores: the vocabulary file lists its pieces by rank; piece ``r`` scores ``-ln(r + 2)``, the
log-probability of a Zipf law up to a constant per token that a vocabulary-sized normaliser would
add. A byte no piece covers costs one token that scores ``BYTE_SCORE``. Ties go to the longer last
piece.

Defined results: null and empty texts have no pre-tokens; null ids and repeated rows stay rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo
from .scan import EXACT, groups, mix, segment_keys, utf8, words
from .spark_io import text_rows

MARK = "▁".encode()
BYTE_SCORE = -20.0
#: Distinct pre-tokens a worker remembers at most, and bytes of pre-tokens in one trie.
KNOWN, TRIE_BYTES = 1 << 20, 1 << 20
#: Bytes of the longest word that goes into a trie.
DEEPEST = 1 << 10
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def scores_of(path: str) -> dict[bytes, float]:
    """Score of every piece of a sentencepiece vocabulary, by rank."""
    from sentencepiece import SentencePieceProcessor

    sp, out = SentencePieceProcessor(model_file=path), {}
    for rank in range(sp.get_piece_size()):
        if sp.is_control(rank) or sp.is_unknown(rank) or sp.is_byte(rank) or sp.is_unused(rank):
            continue
        out.setdefault(sp.id_to_piece(rank).encode(), -float(np.log(rank + 2)))
    return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Piece keys (sorted) and scores by length in bytes."""
    found: dict[int, dict[int, float]] = {}
    for raw, score in scores_of(path).items():
        found.setdefault(len(raw), {})[key_of(raw)] = score
    out = {}
    for size, scores in sorted(found.items()):
        keys = np.array(list(scores), _U)
        order = np.argsort(keys)
        out[size] = (keys[order], np.array(list(scores.values()))[order])
    return out


def solve_alone(token: bytes, scores: dict[bytes, float]) -> int:
    """Token count of one pre-token, byte by byte."""
    longest = max(map(len, scores), default=1)
    best, used = [0.0], [0]
    for end in range(1, len(token) + 1):
        top, n = best[-1] + BYTE_SCORE, used[-1] + 1
        for w in range(1, min(end, longest) + 1):
            score = scores.get(token[end - w : end])
            if score is not None and best[end - w] + score >= top:
                top, n = best[end - w] + score, used[end - w] + 1
        best.append(top)
        used.append(n)
    return used[-1]


def key_of(raw: bytes) -> int:
    """Key of a byte string, as the trie builds it byte by byte."""
    h = 0
    for b in raw:
        h = (h * _STEP + int(EXACT[b])) % (1 << 64)
    return int(mix(np.array([h], _U))[0])


def solve(tokens: list[bytes], vocabulary: dict) -> np.ndarray:
    """Token counts of distinct pre-tokens."""
    sizes = np.array([len(t) for t in tokens])
    order = sorted(range(len(tokens)), key=tokens.__getitem__)
    flat = np.frombuffer(b"".join(tokens[i] for i in order), np.uint8)
    size = sizes[order]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    node = np.zeros(len(tokens), np.int64)  # where each token's path stands
    live = np.arange(len(tokens))
    count = np.zeros(len(tokens), np.int64)
    widths = list(vocabulary)
    # History of the last levels: parent links, path hashes by node of each level.
    parents, bests, used, hashes = [], [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, _U)]
    deepest = max(widths, default=1)
    powers = np.array([pow(_STEP, k, 1 << 64) for k in range(deepest + 1)], _U)
    depth = 0
    while len(live):
        ended = size[live] == depth
        count[live[ended]] = used[-1][node[ended]]
        live, node = live[~ended], node[~ended]
        if not len(live):
            break
        byte = flat[begin[live] + depth]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        above, letter = node[fresh], byte[fresh]
        node = np.cumsum(fresh) - 1
        depth += 1
        parents.append(above)
        path = hashes[-1][above] * _U(_STEP) + EXACT[letter]
        best = bests[-1][above] + BYTE_SCORE
        taken = used[-1][above] + 1
        # Walk up: the ancestor ``w`` levels above, for each width a piece may have.
        up, at = np.arange(len(above)), 0
        for w in range(1, min(depth, deepest) + 1):
            up = parents[-1 - at][up]
            at += 1
            if w not in vocabulary:
                continue
            keys, scores = vocabulary[w]
            piece = mix(path - hashes[-w][up] * powers[w])
            spot = np.minimum(np.searchsorted(keys, piece), len(keys) - 1)
            sum_ = bests[-w][up] + scores[spot]
            better = (keys[spot] == piece) & (sum_ >= best)
            best = np.where(better, sum_, best)
            taken = np.where(better, used[-w][up] + 1, taken)
        hashes.append(path)
        bests.append(best)
        used.append(taken)
        if len(parents) > deepest:  # older levels are out of reach of any piece
            del parents[0], bests[0], used[0], hashes[0]
    out = np.empty(len(tokens), np.int64)
    out[order] = count
    return out


def _counted(at: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, path: str):
    """Token counts of the words at some places, in tries of bounded size."""
    out, size = np.zeros(len(at), np.int64), np.cumsum(end[at] - start[at])
    for part in _runs(size):
        # A word too long to share its path with many others would only make the trie deep.
        long = part[end[at[part]] - start[at[part]] > DEEPEST]
        part = np.setdiff1d(part, long)
        raw = [MARK + data[start[k] : end[k]].tobytes() for k in at[part]]
        out[part] = solve(raw, pieces(path))
        for k in long:
            raw = MARK + data[start[at[k]] : end[at[k]]].tobytes()
            out[k] = solve_alone(raw, scores_of(path))
    return out


def _runs(size: np.ndarray):
    """Consecutive places whose sizes, given as running sums, come to about ``TRIE_BYTES``."""
    number = size // TRIE_BYTES
    for k in np.unique(number):
        yield np.flatnonzero(number == k)


@functools.lru_cache(maxsize=2)
def _known(path: str) -> Memo:
    return Memo(KNOWN, np.int32)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` of every document.

    ``path`` names a sentencepiece vocabulary file that every executor has.
    """

    def run(batches):
        known = _known(path)
        for rows in batches:
            data, offsets = utf8(rows.column("text"))
            for i, j in groups(offsets):
                w = words(data, offsets[i : j + 1])
                keys = segment_keys(data, w.start, w.end)
                counts = known.look_up(keys, lambda at, w=w: _counted(at, data, w.start, w.end, path))
                total = np.bincount(w.doc, counts, j - i)[: j - i].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").slice(i, j - i), pa.array(np.diff(w.first)), pa.array(total)],
                    ["doc_id", "n_pretokens", "n_tokens"],
                )

    return text_rows(docs, F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long"
    )
