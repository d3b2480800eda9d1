"""Phrases of words that occur together, mined set by set (SETM).

The method keeps a relation of occurrences for each phrase length and never looks at the texts again:

1. ``R1`` holds every word with its piece and position, in that order, and is written out.
2. Groups of equal phrases are counted; those below ``min_count`` are infrequent, and so is every
   longer phrase that holds one.
3. The occurrences whose group is frequent stay (a semi-join). Merge-joining them with themselves
   where the piece is the same and the positions are adjacent gives ``R(k+1)``: two overlapping
   phrases of ``k`` words make one of ``k + 1``. A group is known by the ids of its first and its
   last ``k`` words, so no text is compared or hashed from there on.

Occurrences lie in blocks of about ``BLOCK_WORDS`` words of one language, as packed arrays. Within a
block piece and position are one number that skips one between pieces, so "same piece and adjacent" is
"differs by one", and a piece that is cut by the end of a block is followed by the next
``max_words - 1`` words, which can end a phrase but not begin one. A block posts each distinct group
once with its count: tasks add up their posts, a shuffle the rest. For the semi-join posts are dealt
by group and, where there are many blocks, by block too, so a group that fills the corpus is spread;
frequent ones return to their block with their id.

Defined results: A-Z count as a-z; a null language is ``und``; a null or empty text has no words;
rows that repeat an id are documents of their own; other columns are ignored; an empty table gives
no rows. Counts are 64-bit, products and quotients of scores exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import mix
from .spark_io import drop, split_join, staged

#: Words in a block, occurrences or posts in a row of a block, and bytes cut into words at once.
BLOCK_WORDS, ROW, SLICE = 1 << 20, 4096, 1 << 20
#: A task holds back at most so many words in the unfinished blocks of all languages together.
PENDING_WORDS = 1 << 21
#: Posts that are added up or matched together, and most blocks among them.
POSTS, BLOCKS = 1 << 20, 1 << 14
#: Breaks between pieces, as a byte that UTF-8 has not.
_BREAK = b"\xff"
_SIGNS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10
)

_LONG, _INT, _BYTES = pa.int64(), pa.int32(), pa.binary()
#: ``size`` occurrences (gap to the one before, group) and ``posts`` groups (first and last part, count).
_RELATION = pa.schema([
    ("block", _LONG), ("lang", pa.string()), ("own", _INT), ("seq", _INT),
    ("size", _INT), ("occurrences", _BYTES), ("posts", _INT), ("groups", _BYTES), ("words", _BYTES),
])
_OCCURRENCES, _GROUPS, _MATCHES = ("<i4", "<i4"), ("<i8", "<i8", "<i4"), ("<i4", "<i8")
_ASKED = ("<i8", "<i8", "<i4")


def _sql(schema: pa.Schema) -> str:
    names = {_LONG: "long", _INT: "int", _BYTES: "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _pack(arrays, kinds: tuple[str, ...]) -> bytes:
    """Arrays of one length as compressed bytes."""
    data = b"".join(np.asarray(x).astype(k).tobytes() for x, k in zip(arrays, kinds, strict=True))
    return pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    sizes = [n * np.dtype(k).itemsize for k in kinds]
    data = pa.decompress(data, sum(sizes), "zstd", asbytes=True)
    at = np.cumsum([0, *sizes])
    return [np.frombuffer(data, k, n, i) for k, i in zip(kinds, at[:-1], strict=True)]


def _unpacked(rows, size: str, data: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of all rows in order, one after the other."""
    parts = [
        _unpack(x, n, kinds)
        for n, x in zip(rows.column(size).to_pylist(), rows.column(data).to_pylist(), strict=True)
    ]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(kinds))]


def _block(block: int, lang: str, own: int, at, code, groups: tuple, words: list[bytes] | None = None) -> pa.RecordBatch:
    """A block as rows of ``ROW`` occurrences, with ``ROW`` of its groups each while there are some."""
    gap, out = np.diff(at, prepend=0), []
    for seq, i in enumerate(range(0, len(at), ROW)):
        post = [x[i : i + ROW] for x in groups]
        out.append((
            block, lang, own, seq,
            len(at[i : i + ROW]), _pack((gap[i : i + ROW], code[i : i + ROW]), _OCCURRENCES),
            len(post[0]), _pack(post, _GROUPS), words and _BREAK.join(words[i : i + ROW]),
        ))
    columns = list(zip(*out, strict=True)) or [[] for _ in _RELATION]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _RELATION, strict=True)], schema=_RELATION
    )


def _tokens(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words and breaks of texts, some at a time."""
    data = _BREAK.join(texts).translate(_SIGNS) + _BREAK
    at = 0
    while at < len(data):
        end = max(data.rfind(b" ", at, at + SLICE), data.rfind(_BREAK, at, at + SLICE)) + 1
        if end <= at:  # a word longer than a slice
            ends = [e for e in (data.find(b" ", at), data.find(_BREAK, at)) if e >= 0]
            end = min(ends) + 1
        yield data[at:end].replace(_BREAK, b" \xff ").split()
        at = end


def _occurrences(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[pa.RecordBatch]:
    """The word relation of a task, block by block."""
    pending: dict[str, list[bytes]] = {}
    block = TaskContext.get().partitionId() << 32

    def flush(lang: str, words: list[bytes], own: int) -> pa.RecordBatch:
        nonlocal block
        block += 1
        coded = pa.array(words, pa.binary()).dictionary_encode()
        code, known = coded.indices.to_numpy(), coded.dictionary
        gone = known.index(pa.scalar(_BREAK, pa.binary())).as_py()
        at = np.flatnonzero(code != gone)
        code = code[at]
        if gone >= 0:
            code = code - (code > gone)
            known = pa.concat_arrays([known[:gone], known[gone + 1 :]])
        n = np.bincount(code[at < own], minlength=len(known))
        known, name = known.to_pylist(), lang.encode() + _BREAK
        keys = b"".join([xxhash.xxh3_128_digest(name + w) for w in known])
        keys = np.frombuffer(keys, "<i8").reshape(-1, 2)
        return _block(block, lang, own, at, code, (keys[:, 0], keys[:, 1], n), known)

    for rows in batches:
        texts = rows.column("text").cast(pa.large_binary()).to_pylist()
        for lang, places in _by_value(rows.column("lang")):
            held = pending.setdefault(lang, [])
            for part in _tokens([texts[i] for i in places]):
                held += part
                while len(held) >= BLOCK_WORDS + ahead:
                    yield flush(lang, held[: BLOCK_WORDS + ahead], BLOCK_WORDS)
                    del held[:BLOCK_WORDS]
        while sum(map(len, pending.values())) > PENDING_WORDS:
            most = max(pending, key=lambda x: len(pending[x]))
            held = pending.pop(most)
            yield flush(most, held, len(held))
    for lang, held in pending.items():
        yield flush(lang, held, len(held))


def _by_value(column: pa.Array) -> list[tuple[str, np.ndarray]]:
    coded = column.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    return [(v, order[cuts[i] : cuts[i + 1]]) for i, v in enumerate(coded.dictionary.to_pylist())]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the groups of a task's blocks, added up while they are at hand."""
    schema = pa.schema([("g1", _LONG), ("g2", _LONG), ("n", _LONG), ("lang", pa.string()), ("word", _BYTES)])

    def flush(held: list, langs: list, words: list) -> pa.RecordBatch:
        g1, g2, n = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((g2, g1))
        g1, g2 = g1[order], g2[order]
        new = np.flatnonzero(np.append(True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])))
        n = np.add.reduceat(n[order].astype(np.int64), new)
        size, first = len(new), order[new]
        lang = word = pa.nulls(size)
        if words:
            word = [words[i] for i in first]
            lang = [langs[i] for i in np.repeat(np.arange(len(held)), [len(h[0]) for h in held])[first]]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type)
             for x, f in zip((g1[new], g2[new], n, lang, word), schema, strict=True)], schema=schema,
        )

    held, langs, words, size = [], [], [], 0
    for rows in batches:
        columns = (rows.column(c).to_pylist() for c in ("posts", "groups", "lang", "words"))
        for n, data, lang, text in zip(*columns, strict=True):
            if not n:
                continue
            held.append(_unpack(data, n, _GROUPS))
            langs.append(lang)
            size += n
            if text is not None:
                words += text.split(_BREAK)
            if size >= POSTS:
                yield flush(held, langs, words)
                held, langs, words, size = [], [], [], 0
    if held:
        yield flush(held, langs, words)


def _dealt(g1: np.ndarray, g2: np.ndarray, parts: int) -> np.ndarray:
    return (mix(mix(g1.view(np.uint64)) + g2.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _frequent(relation: DataFrame, found: DataFrame) -> DataFrame:
    """The frequent groups of each block with their ids, packed: ``block``, ``size``, ``matches``."""
    posts, blocks = relation.agg(F.sum("posts"), F.count_distinct("block")).first()
    spread = -(-(blocks or 1) // BLOCKS)
    parts = -(-(posts or 1) // (2 * POSTS * spread))

    def dealt(block: int, held: list) -> pa.RecordBatch:
        """All posts of a block, one row for each part of them."""
        g1, g2, local = (np.concatenate(x) for x in zip(*held, strict=True))
        part = _dealt(g1, g2, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        own = [order[i:j] for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part[o[0]] for o in own], _INT), pa.array([hash(block) % spread] * len(own), _INT),
                pa.array([block] * len(own), _LONG), pa.array([len(o) for o in own], _INT),
                pa.array([_pack((g1[o], g2[o], local[o]), _ASKED) for o in own], _BYTES),
            ],
            ["part", "salt", "block", "size", "asked"],
        )

    def ask(batches):
        held, at = [], None  # the rows of a block follow each other
        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("block", "seq", "posts", "groups"))
            for block, seq, n, data in zip(*columns, strict=True):
                if held and block != at:
                    yield dealt(at, held)
                    held = []
                g1, g2, _ = _unpack(data, n, _GROUPS)
                held.append((g1, g2, np.arange(n) + seq * ROW))
                at = block
        if held:
            yield dealt(at, held)

    def deal(batches):
        for rows in batches:
            g1, g2 = rows.column("g1").to_numpy(), rows.column("g2").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_dealt(g1, g2, parts)), *rows.columns], ["part", "g1", "g2", "gid"])

    def match(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and known.num_rows:
            key1, key2 = (np.unique(known.column(c).to_numpy()) for c in ("g1", "g2"))
            at = lambda a, b: np.searchsorted(key1, a) * (len(key2) + 1) + np.searchsorted(key2, b)
            keys = at(known.column("g1").to_numpy(), known.column("g2").to_numpy())
            order = np.argsort(keys)
            keys, k1, k2, gid = (x[order] for x in (keys, *(known.column(c).to_numpy() for c in ("g1", "g2", "gid"))))
            columns = (asked.column(c).to_pylist() for c in ("block", "size", "asked"))
            for block, n, data in zip(*columns, strict=True):
                g1, g2, local = _unpack(data, n, _ASKED)
                place = np.minimum(np.searchsorted(keys, at(g1, g2)), len(keys) - 1)
                hit = np.flatnonzero((k1[place] == g1) & (k2[place] == g2))
                if len(hit):
                    out.append((block, len(hit), _pack((local[hit], gid[place[hit]]), _MATCHES)))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (_LONG, _INT, _BYTES), strict=True)], ["block", "size", "matches"])

    asked = relation.filter("posts > 0").select("block", "seq", "posts", "groups").mapInArrow(
        ask, "part int, salt int, block long, size int, asked binary"
    )
    known = found.select("g1", "g2", "gid").mapInArrow(deal, "part int, g1 long, g2 long, gid long").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    )
    return asked.groupBy("part", "salt").cogroup(known.groupBy("part", "salt")).applyInArrow(
        match, "block long, size int, matches binary"
    )


def _longer(rows: pa.Table, frequent: pa.Table) -> pa.Table:
    """One block of the next relation: the frequent occurrences merged with themselves one further."""
    if not rows.num_rows or not frequent.num_rows:
        return _RELATION.empty_table()
    rows = rows.take(pa.array(np.argsort(rows.column("seq").to_numpy())))
    gap, code = _unpacked(rows, "size", "occurrences", _OCCURRENCES)
    local, gid = _unpacked(frequent, "size", "matches", _MATCHES)
    known = np.full(max(int(code.max()), int(local.max())) + 1, -1, np.int64)
    known[local] = gid
    stay = np.flatnonzero(known[code] >= 0)
    at, code = np.cumsum(gap, dtype=np.int64)[stay], code[stay].astype(np.int64)
    first = np.flatnonzero(at[1:] == at[:-1] + 1)
    pairs, place = np.unique(code[first] * len(known) + code[first + 1], return_inverse=True)
    at, own = at[first], int(rows.column("own")[0].as_py())
    n = np.bincount(place[at < own], minlength=len(pairs))
    groups = known[pairs // len(known)], known[pairs % len(known)], n
    return pa.Table.from_batches(
        [_block(rows.column("block")[0].as_py(), rows.column("lang")[0].as_py(), own, at, place, groups)]
    )


def _numbered(groups: DataFrame, size: int) -> DataFrame:
    """Frequent groups with an id each, written out, so that the ids stay the same."""
    gid = (F.monotonically_increasing_id() * 8 + size).alias("gid")
    return staged(groups.select(gid, "*"), f"phrases{size}")


def phrases(docs: DataFrame, min_count: int, max_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Number of words per language, and the frequent phrases of 1, 2, ... ``max_words`` words.

    Phrases have ``gid``, ``lang``, ``words``, their count ``a``, the counts ``heads`` of their first
    1, 2, ... words and ``tails`` of their last ones, and ``inner``, the ids of phrases of two words
    or more within them.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")
    ).filter("length(text) > 0")
    relation = staged(
        texts.mapInArrow(
            lambda b: _occurrences((x for x in b if x.num_rows), max_words - 1), _sql(_RELATION)
        ),
        "words",
    )

    def counted(relation: DataFrame, *more: str) -> DataFrame:
        added = relation.select("posts", "groups", "lang", "words").mapInArrow(
            _added, "g1 long, g2 long, n long, lang string, word binary"
        )
        return added.groupBy("g1", "g2", *more).agg(F.sum("n").alias("a"))

    longs = F.array().cast("array<long>")
    words = staged(counted(relation, "lang", "word"), "counts")
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    found = [
        _numbered(
            words.filter(F.col("a") >= min_count).select(
                "g1", "g2", "lang", F.array("word").alias("words"), "a",
                longs.alias("heads"), longs.alias("tails"), longs.alias("inner"),
            ), 1,
        )
    ]
    for size in range(2, max_words + 1):
        matches = _frequent(relation, found[-1])
        longer = (
            relation.select("block", "lang", "own", "seq", "size", "occurrences").groupBy("block")
            .cogroup(matches.select((F.col("block") + 0).alias("block"), "size", "matches").groupBy("block"))
            .applyInArrow(_longer, _sql(_RELATION))
        )
        after = staged(longer, f"pairs{size}")
        drop(relation)
        relation = after
        more = counted(relation).filter(F.col("a") >= min_count)
        found.append(_numbered(_described(more, found[-1], size), size))
    drop(relation)
    return sizes, found


def _described(counted: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """Groups of two overlapping phrases with the words and counts of their parts."""
    columns = ["lang", "words", "a", "heads", "tails", "inner"]
    first = shorter.select(F.col("gid").alias("g1"), F.struct(*columns).alias("p"))
    last = shorter.select(F.col("gid").alias("g2"), F.struct(*columns).alias("s"))
    inner = F.array_union(F.array_union("p.inner", "s.inner"), F.array("g1", "g2"))
    return split_join(split_join(counted, first, "g1"), last, "g2").select(
        "g1", "g2", "p.lang",
        F.concat("p.words", F.slice("s.words", -1, 1)).alias("words"), "a",
        F.concat("p.heads", F.array("p.a")).alias("heads"),
        F.concat("s.tails", F.array("s.a")).alias("tails"),
        (inner if size > 2 else F.array().cast("array<long>")).alias("inner"),
    )


def _exact(x: Column | str) -> Column:
    return F.col(x).cast("decimal(20,0)") if isinstance(x, str) else x.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, min_count: int = 30, max_words: int = 4, cover_percent: int = 80, top: int = 2000
) -> DataFrame:
    """The phrases of each language whose parts occur together most.

    Returns ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of its parts at
    the cut where they hold together least), ``n`` (words of the language), ``score`` and
    ``cut`` (words before the cut). The score is 2000000 * a / (l + r), rounded down. Phrases that
    lie in a longer frequent one with ``cover_percent`` of their count are left out, and the first
    ``top`` of each language reported: by score, count and then the bytes of the phrase.
    """
    sizes, found = phrases(docs, min_count, max_words)
    every = found[1].drop("g1", "g2")
    for more in found[2:]:
        every = every.unionByName(more.drop("g1", "g2"))
    within = (
        every.filter("size(inner) > 0").select(F.explode("inner").alias("gid"), F.col("a").alias("most"))
        .groupBy("gid").agg(F.max("most").alias("most"))
    )
    hidden = F.coalesce(_exact("most") * 100 >= _exact("a") * cover_percent, F.lit(False))
    cuts = F.expr("""array_min(transform(sequence(1, size(heads)), k -> named_struct(
        'score', cast(a as decimal(20,0)) * 2000000 div
            (cast(heads[k - 1] as decimal(20,0)) + cast(tails[size(tails) - k] as decimal(20,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k])))""")
    shown = (
        every.join(within, "gid", "left").filter(~hidden)
        .select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "a", cuts.alias("c"))
        .select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.col("c.k").cast("long").alias("cut"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = shown.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"
    )


def oracle_sql(min_count: int = 30, cover_percent: int = 80, top: int = 2000) -> str:
    """The same for phrases of 2 to 4 words in DuckDB's SQL, from all phrases of the texts."""
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
pieces AS (
    SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
words AS (
    SELECT lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM pieces),
spots AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM spots, (SELECT unnest([1, 2, 3, 4]) AS k) AS sizes WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
    SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r,
        (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) AS c
    JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : j], ' ')
    JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
    SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k)) AS s FROM cand), (SELECT unnest([2, 3]) AS m) AS inner_sizes
    WHERE m < k AND s + m - 1 <= k
    UNION ALL
    SELECT lang, a, array_to_string(w[k - 1 : k], ' ') FROM cand WHERE k > 2),
covered AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
shown AS (
    SELECT b.* FROM best AS b LEFT JOIN covered AS v ON v.lang = b.lang AND v.phrase = b.phrase
    WHERE v.most IS NULL OR 100 * v.most::HUGEINT < {cover_percent} * b.a::HUGEINT),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM shown)
SELECT lang, rank, phrase, a, l, r, n.n AS n, score::BIGINT AS score, j AS cut
FROM ranked JOIN n USING (lang) WHERE rank <= {top}
"""
