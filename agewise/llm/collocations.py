"""Phrase collocation mining: each language's best phrases of two and three words.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and these at blanks and tabs
into words.  ``f`` counts a phrase's contiguous occurrences within pieces of a language, ``n`` all its
words.  Candidates have ``a = f >= 10``; cutting one after its first words gives ``l`` and ``r`` and the
score ``floor(1000000 a a / (l r))``; the lowest cut counts (ties: the shortest first part).  A two-word
candidate that a three-word candidate contains goes if ``100 f(longer) >= 50 a``.

Method, best-first branch and bound:

1. A scan counts words, another one pairs of words found 10 times or more (no other can grow to a
   candidate).  They give every pair's exact score, and bounds for what grows from it: as ``a`` never exceeds the count of a part, no phrase that begins with ``x y`` scores
   above ``1000000 f(x y) / f(x)``, and none that ends with ``y z`` above ``1000000 f(y z) / f(z)``.
2. Each language gets a bar: the score of its ``WIDTH``-th best pair.  The frontier is what may matter at or
   above it: triples whose two bounds reach the bar, and triples that contain a pair at or above the bar
   (which they may remove).  One scan counts the frontier's triples; all of these counts are exact.
3. A language is settled if at least ``top`` phrases at or above its bar survive: all others, ties of the
   last one apart, are below.  The bar of the others goes down (``GROW`` times as many pairs, in the end to
   zero, where the frontier is everything) and step 2 is repeated for them alone.

Scans merge equal keys, 64-bit word fingerprints that include the language, and send the partial counts
packed, a row for each shuffle partition, where a task adds them up.  Bars come from counts by language and
score (a million and one at most), and ranks from ranks within ``SALTS`` parts of each language, so a language
may hold all rows.  What is counted reaches the tasks as bitmaps of a fixed size (``BITS``); what these let
through in error is counted like the rest and does no harm.  Words go with their counts, so two words with
one fingerprint show: the scan is then repeated with other fingerprints (two that only ever met in the same
batch would not show, with a chance of 2**-63 a pair).  Products are decimals of up to 37 digits, divided
as integers.

Defined results: null texts are empty, a null lang is ``und``; rows are not told apart by doc_id, repeated
rows count each time; a language with fewer survivors has fewer rows; an empty table has none.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agewise.llm.frames import bytes_and_offsets, partitions, slices
from agewise.llm.hashing import PIECE, U, mix, signed, word_hashes
from agewise.session import materialize

LEAST, TOP, SCALE = 10, 2000, 1000000
#: Pairs that the first bar lets in, as a multiple of ``top``, and by how much their number grows.
WIDTH, GROW = 2, 8
#: Bits of each of the frontier's bitmaps (2 MB).
BITS = 1 << 24
#: Different keys (words: with their texts) that a task holds before it sends their counts.
HELD, HELD_WORDS = 1 << 18, 1 << 16
#: Parts of each language that are ranked on their own first.
SALTS = 64
_HARD = np.zeros(256, bool)
_HARD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAKS = _HARD.copy()
_BREAKS[[0x20, 0x09]] = True
_LOWER = {c: c + 32 for c in range(65, 91)}
_M = mix(np.arange(101, 106, dtype=U)) | U(1)


def words_of(data: np.ndarray, offsets: np.ndarray, salt: int):
    """Fingerprint, start and end of each word of the rows, its row, and whether the next word follows it in its piece."""
    h, start, end, row = word_hashes(data, offsets, breaks=_BREAKS)
    h = mix(h + U(salt)) | U(1)  # never zero, which stands for no word
    hard = np.cumsum(_HARD[data], dtype=np.int32) if len(data) else np.zeros(0, np.int32)
    follows = np.zeros(len(h), bool)
    if len(h) > 1:
        follows[:-1] = (hard[start[1:]] == hard[end[:-1] - 1]) & (row[1:] == row[:-1])
    return h, start, end, row, follows


def mixed(columns) -> np.ndarray:
    key = np.zeros(len(columns[0]), U)
    for c, m in zip(columns, _M, strict=False):
        key = mix(key + c * m)
    return key


def merged(columns, counts: np.ndarray):
    """Keys with summed counts, in the order of their mixed values, and the place of each in ``columns``: equal keys
    are one row, but for two keys with one mixed value, whose rows may stay apart (a later merge adds them up)."""
    order = np.argsort(mixed(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0], order[first]


class _Sums:
    """Counts by keys of several columns, merged as they come."""

    def __init__(self, width: int, held: int):
        self.width, self.held, self.parts, self.n = width, held, [], 0

    def add(self, columns, counts: np.ndarray | None = None) -> np.ndarray:
        keys, counts, at = merged(columns, np.ones(len(columns[0]), np.int64) if counts is None else counts)
        self.parts.append((keys, counts))
        self.n += len(counts)
        return at

    def full(self) -> bool:
        """Whether there are too many keys to hold, also after another merge."""
        if self.n >= self.held:
            self.parts = [self.take()]
            self.n = len(self.parts[0][1])
        return 2 * self.n >= self.held

    def take(self):
        if not self.parts:
            return [np.zeros(0, U)] * self.width, np.zeros(0, np.int64)
        keys, counts, _ = merged([np.concatenate(c) for c in zip(*(k for k, _ in self.parts), strict=True)],
                                 np.concatenate([n for _, n in self.parts]))
        self.parts, self.n = [], 0
        return keys, counts


def lang_code(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _pieces(batch: pa.RecordBatch, salt: int):
    """Of some rows at a time: each word's fingerprint (with its language's), where it stands, and whether the next one follows."""
    data, off = bytes_and_offsets(batch.column("text"))
    names = batch.column("lang").to_pylist()
    codes = {x: U(lang_code(x)) for x in set(names)}
    of = np.array([codes[x] for x in names], U)
    for a, b in slices(off, PIECE):
        part = data[off[a]:off[b]]
        h, start, end, row, follows = words_of(part, off[a:b + 1] - off[a], salt)
        yield part, mix(h ^ of[a:b][row]) | U(1), start, end, row + a, follows, names


_SENT = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary())])
_SENT_SQL = "bucket int, langs array<string>, keys binary, counts binary, words binary"


def _sent(keys, counts: np.ndarray, buckets: int, langs=None, words: dict | None = None):
    """Partial counts, packed: a row for each bucket of keys (by the mixed values, in whose order they are).

    ``words``: a key's place of its language in ``langs``, a blank and its word."""
    cuts = np.searchsorted(mixed(keys), [U((i << 64) // buckets) for i in range(1, buckets)]) if len(counts) else []
    rows = []
    for i, (s, e) in enumerate(zip([0, *cuts], [*cuts, len(counts)], strict=True)):
        if e > s:
            own = [k[s:e] for k in keys]
            spelled = None if words is None else b"\n".join([words[x] for x in own[0].tolist()])
            rows.append((i, langs, np.concatenate(own).tobytes(), counts[s:e].tobytes(), spelled))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _words(salt: int, buckets: int):
    """Partial counts of each language's words, with the words."""
    def run(batches):
        sums, langs, words = _Sums(1, HELD), {}, {}
        for batch in batches:
            for data, h, start, end, row, _, names in _pieces(batch, salt):
                text, at = data.tobytes().lower(), sums.add([h])
                for x, s, e, r in zip(h[at].tolist(), start[at].tolist(), end[at].tolist(), row[at].tolist(), strict=True):
                    if x not in words:
                        words[x] = b"%d %b" % (langs.setdefault(names[r], len(langs)), text[s:e])
                if len(words) >= HELD_WORDS:
                    yield from _sent(*sums.take(), buckets, list(langs), words)
                    langs, words = {}, {}
        yield from _sent(*sums.take(), buckets, list(langs), words)
    return run


def _pairs(salt: int, buckets: int, bits: int, frequent):
    """Partial counts of pairs of frequent words that follow one another."""
    def run(batches):
        flags = np.unpackbits(np.frombuffer(zlib.decompress(frequent.value[_FREQUENT]), np.uint8), bitorder="little")
        sums = _Sums(2, HELD)
        for batch in batches:
            for _, h, _, _, _, follows, _ in _pieces(batch, salt):
                often = flags[_slots(h, U(0), bits)] > 0
                i = np.flatnonzero(follows[:-1] & often[:-1] & often[1:])
                sums.add([h[i], h[i + 1]])
                if sums.full():
                    yield from _sent(*sums.take(), buckets)
        yield from _sent(*sums.take(), buckets)
    return run


_COUNTED = pa.schema([("lang", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("n", pa.int64()), ("word", pa.string())])
_COUNTED_SQL = "lang string, x long, y long, z long, n long, word string"


def _added(width: int, least: int):
    """From packed rows sorted by bucket: keys and counts of ``least`` or more; of words also the words.

    A task holds the different keys of a bucket (24 to 32 bytes each); there is one for each shuffle partition."""
    def of(rows):
        sums, words, wrong, limit = _Sums(width, HELD), {}, set(), HELD
        for langs, keys, counts, spelled in rows:
            keys = np.frombuffer(keys, U).reshape(width, -1)
            sums.parts.append((list(keys), np.frombuffer(counts, np.int64)))
            sums.n += keys.shape[1]
            if sums.n >= limit:
                sums.parts = [sums.take()]
                sums.n = len(sums.parts[0][1])
                limit = max(HELD, 2 * sums.n)
            if spelled is not None:
                for x, named in zip(keys[0].tolist(), spelled.split(b"\n"), strict=True):
                    i, word = named.split(b" ")
                    if words.setdefault(x, (langs[int(i)], word)) != (langs[int(i)], word):
                        wrong.add(x)
        keys, counts = sums.take()
        some = counts >= least
        keys, counts = [signed(k[some]) for k in keys], counts[some]
        keys += [np.zeros(len(counts), np.int64)] * (3 - width)
        names = [words.get(x, (None, None)) for x in keys[0].view(U).tolist()] if words else [(None, None)] * len(counts)
        named = [None if w is None or x in wrong else w.decode("utf-8", "replace") for x, (_, w) in zip(keys[0].view(U).tolist(), names, strict=True)]
        for i in range(0, len(counts), 1 << 16):
            j = i + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in names[i:j]], pa.string()), *(pa.array(k[i:j]) for k in keys),
                                              pa.array(counts[i:j]), pa.array(named[i:j], pa.string())], schema=_COUNTED)

    def rows(batches):
        for b in batches:
            bucket, keys, counts, words = (b.column(c) for c in ("bucket", "keys", "counts", "words"))
            for i in range(b.num_rows):
                yield bucket[i].as_py(), (b.column("langs")[i].as_py(), keys[i].as_buffer(), counts[i].as_buffer(), words[i].as_py())

    def run(batches):
        for _, mine in groupby(rows(batches), itemgetter(0)):
            yield from of(r for _, r in mine)
    return run


def _counted(sent: DataFrame, width: int, least: int) -> DataFrame:
    dealt = sent.repartitionById(partitions(sent), F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_added(width, least), _COUNTED_SQL)


#: What a pair may be in a frontier: frequent, a first pair whose bound reaches the bar, a last one, a pair at the bar itself.
_FREQUENT, _FIRST, _LAST, _PAIR = 1, 2, 4, 8


def _slots(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return (mix(x * _M[0] + y * _M[1]) % U(bits)).astype(np.int64)


def _slot_rows(bits: int):
    schema = pa.schema([("slot", pa.int64()), ("flags", pa.int32())])

    def run(batches):
        for b in batches:
            x, y = (b.column(c).to_numpy().view(U) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([pa.array(_slots(x, y, bits) + 1), b.column("flags")], schema=schema)
    return run


def _triples(salt: int, buckets: int, bits: int, frontier):
    """Partial counts of the frontier's triples."""
    def run(batches):
        flags = np.zeros(bits, np.uint8)
        for flag, bitmap in frontier.value.items():
            flags |= np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little") * np.uint8(flag)
        sums = _Sums(3, HELD)
        for batch in batches:
            for _, h, _, _, _, follows, _ in _pieces(batch, salt):
                if len(h) < 3:
                    continue
                of = np.zeros(len(h), np.uint8)
                i = np.flatnonzero(follows)
                of[i] = flags[_slots(h[i], h[i + 1], bits)]
                first, last = of[:-1], of[1:]
                i = np.flatnonzero((first & last & _FREQUENT > 0) & ((first & _FIRST > 0) & (last & _LAST > 0) | ((first | last) & _PAIR > 0)))
                sums.add([h[i], h[i + 1], h[i + 2]])
                if sums.full():
                    yield from _sent(*sums.take(), buckets)
        yield from _sent(*sums.take(), buckets)
    return run


def _ratio(top: str, bottom: str, name: str):
    """``floor(SCALE * top / bottom)`` of products of counts below 10**14, exactly."""
    wide = lambda x: " * ".join(f"cast({c} as decimal(14,0))" for c in x.split())
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * {wide(top)}) div ({wide(bottom)})").alias(name)


def _word_counts(text: DataFrame, buckets: int) -> tuple[int, DataFrame]:
    """``(lang, x, f, word)`` of every word of every language, and the salt of the fingerprints ``x``."""
    for salt in range(8):
        words = materialize(_counted(text.mapInArrow(_words(salt, buckets), _SENT_SQL), 1, 1).select("lang", "x", F.col("n").alias("f"), "word"))
        if words.where("word is null").isEmpty():
            return salt, words
    raise RuntimeError("words with equal fingerprints under every salt")


def _frontier(pairs: DataFrame, bits: int) -> dict:
    """The frontier's bitmaps by flag; ``pairs`` has x, y and flags."""
    slots = pairs.select("x", "y", "flags").mapInArrow(_slot_rows(bits), "slot long, flags int")
    rows = (slots.select(F.explode(F.array(*[F.lit(f) for f in (_FREQUENT, _FIRST, _LAST, _PAIR)])).alias("flag"), "slot", "flags")
            .where(F.col("flags").bitwiseAND(F.col("flag")) != 0)
            .groupBy("flag", F.expr("bitmap_bucket_number(slot)").alias("part"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap")).collect())  # at most 4 * bits / 8 bytes
    out = {f: np.zeros(bits // 8, np.uint8) for f in (_FREQUENT, _FIRST, _LAST, _PAIR)}
    for r in rows:  # Spark's bitmaps count from 1
        bit = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), bitorder="little")
        place = (r["part"] - 1) * 32768 + np.flatnonzero(bit)
        np.bitwise_or.at(out[r["flag"]], place // 8, (1 << (place % 8)).astype(np.uint8))
    return {f: zlib.compress(x.tobytes(), 1) for f, x in out.items()}


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, width: int = WIDTH, grow: int = GROW, bits: int = BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language."""
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    buckets, send = partitions(text), text.sparkSession.sparkContext.broadcast
    salt, words = _word_counts(text, buckets)
    open_ = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")))  # languages that are not settled
    often = words.where(F.col("f") >= least)
    name = lambda as_, *keep: often.select(F.col("x").alias(as_), *[F.col(c).alias(f"{c}_{as_}") for c in keep])
    frequent = send(_frontier(often.select("x", F.lit(0).cast("long").alias("y"), F.lit(_FREQUENT).alias("flags")), bits))
    pairs = _counted(text.mapInArrow(_pairs(salt, buckets, bits, frequent), _SENT_SQL), 2, least).select("x", "y", F.col("n").alias("a"))
    pairs = pairs.join(often.select("x", "lang", F.col("f").alias("f_x")), "x").join(name("y", "f"), "y")
    pairs = materialize(pairs.select("lang", "x", "y", "a", "f_x", "f_y", _ratio("a a", "f_x f_y", "score"), _ratio("a", "f_x", "first"),
                                     _ratio("a", "f_y", "last")))
    best, found = width * top, []
    while True:
        above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("score")))
        bars = pairs.groupBy("lang", "score").count().withColumn("above", above).where(F.col("above") >= best)
        bars = open_.join(bars.groupBy("lang").agg(F.max("score").alias("bar")), "lang", "left").fillna(0, ["bar"])
        flags = sum((F.when(c, f).otherwise(0) for c, f in ((F.col("first") >= F.col("bar"), _FIRST), (F.col("last") >= F.col("bar"), _LAST),
                                                           (F.col("score") >= F.col("bar"), _PAIR))), F.lit(_FREQUENT))
        mine = materialize(pairs.join(bars, "lang").withColumn("flags", flags))
        frontier = send(_frontier(mine, bits))
        triples = _counted(text.mapInArrow(_triples(salt, buckets, bits, frontier), _SENT_SQL), 3, least).select("x", "y", "z", F.col("n").alias("a"))
        first = mine.select("lang", "x", "y", "f_x", F.col("a").alias("f_xy"), "bar", "n")
        last = mine.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("f_y").alias("f_z"), F.col("a").alias("f_yz"))
        triples = materialize(triples.join(first, ["x", "y"]).join(last, ["y", "z"])
                              .select("*", _ratio("a a", "f_x f_yz", "one"), _ratio("a a", "f_xy f_z", "two")))
        inside = (triples.select("a", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("p"))
                  .groupBy("p.x", "p.y").agg(F.max("a").alias("longer")))
        short = (mine.where("score >= bar").join(inside, ["x", "y"], "left").where("longer is null or 100 * longer < 50 * a")
                 .select("lang", "x", "y", F.lit(0).cast("long").alias("z"), "a", F.col("f_x").alias("l"), F.col("f_y").alias("r"), "n", "score", "bar"))
        low = F.col("one") <= F.col("two")
        long_ = triples.select("lang", "x", "y", "z", "a", F.when(low, F.col("f_x")).otherwise(F.col("f_xy")).alias("l"),
                               F.when(low, F.col("f_yz")).otherwise(F.col("f_z")).alias("r"), "n", F.least("one", "two").alias("score"), "bar")
        alive = short.unionByName(long_.where("score >= bar"))
        settled = materialize(bars.join(alive.groupBy("lang").count(), "lang", "left").where(f"bar = 0 or count >= {int(top)}").select("lang"))
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS)))
        rank = F.rank().over(part.orderBy(F.desc("score"), F.desc("a")))
        named = alive.join(settled, "lang").withColumn("rank", rank).where(F.col("rank") <= top)
        for c in ("x", "y", "z"):
            named = named.join(name(c, "word"), c, "left")
        named = named.withColumn("phrase", F.concat_ws(" ", "word_x", "word_y", "word_z"))
        order = F.desc("score"), F.desc("a"), F.col("phrase")
        named = named.withColumn("rank", F.row_number().over(part.orderBy(*order))).where(F.col("rank") <= top)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        found.append(materialize(named.withColumn("rank", rank).where(F.col("rank") <= top)
                                 .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")))
        open_ = materialize(open_.join(settled, "lang", "left_anti"))
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, found)
        best *= grow


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The best phrases of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(top: int = TOP, least: int = LEAST) -> str:
    """DuckDB SQL for the query: all phrases are counted, no bounds."""
    upper = "".join(map(chr, range(65, 91)))
    grams = lambda k: (f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: ws[i:i + {k - 1}])) AS g "  # noqa: E731
                       f"FROM pieces WHERE len(ws) >= {k}")
    return f"""
    WITH pieces AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM pieces) GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
    two AS (SELECT lang, g[1] AS x, g[2] AS y, count(*) AS f FROM ({grams(2)}) GROUP BY ALL HAVING count(*) >= {least}),
    three AS (SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS f FROM ({grams(3)}) GROUP BY ALL HAVING count(*) >= {least}),
    cuts AS (
      SELECT lang, x || ' ' || y AS phrase, 1 AS k, two.f AS a, p.f AS l, q.f AS r
      FROM two JOIN one p USING (lang, x) JOIN one q ON q.lang = two.lang AND q.x = two.y
      WHERE NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = two.lang AND 100 * t.f >= 50 * two.f
                        AND t.x = two.x AND t.y = two.y)
        AND NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = two.lang AND 100 * t.f >= 50 * two.f
                        AND t.y = two.x AND t.z = two.y)
      UNION ALL
      SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, p.f, q.f
      FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
      UNION ALL
      SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, p.f, q.f
      FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
    scored AS (SELECT *, CAST((CAST({SCALE} AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest JOIN total USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
