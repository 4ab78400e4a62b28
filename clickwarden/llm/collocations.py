"""Phrases that occur far more often than their parts suggest, counted in HAT-tries.

1. Words are counted per language. Words that are too rare break every phrase they are in, so only frequent
   words get an id; a word's id implies its language.
2. Each task slides a window of five frequent words over its texts and counts the windows in a HAT-trie: every
   phrase is a prefix of the windows at its occurrences. When the trie is full, whole subtrees leave it as a
   sorted run, cut at sampled splitters and packed.
3. The runs of a range of prefixes are merged in one task, and one pass over the merged windows counts all their
   prefixes. Prefixes at the border of a range or block are summed afterwards, so a hot prefix may span many ranges.
4. Scores come from joins of phrases with their parts; a phrase is dropped for a phrase of one word more that occurs as
   often (for any longer one, some phrase of one word more between them occurs as often too).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickwarden.llm.arrays import SLICE_BYTES, Words, mix, slices, text_bytes
from clickwarden.llm.hat_trie import ID, HatTrie, borders, columns, least, merge, pack_rows, pieces, prefix_counts, unpack
from clickwarden.llm.scratch import Scratch

BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True


@dataclass(frozen=True)
class Settings:
    longest: int = 5
    least: int = 100  # occurrences of a candidate
    first: int = 2000  # rows of each language
    dictionary: int = 1 << 18  # most frequent words with short ids; other words go by a 63-bit hash
    word_entries: int = 200_000  # distinct words that a task holds, and their bytes
    word_bytes: int = 1 << 25
    trie_entries: int = 300_000  # of a task before it spills
    spills: int = 16  # that leave a task together
    range_windows: int = 1 << 20  # windows of one range
    most_ranges: int = 1 << 13
    sample: int = 64  # windows of each task that splitters are taken from
    merge_windows: int = 1 << 20  # merged at once


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, borders): slices of rows; a long row in parts that end at a phrase break."""
    for lo, hi in slices(column):
        data, borders = text_bytes(column.slice(lo, hi - lo))
        if hi - lo > 1 or len(data) <= 2 * SLICE_BYTES:
            yield lo, hi, data, borders
            continue
        ends = np.flatnonzero(BREAKS[data]) + 1
        at = 0
        while at < len(data):
            # the last break within a slice, else the next one
            k = np.searchsorted(ends, at + SLICE_BYTES, side="right") - 1
            if k < 0 or ends[k] <= at:
                k += 1
            to = int(ends[k]) if k < len(ends) else len(data)
            yield lo, hi, data[at:to], np.array([0, to - at])
            at = to


class _Langs:
    """A 64-bit value for each language name."""

    def __init__(self):
        self._known: dict[str, int] = {}

    def of(self, column: pa.Array) -> tuple[np.ndarray, list[str]]:
        coded = column.dictionary_encode()
        names = coded.dictionary.to_pylist()
        for name in names:
            if name not in self._known:
                self._known[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest())
        values = np.array([self._known[name] for name in names], dtype=np.uint64)
        return (values[coded.indices.to_numpy()] if len(column) else values), names


def _words(batch: pa.RecordBatch, langs: _Langs):
    """For each part of a batch: words, their keys (language and word), and which words follow the one before in its piece."""
    text = batch.column("text")
    lang, _ = langs.of(batch.column("lang"))
    for lo, hi, data, borders in _parts(text):
        words = Words(data, borders, SEPARATORS)
        if not len(words.start):
            continue
        piece = np.cumsum(BREAKS[data])[words.start]
        follows = np.zeros(len(piece), dtype=bool)
        follows[1:] = (piece[1:] == piece[:-1]) & (words.row[1:] == words.row[:-1])
        yield words, words.row + lo, mix(words.hash ^ lang[lo:hi][words.row]), follows


def _window_sizes(alive: np.ndarray, follows: np.ndarray, longest: int) -> np.ndarray:
    """Words of the window that starts at each word: it ends at a piece's end or before a word that isn't alive."""
    n = len(alive)
    stops = np.ones(n, dtype=bool)
    stops[:-1] = ~(follows[1:] & alive[1:] & alive[:-1])
    ends = np.flatnonzero(stops)
    sizes = np.minimum(ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1, longest)
    return np.where(alive, sizes, 0)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end."""
    borders = np.concatenate([[0], np.cumsum(end - start)])
    place = np.arange(borders[-1]) + np.repeat(start - borders[:-1], end - start)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(data[place])])


def _decoded(words: pa.Array) -> pa.Array:
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([w.decode(errors="replace") for w in words.to_pylist()], pa.string())


class _WordCounts:
    """Occurrences of words by key, with the language and the word of each, as arrays that are added up when they get long."""

    def __init__(self):
        self._parts: list[tuple] = []
        self.entries = self.size = 0  # words and their bytes

    def add(self, key: np.ndarray, row: np.ndarray, words: Words, names: pa.Array) -> None:
        keys, first, n = np.unique(key, return_index=True, return_counts=True)
        self._parts.append((keys, n, names.take(pa.array(row[first])), _strings(words.data, words.start[first], words.end[first])))
        self.entries, self.size = self.entries + len(keys), self.size + self._parts[-1][3].nbytes

    def compact(self) -> None:
        if len(self._parts) > 1:
            keys, n = (np.concatenate([p[i] for p in self._parts]) for i in (0, 1))
            names, words = (pa.concat_arrays([p[i] for p in self._parts]) for i in (2, 3))
            order = np.argsort(keys, kind="stable")
            starts = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]])
            first = order[starts]
            self._parts = [(keys[first], np.add.reduceat(n[order], starts), names.take(pa.array(first)), words.take(pa.array(first)))]
        self.entries, self.size = sum(len(p[0]) for p in self._parts), sum(p[3].nbytes for p in self._parts)

    def rows(self, size: int) -> Iterator[pa.RecordBatch]:
        self.compact()
        for keys, n, names, words in self._parts:
            for at in range(0, len(keys), size):
                part = slice(at, at + size)
                yield pa.record_batch([names[part], _decoded(words[part]), pa.array(keys[part].view(np.int64)), pa.array(n[part], pa.int64()),
                                       pa.nulls(len(keys[part]), pa.binary())], names=["lang", "word", "key", "n", "window"])
        self.__init__()


def _count_words(settings: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, counts = _Langs(), _WordCounts()
        sample: dict[int, bytes] = {}
        for batch in batches:
            for words, row, key, follows in _words(batch, langs):
                counts.add(key, row, words, batch.column("lang"))
                # windows of the smallest hashes, each once
                sizes = _window_sizes(np.ones(len(key), bool), follows, settings.longest)
                whole = np.flatnonzero(sizes == settings.longest)
                if len(whole):
                    total = np.zeros(len(whole), np.uint64)
                    for j in range(settings.longest):
                        total = mix(total ^ key[whole + j])
                    least = np.argpartition(total, settings.sample)[: settings.sample] if len(total) > settings.sample else np.arange(len(total))
                    for at in least.tolist():
                        start = whole[at]
                        sample[int(total[at])] = key[start: start + settings.longest].tobytes()
                    sample = dict(sorted(sample.items())[: settings.sample])
                if counts.entries > 2 * settings.word_entries or counts.size > 2 * settings.word_bytes:
                    counts.compact()
                    if counts.entries > settings.word_entries or counts.size > settings.word_bytes:
                        yield from counts.rows(20_000)
        yield from counts.rows(20_000)
        if sample:
            order = np.array(list(sample), np.uint64).view(np.int64)
            none = pa.nulls(len(sample), pa.string())
            yield pa.record_batch([none, none, pa.array(order), pa.nulls(len(sample), pa.int64()), pa.array(list(sample.values()), pa.binary())],
                                  names=["lang", "word", "key", "n", "window"])

    return count


class _Ids:
    """Ids of word keys: the rank in the dictionary, or 2^63 + half the key; 0 for words that are too rare."""

    def __init__(self, keys: np.ndarray, complete: bool):
        order = np.argsort(keys)
        self.keys, self.ranks, self.complete = keys[order], order.astype(np.uint64) + np.uint64(1), complete

    def of(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.uint64) if self.complete else (np.uint64(1 << 63) | (key >> np.uint64(1)))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            listed = self.keys[at] == key
            out[listed] = self.ranks[at[listed]]
        return out


def _count_windows(ids, splitters, settings: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, trie, cuts, runs = _Langs(), HatTrie(), splitters.value, []

        def spilled(left: int, together: int):
            if run := trie.spill(left):
                runs.append((*columns(run, settings.longest), borders(run, cuts)))
            if len(runs) >= together:
                # a run alone has few strings in each of many ranges
                for number, ids_of, counts in pieces(runs) if runs else ():
                    yield pa.record_batch([pa.array([number], pa.int32()), pa.array([least(ids_of)], pa.binary()),
                                           pa.array([pack_rows(ids_of, counts)], pa.binary())], names=["range", "first", "packed"])
                runs.clear()

        for batch in batches:
            for _, _, key, follows in _words(batch, langs):
                own = ids.value.of(key)
                sizes = _window_sizes(own != 0, follows, settings.longest)
                raw = own.astype(">u8").tobytes()
                # a window of one word holds no phrase
                starts = np.flatnonzero(sizes >= 2)
                ends = (starts + sizes[starts]) * ID
                trie.add(Counter([raw[a:b] for a, b in zip((starts * ID).tolist(), ends.tolist())]))
                if trie.entries > settings.trie_entries:
                    yield from spilled(settings.trie_entries // 2, settings.spills)
        yield from spilled(0, 0)

    return count


def _merge_ranges(settings: Settings):
    """Merge the pieces of each range: what lies before the next piece's first string is complete.

    Where little is, since many pieces begin with the range, the next merge waits until as much again has come.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, n, most = None, [], 0, settings.merge_windows

        def counted(ids, counts):
            out = prefix_counts(ids, counts, settings.least)
            for at in range(0, len(out), 20_000):
                keys, totals = zip(*out[at: at + 20_000])
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(totals, pa.int64())], names=["key", "n"])

        def merged():
            return merge(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        for batch in batches:
            for number, first, packed in zip(*(batch.column(c) for c in ("range", "first", "packed"))):
                if number.as_py() != current:
                    if held:
                        yield from counted(*merged())
                    current, held, n, most = number.as_py(), [], 0, settings.merge_windows
                elif n > most:
                    ids, counts = merged()
                    bound = np.frombuffer(first.as_py().ljust(ID * settings.longest, b"\0"), ">u8").tolist()
                    lo, hi = 0, len(ids)
                    while lo < hi:
                        middle = (lo + hi) // 2
                        lo, hi = (middle + 1, hi) if ids[middle].tolist() < bound else (lo, middle)
                    if lo:
                        yield from counted(ids[:lo], counts[:lo])
                    held, n = [(ids[lo:], counts[lo:])], len(ids) - lo
                    most = max(settings.merge_windows, 2 * n)
                held.append(unpack(packed.as_py(), settings.longest))
                n += len(held[-1][0])
        if held:
            yield from counted(*merged())

    return count


def _key_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def _words_from(key: Column, first: int | Column, count: Column | None = None) -> Column:
    """The ids of a key from a word (counted from 0) on."""
    start = F.lit(first) * ID + 1 if isinstance(first, int) else first * ID + 1
    return F.substring(key, start, count * ID) if count is not None else F.substring(key, start, F.octet_length(key))


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language by score, a, phrase.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into
    words. n counts the words of the language, a the occurrences of the phrase (overlapping ones too), l and r those of
    its two parts at the cut with the lowest floor(1000*a*n/(l*r)), the first of equal ones. Candidates have 2 to
    ``longest`` words and ``least`` occurrences or more; one inside a longer candidate that occurs as often is dropped.
    A null text is empty, a null language is ``und``. Repeated rows count each time. A long text is read in parts that
    end at piece borders. Other columns are ignored. An empty table gives an empty result.
    """
    s = settings
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit("und")).alias("lang"))

    counted = scratch.keep(rows.mapInArrow(_count_words(s), "lang string, word string, key long, n long, window binary"))
    words = scratch.keep(counted.where("word IS NOT NULL").groupBy("lang", "word", "key").agg(F.sum("n").alias("n")))
    totals = scratch.keep(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = words.where(F.col("n") >= s.least)
    listed = frequent.orderBy(F.desc("n"), "key").limit(s.dictionary).select("key", "n").toArrow()
    keys = listed.column("key").to_numpy().view(np.uint64)
    total = totals.agg(F.sum("n")).first()[0] or 0
    ids = _Ids(keys, frequent.count() <= s.dictionary)

    # equally many sampled windows between two splitters
    ranges = int(min(max(1, -(-total // s.range_windows)), s.most_ranges))
    sampled = counted.where("window IS NOT NULL").orderBy("key").limit(16 * s.most_ranges).select("window").toArrow().column("window")
    sampled = np.frombuffer(b"".join(sampled.to_pylist()), np.uint64)
    windows = sorted(row.tobytes() for row in ids.of(sampled).astype(">u8").reshape(-1, s.longest) if row[0])  # none begins with a word too rare
    splitters = sorted({windows[len(windows) * i // ranges] for i in range(1, ranges)}) if windows else []

    sent_ids, sent_splitters = spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(splitters)
    runs = rows.mapInArrow(_count_windows(sent_ids, sent_splitters, s), "range int, first binary, packed binary")
    merged = runs.repartition(len(splitters) + 1, "range").sortWithinPartitions("range", "first").mapInArrow(
        _merge_ranges(s), "key binary, n long")
    phrases = merged.groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= s.least)
    phrases = scratch.keep(phrases.withColumn("k", (F.octet_length("key") / ID).cast("int")))
    sent_ids.destroy()
    sent_splitters.destroy()

    # the dictionary again as a table, with the hashed ids of all other frequent words
    dictionary = spark.createDataFrame(
        pa.table({"key": listed.column("key"), "id": pa.array(np.arange(1, len(keys) + 1, dtype=np.int64))}))
    hashed = F.expr("shiftrightunsigned(key, 1)").bitwiseOR(F.lit(-(1 << 63)))
    singles = frequent.join(F.broadcast(dictionary), "key", "left").select(
        "lang", "word", "n", _key_bytes(F.coalesce("id", hashed)).alias("id"))
    singles = scratch.keep(singles)
    parts = phrases.select("key", F.col("a").alias("f")).unionByName(singles.select(F.col("id").alias("key"), F.col("n").alias("f")))

    longer = phrases.where("k > 2").select("a", F.explode(F.array(
        _words_from(F.col("key"), 0, F.col("k") - 1), _words_from(F.col("key"), 1))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("longer"))
    open_phrases = phrases.join(longer, "key", "left").where("longer IS NULL OR longer < a").drop("longer")

    cuts = open_phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({
        "left": _words_from(F.col("key"), 0, F.col("cut")), "right": _words_from(F.col("key"), F.col("cut"))})
    cuts = (cuts.join(parts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
            .join(parts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
            .withColumn("id", _words_from(F.col("key"), 0, F.lit(1))))
    cuts = cuts.join(singles.select("id", "lang"), "id").join(totals, "lang")
    # up to 16 digits each; l and r are a or more, so the quotient is at most 1000 n / a
    cuts = cuts.withColumn("score", F.expr(
        "(cast(a as decimal(16,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(16,0))) div "
        "(cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"))
    best = cuts.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "key", "a", "n", "best.l", "best.r", "best.score")

    # texts only for those that can be among the first whatever their text
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = scratch.keep(best.withColumn("place", F.rank().over(order)).where(F.col("place") <= s.first).drop("place"))
    spelled = near.select("key", F.posexplode(F.sequence(F.lit(0), (F.octet_length("key") / ID).cast("int") - 1)).alias("at", "word_at"))
    spelled = spelled.withColumn("id", _words_from(F.col("key"), F.col("word_at"), F.lit(1))).join(singles.select("id", "word"), "id")
    spelled = spelled.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("key", F.array_join("words.word", " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    result = near.join(spelled, "key").withColumn("rank", rank).where(F.col("rank") <= s.first)
    result = scratch.keep(result.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    scratch.free_others(result)
    return result


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
numbered AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM numbered GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM numbered),
grams AS (SELECT lang, w[i : i + k - 1] AS g FROM places, range(1, 6) AS s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
longer AS (
    SELECT lang, part AS g, max(a) AS longer
    FROM (SELECT lang, a, unnest([g[1 : len(g) - 1], g[2 : len(g)]]) AS part FROM f WHERE len(g) > 2) GROUP BY lang, part),
c AS (
    SELECT f.* FROM f LEFT JOIN longer USING (lang, g)
    WHERE len(g) >= 2 AND (longer IS NULL OR longer < a)),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
scored AS (
    SELECT cuts.lang, cuts.g, cuts.a, x.a AS l, y.a AS r, n, k,
           CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
    FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.g = cuts.g[1 : k]
    JOIN f AS y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1 : len(cuts.g)] JOIN total ON total.lang = cuts.lang
    QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.g ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER best AS INTEGER) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM scored WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))
QUALIFY row_number() OVER best <= 2000
"""}
