"""Phrase collocation mining: phrases of 2 to 5 words that occur far more often than their parts would by chance.

Level by level. Words are counted first. A phrase of k words is a candidate when it is seen between two adjacent frequent phrases of k - 1 words (so all its parts are
frequent: nothing frequent is lost) and its bucket in a table of summed hash counts holds at least ``least``. Candidates get slots by a minimal perfect hash
that stores its keys: for words their language, bytes and length (of words over 16 bytes a 128-bit digest), for phrases the slots of the two overlapping
phrases of k - 1 words, exactly. Mappers replace their text by slots, add up slots by ``bincount``, the arrays are summed in a tree of tasks, and
the counts of both parts of every cut are read by slot along the prefix and suffix links.

Texts become rows of slots with breaks (-1), written once a level and shorter each time. A set of candidates is built in parts by hash, in tasks; workers hold the parts in bundles
of ``BUNDLE`` bytes, all of them up to ``HELD`` bytes and otherwise one at a time, so memory stays bounded. Up to 2^31 - 1 candidates a level (more are refused with an error).

Null and empty texts hold nothing; a null language is ``und``. Ids take no part: repeated rows count each time. Ties go to the shorter first part of a cut, and in the ranking to
the phrase that is less in UTF-8 bytes. A text's words are never cut apart from each other, however long it is. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelspark.llm import mph
from parcelspark.llm.common import materialise, merge_parts, scratch_table, texts_of, trim

LEAST, LONGEST, TOP = 100, 5, 2000
SOME = 1 << 21  # bytes of text, slots or keys handled at a time
ENTRIES = 250_000  # words counted before they are sent on
SEGMENT = 16  # bits of a bucket's place in its segment
BUNDLE, HELD = 1 << 25, 1 << 28
_U = np.uint64
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[ord("A") : ord("Z") + 1] += 32
_TABLE[list(b".,;:!?\n\x0b\x0c\r")] = 10
_TABLE[9] = 32
PLAIN = _TABLE.tobytes()  # A-Z lower-cased, ends of pieces as newlines, gaps as spaces
BLANK = bytes(32 if x == 10 else x for x in PLAIN)  # the same with ends as gaps


def stretches(text: bytes, size: int = SOME):
    """``text`` in stretches of about ``size`` bytes that end before a gap; their words are all its words."""
    at = 0
    while len(text) - at > size:
        cut = min((p for p in (text.find(c, at + size) for c in b" \n") if p >= 0), default=-1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_keys(lang: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 4): language, first and last eight bytes (digest halves of words over 16 bytes), length. ``words`` is padded by eight bytes on both sides."""
    length = (ends - starts).astype(_U)
    view = np.ndarray((len(words) - 7,), "<u8", words, 0, (1,))
    low = view[starts]
    short = length < 8
    low[short] &= (_U(1) << (_U(8) * length[short])) - _U(1)
    high = np.where(length > 8, view[ends - 8], _U(0))
    for i in np.flatnonzero(length > 16):
        digest = xxhash.xxh3_128_intdigest(words[starts[i] : ends[i]])
        low[i], high[i] = digest & (2**64 - 1), digest >> 64
    return np.stack([lang, low, high, length], 1)


def lang_key(lang: str | None) -> int:
    return xxhash.xxh3_64_intdigest("und" if lang is None else lang)


def listed(words: list[bytes], langs: list[str]) -> np.ndarray:
    """``word_keys`` of a list of words."""
    buf = np.frombuffer(b" " * 8 + b" ".join(words) + b" " * 8, np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    ends = 8 + np.cumsum(size + 1) - 1
    return word_keys(np.array([lang_key(x) for x in langs], _U), buf, ends - size, ends)


class Slots:
    """Candidates' slots, for workers: bundles of (part, Mph), sizes and first slots of parts (multiples of 8)."""

    def __init__(self, bits: int, sizes: np.ndarray, bundles: list[Broadcast], held: bool):
        self.bits, self.sizes, self.bundles, self.held = bits, sizes, bundles, held
        ends = np.cumsum((sizes + 7) // 8 * 8)
        self.first, self.end = np.concatenate(([0], ends))[:-1], int(ends[-1])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Global slot of each key, -1 for none."""
        h = mph.hashes(keys)
        part = (h >> _U(64 - self.bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
        out = np.full(len(keys), -1, np.int32)
        for bundle in self.bundles:
            for p, table in bundle.value if self.held else bundle.load_from_path(bundle._path):
                some = order[edges[p] : edges[p + 1]]
                slot = table.find(keys[some], h[some])
                out[some] = np.where(slot >= 0, slot + self.first[p], -1)
        return out


def part_bits(items: int) -> int:
    """Parts hold some four million distinct items at most; there are 16 parts at least, 65,536 at most."""
    return int(np.clip(int(np.ceil(np.log2(max(1, items / (1 << 22))))), 4, 16))


def build_parts(keys: DataFrame, combine, words: bool) -> DataFrame:
    """(part, data: keys), of which ``combine`` makes the distinct keys of a part -> (part, size, table: the pickled Mph)."""

    def last(part: int, data: bytes) -> pa.RecordBatch:
        k = np.frombuffer(data, "<u8")
        table = mph.build(k.reshape(-1, 4) if words else k)
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(table)], pa.int64()), pa.array([pickle.dumps(table)], pa.binary())], ["part", "size", "table"])
        del data, k, table
        trim()
        return out

    return merge_parts(keys.select("part", "data"), combine, last=last, schema="part int, size long, table binary")


def distinct_keys(parts) -> bytes:
    """The distinct ones of arrays that are each distinct, folded in so that no more than some SOME and those so far are held."""
    found, some, held = np.zeros(0, "<u8"), [], 0
    for data in parts:
        some.append(np.frombuffer(data, "<u8"))
        held += len(some[-1])
        if held >= max(SOME, len(found)):
            found, some, held = np.unique(np.concatenate([found, *some])), [], 0
    return np.unique(np.concatenate([found, *some])).tobytes()


def sent(built: DataFrame, bits: int) -> Slots:
    """Bundles of the written parts, one at a time through the driver."""
    sizes, length = np.zeros(1 << bits, np.int64), 0
    for r in built.select("part", "size", F.length("table").alias("length")).collect():
        sizes[r.part], length = r.size, length + r.length
    if sizes.sum() >= 2**31:
        raise ValueError("more than 2^31 candidates of one length")
    spark = built.sparkSession
    rows = built.select("part", "table")
    bundles, some, size = [], [], 0
    for r in rows.collect() if length <= BUNDLE else rows.toLocalIterator():
        some.append((r.part, pickle.loads(r.table)))
        size += len(r.table)
        if size >= BUNDLE:
            bundles.append(spark.sparkContext.broadcast(some))
            some, size = [], 0
    bundles.append(spark.sparkContext.broadcast(some))
    return Slots(bits, sizes, bundles, length <= HELD)


def count_words(documents: DataFrame, least: int) -> DataFrame:
    """(lang, word, a) of words that occur at least ``least`` times, and a row with a null word for each language: all its words."""

    def run(batches):
        found: defaultdict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, counts in found.items():
                words = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "a"])
            found.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                here = found["und" if lang is None else lang]
                for s in stretches(text.translate(BLANK)):
                    words = s.split(b" ")
                    here.update(words)
                    del here[b""]
                    here[None] += len(words) - words.count(b"")
            if sum(map(len, found.values())) > ENTRIES:
                yield from rows()
        yield from rows()
        trim()  # the worker goes on to other tasks

    some = documents.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, word string, a long")
    return some.groupBy("lang", "word").agg(F.sum("a").alias("a")).filter(F.col("word").isNull() | (F.col("a") >= least))


def keyed_words(words: DataFrame, bits: int) -> DataFrame:
    """(part, key, lang, word, a): the part that each frequent word belongs to."""

    def run(batches):
        for b in batches:
            langs, w = b.column("lang").to_pylist(), [x.encode() for x in b.column("word").to_pylist()]
            keys = listed(w, langs)
            part = (mph.hashes(keys) >> _U(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([k.tobytes() for k in keys.astype("<u8")], pa.binary()), *(b.column(c) for c in ("lang", "word", "a"))], ["part", "data", "lang", "word", "a"])

    return words.filter("word IS NOT NULL").select("lang", "word", "a").mapInArrow(run, "part int, data binary, lang string, word string, a long")


def squeezed(ids: np.ndarray, alone: bool) -> np.ndarray:
    """Slots with single breaks, ending in one; slots between two breaks, which no longer phrase holds, stay only where ``alone`` is set."""
    some = np.concatenate(([False], ids >= 0, [False]))
    kept = some[1:-1] & (some[:-2] | some[2:] | alone)
    keep = kept | (~some[1:-1] & np.concatenate(([False], kept[:-1])))
    return np.concatenate((ids[keep], np.full(int(len(ids) > 0 and some[-2]), -1))).astype(np.int32)


def encoded(documents: DataFrame, slots: Slots) -> DataFrame:
    """(ids) rows: the words of many texts as slots, -1 for other words and where pieces end. A text is never spread over two rows."""

    def words_of(parts: list[tuple[int, bytes]]) -> np.ndarray:
        """Slots and breaks of stretches; those that go on with the text before begin with a gap, others with a newline."""
        buf = np.frombuffer(b" " * 8 + b"".join(x for _, x in parts) + b"\n" + b" " * 8, np.uint8)
        gap = (buf == 32) | (buf == 10)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.int32)
        at = 8 + np.concatenate(([0], np.cumsum([len(x) for _, x in parts])))
        lang = np.array([k for k, _ in parts], _U)[np.searchsorted(at, starts, "right") - 1]
        lines = np.cumsum(buf == 10, dtype=np.int32)[starts]
        ids = slots.find(word_keys(lang, buf, starts, ends))
        breaks = np.concatenate(([0], np.cumsum(lines[1:] != lines[:-1]))) + (lines[0] > 0)
        out = np.full(len(ids) + int(breaks[-1]), -1, np.int32)
        out[np.arange(len(ids)) + breaks] = ids
        return out

    def run(batches):
        parts, size, done, held = [], 0, [], 0

        def flush():
            nonlocal parts, size, held
            if parts:
                done.append(words_of(parts))
                held += len(done[-1])
            parts, size = [], 0

        def row():
            nonlocal done, held
            ids = squeezed(np.concatenate(done), alone=False)  # words are counted
            done, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["ids"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                key, first = lang_key(lang), True
                for s in stretches(text.translate(PLAIN)):
                    parts.append((key, b"\n" + s if first else s))
                    first, size = False, size + len(s) + 1
                    if size >= SOME:
                        flush()
                if held >= SOME // 4:
                    flush()
                    yield row()
        flush()
        if done:
            yield row()
        trim()

    return documents.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "ids binary")


def adjacent(ids: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places where a phrase of one more word begins, its key there): both its parts are there and frequent."""
    good = ids >= 0
    if frequent is not None:
        good &= (frequent[np.maximum(ids, 0) >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(good[:-1] & good[1:]) if len(ids) else np.zeros(0, np.int64)
    return at, (ids[at].astype(_U) << _U(32)) | ids[at + 1].astype(_U)


def _rows(ids: DataFrame, frequent: Broadcast | None, each, schema: str) -> DataFrame:
    """``each`` yields batches for the stream of (ids, places, keys) of a task's rows."""

    def run(batches):
        mask = None if frequent is None else frequent.value

        def stream():
            for b in batches:
                for x in b.column("ids"):
                    row = np.frombuffer(x.as_buffer(), "<i4")
                    yield row, *adjacent(row, mask)

        yield from each(stream())
        trim()

    return ids.select("ids").mapInArrow(run, schema)


def _parted(part: np.ndarray, columns: list[np.ndarray]):
    """(part, columns' bytes joined) of rows sorted by part."""
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([b"".join(c[i:j].tobytes() for c in columns) for i, j in pairs], pa.binary())], ["part", "data"])


def heavy_buckets(ids: DataFrame, frequent: Broadcast | None, bits: int, least: int) -> np.ndarray:
    """A bit for each of 2**bits buckets of hashed keys: whether the counts of its keys sum to ``least`` (which is at most 255) or more."""
    within = (1 << SEGMENT) - 1

    def each(stream):
        some, held = [], 0

        def rows():
            nonlocal some, held
            bucket, n = np.unique(np.concatenate(some), return_counts=True)
            some, held = [], 0
            return _parted(bucket >> SEGMENT, [(bucket & within).astype("<u2"), np.minimum(n, least).astype(np.uint8)])

        for _, _, keys in stream:
            some.append((mph.hashes(keys) >> _U(64 - bits)).astype(np.int64))
            held += len(keys)
            if held >= SOME:
                yield rows()
        if held:
            yield rows()

    def combine(parts):
        total = np.zeros(1 << SEGMENT, np.int64)
        for data in parts:
            n = len(data) // 3
            total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.uint8, n, 2 * n)
        at = np.flatnonzero(total)
        return at.astype("<u2").tobytes() + np.minimum(total[at], least).astype(np.uint8).tobytes()

    def full(data: bytes) -> np.ndarray:
        n = len(data) // 3
        return np.frombuffer(data, "<u2", n)[np.frombuffer(data, np.uint8, n, 2 * n) >= least]

    def bitmap(part: int, data: bytes) -> pa.RecordBatch:
        flags = np.zeros(1 << SEGMENT, bool)
        flags[full(data)] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["part", "data"])

    merged = merge_parts(_rows(ids, frequent, each, "part int, data binary"), combine, last=bitmap)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator() if bits > 26 else merged.collect():
        out[r.part << SEGMENT - 3 : (r.part + 1) << SEGMENT - 3] = np.frombuffer(r.data, np.uint8)
    return out


def candidates(ids: DataFrame, frequent: Broadcast | None, buckets: Broadcast, bucket_bits: int, bits: int) -> DataFrame:
    """(part, data): the keys whose bucket is heavy, by part, some of them in several rows."""

    def each(stream):
        heavy, some, held = buckets.value, [], 0

        def rows():
            keys = np.unique(np.concatenate(some))
            h = mph.hashes(keys)
            order = np.argsort(h)
            return _parted((h[order] >> _U(64 - bits)).astype(np.int32), [keys[order]])

        for _, _, keys in stream:
            bucket = (mph.hashes(keys) >> _U(64 - bucket_bits)).astype(np.int64)
            keys = np.unique(keys[(heavy[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1])
            if not len(keys):
                continue
            some.append(keys)
            held += len(keys)
            if held >= SOME:
                some = [np.unique(np.concatenate(some))]
                held = len(some[0])
                if held >= SOME // 2:
                    yield rows()
                    some, held = [], 0
        if held:
            yield rows()

    return _rows(ids, frequent, each, "part int, data binary")


def lengthened(ids: DataFrame, frequent: Broadcast | None, slots: Slots) -> DataFrame:
    """(ids) rows of phrases of one more word."""

    def each(stream):
        for row, at, keys in stream:
            out = np.full(len(row), -1, np.int32)
            out[at] = slots.find(keys)
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(out, alone=True).tobytes()], pa.binary())], ["ids"])

    return _rows(ids, frequent, each, "ids binary")


def slot_counts(ids: DataFrame, slots: Slots) -> DataFrame:
    """(part, data): the summed counts of a part's slots (slots, then counts as long integers). Mappers add up what they met, a tree of tasks the arrays."""
    first, end = slots.first, slots.end

    def run(batches):
        held, some, n = np.zeros(end, np.int64) if end <= SOME else None, [], 0

        def rows():
            slot, count = np.unique(np.concatenate(some), return_counts=True) if held is None else (np.flatnonzero(held), held[held > 0])
            part = np.searchsorted(first, slot, "right") - 1
            return _parted(part, [(slot - first[part]).astype("<u4"), count.astype("<i8")])

        for b in batches:
            for x in b.column("ids"):
                row = np.frombuffer(x.as_buffer(), "<i4")
                row = row[row >= 0]
                n += len(row)
                if held is None:
                    some.append(row)
                else:
                    held += np.bincount(row, minlength=end)
                if held is None and n >= SOME:
                    yield rows()
                    some, n = [], 0
        if n:
            yield rows()

    def combine(parts):
        total = np.zeros(0, np.int64)
        for data in parts:
            n = len(data) // 12
            slot = np.frombuffer(data, "<u4", n)
            if int(slot.max(initial=0)) >= len(total):
                total = np.concatenate((total, np.zeros(int(slot.max()) + 1 - len(total), np.int64)))
            total[slot] += np.frombuffer(data, "<i8", n, 4 * n)  # slots are distinct within each
        at = np.flatnonzero(total)
        return at.astype("<u4").tobytes() + total[at].tobytes()

    return merge_parts(ids.mapInArrow(run, "part int, data binary"), combine)


def _counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<u4", n), np.frombuffer(data, "<i8", n, 4 * n)


def frequent_bits(counts: DataFrame, slots: Slots, least: int) -> np.ndarray:
    """A bit for each slot: whether it is counted ``least`` times or more."""

    def run(batches):
        for b in batches:
            maps = []
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                slot, n = _counts(data)
                flags = np.zeros(int(slots.sizes[part] + 7) // 8 * 8, bool)
                flags[slot[n >= least]] = True
                maps.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(maps, pa.binary())], ["part", "data"])

    out = np.zeros(slots.end // 8, np.uint8)
    for r in counts.select("part", "data").mapInArrow(run, "part int, data binary").collect():
        at = int(slots.first[r.part]) // 8
        out[at : at + len(r.data)] = np.frombuffer(r.data, np.uint8)
    return out


def links(counts: DataFrame, built: DataFrame, slots: Slots, least: int) -> DataFrame:
    """(slot, prefix, suffix, a) of frequent phrases: the slots of the two phrases of one word less."""
    first = slots.first

    def run(batches):
        for b in batches:
            for part, data, table in zip(*(b.column(c).to_pylist() for c in ("part", "data", "table")), strict=True):
                slot, n = _counts(data)
                slot, n = slot[n >= least], n[n >= least]
                key = pickle.loads(table).keys[slot]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (slot + first[part], key >> _U(32), key & _U(2**32 - 1), n)], ["slot", "prefix", "suffix", "a"])

    return counts.join(built.select("part", "table"), "part").select("part", "data", "table").mapInArrow(run, "slot long, prefix long, suffix long, a long")


def phrases_of_words(words: DataFrame, slots: Slots) -> DataFrame:
    """The first level: (slot, lang, words, a, lefts, rights, n)."""

    def run(batches):
        for b in batches:
            slot = slots.find(listed([x.encode() for x in b.column("word").to_pylist()], b.column("lang").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), b.column("lang"), b.column("word"), b.column("a")], ["slot", "lang", "word", "a"])

    totals = words.filter("word IS NULL").select("lang", F.col("a").alias("n"))
    rows = words.filter("word IS NOT NULL").select("lang", "word", "a").mapInArrow(run, "slot long, lang string, word string, a long")
    return rows.join(totals, "lang").select("slot", "lang", F.array("word").alias("words"), "a", F.array("a").alias("lefts"), F.array("a").alias("rights"), "n")


def lengthen_phrases(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """``found`` (links) with what ``shorter`` says of both parts. lefts, rights: counts of the first and of the last 1, 2, ... words."""
    before = shorter.select(F.col("slot").alias("prefix"), "lang", "words", F.col("a").alias("prefix_a"), "lefts", "n")
    after = shorter.select(F.col("slot").alias("suffix"), F.element_at("words", -1).alias("last"), F.col("a").alias("suffix_a"), "rights")
    rows = found.join(before, "prefix").join(after, "suffix")
    return rows.select("slot", "lang", F.concat("words", F.array("last")).alias("words"), "a", F.concat("lefts", F.array("a")).alias("lefts"), F.concat("rights", F.array("a")).alias("rights"), "n", "prefix", "suffix", "prefix_a", "suffix_a")


def scored(phrases: DataFrame, length: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score by the cut of least score, the first of equal ones."""
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("lefts", k), F.element_at("rights", F.lit(length) - k)
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col("n")), wide(l) * wide(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.array(*(cut(F.lit(k)) for k in range(1, length))))
    return phrases.withColumn("best", best).select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")


def levels(spark: SparkSession, documents: DataFrame, least: int, longest: int, stack: ExitStack) -> list[DataFrame]:
    """Written tables of the frequent phrases of 1, 2, ... words. Scratch tables go when ``stack`` closes."""
    words = scratch_table(stack, count_words(documents, least), "frequent-words")
    found = words.filter("word IS NOT NULL").agg(F.count("*").alias("distinct"), F.sum("a").alias("all")).first()
    if not found.distinct:
        return []
    bits = part_bits(found.distinct)
    built = scratch_table(stack, build_parts(keyed_words(words, bits), b"".join, words=True), "word-slots")
    slots = sent(built, bits)
    out = [materialise(phrases_of_words(words, slots), "phrases")]
    ids, frequent, places = scratch_table(stack, encoded(documents, slots), "slots"), None, found["all"]
    for _ in range(2, longest + 1):
        bucket_bits = int(np.clip(np.ceil(np.log2(places / 4)), SEGMENT, 28))
        heavy = spark.sparkContext.broadcast(heavy_buckets(ids, frequent, bucket_bits, least))
        bits = part_bits(places / least)
        built = scratch_table(stack, build_parts(candidates(ids, frequent, heavy, bucket_bits, bits), distinct_keys, words=False), "candidates")
        slots = sent(built, bits)
        if not slots.end:
            break
        ids = scratch_table(stack, lengthened(ids, frequent, slots), "slots")
        counts = scratch_table(stack, slot_counts(ids, slots), "counts")
        out.append(materialise(lengthen_phrases(links(counts, built, slots, least), out[-1]), "phrases"))
        places = out[-1].agg(F.sum("a").alias("a")).first().a
        if not places:
            break
        frequent = spark.sparkContext.broadcast(frequent_bits(counts, slots, least))
    return out


def mine(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases. Phrases that a longer one holds as often as they occur are left out."""
    if not 2 <= least <= 255:
        raise ValueError("least must be within 2 and 255")
    spark = documents.sparkSession
    with ExitStack() as stack:
        tables = levels(spark, documents, least, longest, stack)
    kept = None
    for k, phrases in enumerate(tables[1:], 2):
        if k < len(tables):
            longer = tables[k]
            within = longer.filter("a = prefix_a").select(F.col("prefix").alias("slot")).unionByName(longer.filter("a = suffix_a").select(F.col("suffix").alias("slot"))).distinct()
            phrases = phrases.join(within, "slot", "left_anti")
        rows = scored(phrases, k)
        kept = rows if kept is None else kept.unionByName(rows)
    if kept is None:
        kept = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    ranked = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    rows = kept.withColumn("rank", F.row_number().over(ranked).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same in DuckDB's SQL: all phrases counted, without candidates."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)" for k in range(1, longest + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, k, a, {j} AS cut, array_to_string(string_split(phrase, ' ')[1:{j}], ' ') AS p, array_to_string(string_split(phrase, ' ')[{j + 1}:], ' ') AS q FROM counts WHERE k > {j}" for j in range(1, longest))
    return f"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
scores AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, t.n, (1000 * c.a * t.n) // (x.a * y.a) AS score
    FROM ({cuts}) c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, k, a, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase FROM counts WHERE k > 2),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.phrase = b.phrase AND x.a >= b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {top}
"""
