"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share.

1. Texts with equal sets form one class, known by its smallest id.
2. Every text, once a task for equal sets, emits its prefix: with shingles in one fixed order, two sets of similarity t share a shingle among
   the first n - ceil(t n) + 1 of each. Shingles in crowded cells of a corpus-wide count sketch come last in that
   order, so common passages stay out of prefixes. The order affects cost only, never the result.
3. Tiles: what shares a prefix shingle and lies within the size ratio meets in a tile; large groups are cut into size bands
   and blocks. Parity bitmaps bound the overlap from above: differing bits cannot outnumber differing shingles. Large groups
   run twice: first each text is tried against its most alike partners, which joins copies of one text without listing their
   pairs; then all pairs across components.
4. A pair must share so many prefix shingles that the similarity can still be met.
5. Pairs that pass are settled by intersecting the sorted arrays; links become components.

No candidate is capped or sampled. Null, empty and wordless texts have the empty set and link with nothing.
Shingles are 64-bit hashes; equal sets are recognised by size and two independent 64-bit sums.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.llm.common import chunks, discard, materialise, merge_parts, mix, scratch_table, shingle_sets, texts_of, trim
from parcelspark.llm.components import components

CELLS = 1 << 20
HEAVY = 6  # standard deviations above the mean load of a cell
SALTS = 16
BLOCK = 1024  # of a tile's side
LARGE = 64  # members from which on a group goes through tiles
BEST = 4
MET = 200_000
BITS = 1 << 23
ROWS = 50_000  # of small groups in one call
PREFIX = 2048  # shingles of a leader whose small groups go together
TOKENS = 2048  # shingles of a tile that are multiplied at a time
CHUNK = 2 << 20


def _sets(batches, width):
    """(ids, sets) of Arrow batches with the columns id and text, a few MB of text at a time."""
    for b in batches:
        docs = texts_of(b.column(1))
        for i, j in chunks([len(d) for d in docs], CHUNK):
            yield b.column(0).slice(i, j - i), shingle_sets(docs[i:j], width)
    trim()


def need(n, m, percent: int):
    """Least intersection of sets of n and m members that reaches ``percent`` of the union."""
    return -((-percent * (n + m)) // (100 + percent))


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit j is the parity of the number of members hashed to j; about one bit a member, a power of two."""
    bits = 1 << min(16, max(6, int(len(s)).bit_length()))
    return np.packbits(np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def fold_bitmap(x: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmaps halve by XOR of their halves."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def describe(df: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and two sums that identify the set."""

    def run(batches):
        for ids, sets in _sets(batches, width):
            a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            c = np.array([mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(c)], ["doc_id", "n_shingles", "sum_a", "sum_b"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, sum_a long, sum_b long")


def crowded_cells(df: DataFrame, width: int) -> np.ndarray:
    """Boolean per cell: it holds more shingle occurrences (once a text) than chance explains. 128 KB whatever the corpus."""
    parts = 16

    def count(batches):
        total = np.zeros(CELLS, np.int32)
        for _, sets in _sets(batches, width):
            s = np.concatenate(sets)
            total += np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32)
        cut = [total[i::parts].tobytes() for i in range(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(cut, pa.binary())], ["part", "data"])

    def add(items):
        total = np.zeros(CELLS // parts, np.int64)
        for x in items:
            total += np.frombuffer(x, np.int64 if len(x) == 8 * len(total) else np.int32)
        return total.tobytes()

    rows = merge_parts(df.mapInArrow(count, "part int, data binary"), add).collect()  # CELLS counters: 8 MB at any corpus size
    total = np.zeros(CELLS, np.int64)
    for r in rows:
        total[r["part"] :: parts] = np.frombuffer(r["data"], np.int64)
    mean = total.mean()
    return total > mean + HEAVY * mean**0.5 + 16  # a cell of unrelated rare shingles stays below


def prefixes(df: DataFrame, width: int, percent: int, crowded: np.ndarray) -> DataFrame:
    """One row for each prefix shingle of each text: shingle, salt (0 unless crowded), n, doc.

    Of equal sets that a task meets, the first speaks for all (while MET of them are remembered), so a much-copied text has
    a few rows a task. Sizes and sums of 64-bit hashes tell sets apart here; the texts left out keep their class.
    """
    cells = df.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def run(batches):
        heavy = np.unpackbits(cells.value).astype(bool)
        met: set[tuple[int, int]] = set()
        for ids, sets in _sets(batches, width):
            keys, salts, sizes, docs = [], [], [], []
            for doc, s in zip(ids.to_pylist(), sets, strict=True):
                n = len(s)
                if not n or (n, total := int(s.sum(dtype=np.uint64))) in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add((n, total))
                h = heavy[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                length = n - -(-percent * n // 100) + 1
                light = s[~h][:length]
                late = s[h][: length - len(light)]
                keys += [light, late]
                salts += [np.zeros(len(light), np.int32), np.full(len(late), 1 + doc % SALTS, np.int32)]
                sizes.append(np.full(length, n, np.int32))
                docs.append(np.full(length, doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in keys], salts, sizes, docs)], ["shingle", "salt", "n", "doc"])

    return df.mapInArrow(run, "shingle long, salt int, n int, doc long")


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit map of hashed ids (column doc), BITS / 8 bytes whatever their number: it lets a superset of them through."""

    def mark(batches):
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[_bit(b.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "data"])

    def either(items):
        bits = np.zeros(BITS // 8, np.uint8)
        for x in items:
            bits |= np.frombuffer(x, np.uint8)
        return bits.tobytes()

    found = merge_parts(ids.select("doc").mapInArrow(mark, "part int, data binary"), either).collect()
    return np.frombuffer(found[0]["data"], np.uint8) if found else np.zeros(BITS // 8, np.uint8)


def _bit(ids) -> np.ndarray:
    return (mix(np.asarray(ids, np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def sorted_arrays(df: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc, size, members (sorted hashes), bitmap of the texts whose id is in ``ids``.

    Texts stay where they are read; where there are too many ids for their bit map to tell them apart, texts and ids are joined.
    """
    few = ids.count() <= BITS // 4
    shared = df.sparkSession.sparkContext.broadcast(id_bits(ids)) if few else None
    if not few:
        df = df.join(ids.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")

    def run(batches):
        def wanted():
            bits = np.unpackbits(shared.value).astype(bool) if few else None
            for b in batches:
                yield b.filter(pa.array(bits[_bit(b.column(0))])) if few else b

        for ids, sets in _sets(wanted(), width):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity_bitmap(s) for s in sets], pa.binary())], ["doc", "size", "members", "bitmap"])

    found = df.mapInArrow(run, "doc long, size long, members binary, bitmap binary")
    return found.join(ids.select("doc"), "doc", "left_semi") if few else found


def overlap_bound(n, m, x: bytes, y: bytes) -> int:
    """Upper bound of the intersection from the bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return (n + m - int(np.bitwise_count(fold_bitmap(a, size) ^ fold_bitmap(b, size)).sum())) // 2


def verify(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that link: bitmap bound first, then the sorted arrays."""
    bits = arrays.select("doc", "size", "bitmap")
    near = pairs.join(bits.toDF("a", "size_a", "bits_a"), "a").join(bits.toDF("b", "size_b", "bits_b"), "b")

    def bounded(batches):
        for t in batches:
            r = t.to_pydict()
            ok = [overlap_bound(sa, sb, x, y) >= need(sa, sb, percent) for sa, sb, x, y in zip(r["size_a"], r["size_b"], r["bits_a"], r["bits_b"], strict=True)]
            yield t.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    near = materialise(near.mapInArrow(bounded, "a long, b long"), "bounded")
    rows = arrays.select("doc", "members")
    both = near.join(rows.toDF("b", "set_b"), "b").join(rows.toDF("a", "set_a"), "a")

    def exact(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield t.filter(pa.array(ok, pa.bool_())).select([0, 1])

    links = materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long"), "links")
    discard(near)
    return links


def _settle(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among the pairs."""
    with ExitStack() as done:
        pairs = scratch_table(done, pairs, "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        arrays = scratch_table(done, sorted_arrays(docs, ends, width), "arrays")
        return verify(pairs, arrays, percent)


def least_matches(n: Column, m: Column, percent: int) -> Column:
    """Shingles that the prefixes of a linking pair share at least.

    Of the set whose prefix ends first in the common order, at most n - need shingles are missing from the other, so
    the rest of its prefix lies in the other's prefix too.
    """
    required = F.ceil(F.lit(percent / (100 + percent)) * (n + m) - 1e-9)
    prefix = lambda k: k - F.ceil(F.lit(percent / 100) * k - 1e-9) + 1
    return F.greatest(F.lit(1), F.least(prefix(n) - (n - required), prefix(m) - (m - required)))


def _near_in_size(group, n, doc, comp, percent):
    """Index pairs of rows sorted by (group, n): same group, other component, sizes within ``percent``. Walks one step of distance at a time."""
    left, right = [], []
    at = np.arange(len(n) - 1)
    step = 1
    while len(at):
        to = at + step
        ok = (group[at] == group[to]) & (100 * n[at] >= percent * n[to])
        at, to = at[ok], to[ok]
        new = comp[at] != comp[to]
        left.append(at[new])
        right.append(to[new])
        step += 1
        at = at[at + step < len(n)]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _pair_table(x, y) -> pa.Table:
    """Pairs of ids, smaller first, with how often each occurs."""
    both = np.stack([np.minimum(x, y), np.maximum(x, y)])
    out, times = np.unique(both, axis=1, return_counts=True) if both.size else (both.astype(np.int64), np.zeros(0, np.int64))
    return pa.table({"a": pa.array(out[0]), "b": pa.array(out[1]), "matches": pa.array(times.astype(np.int64))})


def _small_groups(rows: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Pairs of shingle groups of up to LARGE members; groups led by the same text go together, so a pair mostly leaves once."""

    def pairs(t):
        shingle, n, doc, comp = (t.column(c).to_numpy() for c in ("shingle", "n", "doc", "comp"))
        order = np.lexsort((n, shingle))
        shingle, n, doc, comp = shingle[order], n[order].astype(np.int64), doc[order], comp[order]
        i, j = _near_in_size(shingle, n, doc, comp, percent)
        return _pair_table(doc[i], doc[j])

    parts = F.ceil(F.col("longest") / PREFIX)  # the groups of a long leader are dealt over several buckets
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("lead", F.pmod("shingle", parts)), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(pairs, "a long, b long, matches long")


def _large_groups(rows: DataFrame, bits: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """Pairs of larger groups: tiles of two blocks of a size band and the band below, thinned by the bitmaps.

    Groups led by the same text share tiles, and each tile is dealt by its own key: those of one leader run in many tasks.
    ``best`` keeps each text's most alike partners of a tile only.
    """
    ratio = float(np.log(100 / percent))
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number: tiles are small in bytes and long in time
    rows = rows.repartition(wide, "lead", "doc").groupBy("lead", "doc").agg(F.collect_set("shingle").alias("shingles"), F.first("blocks").alias("blocks"), F.first("n").alias("n"), F.first("comp").alias("comp"))  # a text's prefix at most
    rows = rows.join(bits, "doc")
    rows = rows.withColumn("band", F.floor(F.log(F.col("n")) / ratio + 1e-9).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # A member is at home in its band and a guest in the band above; a link spans at most one band edge.
    rows = rows.withColumn("at", F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("home")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("home")))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.select("lead", F.col("at.tile").alias("tile"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("at.home").alias("home"), "block", "n", "doc", "comp", "shingles", "bitmap")

    def pairs(key, t):
        low, high = key[2].as_py(), key[3].as_py()
        home = t.column("home").to_numpy()
        block, n, doc, comp = (t.column(c).to_numpy() for c in ("block", "n", "doc", "comp"))
        n = n.astype(np.int64)
        maps = [np.frombuffer(x, np.uint8) for x in t.column("bitmap").to_pylist()]
        held = t.column("shingles").combine_chunks()
        token = np.unique(held.flatten().to_numpy(), return_inverse=True)[1]
        by = np.argsort(token, kind="stable")
        token, owner = token[by], np.repeat(np.arange(len(n)), np.diff(held.offsets.to_numpy()))[by]
        x, y, z = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        every = np.arange(len(n))
        sides = [(every[home & (block == low)], every[block == high])] + ([(every[home & (block == high)], every[block == low])] if low != high else [])
        for homes, rest in sides:
            if not len(homes) or not len(rest) or (comp[homes].min() == comp[homes].max() == comp[rest].min() == comp[rest].max()):
                continue
            shared = common_tokens(token, owner, len(n), homes, rest)
            size = min(min(len(maps[i]) for i in homes), min(len(maps[i]) for i in rest))
            stack = np.stack([fold_bitmap(maps[i], size) for i in rest]).view(np.uint64)
            for i, common in zip(homes, shared, strict=True):
                fit = (common > 0) & (comp[rest] != comp[i]) & (100 * n[rest] >= percent * n[i]) & (100 * n[i] >= percent * n[rest])
                fit &= ~home[rest] | (doc[rest] > doc[i])
                at = np.flatnonzero(fit)
                differ = np.bitwise_count(stack[at] ^ fold_bitmap(maps[i], size).view(np.uint64)).sum(axis=1).astype(np.int64)
                m = n[rest[at]]
                ok = (n[i] + m - differ) // 2 >= need(int(n[i]), m, percent)
                at, differ = at[ok], differ[ok]
                if best is not None and len(at) > best:
                    at = at[np.argpartition(differ, best)[:best]]
                x.append(doc[rest[at]])
                y.append(np.full(len(at), doc[i]))
                z.append(common[at].astype(np.int64))
        x, y, z = np.concatenate(x), np.concatenate(y), np.concatenate(z)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "matches": z})

    return rows.repartition(wide, "lead", "tile", "low", "high").groupBy("lead", "tile", "low", "high").applyInArrow(pairs, "a long, b long, matches long")


def common_tokens(token: np.ndarray, owner: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each of ``left`` shares with each of ``right``; (token, owner) pairs come by token, some of which are multiplied at a time."""
    shared = np.zeros((len(left), len(right)), np.float32)
    top = int(token[-1]) + 1 if len(token) else 0
    for t in range(0, top, TOKENS):
        i, j = np.searchsorted(token, (t, t + TOKENS))
        member = np.zeros((rows, min(TOKENS, top - t)), np.float32)
        member[owner[i:j], token[i:j] - t] = 1
        shared += member[left] @ member[right].T
    return shared


def jaccard_components(documents: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included), class_id (smallest id of an equal set).

    One row for each row of ``documents``. Where ids are null or repeated, rows are told apart by a key of their own (a copy of the
    table is written with it); nulls are never the smallest id, and a component of null ids alone has a null name.
    Empty tables give an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        out = _components(docs, width, percent)
    else:
        keyed = materialise(docs.withColumn("key", F.monotonically_increasing_id()), "keyed")
        out = _components(keyed.select(F.col("key").alias("doc_id"), "text"), width, percent)
        out = out.withColumnsRenamed({"doc_id": "key", "component_id": "component", "class_id": "class"}).join(keyed.select("key", "doc_id"), "key")
        for name in ("component", "class"):
            out = out.join(out.groupBy(name).agg(F.min("doc_id").alias(f"{name}_id")), name)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "class_id")


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The same for unique ids."""
    sets = materialise(describe(docs, width), "sets")
    identity = ["n_shingles", "sum_a", "sum_b"]
    classes = materialise(sets.filter("n_shingles > 0").groupBy(*identity).agg(F.min("doc_id").alias("class_id")), "classes")

    with ExitStack() as done:
        rows = prefixes(docs, width, percent, crowded_cells(docs, width))
        groups = rows.withColumn("size", F.count("*").over(Window.partitionBy("shingle", "salt"))).filter("size > 1 OR salt > 0")
        named = sets.join(classes, identity).select(F.col("doc_id").alias("doc"), "class_id")
        groups = materialise(groups.join(named, "doc").select("shingle", "n", F.col("class_id").alias("doc")).distinct(), "groups")
        heads = groups.groupBy("shingle").agg(F.count("*").alias("size"), F.min("doc").alias("lead"), F.max("n").alias("longest")).filter("size > 1")
        rest = scratch_table(done, groups.join(heads, "shingle"), "rest")
        discard(groups)
        small = rest.filter(F.col("size") <= LARGE).select("shingle", "lead", "longest", "n", "doc")

        # Groups of one leader share tiles, as many as the largest needs; the leaders are salted, as one may lead most rows.
        large = rest.filter(F.col("size") > LARGE)
        most = large.groupBy("lead").agg(F.max("size").alias("most")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = large.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(most, ["lead", "salt"])
        large = large.select("shingle", "lead", "n", "doc", F.ceil(F.col("most") / BLOCK).alias("blocks"))

        # Large groups first lose their copies: each text is tried against its most alike partners.
        bits = scratch_table(done, sorted_arrays(docs, large.select("doc").distinct(), width).select("doc", "bitmap"), "bitmaps")
        tries = _large_groups(large.withColumn("comp", F.col("doc")), bits, percent, BEST).select("a", "b").distinct()
        first = _settle(docs, tries, width, percent)
        done.callback(discard, first)
        labels = components(first)
        done.callback(discard, labels)

        # Then all pairs of texts that are not yet in one component.
        def split(x):
            return x.join(labels, "doc", "left").withColumn("comp", F.coalesce("label", "doc")).drop("label")

        buckets = max(1, small.count() // ROWS)
        pairs = _small_groups(split(small), percent, buckets).unionByName(_large_groups(split(large), bits, percent))
        pairs = pairs.groupBy("a", "b").agg(F.sum("matches").alias("matches"))
        size = rest.groupBy("doc").agg(F.max("n").cast("long").alias("n"))
        pairs = pairs.join(size.toDF("a", "n"), "a").join(size.toDF("b", "m"), "b").filter(F.col("matches") >= least_matches(F.col("n"), F.col("m"), percent)).select("a", "b")
        second = _settle(docs, pairs, width, percent)
        done.callback(discard, second)
        labels = components(first.unionByName(second))

    members = sets.join(classes, identity, "left")
    out = members.join(labels.toDF("class_id", "label"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
