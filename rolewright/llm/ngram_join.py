"""N-gram Jaccard join through parity sketches.

The sketch of a set is a row of cells. A shingle falls into the cell that its hash names and is XORed into it, so a cell keeps the parity of
its shingles, and two sketches differ in at most as many cells as the sets differ in shingles. A pair with Jaccard similarity of at least t
differs in at most D = (a + b)(1 - t)/(1 + t) shingles of sets of sizes a and b. With D + 1 cells at least one cell is equal (pigeonhole), so
the join on cells, size band by size band, finds every such pair. With a few cells more, a similar pair has as many more equal cells, so a set that
shares fewer cells than that with all others together is left out before any pair is built. Sketches of single bits, one of fixed size and one as large as the set, then bound the
difference of a pair from below by their Hamming distance, and the pairs that are left are verified on their shingles.

Equal sets are one vertex. Pairs are verified hub by hub: first the set of a cell that shares most with others with each other one, most shared cells first, and then, only
between components that are still apart, the pairs of a cell. There the more equal cells of a similar pair serve again: each set leaves out its most common cells, as many
as the pair can do without, and so the cells that a whole group of copies shares make no pairs. A group of n near copies costs about n verifications and no link is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolewright.llm import blocks as B
from rolewright.llm.components import components
from rolewright.llm.stage import broadcast_if_small, discard, identified, stage

MINI_BITS, MINI_MOST = 512, 4096  # bits of the sketch that rows of a cell carry
BAND_GROWTH = 1.5
BAND_BITS = 6
MORE_CELLS = 30  # percent of the cells that pigeonhole asks for
CELL_ROWS = 2048
_SKETCHED = "doc long, doc_id long, n_shingles long, set_id long, first boolean, cells array<long>, mini binary, sketch binary"
_SALT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a block, ascending. Words are what stands between white space, A-Z lower-cased; a row of fewer
    words than a shingle takes has its whole sequence as one."""
    low = B.lower_ascii(data)
    starts, ends = B.word_spans(low, offsets, B.NOT_SPACE)
    hashes = B.Prefix(low).spans(starts, ends)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    begin = B.spread(first[:-1], count)
    size = np.repeat(np.minimum(n, words), count)
    row = np.repeat(np.arange(len(n)), count)
    value = np.zeros(len(begin), np.uint64)
    for k in range(words):
        inside = size > k
        value[inside] = B.mix(value[inside] * np.uint64(_SALT[0]) + hashes[begin[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], value[new]


def size_bands(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each band, and the cells of a sketch in it: MORE_CELLS percent more than what two sets of the band's largest size may differ in,
    and one more at least."""
    lows, cells, lo = [], [], 1
    while True:
        hi = max(lo, int(lo * BAND_GROWTH))
        lows.append(lo)
        differ = 2 * hi * (100 - percent) // (100 + percent)
        cells.append((differ + 1) * (100 + MORE_CELLS) // 100 if differ else 1)
        if hi >= largest:
            return np.array(lows), np.array(cells)
        lo = hi + 1


def cells_of(row: np.ndarray, value: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch cells of all rows, whose last bits name the band, and the number of keys of each row. A row has the cells of its own size band, and those of the next
    one if a set that large could still be similar. Bands with one cell find nothing but equal sets and are left out."""
    lows, cells = size_bands(int(sizes.max(initial=1)) * 100 // percent + 1, percent)
    own = np.searchsorted(lows, sizes, "right") - 1
    after = np.minimum(own + 1, len(lows) - 1)
    rows_at = np.searchsorted(row, np.arange(len(sizes) + 1))
    keys, owner = [], []
    for band, taken in ((own, sizes > 0), (after, (after > own) & (sizes > 0) & (sizes * 100 >= lows[after] * percent))):
        width = np.where(taken & (cells[np.maximum(band, 0)] > 1), cells[np.maximum(band, 0)], 0)
        base = np.cumsum(width) - width
        parity = np.zeros(int(width.sum()), np.uint64)
        used = np.repeat(width > 0, np.diff(rows_at))
        r, v = row[used], value[used]
        if len(r):
            cell = base[r] + (((v >> np.uint64(32)) * width[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            parity[cell[new]] = np.bitwise_xor.reduceat(v, new)
        of = np.repeat(np.arange(len(sizes)), width)
        place = np.arange(len(parity)) - base[of]
        tag = (band[of].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64)
        hashed = B.mix(parity ^ B.mix(tag + np.uint64(_SALT[1])))
        keys.append(hashed >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | band[of].astype(np.uint64))
        owner.append(of)
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return keys[order].view(np.int64), np.bincount(owner, minlength=len(sizes))


def _parity(row: np.ndarray, value: np.ndarray, bits: np.ndarray) -> pa.Array:
    """Bit sketches: shingle h of row r flips bit h mod bits[r], a power of two or 0; so half of a sketch XOR its other half is the sketch of half the size."""
    stop = np.cumsum(bits)
    place = (stop - bits)[row] + (value & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(stop[-1]) if len(stop) else 0) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer((np.concatenate(([0], stop)) // 8).astype(np.int32)), pa.py_buffer(packed)])


def _near(percent: int):
    """The pairs whose bit sketches differ in no more bits than the sets may in shingles."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column(3).to_numpy() + batch.column(4).to_numpy()
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(c[r].as_buffer(), np.uint64) for c in (batch.column(5), batch.column(6)))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                keep[r] = int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= sizes[r] * (100 - percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:3]], ["a", "b", "cells"])

    return near


def sketched(rows: DataFrame, words: int, percent: int, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """A row for each of the ``identified`` rows: size and id of its set, and, for the first one of a set in its task, cells and bit sketch."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, data, offsets in B.text_blocks(batch, 2, block_bytes):
                n = part.num_rows
                row, value = shingles(data, offsets, words)
                at = np.searchsorted(row, np.arange(n + 1))
                sizes = np.diff(at)
                sums = np.concatenate(([np.uint64(0)], np.cumsum(B.mix(value ^ np.uint64(_SALT[1])))))
                set_id = B.mix((sums[at[1:]] - sums[at[:-1]]) ^ B.mix(sizes.astype(np.uint64))).view(np.int64)
                first = np.zeros(n, bool)
                for i, s in enumerate(set_id.tolist()):
                    if sizes[i] and s not in seen:
                        seen.add(s)
                        first[i] = True
                keep = first[row] if len(row) else np.zeros(0, bool)
                keys, width = cells_of(row[keep], value[keep], np.where(first, sizes, 0), percent)
                large = np.where(first, np.maximum(MINI_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
                mini, sketch = (_parity(row[keep], value[keep], width) for width in (np.minimum(large, MINI_MOST), large))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(set_id), pa.array(first), lists, mini, sketch], [c.split()[0] for c in _SKETCHED.split(", ")])

    return rows.select("doc", "doc_id", "text").mapInArrow(sketches, _SKETCHED)


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (cell, set, size) in order: the rows of cells that several sets have, each with the least set of the cell."""
    held, hub, run = None, None, None  # the last row and whether it is shared already; the hub of its cell

    def out(cell, sets, size, hubs, shared) -> Iterator[pa.RecordBatch]:
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (cell, sets, size, hubs)], ["cell", "set_id", "n", "hub"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, sets, size = (c.to_numpy() for c in batch.columns)
        if held is not None:
            cell, sets, size = (np.concatenate(([h], x)) for h, x in zip(held, (cell, sets, size), strict=True))
        fresh = np.concatenate(([True], (cell[1:] != cell[:-1]) | (sets[1:] != sets[:-1])))
        cell, sets, size = cell[fresh], sets[fresh], size[fresh]
        begins = np.concatenate(([True], cell[1:] != cell[:-1]))
        hubs = sets[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        shared = np.zeros(len(cell), bool)
        shared[1:] |= ~begins[1:]
        shared[:-1] |= ~begins[1:]
        if held is not None:
            shared[0] |= run
            hubs[cell == cell[0]] = hub
        yield from out(cell[:-1], sets[:-1], size[:-1], hubs[:-1], shared[:-1])
        held, hub, run = (cell[-1], sets[-1], size[-1]), hubs[-1], bool(shared[-1])
    if held is not None:
        yield from out(*(np.array([x]) for x in (*held, hub, run)))


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Bit sketches, one a row, folded to the width of the smallest one: half of a sketch XOR its other half is the sketch of half the size."""
    least = min(map(len, sketches))
    rows = []
    for x in sketches:
        bits = np.frombuffer(x, np.uint64)
        rows.append(np.bitwise_xor.reduce(bits.reshape(-1, least // 8), axis=0))
    return np.stack(rows)


def _pairs_apart(percent: int):
    """Pairs of different components within a cell block whose sizes and bit sketches allow the similarity."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            group = np.stack([table[c].to_numpy() for c in ("cell", "i", "j")], 1)
            begins = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(1))))
            yield from emit(table.slice(0, int(begins[-1])), begins[:-1])
            held = table.slice(int(begins[-1]))
        if held is not None and held.num_rows:
            yield from emit(held, np.zeros(1, np.int64))

    def emit(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:  # all rows so far are of the group that is held
            return
        sets, size, root, own, i, j = (table[c].to_numpy() for c in ("set_id", "n", "root", "own", "i", "j"))
        mini = table["mini"].to_pylist()
        for lo, hi in zip(begins, np.append(begins[1:], table.num_rows), strict=True):
            if (root[lo:hi] == root[lo]).all():
                continue
            at = np.arange(lo, hi)
            bits = _folded(mini[lo:hi])
            left, right = at[own[lo:hi] == i[lo]], at[own[lo:hi] == j[lo]]
            for x in left.tolist():
                y = right[(root[right] != root[x]) & (np.minimum(size[right], size[x]) * 100 >= np.maximum(size[right], size[x]) * percent)]
                if i[lo] == j[lo]:
                    y = y[sets[y] > sets[x]]
                y = y[np.bitwise_count(bits[y - lo] ^ bits[x - lo]).sum(1, dtype=np.int64) * (100 + percent) <= (size[y] + size[x]) * (100 - percent)]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sets[y], sets[x])), pa.array(np.maximum(sets[y], sets[x]))], ["a", "b"])

    return pairs


def _verified(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(c[r].as_buffer(), np.uint64) for c in (left, right))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                linked[r] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    return check


class _Verifier:
    """Checks pairs of sets: by sizes and bit sketches first, then on the shingles of a document of each set, which are cut once a set."""

    def __init__(self, rows: DataFrame, sets: DataFrame, words: int, percent: int, block_bytes: int):
        self.rows, self.sets, self.words, self.percent, self.block_bytes = rows, sets, words, percent, block_bytes
        self.lists: list[DataFrame] = []

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of (a, b, cells) that sizes and bit sketches allow."""
        left = self.sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = self.sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        joined = pairs.join(left, "a").join(right, "b").where("least(n_a, n_b) * 100 >= greatest(n_a, n_b) * %d" % self.percent)
        return joined.select("a", "b", "cells", "n_a", "n_b", "s_a", "s_b").mapInArrow(_near(self.percent), "a long, b long, cells long")

    def read(self, pairs: DataFrame) -> None:
        """Cut the shingles of the sets of these pairs that haven't been cut yet."""
        wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        for known in self.lists:
            wanted = wanted.join(known.select("set_id"), "set_id", "left_anti")
        docs = stage(self.sets.join(wanted, "set_id").select("doc", "set_id"), "wanted")
        if docs.count():
            lists = self.rows.select("doc", "text").join(broadcast_if_small(docs), "doc").select("set_id", "text").mapInArrow(self._lists(), "set_id long, list binary")
            # a row that is repeated as a whole gives its set more than once; one is enough
            self.lists.append(stage(lists.dropDuplicates(["set_id"]), "shingles"))
        discard(docs)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        near = stage(pairs, "near-pairs")
        self.read(near)
        if not self.lists:  # no pair at all
            return stage(near.select("a", "b", F.lit(False).alias("linked")), "verified")
        lists = self.lists[0]
        for more in self.lists[1:]:
            lists = lists.unionByName(more)
        joined = near.join(lists.select(F.col("set_id").alias("a"), F.col("list").alias("l_a")), "a").join(lists.select(F.col("set_id").alias("b"), F.col("list").alias("l_b")), "b")
        done = stage(joined.select("a", "b", "l_a", "l_b").mapInArrow(_verified(self.percent), "a long, b long, linked boolean"), "verified")
        discard(near)
        return done

    def _lists(self):
        words, block_bytes = self.words, self.block_bytes

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in B.text_blocks(batch, 1, block_bytes):
                    row, value = shingles(data, offsets, words)
                    at = (np.searchsorted(row, np.arange(part.num_rows + 1)) * 8).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at), pa.py_buffer(value)])], ["set_id", "list"])

        return lists


def similar_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``doc, doc_id, n_shingles, component_id, root`` for every row. Two documents are linked when the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``percent`` / 100; ``component_id`` is the least ``doc_id`` that links lead to.

    ``doc`` is a hash of id and text; ``root`` names the component, whatever its ids are, and is null without shingles. Null texts and texts without words have no shingles and no links: their component is their own id. Repeated rows are linked
    with each other. Ids that are null take part and are never the least, unless a component has no other. Columns beside id and text
    are ignored, whatever their names.
    """
    rows = identified(docs, id_col, text_col)
    full = stage(sketched(rows, words, percent, block_bytes), "sketches")
    every = stage(full.select("doc", "doc_id", "n_shingles", "set_id"), "documents")
    firsts = full.where("first")
    sets = stage(firsts.groupBy("set_id").agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("n"), F.max("mini").alias("mini"), F.max("sketch").alias("sketch")), "sets")
    cells = firsts.select(F.explode("cells").alias("cell"), "set_id", F.col("n_shingles").alias("n"))
    shared = stage(cells.repartition("cell").sortWithinPartitions("cell", "set_id").mapInArrow(_shared_cells, "cell long, set_id long, n long, hub long"), "cells")
    discard(full)
    shared = _able(shared, percent)
    verify = _Verifier(rows, sets, words, percent, block_bytes)
    stars = shared.where("set_id <> hub").groupBy(F.col("hub").alias("a"), F.col("set_id").alias("b")).agg(F.count("*").alias("cells"))
    stars = stage(verify.near(stars), "stars")
    verify.read(stars)
    first = verify(stars.groupBy("b").agg(F.max_by("a", F.struct("cells", "a")).alias("a")).select("a", "b"))
    roots = components(first.where("linked"))
    second = verify(_apart(stars.select("a", "b"), roots).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    tested = first.unionByName(second)
    roots = components(tested.where("linked"))
    starred = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = _cell_pairs(shared, sets, roots, percent, cell_rows).join(starred, ["a", "b"], "left_anti")
    third = verify(verify.near(apart.withColumn("cells", F.lit(1).cast("long"))).select("a", "b"))
    roots = components(tested.unionByName(third).where("linked"))
    discard(first, second, third, stars, shared, sets, *verify.lists)
    of_set = every.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    of_set = of_set.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = of_set.groupBy("root").agg(F.min("least").alias("component_id"))
    final = of_set.join(least, "root").select("set_id", "component_id", "root")
    whole = every.select("doc", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id"))
    named = whole.where("n_shingles > 0").join(final, "set_id").select("doc", "doc_id", "n_shingles", "component_id", "root")
    return named.unionByName(whole.where("n_shingles = 0").select("doc", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")))


def _able(shared: DataFrame, percent: int) -> DataFrame:
    """``cell, set_id, n, hub, prefix`` without the sets that share too few cells of a band with others to be similar to any: each set needs as many equal cells as its band has
    beyond those that a similar set may differ in. The second pass starts from what the first one left.

    A similar pair has ``need`` equal cells at least, so it still has one when each set leaves out its ``need - 1`` most common ones; ``prefix`` tells those that are not left out.
    The hub of a cell is the set whose cells others have most often: among near copies the one that most others are close to."""
    _, cells = size_bands(1 << 40, percent)
    band = F.col("cell").bitwiseAND((1 << BAND_BITS) - 1).cast("int")
    of_band = F.element_at(F.array(*[F.lit(int(c)) for c in cells]), F.col("band") + 1)
    differ = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent) / (100 + percent))
    rows = shared.select("cell", "set_id", "n", F.lit(1).cast("long").alias("m"), band.alias("band"))
    for last in (False, True):
        able = rows.groupBy("set_id", "band").agg(F.count("*").alias("own"), F.max("n").alias("n"), F.sum("m").alias("common"))
        able = able.withColumn("need", of_band - differ).where("own >= need").select("set_id", "band", "need", "common")
        left = rows.join(able, ["set_id", "band"])
        most = F.max_by("set_id", F.struct("common", F.negative("set_id"))).alias("hub")
        hubs = left.groupBy("cell").agg(F.count("*").alias("now"), most).where("now > 1")
        if not last:
            now = stage(left.select("cell", "set_id", "n", "band").join(hubs.select("cell", F.col("now").alias("m")), "cell"), "cells")
            rows = now
            continue
        rank = F.row_number().over(Window.partitionBy("set_id", "band").orderBy(F.desc("m"), "cell"))
        left = left.withColumn("prefix", rank >= F.col("need"))
        done = stage(left.select("cell", "set_id", "n", "prefix").join(hubs.select("cell", "hub"), "cell"), "cells")
    discard(shared, now)
    return done


def _rooted(frame: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return frame.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, "a", roots, "r_a"), "b", roots, "r_b").where("r_a <> r_b").select("a", "b")


def _cell_pairs(shared: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """All pairs of sets that share a cell, lie in different components and may be similar by their bit sketches. Cells with many sets are dealt
    out as pairs of blocks; what leaves a task is not all pairs of a cell but those within the bound."""
    rooted = _rooted(shared.where("prefix"), "set_id", roots, "root")
    mixed = rooted.groupBy("cell").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell", F.ceil(F.col("m") / cell_rows).cast("int").alias("k"))
    members = rooted.join(mixed, "cell").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("k")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    members = members.join(sets.select("set_id", "mini"), "set_id")
    members = members.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "n", "root", "mini")
    dealt = members.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return dealt.mapInArrow(_pairs_apart(percent), "a long, b long").distinct()
