"""N-gram Jaccard join as a blocked sparse product over rare-first prefix columns.

Rows of the incidence matrix are distinct shingle sets: documents of equal sets are one row,
named by 128 bits of hashes of the set, so exact copies never meet as pairs. Columns (hashed shingles) have one
order for all rows, rare ones first, by a table of SLOTS counts that has the same size for any corpus. A row of
size s enters the product with its first s - ceil(t * s) + c(s) columns: two sets at the threshold t share
at least c(the smaller size) of those, whatever the order is. c grows with s, for long sets share a few rare columns by chance.
Columns are dealt to blocks; each block multiplies its part of the matrix, drops pairs beyond the size bound, and the counts of
shared columns of a pair are accumulated over the blocks. Pairs with fewer than c are dropped; the others are counted exactly, over whole rows.

A column of more than COOL rows is hot: its product would grow with the square of its rows. Its rows are one group
instead (by classes of size). Links are found towards a hub of the group, then, for groups that
still span components, towards hubs of their largest components; what is still apart is compared in blocks of rows by
sketches (counts of hashed shingles: their L1 distance is at most the sets' difference), and the
pairs that these don't rule out are counted exactly. So no link between different components is lost, in hot
columns or others, at any size of set. Links within a component are not all found, and none are returned.

Links, components and sets stay distributed. Defined cases: null text and texts without words have empty sets and
link with nothing; texts of fewer words than a shingle are one shingle; rows with the same doc_id are documents of that id;
null doc_id names no component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, repeats
from .common import dealt, discard, small, table, tidy
from .ragged import ASCII_LOWER, IS_SPACE, Texts, grams, mix, pieces, span_hashes, split_words, WORD_BASE

SHINGLE, PERCENT = 3, 90
_SALT = np.uint64(0x2545F4914F6CDD1D)
#: Prefix columns that linked sets share, at least and one more for so many of their size; rows from which on a column is hot; slots of the table that orders columns
#: (the more shingles fall to a slot, the less its count tells of each, and the more columns of a prefix are hot).
COMMON, COMMON_PER, COOL, SLOTS = 3, 64, 32, 1 << 20
#: Counters of a sketch; rounds of stars between components; rows of a block of compared sketches.
SKETCH, STARS, BLOCK = 256, 2, 2048
#: Cells from which on a row is a hub's.
HUB = 64
#: Entries of columns a worker gathers before it sends them on; entries of rows counted at once (one cell at least).
FLUSH, CELL_ENTRIES = 500_000, 250_000


def shingle_sets(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted."""
    words = split_words(texts, ~IS_SPACE, ASCII_LOWER)
    at, hashes = grams(words, n)
    rows = words.row[at]
    bounds = words.bounds(len(texts.offsets) - 1)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < n))
    rows = np.concatenate((rows, short))
    hashes = np.concatenate((hashes, span_hashes(words.hashes, bounds[short], bounds[short + 1], WORD_BASE)))
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def named_sets(texts: Texts, n: int = SHINGLE):
    """(row, size, name) of the texts with a set, and the sets' hashes one after the other. A name is two numbers."""
    rows, hashes = shingle_sets(texts, n)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), hashes
    size = np.diff(np.append(starts, len(rows)))
    high = mix(np.add.reduceat(mix(hashes), starts) ^ size.astype(np.uint64))
    low = mix(np.add.reduceat(mix(hashes ^ _SALT), starts))
    return rows[starts], size, np.stack((high, low), 1), hashes


def blobs(name: np.ndarray) -> pa.Array:
    """Names as 16 bytes each, which order as the numbers do."""
    offsets = np.arange(len(name) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(offsets), pa.py_buffer(name.astype(">u8").tobytes())])


def _cut_sets(which: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    blob, at = hashes.tobytes(), np.concatenate(([0], np.cumsum(size))) * 8
    return [blob[at[i] : at[i + 1]] for i in which.tolist()]


def _numbered(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct names in order, number of each name among them)."""
    order = np.lexsort((name[:, 1], name[:, 0]))
    some = name[order]
    new = np.ones(len(some), bool)
    new[1:] = (some[1:] != some[:-1]).any(1)
    number = np.empty(len(name), np.int64)
    number[order] = np.cumsum(new) - 1
    return some[new], number


def _planes(counts: np.ndarray) -> bytes:
    """Counts of slots by the place of their bytes: the high ones, mostly 0, take next to nothing once compressed."""
    return counts.view(np.uint8).reshape(len(counts), -1).T.tobytes()


def _counted(blob: bytes) -> np.ndarray:
    """The counts of slots in _planes() of 4 or 8 bytes."""
    planes = np.frombuffer(blob, np.uint8).reshape(-1, SLOTS)
    return np.ascontiguousarray(planes.T).view(np.int32 if len(planes) == 4 else np.int64)[:, 0]


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, name, counts) of every document, name null where the set is empty; and one row a task with only counts: shingles by slot."""

    def scan(batches):
        counts, slots, held = np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            sizes, names = np.zeros(len(batch), np.int64), np.zeros((len(batch), 2), np.uint64)
            for t in pieces(batch.column(1)):
                row, size, name, hashes = named_sets(t, n)
                sizes[t.first + row], names[t.first + row] = size, name
                slots.append((hashes >> np.uint64(40)).astype(np.int32) % SLOTS)
                held += len(hashes)
                if held >= SLOTS:
                    counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
                    slots, held = [], 0
            name = pc.if_else(pa.array(sizes > 0), blobs(names), pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), name, pa.nulls(len(batch), pa.binary())], names=["doc_id", "n_shingles", "name", "counts"])
        if held:
            counts += np.bincount(np.concatenate(slots), minlength=SLOTS)
        if counts.any():
            blob = _planes(np.minimum(counts, 2**31 - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names=["doc_id", "n_shingles", "name", "counts"])

    return docs.mapInArrow(scan, "doc_id long, n_shingles long, name binary, counts binary")


def column_ranks(sets: DataFrame) -> np.ndarray:
    """The place in the columns' order of each slot, as a byte. Counts are summed where they lie, then in one short task."""

    def add(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += _counted(blob.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([_planes(total)], pa.binary())], names=["counts"])

    partial = sets.filter("counts IS NOT NULL").select("counts").mapInArrow(add, "counts binary")
    total = _counted(partial.repartition(1).mapInArrow(add, "counts binary").collect()[0][0])
    return np.minimum(4 * np.log2(1 + total), 255).astype(np.uint8)


def common_columns(size: np.ndarray, percent: int) -> np.ndarray:
    """Prefix columns that two different linked sets share at least, by the smaller size. No set can link with fewer common columns in all."""
    least = COMMON if percent >= 100 else max(1, min(COMMON, -(-percent // (100 - percent))))
    return np.minimum(least + size // COMMON_PER, np.maximum(size * percent // 100, 1))


def prefix_entries(size: np.ndarray, hashes: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, column) of the sets' prefixes."""
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(owner << 8 | ranks[(hashes >> np.uint64(40)).astype(np.int64) % SLOTS], kind="stable")  # within a rank by hash
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    kept = nth < np.repeat(size + (-size * percent) // 100 + common_columns(size, percent), size)
    return owner[kept], hashes[order][kept]


def size_class(size: np.ndarray, percent: int) -> np.ndarray:
    """Classes of size: sets that link are at most one class apart."""
    first, most = [1], int(size.max(initial=1))
    while first[-1] <= most:
        first.append(first[-1] * 100 // percent + 1)
    return np.searchsorted(np.array(first), size, "right") - 1


def _hot_rows(column: np.ndarray, name: np.ndarray, size: np.ndarray, percent: int) -> pa.Table:
    """Members (g, a) of the groups of hot columns: each row in its own class of size and the next."""
    level = size_class(size, percent).astype(np.uint64)
    group = np.concatenate([mix(column ^ mix(level + np.uint64(step))) for step in (1, 2)])
    n = len(group)
    return pa.table({"g": group.view(np.int64), "a": blobs(np.concatenate((name, name))), "b": pa.nulls(n, pa.binary()), "n": pa.nulls(n, pa.int32()), "least": pa.nulls(n, pa.int32())})


def column_entries(docs: DataFrame, n: int, percent: int, ranks: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, c0: columns, c1: names, c2: sizes, c3: columns of each set): prefix entries dealt by column, set by set. Columns found
    hot within a flush stay where they lie, in bucket -1, and leave one entry of a set of size 0 in their bucket as a mark."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def row(bucket, column, of, name, size):
        head = np.flatnonzero(np.diff(of, prepend=-1))
        sets = of[head]
        each = np.diff(np.append(head, len(of)))
        return [bucket, repeats._cut(column).tobytes(), name[sets].tobytes(), size[sets].tobytes(), each.astype(np.uint32).tobytes()]

    def flush(column, of, name, size):
        column = column >> np.uint64(16) << np.uint64(16)
        by = np.argsort(column, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], column[by[1:]] != column[by[:-1]])))
        many = np.diff(np.append(starts, len(by)))
        hot = np.zeros(len(by), bool)
        hot[by] = np.repeat(many > COOL, many)
        rows = []
        if hot.any():
            rows.append(row(-1, column[hot], of[hot], name, size))
            marks = column[by[starts[many > COOL]]]
            column, of = np.concatenate((column[~hot], marks)), np.concatenate((of[~hot], np.full(len(marks), len(name))))
            name, size = np.concatenate((name, np.zeros((1, 2), np.uint64))), np.append(size, np.uint32(0))
        bucket = (((column >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        by = np.lexsort((of, bucket))
        for lo, hi in repeats._runs(bucket[by]):
            some = by[lo:hi]
            rows.append(row(int(bucket[some[0]]), column[some], of[some], name, size))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(5)], names=["bucket", "c0", "c1", "c2", "c3"])

    def scan(batches):
        columns, owners, names, sizes, held, sets, seen = [], [], [], [], 0, 0, set()
        for batch in batches:
            for t in pieces(batch.column(1)):
                _, size, name, hashes = named_sets(t, n)
                fresh = np.zeros(len(name), bool)
                for i, k in enumerate(map(tuple, name.tolist())):  # copies in this flush are sent once
                    fresh[i] = k not in seen
                    seen.add(k)
                owner, column = prefix_entries(size[fresh], hashes[np.repeat(fresh, size)], sent.value, percent)
                columns.append(column)
                owners.append(owner + sets)
                names.append(name[fresh])
                sizes.append(size[fresh].astype(np.uint32))
                held += len(column)
                sets += len(sizes[-1])
                if held >= FLUSH:
                    yield from flush(*map(np.concatenate, (columns, owners, names, sizes)))
                    columns, owners, names, sizes, held, sets, seen = [], [], [], [], 0, 0, set()
        if held:
            yield from flush(*map(np.concatenate, (columns, owners, names, sizes)))
        packed.give_back()

    return docs.mapInArrow(scan, packed.schema(4))


CELLS = "g long, a binary, b binary, n int, least int"


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(columns, set of each, names, sizes) of packed rows."""
    name, size, each = packed.column(table, 1, np.uint64).reshape(-1, 2), packed.column(table, 2, np.uint32), packed.column(table, 3, np.uint32)
    return repeats._uncut(b"".join(table["c0"].to_pylist())), np.repeat(np.arange(len(each)), each), name, size.astype(np.int64)


def multiplied(group: pa.Table, percent: int) -> pa.Table:
    """The product of one block of columns: pairs (a, b), the number n of columns of the block that they share and the least number in all; members of hot columns as (g, a)."""
    column, of, name, size = _entries(group)
    distinct, number = _numbered(name)
    sizes = np.zeros(len(distinct), np.int64)
    sizes[number] = size
    number = number[of]
    order = np.lexsort((number, column))
    column, number = column[order], number[order]
    head = np.ones(len(column), bool)
    head[1:] = column[1:] != column[:-1]
    new = head.copy()
    new[1:] |= number[1:] != number[:-1]
    of, mark = np.cumsum(head) - 1, sizes[number] == 0
    hot = np.bincount(of, weights=mark) > 0
    new &= ~mark
    column, number, of = column[new], number[new], of[new]
    hot |= np.bincount(of, minlength=len(hot)) > COOL
    out = [_hot_rows(column[hot[of]], distinct[number[hot[of]]], sizes[number[hot[of]]], percent)]
    number, of = number[~hot[of]], of[~hot[of]]
    size, pairs = sizes[number], []
    for step in range(1, COOL):
        i = np.flatnonzero(of[step:] == of[:-step]) if len(of) > step else np.zeros(0, np.int64)
        i = i[np.minimum(size[i], size[i + step]) * 100 >= np.maximum(size[i], size[i + step]) * percent]
        pairs.append(number[i] * len(distinct) + number[i + step])
    pair, shared = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = np.divmod(pair, len(distinct))
    least = common_columns(np.minimum(sizes[a], sizes[b]), percent)
    out.append(pa.table({"g": pa.nulls(len(pair), pa.int64()), "a": blobs(distinct[a]), "b": blobs(distinct[b]), "n": shared.astype(np.int32), "least": least.astype(np.int32)}))
    packed.give_back()
    return pa.concat_tables(out)


def product(docs: DataFrame, n: int, percent: int, ranks: np.ndarray, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, n) of cool columns with enough shared ones, members (g, name) of the groups of hot columns)."""
    entries = table(column_entries(docs, n, percent, ranks, buckets), "jaccard-entries")

    def spread(batches):
        for batch in batches:
            for row in range(len(batch)):
                column, of, name, size = _entries(pa.Table.from_batches([batch.slice(row, 1)]))
                yield from _hot_rows(column, name[of], size[of], percent).to_batches()

    cells = table(packed.by_bucket(entries.filter("bucket >= 0"), lambda g: multiplied(g, percent), CELLS), "jaccard-product")
    near = entries.filter("bucket < 0").mapInArrow(spread, CELLS)
    pairs = cells.filter("g IS NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("least").alias("least")).filter("n >= least").drop("least")
    members = cells.filter("g IS NOT NULL").unionByName(near).select("g", F.col("a").alias("name")).distinct()
    members = table(members, "jaccard-members")
    pairs = table(pairs, "jaccard-pairs")
    discard(entries, cells)
    tidy(docs.sparkSession)
    # groups of the same members once
    same = members.groupBy("g").agg(F.sum(F.xxhash64("name").cast("decimal(38,0)")).alias("s"), F.count("*").alias("c")).filter("c > 1")
    once = same.groupBy("s", "c").agg(F.min("g").alias("g")).select("g")
    return pairs, table(members.join(once, "g"), "jaccard-groups")


def sketches(size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many of each set's shingles fall to each of SKETCH counters, 255 at most: that takes nothing from the bound, for it only brings counters closer."""
    slot = np.repeat(np.arange(len(size)), size) * SKETCH + (hashes >> np.uint64(40)).astype(np.int64) % SKETCH
    return np.minimum(np.bincount(slot, minlength=len(size) * SKETCH), 255).astype(np.uint8).reshape(-1, SKETCH)


def may_link(size_a: np.ndarray, size_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the L1 distance of sketches, at most the sets' difference, allow a link."""
    sizes = np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent
    return sizes & (apart * (100 + percent) <= (100 - percent) * (size_a + size_b))


def rows_of(docs: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(name, row, size, sketch) of the named sets: their hashes, sorted, how many, and counts of them."""
    names = table(names, "jaccard-wanted")
    wanted, sent = small(names), None
    if wanted is not names:  # few enough to leave the others out before rows are made
        high = names.select(F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long").alias("h")).toArrow().column("h")
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(high).view(np.uint64)))

    def scan(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for t in pieces(batch.column(1)):
                _, size, name, hashes = named_sets(t, n)
                which = np.unique(_numbered(name)[1], return_index=True)[1]
                if sent is not None:
                    which = which[np.isin(name[which, 0], sent.value)]
                    which = np.array([i for i, k in zip(which.tolist(), map(tuple, name[which].tolist()), strict=True) if k not in seen], np.int64)
                    seen.update(map(tuple, name[which].tolist()))
                wanted_rows = np.isin(np.arange(len(size)), which)
                drawn = np.empty(len(size), object)
                drawn[wanted_rows] = [s.tobytes() for s in sketches(size[wanted_rows], hashes[np.repeat(wanted_rows, size)])]
                drawn = drawn[which].tolist()
                arrays = [blobs(name[which]), pa.array(_cut_sets(which, size, hashes), pa.binary()), pa.array(size[which], pa.int64()), pa.array(drawn, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "row", "size", "sketch"])
        packed.give_back()

    found = docs.mapInArrow(scan, "name binary, row binary, size long, sketch binary").join(wanted, "name")
    rows = dealt(found.groupBy("name").agg(*[F.first(c).alias(c) for c in ("row", "size", "sketch")]), "jaccard-rows", "name")
    discard(names)
    tidy(docs.sparkSession)
    return rows


def _turned(cells: DataFrame) -> DataFrame:
    """(a, b, links) of cells, each turned so that a is the end in more cells, which are its links. So no b is in many: at most about the root of all of them."""
    degree = cells.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("d"))
    at = lambda c, d: degree.select(F.col("name").alias(c), F.col("d").alias(d))
    both, first = cells.join(at("a", "da"), "a").join(at("b", "db"), "b"), F.col("da") >= F.col("db")
    return table(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("da", "db").alias("links")), "jaccard-turned")


def _met(cells: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) of the written table cells with those columns of both rows, as a_column and b_column.

    What a has travels to where rows keeps that of b. Hubs, in more than HUB cells, are broadcast if their bytes allow it: they don't travel once a cell.
    """
    cells = _turned(cells.select("a", "b"))
    is_hub = F.col("links") > HUB
    heads = table(rows.select("name", *columns).join(cells.filter(is_hub).select(F.col("a").alias("name")).distinct(), "name"), "jaccard-hubs")
    sent = small(heads)
    at = lambda df, end: df.select(F.col("name").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    wanted = ["a", "b", *[f"{end}_{c}" for c in columns for end in "ab"]]
    far = cells if sent is heads else cells.filter(~is_hub)
    both = at(rows, "a").join(small(far), "a").drop("links").join(at(rows, "b"), "b").select(*wanted)
    if sent is heads:
        return both
    return both.unionByName(cells.filter(is_hub).join(at(rows, "b"), "b").join(at(sent, "a"), "a").select(*wanted))


def likely_cells(cells: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the written table cells that sizes and sketches don't rule out: whole rows travel only for these."""

    def check(batches):
        for batch in batches:
            size_a, size_b = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in (4, 5))
            ok = pa.array(may_link(size_a, size_b, np.abs(left - right).sum(1, dtype=np.int64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return _met(cells, rows, ["size", "sketch"]).mapInArrow(check, "a binary, b binary")


def overlap_links(cells: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of the written table cells whose sets are similar enough, by exact overlap counts."""
    both = _met(table(likely_cells(cells, rows, percent), "jaccard-likely"), rows, ["row"])

    def multiply(batches):
        for batch in batches:
            entries = np.cumsum(sum(np.asarray(pc.binary_length(batch.column(c)), np.int64) // 8 for c in (2, 3)))
            run = np.flatnonzero(np.diff(entries // CELL_ENTRIES, prepend=-1))
            for lo, hi in zip(run.tolist(), np.append(run, len(batch))[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                left, right = part.column(2).to_pylist(), part.column(3).to_pylist()
                na, nb = np.array([len(x) // 8 for x in left]), np.array([len(x) // 8 for x in right])
                cell = np.arange(len(part))
                # entries of both sparse rows of each cell, side by side: an equal neighbour is an overlap
                of = np.concatenate((np.repeat(cell, na), np.repeat(cell, nb)))
                value = np.frombuffer(b"".join(left + right), np.uint64)
                order = np.lexsort((value, of))
                of, value = of[order], value[order]
                twin = (of[1:] == of[:-1]) & (value[1:] == value[:-1])
                overlap = np.bincount(of[1:][twin], minlength=len(part))
                ok = pa.array(overlap * 100 >= percent * (na + nb - overlap))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])
        packed.give_back()

    return both.mapInArrow(multiply, "a binary, b binary")


def near_cells(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): of members (g, name, root, size, sketch), pairs of a group and different roots whose sketches allow a link.

    Groups are compared in blocks of about BLOCK members by BLOCK; only pairs that pass are emitted.
    """
    sizes = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"))
    parts = members.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("name"), F.col("of")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    parts = parts.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        name, (_, root) = table["name"].to_pylist(), np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
        size, own = (np.asarray(table[c]) for c in ("size", "own"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        right = right[np.argsort(size[right], kind="stable")]
        out = []
        for k in left.tolist():
            lo, hi = np.searchsorted(size[right], (-(-size[k] * percent // 100), size[k] * 100 // percent + 1))
            near = right[lo:hi]
            near = near[(root[near] != root[k]) & ((near > k) if i == j else True)]
            near = near[may_link(size[near], size[k], np.abs(sketch[near] - sketch[k]).sum(1, dtype=np.int64), percent)]
            out += [(name[k], name[x]) if name[k] < name[x] else (name[x], name[k]) for x in near.tolist()]
        return pa.table([pa.array([p[c] for p in out], pa.binary()) for c in (0, 1)], names=["a", "b"])

    return parts.select("g", "name", "root", "size", "sketch", "own", "i", "j").groupBy("g", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def connected(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(name, root) for the ends of the written table links: contraction towards the neighbour of most links (of equals by a hash redrawn every round)."""
    edges, roots = links, None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("name"), F.col("b").alias("root"))
    for k in range(max_rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count("*").alias("d"))
        rank = lambda c: F.struct("d", F.xxhash64(F.col(c), F.lit(k)).alias("r"), F.col(c).alias("v"))  # noqa: E731, B023
        degree = table(degree, f"degree-{k}")
        near = both.join(degree.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.max(rank("b")).alias("near"))
        step = table(near.join(degree, "a").select("a", F.greatest("near", rank("a"))["v"].alias("to")), f"step-{k}")
        at = lambda c, d: step.select(F.col("a").alias(c), F.col("to").alias(d))  # noqa: E731, B023
        left = table(edges.join(at("a", "x"), "a").join(at("b", "y"), "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges-{k}")
        old = [degree, *([edges, roots, step] if k else [])]
        roots = step.select(F.col("a").alias("name"), F.col("to").alias("root")) if roots is None else table(roots.join(at("root", "to"), "root", "left").select("name", F.coalesce("to", "root").alias("root")), f"roots-{k}")
        if k == 0:
            roots.written_to = step.written_to
        discard(*old)
        edges = left
        if edges.isEmpty():
            return roots
    raise RuntimeError("components did not converge")


def joined_by(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (name, root) after further links: only edges between old components are contracted."""
    if roots is None:
        found = table(links, "jaccard-links")
        tidy(links.sparkSession)
        return connected(found)
    at = lambda c, d: roots.select(F.col("name").alias(c), F.col("root").alias(d))
    edges = links.join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    edges = table(edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-links")
    tidy(links.sparkSession)
    if edges.isEmpty():
        return roots
    new = connected(edges)
    moved = roots.join(new.select(F.col("name").alias("root"), F.col("root").alias("to")), "root", "left").select("name", F.coalesce("to", "root").alias("root"))
    return table(moved.unionByName(new.join(roots.select("name"), "name", "left_anti")), "jaccard-roots")


def apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, name, root) of the groups that span components."""
    rooted = members.select("g", "name").join(roots, "name", "left").select("g", "name", F.coalesce("root", "name").alias("root"))
    split = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
    return table(rooted.join(split, "g"), "jaccard-split")


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def linked_sets(docs: DataFrame, n: int, percent: int, ranks: np.ndarray, buckets: int) -> DataFrame:
    """(name, root) of the sets that link with another."""
    pairs, members = product(docs, n, percent, ranks, buckets)
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(members.select("name")).distinct()
    rows = rows_of(docs, names, n)
    try:
        return _joined(pairs, members, rows, percent)
    finally:
        discard(rows)


def _joined(pairs: DataFrame, members: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(name, root) of the sets that link with another, of the pairs and the members of groups."""
    # first each row with the one that it shares most columns with, and each group with the hub that is in most groups
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = both.groupBy("a").agg(F.max(F.struct("n", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    degree = members.groupBy("name").agg(F.count("*").alias("d"))
    hubs = members.join(degree, "name").groupBy("g").agg(F.max(F.struct("d", F.xxhash64("name").alias("r"), "name"))["name"].alias("hub"))
    cells = _cells(best, "a", "b").unionByName(_cells(members.join(hubs, "g"), "hub", "name")).distinct()
    roots = joined_by(None, overlap_links(table(cells, "jaccard-cells"), rows, percent))
    for k in range(STARS + 1):
        at = lambda c, d: roots.select(F.col("name").alias(c), F.col("root").alias(d))  # noqa: E731, B023
        members = apart(members, roots)
        grouped = not members.isEmpty()
        if k == 0:  # the other pairs, where their ends are still apart
            rest = pairs.join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left")
            cells = rest.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
            if not grouped:
                cells = table(cells, "jaccard-cells")
                return roots if cells.isEmpty() else joined_by(roots, overlap_links(cells, rows, percent))
        elif not grouped:
            break
        if k < STARS:  # a member of a group's largest component against all outside of it
            part = members.groupBy("g", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("name", F.lit(k)).alias("r"), "name")).alias("hub"))
            part = part.groupBy("g").agg(F.max(F.struct("n", "root", F.col("hub")["name"].alias("hub"))).alias("top")).select("g", "top.hub", F.col("top.root").alias("top"))
            star = _cells(members.join(part, "g").filter("root <> top"), "hub", "name")
        else:
            star = near_cells(members.join(rows.select("name", "size", "sketch"), "name"), percent)
        cells = table((cells.unionByName(star) if k == 0 else star).distinct(), "jaccard-cells")
        if not cells.isEmpty():
            roots = joined_by(roots, overlap_links(cells, rows, percent))
    return roots


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id reachable by links."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    every = table(sets_of(slim, n), "jaccard-sets")
    tidy(docs.sparkSession)
    sets = every.filter("counts IS NULL").select("doc_id", "n_shingles", "name")
    entries = sets.agg(F.sum(F.floor(F.col("n_shingles") * (100 - percent) / 100 + F.col("n_shingles") / COMMON_PER) + COMMON)).first()[0] or 0
    buckets = 2 * packed.n_buckets(entries, 28)  # half-size buckets: multiplied() holds several copies of one
    roots = linked_sets(slim, n, percent, column_ranks(every), buckets)
    named = sets.join(small(roots), "name", "left").withColumn("root", F.coalesce("root", "name"))
    named = named.select("doc_id", "n_shingles", "root")
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("of")).filter("of > 1").select("root", "least")
    out = named.join(small(table(least, "jaccard-least")), "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
