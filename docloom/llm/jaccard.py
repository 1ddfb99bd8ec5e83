r"""Exact Jaccard similarity join on word shingles, and its components.

A document's set holds its distinct shingles of SIZE words (A-Z lower-cased;
words are runs of characters other than ASCII white space), as 64-bit hashes; a
text of fewer words has one shingle, the whole sequence.  Two documents link when
100 * |intersection| >= PERCENT * |union|.

1. Signatures: documents with equal sets (equal 128-bit digests of the sorted
   set) form a class; one member stands for it.  Copies are never paired.
2. Rare-first order: a table of TABLE counters, filled from all documents, gives
   each shingle a frequency; shingles are ordered by (frequency, hash).  Any
   order gives exact results, and rare-first keeps the lists below short.
3. Prefixes: a set of n shingles puts its first n - ceil(n * PERCENT / 100) + 1
   into the inverted list; two sets that link share one of these.
4. Candidates come from the lists under the length and the positional filter,
   then the suffix filter: hash space is cut at fixed pivots into parts, and the
   parts in which the sizes of two sets differ in parity bound what the sets do
   not share; PARTS parts within the lists, then as many as the sets have members.
5. Each candidate pair is verified once, on whole sets.

A list may be very long when many documents are near copies of each other, so a
list is never put out as all its pairs.  First each list compares its members
with one of them only, the one nearest to what they share; the links found merge
into components.  Then members of different components are compared, all of
them, in strips within a task; only pairs that pass the filters leave it.  Long
lists are salted into parts by a hash of the member: each part has a first
member of its own, these are compared with one of them, and later the members
outside the list's largest component visit every part, in groups of about a
part's size.  So a task holds about two parts, no link between different
components is lost, and components are those of the complete join.

Ids may be of any type that has an order: integers are used as they are, others
are numbered in their order.

Defined results: a null or empty text, or one without words, has an empty set and
links with nothing; a null id takes no part in similar_components() and has a
null component there, while keep_one() compares rows without an id like any
others; rows that share an id are one document (a link of either is a link of
the id); ties need no order, since components do not depend on pairs found
twice; texts may be of any length; an empty table gives an empty table; other columns, whatever
their names, are kept by keep_one() and not read.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import BROADCAST_ROWS, cut, discard, map_arrow, map_texts, settle, slices
from docloom.llm.components import components

SIZE = 4
PERCENT = 85
TABLE = 1 << 20
BLOCK = 1 << 14
PARTS = 512
#: Members of a list beyond which it is salted.
LIST = 4096

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)  # numbers words as they come
    numbers, starts = [], [0]
    for t in texts:
        numbers += map(known.__getitem__, (t or "").encode("utf-8", "replace").lower().split())
        starts.append(len(numbers))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))[np.array(numbers, dtype=np.int64)]
    n = max(0, len(word) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        rolled = _mixed(rolled * _M1 + word[i : i + n])
    out = []
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = _mixed(short * _M1 + word[i : i + 1])
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def overlap_needed(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m that links them."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)


def _parities(s: np.ndarray, parts: int = PARTS) -> bytes:
    """Hash space cut at fixed pivots into equal parts: a bit for each, whether the set has an odd number there."""
    counts = np.bincount((_mixed(s) >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64), minlength=parts)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _wide(s: np.ndarray) -> bytes:
    """Parities of as many parts as the set has members, or a little more."""
    return _parities(s, max(PARTS, 1 << max(0, len(s) - 1).bit_length()))


def _apart(x: bytes, y: bytes) -> int:
    """The parts whose parities differ, at the coarser of the two cuts; the finer one's bits fold into it."""
    small, large = sorted((np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (x, y)), key=len)
    folded = large.reshape(len(small), -1).sum(axis=1) & 1
    return int((small != folded).sum())


def _signatures(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, sig, parity, wide) of each row, kept in the shared folder, and the table of frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TABLE, dtype=np.int64)
        kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("parity", pa.binary()), ("wide", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
        for part in batches:
            sets = shingle_sets(part.column("text").to_pylist(), size)
            counts += np.bincount(_cells(np.concatenate(sets)), minlength=TABLE)
            cols = [part.column("id"), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(map(_parities, sets), pa.binary()), pa.array(map(_wide, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=kind)
        blocks = [i for i in range(TABLE // BLOCK) if counts[i * BLOCK : (i + 1) * BLOCK].any()]
        packed = [pa.compress(counts[i * BLOCK : (i + 1) * BLOCK].astype("<u4"), "zstd", asbytes=True) for i in blocks]
        none = [pa.nulls(len(blocks), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], schema=kind)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches, "text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = sums.setdefault(block, np.zeros(BLOCK, dtype=np.int64))
                total += np.frombuffer(pa.decompress(packed, BLOCK * 4, "zstd", asbytes=True), dtype="<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])

    made = cut(map_arrow(docs, sliced, "id long, n long, sig binary, parity binary, wide binary, block int, counts binary"))
    table = np.zeros(TABLE, dtype=np.int64)
    blocks = made.where("block is not null").select("block", "counts").repartition(F.col("block"))
    for block, counts in map_arrow(blocks, add, "block int, counts binary").collect():
        table[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bytes(counts), dtype=np.int64)
    settle(docs.sparkSession)
    return made.where("block is null").select("id", "n", "sig", "parity", "wide"), table


def _postings(docs: DataFrame, table: np.ndarray, size: int, percent: int, part: int) -> DataFrame:
    """(token, salt, parts, id, n, pos) of the prefix of each document.

    pos counts from 0 in the rare-first order; salt is the part of its list that a document is in, of parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(table, 2**32 - 1).astype(np.uint32))
    usual = int(np.median(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for rows in slices(batches, "text"):
            ids, sets = rows.column("id").to_pylist(), shingle_sets(rows.column("text").to_pylist(), size)
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, s in zip(ids, sets, strict=True):
                # A row that stands here many times is put out once for each partition.
                mark = (i, len(s), int(s[0]) if len(s) else 0)
                if not len(s) or mark in seen:
                    continue
                seen.add(mark)
                frequency = counts[_cells(s)]
                first = np.lexsort((s, frequency))[: prefix_length(len(s), percent)]
                parts = 1 + np.maximum(0, frequency[first].astype(np.int64) - 2 * usual) // part
                for col, x in zip(cols, (s[first].view(np.int64), hash_id(i) % parts, parts, np.full(len(first), i), np.full(len(first), len(s)), np.arange(len(first))), strict=True):
                    col.append(x)
            if cols[0]:
                flat = [np.concatenate(c) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.int64)), pa.array(flat[4].astype(np.int32)), pa.array(flat[5].astype(np.int32))], names=["token", "salt", "parts", "id", "n", "pos"])

    return map_arrow(docs, run, "token long, salt int, parts int, id long, n int, pos int")


def hash_id(i: int) -> int:
    return int(_mixed(np.array([i & (2**64 - 1)], dtype=np.uint64))[0] >> np.uint64(1))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, set): the whole set of each row."""

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(part.column("text").to_pylist(), size)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "set"])

    return map_texts(docs, "id long, set array<long>", work)


def _bounded(n: int, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Lists:
    """Rows of inverted lists, a list after the other."""

    names = ("id", "n", "pos", "comp")

    def __init__(self, batch: pa.RecordBatch, keys: list[str]):
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.id, self.n, self.pos, self.comp = (column(c).astype(np.int64) for c in self.names)
        self.parity = np.frombuffer(b"".join(batch.column("parity").to_pylist()), dtype=np.uint64).reshape(-1, PARTS // 64)
        self.keys = np.stack([column(k).astype(np.int64) for k in keys], axis=1)

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs of rows (i, j) pass the component test and the length, positional and suffix filters."""
        n, m, p, q = self.n[i], self.n[j], self.pos[i], self.pos[j]
        ok = (self.comp[i] != self.comp[j]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        # Tokens before either position can match each other: at most min(p, q) of them.
        most = np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1)
        ok &= most * (100 + percent) >= (n + m) * percent
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 1 << 17):
            part = at[k : k + (1 << 17)]
            # Each part whose parity differs holds something that the sets do not share.
            apart = np.bitwise_count(self.parity[i[part]] ^ self.parity[j[part]]).sum(axis=1, dtype=np.int64)
            ok[part] = (n[part] + m[part] - apart) * (100 + percent) >= 2 * (n[part] + m[part]) * percent
        return ok


#: What a row of a list is where parts meet: a member of the part, one from another part, or a member that is there again for more guests.
OWN, GUEST, AGAIN = 0, 1, 2


def _star(rows: Lists, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member against the first of its list."""
    head = np.repeat(bounds[:-1], np.diff(bounds))
    i = np.flatnonzero(head != np.arange(len(head)))
    ok = rows.near(i, head[i], percent)
    return i[ok], head[i][ok]


def _across(rows: Lists, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of different components: those outside a part's largest one, and guests, against the part's own members.

    Further groups of guests meet own members that are there again for them.  The comparisons run in strips of bounded size.
    """
    guest = rows.keys[:, -1] == GUEST
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = a + np.flatnonzero(~guest[a:b])
        comps, which, size = np.unique(rows.comp[own], return_inverse=True, return_counts=True)
        guests = a + np.flatnonzero(guest[a:b])
        if not len(own) or len(comps) < 2 and not len(guests):
            continue
        large = which == size.argmax()
        again = rows.keys[own[0], -1] == AGAIN
        rest = guests if again else np.concatenate([own[~large], guests])
        strip = max(1, (1 << 20) // len(own))
        for k in range(0, len(rest), strip):
            i, at = (x.ravel() for x in np.meshgrid(rest[k : k + strip], np.arange(len(own)), indexing="ij"))
            j = own[at]
            # Of two members outside the largest component each pair comes once.
            fresh = guest[i] | large[at] | (rows.comp[i] < rows.comp[j])
            i, j = i[fresh], j[fresh]
            ok = rows.near(i, j, percent)
            left.append(i[ok])
            right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def _list_pairs(rows: DataFrame, keys: list[str], order: list[str], percent: int, pairing, extra: tuple[str, ...] = ()) -> DataFrame:
    """The distinct pairs (a, b) that pairing finds in lists; rows of a list meet in one task, which holds a batch and a list."""
    arranged = rows.select(*keys, *extra, *Lists.names, "parity").repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    used = [*keys, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            lists = Lists(table.combine_chunks().to_batches()[0], used)
            k = lists.keys[:, : len(keys)]
            bounds = np.concatenate([[0], 1 + np.flatnonzero((k[1:] != k[:-1]).any(axis=1)), [len(k)]])
            i, j = pairing(lists, bounds, percent)
            both = np.unique(np.stack([lists.id[i], lists.id[j]], axis=1)[lists.id[i] != lists.id[j]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(k)[held.num_rows - 1].as_py() for k in keys]
            if not held.num_rows or [held.column(k)[0].as_py() for k in keys] == last:
                continue
            same = np.ones(held.num_rows, dtype=bool)
            for k, v in zip(keys, last, strict=True):
                same &= held.column(k).to_numpy() == v
            cut_at = int(np.argmax(same))
            yield from pairs(held.slice(0, cut_at))
            held = held.slice(cut_at)
        if held is not None:
            yield from pairs(held)

    return map_arrow(arranged, run, "a long, b long").distinct()


def _sifted(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart) of the pairs that pass the suffix filter at the cut that suits their sizes."""
    met = pairs.join(wide.toDF("a", "n", "one"), "a").join(wide.toDF("b", "m", "two"), "b").select("a", "b", "n", "m", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            apart = np.array([_apart(x, y) for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)], dtype=np.int64)
            ok = pa.array((n + m - apart) * (100 + percent) >= 2 * (n + m) * percent)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(apart).filter(ok)], names=["a", "b", "apart"])

    return map_arrow(met, run, "a long, b long, apart long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = cut(pairs)
    settle(docs.sparkSession)
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = _sets(docs.join(_bounded(wanted.count(), wanted), "id", "left_semi"), size)
    met = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b")
    common = F.size(F.array_intersect("one", "two"))
    out = cut(met.where(common * 100 >= (F.size("one") + F.size("two") - common) * percent).select("a", "b").distinct())
    discard(pairs, wanted)
    return out


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, part: int = LIST) -> DataFrame:
    """Per row of df: the key, n_shingles and component_id, the smallest key reachable by links (both of the key's type)."""
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        names = _numbered(df.select(F.col(key).alias("name")))
        rows = df.select(F.col(key).alias("name"), F.col(text).alias("text")).join(names, "name", "left").select("id", "text")
        found = similar_components(rows, "id", "text", size, percent, part)
        named = found.join(names.toDF("k", "id"), "id", "left").join(names.toDF("c", "component_id"), "component_id", "left")
        return named.select(F.col("k").alias(key), "n_shingles", F.col("c").alias("component_id"))
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed, table = _signatures(docs, size)
    live = signed.where("n > 0 and id is not null")
    # Kept apart from its aggregation, so that a class of very many copies can be split in the join.
    classes = cut(live.groupBy("sig", "n").agg(F.min("id").alias("rep")))
    member = cut(live.join(classes, ["sig", "n"]).select("id", "rep").distinct())
    discard(classes)
    copies = member.groupBy("id").agg(F.min(F.col("rep")).alias("least"), F.max(F.col("rep")).alias("most"), F.max((F.col("rep") == F.col("id")).cast("int")).alias("own"))
    others = copies.where("own = 0").select("id")
    n_others = others.count()
    own = docs.where(F.col("id").isNotNull()).join(_bounded(n_others, others), "id", "left_anti")

    # The lists that hold two documents; one in parts may have its others in another part.
    group = Window.partitionBy("token", "salt")
    post = _postings(own, table, size, percent, part).withColumn("lo", F.min("id").over(group)).withColumn("hi", F.max("id").over(group))
    lists = cut(post.where("parts > 1 or lo < hi").drop("lo", "hi"))
    parity = live.select("id", "n", "parity").distinct()
    wide = live.select("id", "n", "wide").distinct()

    settle(df.sparkSession)

    links = cut(copies.where("least < most").select(F.col("least").alias("a"), F.col("most").alias("b")).union(member.join(copies.where("least < most"), "id").select(F.col("rep"), F.col("least"))).distinct())
    merged = components(links)
    for last in (False, True):
        placed = lists.join(merged.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        open_lists = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        placed = cut(placed.join(open_lists, "token"))
        if not last:
            # The member with the fewest rarer tokens is nearest to what the others share.
            near = _list_pairs(placed.join(parity, ["id", "n"]), ["token", "salt"], ["pos", "id"], percent, _star)
            heads = placed.where("parts > 1").groupBy("token", "salt").agg(F.min(F.struct("pos", "id", "n", "comp")).alias("h")).select("token", "salt", "h.*")
            near = near.union(_list_pairs(heads.join(parity, ["id", "n"]), ["token"], ["pos", "id"], percent, _star)).distinct()
            # One nearest pivot for each member; what it does not link to is compared below.
            near = _sifted(near, wide, percent).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")
        else:
            # In a list of several parts, members outside its largest component are guests in all other parts, in groups of about a part's size.
            split = placed.where("parts > 1")
            largest = split.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"))
            guests = split.join(largest, "token").where("comp <> largest").drop("largest")
            groups = guests.groupBy("token").agg(F.ceil(F.count("*") / part).cast("int").alias("groups"))
            sent = guests.join(groups, "token").withColumn("group", F.pmod(F.xxhash64("id"), "groups").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            sent = sent.where("other <> salt").withColumn("salt", F.col("other")).drop("other", "groups").withColumn("role", F.lit(GUEST))
            again = split.join(groups.where("groups > 1"), "token").withColumn("group", F.explode(F.sequence(F.lit(1), F.col("groups") - 1))).drop("groups").withColumn("role", F.lit(AGAIN))
            rows = placed.withColumn("group", F.lit(0)).withColumn("role", F.lit(OWN)).unionByName(sent).unionByName(again).join(parity, ["id", "n"])
            near = _list_pairs(rows, ["token", "salt", "group"], ["id"], percent, _across, ("role",))
            near = _sifted(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), wide, percent).select("a", "b")
        more = _verified(near, own, size, percent)
        settle(df.sparkSession)
        before = links, merged
        links = cut(links.union(more).distinct())
        merged = components(links)
        discard(placed, more, *before)
        settle(df.sparkSession)
    discard(lists, links)
    reached = member.join(merged.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.join(reached, "id", "left")
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))


def _numbered(names: DataFrame) -> DataFrame:
    """(name, id): numbers of the distinct non-null names, in their order."""
    return cut(names.where("name is not null").distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """df without the documents that are not the first of their component; rows without a key come after all others.

    Of rows that share a key one stays; of rows without a key those stay that are no copy of another document.
    """
    rid = "__rid"
    while rid in df.columns:
        rid += "_"
    if isinstance(df.schema[key].dataType, T.IntegralType):
        named = df.where(F.col(key).isNotNull()).withColumn(rid, F.col(key).cast("long"))
    else:
        names = _numbered(df.select(F.col(key).alias("name")))
        named = df.where(F.col(key).isNotNull()).join(names.toDF(key, rid), key).select(*df.columns, rid)
    if not df.where(F.col(key).isNull()).isEmpty():
        first = named.agg(F.greatest(F.coalesce(F.max(rid), F.lit(0)), F.lit(0))).first()[0] + 1
        # Kept, as numbers given to rows must not change.
        named = named.union(cut(df.where(F.col(key).isNull()).withColumn(rid, F.monotonically_increasing_id() + F.lit(first)).select(*df.columns, rid)))
    found = cut(similar_components(named.select(F.col(rid).alias("id"), F.col(text).alias("text")), "id", "text", size, percent))
    gone = found.where("component_id < id").select(F.col("id").alias(rid)).distinct()
    repeated = cut(found.where("component_id = id").groupBy(F.col("id").alias(rid)).count().where("count > 1").select(rid))
    n_repeated = repeated.count()
    away = cut(gone.union(repeated))
    discard(found)
    settle(df.sparkSession)
    kept = named.join(_bounded(away.count(), away), rid, "left_anti").select(*df.columns)
    if n_repeated:
        kept = kept.union(named.join(_bounded(n_repeated, repeated), rid, "left_semi").dropDuplicates([rid]).select(*df.columns))
    return kept
