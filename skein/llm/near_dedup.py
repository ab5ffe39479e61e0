"""MinHash near-duplicate detection with tensored banding.

Two small collections of sketches, A and B, are computed for a document; a
table key combines one sketch of A with one of B, so ``m * m`` tables cost
``2 * m`` sketches.  The same square root saves rows: a document goes to the
tables only with those of its A and B sketches that another document shares,
and of buckets with the same documents one is kept.

Buckets are compared in two steps, neither of which lists a group's pairs.
First each bucket, in blocks of bounded size, proposes a spanning forest of its
likeliest links; these are confirmed on the full shingle sets.  That joins most
groups.  Then every bucket that still spans several components is finished
exactly: the documents outside its largest component go to a group, that of the
largest component they meet, and are compared, full set against full set and
block by block, with all documents that share a bucket with any of the group;
only links that join two components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize
from .vectext import by_row, column, mix, pieces, shingles, spread, words

#: Sketches in each collection, and minhashes joined in a sketch.
SKETCHES, JOINED = 12, 2
#: Minhashes of 8 bits that a pair must agree on, as a share of those expected at the threshold, to be confirmed on full sets: 23 of 48, four standard deviations below, which a pair at the threshold misses once in 80000 times, and the tables once in 10000.
SIGNATURE_SHARE = 0.64
#: Documents of a block, about; shingles of the documents compared with others at a time, and of these others.
BLOCK, OUTSIDE, AGAINST = 256, 1 << 17, 1 << 17
#: Rounds over which buckets larger than a block propose links; the exact step does the rest.
DEALS = 3


def _sketch(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (rows x 2*SKETCHES int64) and 8-bit signatures (rows x bytes)."""
    n, k = len(offsets) - 1, 2 * SKETCHES * JOINED
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.empty((k, n), np.uint64)
    for i in range(k):
        low[i] = by_row((sets ^ seeds[i]) * (seeds[k + i] | np.uint64(1)), offsets, np.minimum, 0)
    keys = np.zeros((2 * SKETCHES, n), np.uint64)
    for j in range(JOINED):
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + low[j::JOINED])
    keys = mix(keys + np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
    return keys.T.astype(np.int64), (mix(low) >> np.uint64(56)).T.astype(np.uint8)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column(batch.column(1))
            for i, j in pieces(off):
                hashes, first, _ = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                sets, at = shingles(hashes, first, k)
                keys, signature = _sketch(sets, at)
                size = np.diff(at)
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, m),
                        pa.array(size, pa.int64()),
                        pa.array(by_row(mix(sets), at, np.add, 0).astype(np.int64)),
                        pa.array(by_row(mix(sets ^ np.uint64(0xC2B2AE3D27D4EB4F)), at, np.bitwise_xor, 0).astype(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, m * 2 * SKETCHES + 1, 2 * SKETCHES, dtype=np.int32), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in signature], pa.binary()),
                    ],
                    names=["id", "n", "h1", "h2", "keys", "sig"],
                )

    return run


def _members(batch: pa.RecordBatch, at: int, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns ``names`` of the structs of each row's list, signatures as rows of bytes."""
    lists = batch.column(at)
    off = lists.offsets.to_numpy()
    flat = []
    for name in names:
        c = lists.values.field(name)
        if name == "sig":  # of one length
            _, at_, data = c.buffers()
            at_ = np.frombuffer(at_, np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
            flat.append(np.frombuffer(data, np.uint8)[at_[0] : at_[-1]].reshape(len(c), -1) if len(c) else np.zeros((0, 1), np.uint8))
        else:
            flat.append(c.to_numpy(zero_copy_only=False))
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield tuple(c[i:j] for c in flat)


def _forest(percent: int, least: int):
    """Blocks of (id, c, n, sig) to pairs (a, b): a spanning forest over the
    block's components, of the pairs that agree in most minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for ids, c, n, sig in _members(batch, 0, ("id", "c", "n", "sig")):
                m = len(ids)
                if m < 2:
                    continue
                agree = (sig[:, None, :] == sig[None, :, :]).sum(2) if m <= 2 * BLOCK else np.stack([(sig == x).sum(1) for x in sig])
                agree[(agree < least) | (100 * np.minimum(n[:, None], n) < percent * np.maximum(n[:, None], n))] = 0
                agree[c[:, None] == c] = 1 << 20
                best, near, out = agree[0].copy(), np.zeros(m, np.int64), np.ones(m, bool)
                out[0] = False
                for _ in range(m - 1):
                    j = int(np.where(out, best, -1).argmax())
                    out[j] = False
                    if 0 < best[j] < 1 << 20:
                        a.append(int(min(ids[j], ids[near[j]])))
                        b.append(int(max(ids[j], ids[near[j]])))
                    closer = agree[j] > best
                    best[closer] = agree[j][closer]
                    near[closer] = j
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of sorted batches by the values of the first ``k`` columns; a run may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy() for c in batch.columns[:k]]
        new = np.zeros(batch.num_rows - 1, bool)
        for x in keys:
            new |= x[1:] != x[:-1]
        at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            yield tuple(int(x[i]) for x in keys), batch.slice(i, j - i)


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, part, role, of, big, id, c), of which role 0 tells the
    largest component of an open bucket and its size, to (key, of, big, id) of
    its documents outside that."""
    now, big = None, None
    for key, rows in _runs(batches, 2):
        role = rows.column(2).to_numpy()
        if key != now:
            now, big = key, (rows.column(3)[0].as_py(), rows.column(4)[0].as_py()) if role[0] == 0 else None
        if big is None:
            continue
        kept = rows.filter(pa.array((role == 1) & (rows.column(6).fill_null(0).to_numpy() != big[1])))
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept.column(0), *(pa.array(np.full(kept.num_rows, x)) for x in big), kept.column(5)], names=["key", "of", "big", "id"])


def _suspects(percent: int, least: int):
    """Sorted rows (g, part, role, q, id, c, n, sig), members (role 0) before
    outside documents (role 1), to rows (g, q, out, id, c, n): outside documents
    of share ``q`` that may have a link to another component, and, for their
    share, whom with.  A part's members are held, outside documents pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(pieces_: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
            t = pa.Table.from_batches(pieces_).combine_chunks()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            return *(t.column(x).to_numpy() for x in ("id", "c", "n")), sig

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["g", "q", "out", "id", "c", "n"])

        now, held, members, met = None, [], None, {}

        def whom() -> list[tuple]:
            if not met:
                return []
            ids, c, n, _ = members
            return [(now[0], q, False, int(ids[y]), int(c[y]), int(n[y])) for q, mask in met.items() for y in np.flatnonzero(mask).tolist()]

        for key, rows in _runs(batches, 2):
            if key != now:
                if out := whom():
                    yield made(out)
                now, held, members, met = key, [], None, {}
            role = rows.column(2).to_numpy()
            if (role == 0).any():
                held.append(rows.filter(pa.array(role == 0)))
            xs = rows.filter(pa.array(role == 1))
            if not xs.num_rows or not held:
                continue
            members = table(held) if members is None else members
            ids, c, n, sig = members
            out = []
            for q, i, own, size, mark in zip(xs.column(3).to_pylist(), *table([xs]), strict=True):
                y = np.flatnonzero((c != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)))
                y = y[(sig[y] == mark).sum(1) >= least]
                if len(y):
                    out.append((key[0], q, True, int(i), int(own), int(size)))
                    met.setdefault(q, np.zeros(len(ids), bool))[y] = True
            if out:
                yield made(out)
        if out := whom():
            yield made(out)

    return run


def _compare(percent: int):
    """Blocks of (out, id, c, set) to links (a, b), at most one fewer than the
    block has components: each document is compared, on full sets, with all
    outside documents of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outside, ids, c, sets in _members(batch, 0, ("out", "id", "c", "set")):
                a: list[int] = []
                b: list[int] = []
                sets = [np.frombuffer(x, np.uint64) for x in sets]
                root = {x: x for x in c.tolist()}

                def find(x: int, root=root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                own = np.flatnonzero(outside)
                every = np.concatenate([sets[x] for x in own]) if len(own) else np.zeros(0, np.uint64)
                owner = np.repeat(np.arange(len(own)), [len(sets[x]) for x in own])
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                size = np.array([len(sets[x]) for x in own], np.int64)
                for y in np.flatnonzero(~outside).tolist():
                    low = np.searchsorted(every, sets[y], "left")
                    held = np.searchsorted(every, sets[y], "right") - low
                    common = np.bincount(owner[spread(low, held)], minlength=len(own))
                    for k in np.flatnonzero(100 * common >= percent * (size + len(sets[y]) - common)).tolist():
                        x = int(own[k])
                        p, r = find(int(c[x])), find(int(c[y]))
                        if p != r:
                            root[p] = r
                            a.append(int(min(ids[x], ids[y])))
                            b.append(int(max(ids[x], ids[y])))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = column(batch.column(1))
            for i, j in pieces(off):
                hashes, first, _ = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                sets, at = shingles(hashes, first, k)
                data = sets.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([data[8 * x : 8 * y] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())], names=["id", "set"])

    return run


def _confirm(percent: int):
    """Pairs (a, b, set of a, set of b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(len(both) > 0 and 100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(rows: DataFrame, percent: int, least: int, deal: int) -> DataFrame:
    """(a, b): the likeliest links between components of each bucket, whose
    rows (key, size, id, c, n, sig) go to blocks of about ``BLOCK`` at random."""
    part = F.pmod(F.xxhash64("id", F.lit(deal)), F.ceil(F.col("size") / BLOCK)).cast("int")
    rows = rows.groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("id", "c", "n", "sig")).alias("members"))
    return rows.where(F.size("members") > 1).select("members").mapInArrow(_forest(percent, least), "a long, b long").distinct()


def _known(held: DataFrame, component: DataFrame | None) -> DataFrame:
    """``held`` with the component ``c`` of each document and its number of documents ``of``."""
    if component is None:
        return held.withColumn("c", F.col("id")).withColumn("of", F.lit(1).cast("long"))
    sizes = component.groupBy("component").agg(F.count("*").alias("of"))
    known = component.join(sizes, "component").select(F.col("node").alias("id"), "component", "of")
    return held.join(known, "id", "left").withColumn("c", F.coalesce("component", "id")).withColumn("of", F.coalesce("of", F.lit(1)))


def _last_links(held: DataFrame, component: DataFrame | None, sets: DataFrame, percent: int, least: int) -> DataFrame | None:
    """Links between the components that still share a bucket; None if no pair is left to compare."""
    known = materialize(_known(held, component), "known")
    rows = known.select(F.explode("buckets").alias("b"), "id", "c", "of").select("b.key", "b.size", "id", "c", "of")
    parts = F.ceil(F.col("size") / (4 * BLOCK)).cast("int")
    part = lambda of: F.pmod(F.xxhash64("id", F.lit(7)), of).cast("int").alias("part")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1)).alias("part")

    def in_parts(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(key, "part").sortWithinPartitions(key, "part", "role")

    # Buckets of several components, and the largest of these, told to each part of a bucket.
    open_ = rows.groupBy("key", "size").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max(F.struct("of", "c")).alias("m")).where("c1 <> c2")
    told = open_.select("key", every(parts), F.lit(0).alias("role"), "m.of", F.col("m.c").alias("big"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("c"))
    told = told.unionByName(rows.select("key", part(parts), F.lit(1).alias("role"), F.lit(None).cast("long").alias("of"), F.lit(None).cast("long").alias("big"), "id", "c"))
    outside = materialize(in_parts(told, "key").mapInArrow(_outside, "key long, of long, big long, id long"), "outside")
    # A document outside belongs to the group of the largest component it meets; a group meets all that share a bucket with one of it.
    group = outside.groupBy("id").agg(F.max(F.struct("of", "big")).alias("m")).select("id", F.col("m.big").alias("g"))
    group = materialize(group, "group")
    facts = known.select("id", "c", "n", "sig")
    meets = rows.select("key", "id").join(outside.join(group, "id").select("key", "g").distinct(), "key").select("g", "id").distinct()
    ys = materialize(meets.join(facts, "id"), "meets")
    xs = materialize(group.join(facts, "id"), "strays")
    sizes = ys.groupBy("g").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("parts"))
    sizes = materialize(sizes.join(xs.groupBy("g").agg(F.ceil(F.sum("n") / OUTSIDE).cast("int").alias("shares")), "g"), "groups")
    ys = ys.join(sizes, "g").select("g", part(F.col("parts")), F.lit(0).alias("role"), F.lit(None).cast("int").alias("q"), "id", "c", "n", "sig")
    xs = xs.join(sizes, "g").select("g", every(F.col("parts")), F.lit(1).alias("role"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("q"), "id", "c", "n", "sig")
    suspects = in_parts(ys.unionByName(xs), "g").mapInArrow(_suspects(percent, least), "g long, q int, out boolean, id long, c long, n long")
    suspects = materialize(suspects.distinct(), "suspects")
    discard(outside)
    if suspects.isEmpty():
        return None
    counts = materialize(suspects.where("NOT out").groupBy("g", "q").agg(F.ceil(F.sum("n") / AGAINST).cast("int").alias("shares")), "shares")
    met = suspects.join(counts, ["g", "q"]).join(sets.hint("merge"), "id")
    shares = F.when(F.col("out"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")))
    met = met.withColumn("share", F.explode(shares)).groupBy("g", "q", "share").agg(F.collect_list(F.struct("out", "id", "c", "set")).alias("members"))
    links = materialize(met.select("members").mapInArrow(_compare(percent), "a long, b long").distinct(), "links")
    discard(known, group, suspects, counts, sizes)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_per_shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` (size of the distinct
    shingle set), ``component_id`` (smallest id reachable over links, itself
    included), ``kept`` (id = component_id).

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their shingle sets.  Null and empty texts, and texts without words, have an
    empty set and no link.  Rows with the same id are one node.  A null id has
    a null component, no link, and is kept.  Very long texts count with all
    their shingles; of equal texts the smallest id stands for all.  Other
    columns are ignored, and an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = materialize(src.mapInArrow(_sign(words_per_shingle), "id long, n long, h1 long, h2 long, keys array<long>, sig binary"), "sigs")
    usable = sigs.where("n > 0 AND id IS NOT NULL")
    same = ["h1", "h2", "n"]
    # Exact copies of a set: one representative each.
    reps = materialize(usable.groupBy(*same).agg(F.min("id").alias("rep"), F.max("id").alias("last")), "reps")
    copies = materialize(usable.select("id", *same).join(reps.where("rep <> last").drop("last"), same).where("id <> rep").select("id", "rep").distinct(), "copies")
    # An id whose rows have different sets ties these together.
    twice = copies.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    links = materialize(twice.unionByName(several).distinct(), "links")
    # Sketches that two representatives share.
    lead = materialize(sigs.join(reps.select(F.col("rep").alias("id"), *same), ["id", *same], "left_semi").dropDuplicates(["id", *same]).select("id", "n", "keys", "sig"), "leads")
    each = lead.select("id", F.posexplode("keys").alias("at", "key"))
    shared = materialize(each.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"), "shared")
    both = each.join(shared, "key").groupBy("id").agg(F.collect_list(F.struct("at", "key")).alias("k"))
    half = lambda low: F.filter("k", lambda x: (x["at"] < SKETCHES) if low else (x["at"] >= SKETCHES))
    tables = both.select("id", half(False).alias("b"), F.explode(half(True)).alias("a")).select("id", "a", F.explode("b").alias("b"))
    tables = materialize(tables.select(F.xxhash64("a.key", "b.key").alias("key"), "id"), "tables")
    # Of buckets with the same documents one is enough.
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in (1, 2)]
    buckets = tables.groupBy("key").agg(F.count("*").alias("size"), *mark).where("size > 1").groupBy("size", "x1", "x2").agg(F.min("key").alias("key"))
    held = tables.join(materialize(buckets.select("key", "size"), "buckets"), "key").groupBy("id").agg(F.collect_list(F.struct("key", "size")).alias("buckets"))
    held = materialize(held.join(lead.select("id", "n", "sig"), "id"), "held")
    discard(shared, tables)
    # The full sets of the documents that share a bucket; joins with texts and sets are merge joins at every size.
    sets = materialize(src.join(held.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(_full_sets(words_per_shingle), "id long, set binary"), "sets")

    links, component = (None if links.isEmpty() else links), None
    least = int(2 * SKETCHES * JOINED * percent / 100 * SIGNATURE_SHARE)
    for deal in range(DEALS):
        # A bucket larger than a block proposes links in one of the rounds, a smaller one in the first.
        now = lambda x, deal=deal: (x["size"] > BLOCK) & (F.pmod(x["key"], F.lit(DEALS)) == deal)
        some = held.withColumn("buckets", F.filter("buckets", now if deal else lambda x: (x["size"] <= BLOCK) | now(x))).where(F.size("buckets") > 0)
        if deal and some.isEmpty():
            continue
        rows = _known(some, component).select(F.explode("buckets").alias("b"), "id", "c", "n", "sig").select("b.key", "b.size", "id", "c", "n", "sig")
        near = materialize(_blocks(rows, percent, least, deal), "near")
        sure = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
        sure = materialize(sure.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")
        discard(near)
        if sure.isEmpty():
            continue
        links = sure if links is None else links.unionByName(sure)
        component = connected_components(links, "a", "b")
    more = _last_links(held, component, sets, percent, least)
    if more is not None:
        links = more if links is None else links.unionByName(more)
        component = None
    if component is None and links is not None:
        component = connected_components(links, "a", "b")
    discard(held, sets, lead, reps)

    base = sigs.select(F.col("id").alias(id_col), "n")
    out = base.join(copies.groupBy(F.col("id").alias(id_col)).agg(F.min("rep").alias("rep")), id_col, "left").withColumn("rep", F.coalesce("rep", F.col(id_col)))
    if component is not None:
        out = out.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
        out = out.withColumn("component_id", F.coalesce("component", "rep"))
    else:
        out = out.withColumn("component_id", F.col("rep"))
    kept = F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    return out.select(id_col, F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
