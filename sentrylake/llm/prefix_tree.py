"""Documents whose sets of word n-grams are alike (Jaccard), by a join over prefix trees.

All sets are put in one global order, rare n-grams first by a count sketch of the whole corpus. Two sets
that are alike share an n-gram among the first of both, so only these go through a shuffle. A set is then
compared with a block of others at once: the block's sets stand in a tree, common n-grams first, which is
walked with one overlap for each shared path and cut where what remains is too short.

For the components not all pairs of a group are needed. Some rounds compare each set with one other for
every shared n-gram, while several components have that n-gram. Then sets of n-grams that many have are
compared along random trees of the pairs that may be linked, as long as that joins components. Of what
remains apart all pairs that share an n-gram are compared, so no link between two components is lost. An
n-gram that many of these sets have is dealt in blocks of sets, so its pairs never become rows. Trees stay
within a block, other ones in each round. Of all pairs, sets of the n-gram's largest component meet only
those of others, so they are sent once while the others fit a block.

Before sets are sent, a pair must pass an exact test of its sets' signatures, bitmaps of the parity of the
n-grams at each bit: they differ in no more bits than the sets differ in n-grams.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, mix, partitions, pick, shingle_hashes, words_of
from sentrylake.llm.components import components
from sentrylake.session import materialize

#: Words of an n-gram, and the similarity from which two sets are linked, in hundredths.
WORDS, ALIKE = 5, 75
#: Counters of the sketch, and bits of the filter of documents whose sets are compared: sizes of what each task gets.
#: N-grams that share a counter come in another order, documents that share a bit are sent in vain; neither changes the result.
COUNTERS, FILTER_BITS = 1 << 18, 1 << 24
#: Sets of a block; a set with more partners has several blocks.
BLOCK = 256
#: Rounds in which a set is compared with one other for each n-gram, before all pairs across components are.
ROUNDS = 1
#: Most rounds in which the sets of an n-gram that many have are compared along a tree of pairs, before all pairs are. They go
#: on while a quarter of the pairs are linked; neither number changes the result.
TREE_ROUNDS = 8
#: Pairs of such a tree that begin at one set of a block.
BRANCHES = 2
#: Rows of a batch that are turned into Python values at once; a memory bound.
ROWS = 256
#: From this many sets on an n-gram is dealt in blocks of ``DEALT`` sets, below it pairs come from a join.
MANY, DEALT = 32, 1024


def needed(a: int, b: int, alike: int = ALIKE) -> int:
    """Smallest overlap of sets of these sizes that are alike."""
    return -(-alike * (a + b) // (100 + alike))


def ngram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of the n-grams of a whole text in ascending order; empty without words."""
    return np.unique(shingle_hashes(words_of(text), words))


def set_id(hashes: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(hashes + np.uint64(len(hashes))), dtype=np.uint64)
        return int(mix(np.array([total ^ np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def in_order(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A set in the global order, rare n-grams first."""
    return hashes[np.lexsort((hashes, sketch[(hashes & np.uint64(len(sketch) - 1)).astype(np.int64)]))]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parity of the n-grams at each of at least two bits for every one; half of it folded on the other is the next smaller one."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    at = (hashes >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ; the sets differ in at least as many n-grams."""
    x, y, size, other = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    if size < other:
        x, y, size, other = y, x, other, size
    while size > other:
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ y).bit_count()


class Tree:
    """Sets in one order as paths; a node holds a run of n-grams, the sets that end there, and the sizes below it."""

    __slots__ = ("run", "below", "ends", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.below, self.ends, self.least, self.most = run, {}, [], 1 << 62, 0

    def add(self, items: np.ndarray, name) -> None:
        node, size, at = self, len(items), 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            at += len(node.run)
            if at == size:
                node.ends.append(name)
                return
            key = int(items[at])
            child = node.below.get(key)
            if child is None:
                child = node.below[key] = Tree(items[at:])
                child.least = child.most = size
                child.ends.append(name)
                return
            n = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:n] != items[at : at + n])
            common = int(differ[0]) if len(differ) else n
            if common < len(child.run):  # cut the run where the paths part
                upper = Tree(child.run[:common])
                upper.least, upper.most = child.least, child.most
                child.run = child.run[common:]
                upper.below[int(child.run[0])] = child
                node.below[key] = child = upper
            node = child

    def search(self, probe: np.ndarray, alike: int = ALIKE) -> list:
        """Names of the sets alike to ``probe``, an ascending set that isn't empty."""
        found, todo = [], [(self, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            if len(node.run):
                at = np.minimum(np.searchsorted(probe, node.run), len(probe) - 1)
                overlap += int(np.count_nonzero(probe[at] == node.run))
                depth += len(node.run)
            if node.ends and overlap >= needed(len(probe), depth, alike):
                found += node.ends
            for child in node.below.values():
                # the best that any set below can reach, and the least that any of them needs
                if overlap + min(child.most - depth, len(probe) - overlap) >= needed(len(probe), child.least, alike):
                    todo.append((child, overlap, depth))
        return found


def _sets(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """``doc_id, n, sid, sig`` for each document, and with a chunk number the packed counts of a task's sets.

    Only the first of a task's equal sets has its signature.
    """

    def run(batches):
        counts, seen = np.zeros(counters, np.int32), set()
        fields = ["doc_id", "n", "sid", "sig", "chunk", "counts"]
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
            sizes, sids, sigs = [], [], []
            for text in batch.column(1):
                h = ngram_set(text.as_py(), words)
                sizes.append(len(h))
                sids.append(sid := set_id(h) if len(h) else None)
                sigs.append(None)
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    sigs[-1] = signature(h).tobytes()
                    counts += np.bincount((h & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.int32)
            columns = [batch.column(0), sizes, sids, sigs, [None] * len(sizes), [None] * len(sizes)]
            yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c, t) for i, (c, t) in enumerate(zip(columns, kinds, strict=True))], fields)
        if seen:
            parts = np.split(counts, 64)
            columns = [[None] * 64, [None] * 64, [None] * 64, [None] * 64, list(range(64)), [zlib.compress(p.tobytes(), 1) for p in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(frugal(run), f"doc_id {kind}, n int, sid long, sig binary, chunk int, counts binary")


def _sketch(sets: DataFrame, counters: int) -> np.ndarray:
    """The counts of all tasks; the driver gets ``counters`` numbers."""

    def add(pdf):
        total = np.sum([np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in pdf["counts"]], 0)
        return pdf.iloc[:1][["chunk"]].assign(counts=[total.tobytes()])

    rows = sets.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    out = np.zeros((64, counters // 64), np.int64)
    for chunk, data in rows:
        out[chunk] = np.frombuffer(bytes(data), np.int64)
    return out.reshape(-1)


def _firsts(docs: DataFrame, words: int, alike: int, sketch: np.ndarray) -> DataFrame:
    """``token, sid, meta``: a set's first n-grams, one of which it shares with every set alike; size and place in ``meta``."""

    def run(batches):
        seen = set()
        for batch in batches:
            tokens, sids, metas = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(1):
                h = ngram_set(text.as_py(), words)
                sid = set_id(h) if len(h) else None
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                k = len(h) - -(-alike * len(h) // 100) + 1
                tokens.append(in_order(h, sketch)[:k])
                sids.append(np.full(k, sid, np.int64))
                metas.append((len(h) << 32) + np.arange(k))
            columns = [np.concatenate(tokens).view(np.int64), np.concatenate(sids), np.concatenate(metas)]
            for at in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["token", "sid", "meta"])

    return docs.mapInArrow(frugal(run), "token long, sid long, meta long")


def _ordered_sets(docs: DataFrame, sids: DataFrame, keys: DataFrame, words: int, sketch: np.ndarray, filter_bits: int) -> DataFrame:
    """``sid, items`` of at least the sets ``sid``, common n-grams first, from documents ``key, text``.

    Of the documents of a set only the one with the smallest key is turned again, found by a filter of its
    bits; another that has the same bits is sent in vain.
    """
    slots = keys.join(sids, "sid", "left_semi").select(F.col("key").bitwiseAND(F.lit(filter_bits - 1)).alias("slot")).distinct()
    bits = np.zeros(filter_bits, np.uint8)
    bits[slots.toArrow()["slot"].to_numpy()] = 1  # at most filter_bits rows
    bits = np.packbits(bits, bitorder="little")

    def run(batches):
        seen = set()
        for batch in batches:
            slot = batch.column(0).to_numpy() & (filter_bits - 1)
            for at in np.array_split(np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1), batch.num_rows // 256 + 1):
                sids, items = [], []
                for i in at.tolist():
                    h = ngram_set(batch.column(1)[i].as_py(), words)
                    sid = set_id(h) if len(h) else None
                    if sid is not None and sid not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        items.append(in_order(h, sketch)[::-1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(items, pa.binary())], ["sid", "items"])

    return docs.select("key", "text").mapInArrow(frugal(run), "sid long, items binary")


def _can_link(meta_a: Column, meta_b: Column, alike: int) -> Column:
    """Whether sizes, and places of an n-gram as the first common one, leave room for enough overlap."""
    (a, i), (b, j) = ((F.shiftright(m, 32), m.bitwiseAND(F.lit(0xFFFFFFFF))) for m in (meta_a, meta_b))
    room = F.least(a - i, b - j)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * alike) & (room * (100 + alike) >= (a + b) * alike)


def _may_link(pairs: DataFrame, signed: DataFrame, alike: int) -> DataFrame:
    """The pairs ``p, x`` whose signatures leave room for enough overlap."""
    for end in ("p", "x"):
        pairs = pairs.join(signed.select(F.col("sid").alias(end), F.struct("n", "sig").alias(f"of_{end}")), end)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, sig = ([batch.column(i).field(name) for i in (2, 3)] for name in ("n", "sig"))
                sizes = zip(*(x.to_pylist() for x in n), strict=True)
                keep = [
                    bits_apart(x.as_py(), y.as_py()) <= a + b - 2 * needed(a, b, alike) for (a, b), x, y in zip(sizes, *sig, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["p", "x"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("p", "x", "of_p", "of_x").mapInArrow(frugal(run), "p long, x long")


def _first_common(own: np.ndarray, theirs: np.ndarray) -> int:
    """The first of ``own`` that is in ``theirs``, which ascends; there is one."""
    for at in range(0, len(own), 64):
        part = own[at : at + 64]
        hit = np.flatnonzero(theirs[np.minimum(np.searchsorted(theirs, part), len(theirs) - 1)] == part)
        if len(hit):
            return int(part[hit[0]])
    raise ValueError("nothing in common")


def _find(up: dict[int, int], at: int) -> int:
    """Where ``at`` ends in ``up``; paths are halved on the way."""
    while up.setdefault(at, at) != at:
        up[at] = at = up[up[at]]
    return at


def _pairs_of_block(
    token: int, sids, ns, places, roots, parts, sigs, peers, crossing: bool, alike: int, seed: int | None = None
) -> list[tuple[int, int]]:
    """Pairs of a block that may be linked, each one only for the first n-gram of many sets that both have.

    With ``seed``, which draws their order, only pairs of two components whose sets no pairs before have joined:
    fewer than the block has sets.
    """
    order = np.argsort(ns, kind="stable")
    ns, places, roots, parts = (x[order] for x in (ns, places, roots, parts))
    words = np.array([len(sigs[i]) // 8 for i in order])
    ends = np.searchsorted(ns, ns * 100 // alike, "right")
    sets, found, at, folded, up = {}, [], -1, None, {}
    rng = None if seed is None else np.random.default_rng(seed)
    for r in range(len(order)):
        if at < 0 or words[r] != words[at]:
            # the signatures of this size, and those of larger sets folded to it
            at, rows = r, []
            for i in order[r : max(ends[r:][words[r:] == words[r]])]:
                row = np.frombuffer(sigs[i], np.uint64)
                while len(row) > words[r]:
                    row = row[: len(row) // 2] ^ row[len(row) // 2 :]
                rows.append(row)
            folded = np.stack(rows)
        own = np.arange(r + 1, ends[r])
        both = ns[own] + ns[r]
        least = -(-alike * both // (100 + alike))
        ok = (roots[own] != roots[r]) & (np.minimum(ns[own] - places[own], ns[r] - places[r]) >= least)
        if crossing:
            ok &= parts[own] != parts[r]
        own, room = own[ok], (both - 2 * least)[ok]
        if not len(own):
            continue
        apart = np.bitwise_count(folded[own - at] ^ folded[r - at]).sum(1, dtype=np.int64)
        own = own[apart <= room]
        left = len(own) if rng is None else BRANCHES
        for x in (own if rng is None else rng.permutation(own)).tolist():
            i, j = int(order[r]), int(order[x])
            if not left:
                break
            if rng is not None and (a := _find(up, r)) == (b := _find(up, x)):
                continue
            theirs = sets.get(j)
            if theirs is None:
                theirs = sets[j] = np.sort(peers[j])
            if _first_common(peers[i], theirs) == token:
                found.append((min(sids[i], sids[j]), max(sids[i], sids[j])))
                left -= 1
                if rng is not None:
                    up[a] = b
    return found


def _alone(rows: DataFrame, dealt: int, seed: int) -> DataFrame:
    """``token, i, j, sid, meta, root, part``: the sets of an n-gram in blocks that don't meet, each set in one, other ones for each seed."""
    part = F.pmod(F.xxhash64("sid", F.lit(seed)), F.ceil(F.col("many") / dealt)).cast("int")
    return rows.select("token", part.alias("i"), part.alias("j"), "sid", "meta", "root", part.alias("part"))


def _dealt(rows: DataFrame, dealt: int) -> DataFrame:
    """``token, i, j, sid, meta, root, part``: each two sets of an n-gram meet in a group ``i, j`` unless both are in its largest component."""
    of_root = rows.where(F.col("many") > dealt).groupBy("token", "root").agg(F.count("*").alias("n"))
    largest = of_root.groupBy("token").agg(F.max(F.struct("n", "root")).alias("main"))
    rows = rows.join(largest, "token", "left")
    within = F.coalesce(F.col("main.n"), F.lit(0))
    rows = rows.withColumn("mains", F.ceil(within / dealt).cast("int")).withColumn("others", F.ceil((F.col("many") - within) / dealt).cast("int"))
    rows = rows.withColumn("is_main", F.coalesce(F.col("main.root") == F.col("root"), F.lit(False)))
    part = F.when(F.col("is_main"), F.pmod(F.xxhash64("sid"), F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(F.xxhash64("sid"), F.greatest("others", F.lit(1))))
    first = F.when(F.col("is_main"), F.col("mains")).otherwise(0)
    rows = rows.withColumn("part", part.cast("int")).withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)))
    return rows.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "sid", "meta", "root", "part")


def _pairs_of_many(rows: DataFrame, signed: DataFrame, alike: int, dealt: int, seed: int | None = None) -> DataFrame:
    """The pairs ``p, x`` across components that may be linked, of ``token, sid, meta, root, many`` with n-grams of many sets.

    With ``seed`` only pairs that make a tree of the sets of each block that may be linked, other blocks and trees for each seed.

    The sets of an n-gram are split in blocks by their hash, and each two blocks meet in one group, but for those
    of its largest component: a set of that is sent once for each block of the others, and they once for each
    block. A group has about two blocks.
    """
    peers = rows.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("meta", "token")))["token"].alias("peers"))
    rows = _dealt(rows, dealt) if seed is None else _alone(rows, dealt, seed)
    rows = rows.join(peers.join(signed.select("sid", "sig"), "sid"), "sid")
    rows = rows.select("token", "i", "j", "sid", "meta", "root", "part", "sig", "peers")
    rows = rows.repartition(partitions(rows), "token", "i", "j").sortWithinPartitions("token", "i", "j")

    def run(batches):
        key, group = None, []

        def made():
            if len(group) < 2:
                return []
            sids, metas, roots, parts, sigs, peers = zip(*group, strict=True)
            metas = np.array(metas, np.int64)
            return _pairs_of_block(
                key[0], sids, metas >> 32, metas & 0xFFFFFFFF, np.array(roots, np.int64), np.array(parts), sigs, peers, key[1] != key[2], alike, seed
            )

        def packed(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["p", "x"])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(8)
                flat, ends = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
                for r, row in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)):
                    if row[:3] != key:
                        if pairs := made():
                            yield packed(pairs)
                        key, group = row[:3], []
                    group.append((*row[3:], batch.column(7)[r].as_py(), flat[ends[r] : ends[r + 1]].copy()))
        yield packed(made())

    return rows.mapInArrow(frugal(run), "p long, x long").distinct()


def _links(pairs: DataFrame, sets: DataFrame, alike: int, block: int) -> DataFrame:
    """The pairs ``p, x`` that are linked: for each ``p`` the sets ``x`` stand in trees of about ``block`` sets."""
    sizes = pairs.groupBy("p").agg((F.count("*") / block).cast("int").alias("more"))
    pairs = pairs.join(sizes, "p").select("p", "x", F.pmod(F.xxhash64("x"), F.col("more") + 1).cast("int").alias("part"))
    probes = pairs.select("p", "part").distinct().join(sets.withColumnRenamed("sid", "p"), "p").select("p", "part", F.lit(None).cast("long").alias("x"), "items")
    others = pairs.join(sets.withColumnRenamed("sid", "x"), "x").select("p", "part", "x", "items")
    rows = probes.unionByName(others).repartition(partitions(pairs), "p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())

    def run(batches):
        key, probe, tree = None, None, None

        def made():
            found = tree.search(np.sort(probe), alike) if tree is not None and tree.below else []
            return [(key[0], x) for x in found]

        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            for p, part, x, items in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (p, part) != key:
                    out += made()
                    key, tree = (p, part), Tree(np.zeros(0, np.uint64))
                own = np.frombuffer(items.as_py(), np.uint64)
                if x is None:
                    probe = own
                else:
                    tree.add(own, x)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], ["a", "b"])
        out = made()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(frugal(run), "a long, b long")


def _with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` of the components that links ``a, b`` make of those of ``roots``; other nodes are their own."""
    for end in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    joined = components(links)
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    new = joined.join(roots.select("node"), "node", "left_anti")
    return materialize(moved.select("node", F.coalesce("to", "root").alias("root")).unionByName(new), "near-roots")


def alike_documents(
    docs: DataFrame, words: int = WORDS, alike: int = ALIKE, doc_id: str = "doc_id", text: str = "text",
    counters: int = COUNTERS, filter_bits: int = FILTER_BITS, block: int = BLOCK, many: int = MANY, dealt: int = DEALT,
) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, group``: the smallest id that a document reaches by links.

    Words are those between white space, A-Z in lower case; fewer than ``words`` are one n-gram. Two
    documents are linked when 100 times their sets' intersection is at least ``alike`` times the union.
    Null texts and texts without words have an empty set and are linked with nothing. Equal sets are
    one node, known by a 64-bit number. Every row is a document, also repeated ones; a null id is never the
    smallest, and a group without any id has a null component. ``text_hash`` (xxhash64) tells rows of one id
    apart, and ``group`` (null for an empty set) components in which one id occurs.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    hashes = rows.withColumn("text_hash", F.xxhash64("text"))
    keyed = hashes.select(F.struct("doc_id", "text_hash").alias("doc_id"), "text")
    sets = materialize(_sets(keyed, words, counters), "ngram-sets")
    sketch = _sketch(sets, counters)
    signed = materialize(sets.where("sig is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "signatures")
    sets = sets.where("chunk is null").select("doc_id.doc_id", "doc_id.text_hash", "n", "sid")

    firsts = _firsts(rows, words, alike, sketch)
    w = Window.partitionBy("token")
    shared = firsts.withColumn("low", F.min("sid").over(w)).withColumn("high", F.max("sid").over(w)).where("low <> high")
    shared = materialize(shared.select("token", "sid", "meta").distinct(), "shared-ngrams")

    keyed = keyed.select(F.xxhash64("doc_id.doc_id", "doc_id.text_hash").alias("key"), "text")
    keys = sets.where("sid is not null").groupBy("sid").agg(F.min(F.xxhash64("doc_id", "text_hash")).alias("key"))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        sids = pairs.select(F.col("p").alias("sid")).unionByName(pairs.select(F.col("x").alias("sid"))).distinct()
        ordered = materialize(_ordered_sets(keyed, sids, keys, words, sketch, filter_bits), "ordered-sets")
        return materialize(_links(pairs, ordered, alike, block), name)

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """``token, sid, meta, root, many`` of n-grams whose sets are in several components, and how many sets."""
        rows = rows.select("token", "sid", "meta").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        w = Window.partitionBy("token")
        rows = rows.withColumn("low", F.min("root").over(w)).withColumn("high", F.max("root").over(w)).withColumn("many", F.count("*").over(w)).where("low <> high")
        return materialize(rows.drop("low", "high"), "ngrams-apart")

    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    rest = shared.withColumn("root", F.col("sid")).withColumn("many", F.count("*").over(w))
    tried = None
    for i in range(ROUNDS):
        # every set with one other of each n-gram, the same for most of them, another one in each round
        w = Window.partitionBy("token")
        one = rest.withColumn("o", F.min(F.struct(F.xxhash64("sid", F.lit(i)).alias("by"), "sid", "meta", "root")).over(w))
        near = one.where((F.col("o.root") != F.col("root")) & _can_link(F.col("meta"), F.col("o.meta"), alike))
        near = materialize(near.select(F.col("o.sid").alias("p"), F.col("sid").alias("x")).distinct(), "maybe-pairs")
        near = materialize(_may_link(near, signed, alike), "near-pairs")
        done = near.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x"))
        tried = done if tried is None else tried.unionByName(done)
        roots = _with_links(roots, linked(near, "near-links"))
        rest = apart(rest, roots)

    # sets of n-grams that many have along trees of pairs, as long as these join components
    for i in range(TREE_ROUNDS):
        along = _pairs_of_many(rest.where(F.col("many") >= many), signed, alike, dealt, i)
        along = materialize(along if tried is None else along.join(tried, ["p", "x"], "left_anti"), "tree-pairs")
        pairs = along.count()
        if not pairs:
            break
        tried = along if tried is None else tried.unionByName(along)
        links = linked(along, "tree-links")
        roots = _with_links(roots, links)
        rest = apart(rest, roots)
        if 4 * links.count() < pairs:
            break

    # all pairs that may be linked across the components that are left
    few = rest.where(F.col("many") < many)
    a, b = (few.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "meta", "root")]) for s in "ab")
    across = a.join(b, "token").where("root_a <> root_b and sid_a < sid_b").where(_can_link(F.col("meta_a"), F.col("meta_b"), alike))
    across = materialize(across.select(F.col("sid_a").alias("p"), F.col("sid_b").alias("x")).distinct(), "maybe-pairs")
    across = _may_link(across, signed, alike)
    across = across.unionByName(_pairs_of_many(rest.where(F.col("many") >= many), signed, alike, dealt)).distinct()
    across = materialize(across if tried is None else across.join(tried, ["p", "x"], "left_anti"), "apart-pairs")
    if not across.isEmpty():
        roots = _with_links(roots, linked(across, "apart-links"))

    firsts_of = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    named = firsts_of.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.select("sid", "root").join(lowest, "root").select("sid", "component_id", F.col("root").alias("group"))
    out = sets.join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "group")


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; texts without words are each one.

    Of rows that share that id one text stays, and of rows alike in id and text one row. Documents without an
    id stay only where no document with one is linked to them, one of each group.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("own_hash", F.xxhash64(f"c{names.index(text)}"))
    stay = found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("its_id"), F.coalesce("group", "text_hash")).agg(F.min("text_hash").alias("its_hash"))
    key = f"c{names.index(doc_id)}"
    kept = plain.join(stay, F.col(key).eqNullSafe(F.col("its_id")) & (F.col("own_hash") == F.col("its_hash")), "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, "own_hash"])
    return kept.drop("own_hash").toDF(*names)
