"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

A document's set holds its distinct shingles (four words, or as many as the caller says) as 64-bit hashes. All coordinates
of its signature come from two permutations of one circular universe: the first scatters the shingles, the second is read
at positions shifted by k for coordinate k, and the least value is the coordinate. Bands of coordinates deal documents to
buckets.

Documents with equal sets are one node from the start. In a bucket every node is held against the bucket's most popular
node (the one whose buckets hold most nodes together: the text that the others are copies of), not each with each. Where a
bucket still has several components it is held against its second most popular node too. Links are confirmed on the full
sets: a leader's set is sent once for PART members, and all sets travel in pieces of PIECE shingles, so neither a large
group nor a long text makes a task's rows large.

Of what is then still in different components of one bucket, only those pairs are compared that exact bounds leave: a node
loses its place in a bucket where too many of its shingles stand in no other open node, a pair is left out where the two
differ too much in their distance from the leader (Jaccard distance is a metric), and what two nodes have in common is
either shared with the leader (and what most of its group share beside), which holds little of a node far from it, or else
found by joining the shingles that this centre lacks. So no link between components is left out. Where a group has several
centres, stragglers of one meet much of it by the shingles of another: this part can grow with stragglers times group size.
Hashes of 64 bits stand for shingles and sets.

A pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8 ** ROWS) ** BANDS = 3e-6.

Defined cases: a text without words is linked with nothing and is its own component; a null doc_id ranks after all others
and the component of null doc_ids alone is null; rows of equal doc_id and unlike texts are judged each by its own text, so
op4 may keep one of them (the least of its own component) and drop another; the pipeline's stage keeps one row of each
component; an empty table gives an empty result; the stage passes all columns through, whatever their names. Links that do
not settle in graph.components' 60 steps raise an error instead of losing a link; 60 steps settle chains of any length met
in practice, as depth falls with each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, discarded, let_go, rowed, saved, saved_by
from tessera.llm.graph import components
from tessera.llm.substring import WordHashes, mixed, split_words

SHINGLE = 4
BANDS, ROWS = 24, 4
#: Links hold where 100 * intersection >= SHARE * union.
SHARE = 80
#: Shingles whose signatures are made at a time.
BLOCK = 1 << 16
#: Shingles of a set in one row, and rows of tokens given back at a time: both bound what a Python worker holds.
PIECE, CHUNK = 512, 50_000
#: Texts turned into signatures at a time.
ROWS_AT_A_TIME = 512
#: Sets that are held against one copy of a leader's set.
PART = 2048
#: Bits of a bitmap for each row that is looked for, and of a bitmap at most (16 MB): a larger table only has more rows pass.
BITS, MOST_BITS = 16, 1 << 27
LAST = 2**63 - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle are one as a whole."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(size, len(words))
    n = len(words) - wide + 1
    run = np.full(n, wide, np.uint64)
    for k in range(wide):
        run = run * _ODD + hashes[k : k + n]
    return np.unique(mixed(run))


def permuted(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit positions (xor-shifts and odd factors, each of them a bijection), in out."""
    np.bitwise_xor(x, np.right_shift(x, np.uint32(16), out=spare), out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.bitwise_xor(out, np.right_shift(out, np.uint32(13), out=spare), out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    np.bitwise_xor(out, np.right_shift(out, np.uint32(16), out=spare), out=out)
    return out


def signatures(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """Signature of each non-empty set, a row each. Position k of the circle is read by shifting all positions by k."""
    out = np.empty((len(sets), n), np.uint32)
    begin = 0
    while begin < len(sets):
        end, total = begin + 1, len(sets[begin])
        while end < len(sets) and total + len(sets[end]) <= BLOCK:
            total += len(sets[end])
            end += 1
        # The first permutation of the universe: the upper half of a 64-bit bijection.
        places = (mixed(np.concatenate(sets[begin:end])) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[begin : end - 1]]))).astype(np.int64)
        buffer, spare, shifted = (np.empty_like(places) for _ in range(3))
        for k in range(n):
            np.add(places, np.uint32(k), out=shifted)
            out[begin:end, k] = np.minimum.reduceat(permuted(shifted, buffer, spare), starts)
        begin = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * _ODD + parts[:, :, r])
    return key.view(np.int64)


def node_of(members: np.ndarray) -> np.int64:
    """A set's own hash, never 0: of a sum and a xor of its members, which come in no order."""
    both = np.array([members.sum(), np.bitwise_xor.reduce(members) + np.uint64(len(members))], np.uint64)
    return mixed(mixed(both[:1]) * _ODD + both[1:]).view(np.int64)[0] or np.int64(1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_key, text_key and text; the two keys tell rows apart, rows of equal keys are equal in doc_id and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "text")


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_key, text_key, node, n_shingles, bands) of each document; node is 0 and bands empty without words."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        known = WordHashes()
        for whole in batches:
            # Some texts at a time: the sets of a whole batch aren't held together.
            for begin in range(0, len(whole), ROWS_AT_A_TIME):
                batch = whole.iloc[begin : begin + ROWS_AT_A_TIME]
                sets = [shingle_set(t, known, size) for t in batch["text"]]
                full = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [np.empty(0, np.int64)] * len(sets)
                nodes = np.zeros(len(sets), np.int64)
                if full:
                    for k, row in zip(full, band_keys(signatures([sets[k] for k in full])), strict=True):
                        bands[k] = row
                        nodes[k] = node_of(sets[k])
                yield pd.DataFrame({"doc_key": batch["doc_key"].to_numpy(), "text_key": batch["text_key"].to_numpy(), "node": nodes, "n_shingles": [len(s) for s in sets], "bands": bands})

    return keyed(docs).mapInPandas(sketched, "doc_key long, text_key long, node long, n_shingles long, bands array<long>")


def likely(rows: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("doc_key", "text_key")) -> DataFrame:
    """Rows whose keys may be among those asked for: all that are, and of the others about one in BITS. The rest needn't be sent
    to a join.

    The hashes asked for are marked in a bitmap of BITS bits a row asked for, which is small enough to be broadcast.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(min(MOST_BITS, max(1 << 15, BITS * asked.count())))) + 1
    asked = asked.select(F.bitmap_bucket_number(place).alias("mark_row"), F.bitmap_bit_position(place).alias("bit"))
    marks = asked.groupBy("mark_row").agg(F.bitmap_construct_agg("bit").alias("marks"))
    marked = rows.withColumns({"mark_row": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)}).join(F.broadcast(marks), "mark_row")
    held = F.expr("getbit(cast(conv(hex(substring(marks, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1")
    return marked.where(held).select(*rows.columns)


def set_pieces(needed: DataFrame, docs: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, piece, members) of the nodes in needed, saved by node: their texts are turned into sets again, so sets are never
    kept for all documents. Pieces are numbered in the order of their members; repeated rows give repeated pieces.

    A text's node follows from its set, so texts are turned into sets where they lie and only sets are shuffled, once: the
    joins by node that follow find them dealt out. Of rows that pass the bitmap by chance the join with their node lets
    only the node's own text through.
    """

    def as_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        known = WordHashes()
        for batch in batches:
            out, held = [], 0
            for doc_key, text_key, text in zip(batch["doc_key"], batch["text_key"], batch["text"], strict=True):
                members = shingle_set(text, known, size)
                if not len(members):
                    continue
                node = node_of(members)
                out += [(node, doc_key, text_key, k, members[k * PIECE : (k + 1) * PIECE].tobytes()) for k in range(-(-len(members) // PIECE))]
                held += len(members)
                if held > CHUNK:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)

    columns = ["node", "doc_key", "text_key", "piece", "members"]
    asked = saved(needed.join(nodes.select("node", "rep"), "node").select("node", F.col("rep.doc_key").alias("doc_key"), F.col("rep.text_key").alias("text_key")), "asked")
    made = likely(keyed(docs), asked).mapInPandas(as_pieces, "node long, doc_key long, text_key long, piece int, members binary")
    own = asked.select("node", F.col("doc_key").alias("own_doc"), F.col("text_key").alias("own_text"))
    # Held equal by a xor, so that the join is by node alone and its rows stay dealt out by node.
    same = F.col("doc_key").bitwiseXOR(F.col("own_doc")).bitwiseOR(F.col("text_key").bitwiseXOR(F.col("own_text"))) == 0
    out = saved_by(made, "sets", "node", lambda dealt_out: dealt_out.join(own, "node").where(same).select("node", "piece", "members"))
    discarded(asked)
    return out


def dealt(pairs: DataFrame) -> DataFrame:
    """(a, b, part) of pairs (a, b), saved: b's members in parts of about PART."""
    pairs = saved(pairs.select("a", "b"), "pairs")
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("size"))
    out = saved(pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / PART)).alias("part")), "pairs")
    discarded(pairs)
    return out


def beside_leaders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(b, part, is_own, a, piece, members) for pairs (a, b, part), sorted: in each part of b's members first the pieces of
    b's own set, then those of each member."""
    row = lambda own: ("b", "part", F.lit(own).alias("is_own"), "a", "piece", "members")
    members = pairs.join(sets.withColumnRenamed("node", "a"), "a").select(*row(False))
    leaders = pairs.select("b", "part").distinct().join(sets.withColumnRenamed("node", "b"), "b").withColumn("a", F.col("b")).select(*row(True))
    order = ("b", "part", F.col("is_own").desc(), "a", "piece")
    return leaders.unionByName(members).repartition("b", "part").sortWithinPartitions(*order)


def each_beside(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(a, b, size of b's set, members of a's piece, which of them b has) from the rows of beside_leaders."""
    part, last, leader, own = None, None, np.empty(0, np.int64), []
    for batch in batches:
        for b, at, is_own, a, piece, members in zip(*(batch[c].tolist() for c in ("b", "part", "is_own", "a", "piece", "members")), strict=True):
            if (b, at) != part:
                part, own, last = (b, at), [], None
            if (is_own, a, piece) == last:
                continue
            last, found = (is_own, a, piece), np.frombuffer(members, np.uint64)
            if is_own:
                own.append(found)
                continue
            if own:
                leader, own = np.concatenate(own), []
            place = leader.searchsorted(found)
            place[place == len(leader)] = 0
            yield a, b, len(leader), found, leader[place] == found


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either) of each of pairs (a, b): sizes of the intersection and the union of their sets."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list[int]] = []
        for a, b, size, found, held in each_beside(batches):
            if not out or out[-1][:2] != [a, b]:
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=["a", "b", "both", "either"])
                    out = []
                out.append([a, b, 0, size])
            both = int(held.sum())
            out[-1][2] += both
            out[-1][3] += len(found) - both
        yield pd.DataFrame(out, columns=["a", "b", "both", "either"])

    return beside_leaders(dealt(pairs), sets).mapInPandas(sizes, "a long, b long, both long, either long")


def lacking(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, leader, member) for pairs (a, b): the shingles of node a that its leader b lacks."""

    def lacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for a, b, _, found, held in each_beside(batches):
            more = found[~held].view(np.int64)
            out.append((np.full(len(more), a), np.full(len(more), b), more))
            n += len(more)
            if n > CHUNK:
                yield pd.DataFrame(dict(zip(("node", "leader", "member"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                out, n = [], 0
        if out:
            yield pd.DataFrame(dict(zip(("node", "leader", "member"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return beside_leaders(dealt(pairs), sets).mapInPandas(lacked, "node long, leader long, member long")


def unshared(needed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, alone): how many shingles of a node stand in no other node of needed; nodes without any are left out."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), CHUNK // PIECE):
                some = batch.iloc[k : k + CHUNK // PIECE]
                rows = [np.frombuffer(x, np.int64) for x in some["members"]]
                yield pd.DataFrame({"member": np.concatenate(rows), "node": np.repeat(some["node"].to_numpy(), [len(x) for x in rows])})

    rows = sets.join(needed, "node", "left_semi").select("node", "members").mapInPandas(members, "member long, node long")
    once = rows.groupBy("member").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def with_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """entries of buckets whose nodes are in different components, with each node's root."""
    named = roots.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
    rooted = entries.drop("root").join(named, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("r_root", "node")).drop("r_node", "r_root")
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least_n")).where("low < high")
    return rooted.drop("least_n").join(several.select("bucket", "least_n"), "bucket")


#: x and y aren't linked yet, and neither their sizes nor their distances from the leader keep them apart.
OPEN = f"""x.node < y.node and x.root <> y.root and 100 * least(x.n, y.n) >= {SHARE} * greatest(x.n, y.n)
    and abs(x.away - y.away) <= 1 - {SHARE} / 100 + 1e-9"""
#: So many shingles in common are needed by sets of x.n and y.n.
NEED = f"{SHARE} * (x.n + y.n) / {100 + SHARE}.0 - 1e-6"
#: Sizes of a node and its leader that can be linked.
LIKE = f"100 * least(n, m) >= {SHARE} * greatest(n, m)"


def centred(placed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed (bucket, node, leader, n, m, both, ...) and added (node, leader, member) for centres instead of leaders, placed
    with away, the distance from the centre.

    A centre is the leader's set and what more than half of its nodes have that it lacks. The bounds hold for any set, and
    a copy that lacks what its group shares would leave all of the group together.
    """
    sizes = placed.select("node", "leader").distinct().groupBy("leader").agg(F.count(F.lit(1)).alias("nodes"))
    held = added.groupBy("leader", "member").agg(F.count(F.lit(1)).alias("holders"))
    common = saved(held.join(sizes, "leader").where("2 * holders > nodes").select("leader", "member"), "common")
    more = common.groupBy("leader").agg(F.count(F.lit(1)).alias("more"))
    gain = added.join(common, ["leader", "member"]).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("gain"))
    moved = placed.join(gain, ["node", "leader"], "left").join(more, "leader", "left")
    both, m = F.col("both") + F.coalesce("gain", F.lit(0)), F.col("m") + F.coalesce("more", F.lit(0))
    moved = moved.withColumn("both", both).withColumn("away", 1 - F.col("both") / (F.col("n") + m - F.col("both")))
    return moved.drop("gain", "more", "m"), added.join(common, ["leader", "member"], "left_anti")


def placed_members(placed: DataFrame, added: DataFrame) -> DataFrame:
    """added (node, leader, member) with what placed says of the node: as many rows."""
    return added.join(placed.drop("bucket", "least_n").distinct(), ["node", "leader"])


def pairs_by_added(rows: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that share a shingle which their leader lacks, from the rows of placed_members.
    These are read several times, so they should be saved."""
    several = rows.groupBy("leader", "member").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rows = rows.join(several.select("leader", "member"), ["leader", "member"])
    bound = F.expr(f"least(x.both, y.both) + least(x.c - x.both, y.c - y.both) >= {NEED}")
    same = (F.col("x.leader") == F.col("y.leader")) & (F.col("x.member") == F.col("y.member"))
    return rows.alias("x").join(rows.alias("y"), same & F.expr(OPEN) & bound).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def pairs_by_kept(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of nodes in different components for which what they have in common with their leader can be enough.

    Nodes that are not in the leader's component (stray) reach only sets smaller than the leader, so most of a group of
    near copies leaves the buckets here.
    """
    # Leaders' roots are looked up once a bucket, not for each of its nodes.
    led = placed.select("bucket", "leader").distinct().join(roots.select(F.col("node").alias("leader"), F.col("root").alias("lead_root")), "leader", "left")
    led = led.select("bucket", F.coalesce("lead_root", "leader").alias("lead_root"))
    free = placed.where(f"both >= {SHARE} * (n + greatest({SHARE} * n / 100, least_n)) / {100 + SHARE}.0 - 1e-6")
    free = free.join(led, "bucket").withColumn("stray", F.col("root") != F.col("lead_root")).drop("lead_root")
    reach = free.where("stray").groupBy("bucket").agg(F.max(F.expr(f"{100 + SHARE} * both - {SHARE} * n")).alias("reach"))
    near = with_roots(free.join(reach, "bucket").where(f"stray or {SHARE} * n <= reach").drop("reach"), roots)
    same = F.col("x.bucket") == F.col("y.bucket")
    pairs = near.alias("x").join(near.alias("y"), same & F.expr(OPEN) & F.expr(f"least(x.both, y.both) >= {NEED}"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def led_by(entries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """entries (bucket, node, n, popular, ...) with leader and m: the bucket's most popular node and its size; with its
    component lead_root where roots are given. A node that has been the leader before (column before, if there is one)
    isn't taken again."""
    able = entries.where("node <> before") if "before" in entries.columns else entries
    best = able.groupBy("bucket").agg(F.max(F.struct("popular", F.col("node").alias("leader"), F.col("n").alias("m"))).alias("best")).select("bucket", "best.leader", "best.m")
    if roots is not None:
        named = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead_root"))
        best = best.join(named, "leader", "left").withColumn("lead_root", F.coalesce("lead_root", "leader"))
    return entries.join(best, "bucket")


def node_components(docs: DataFrame, sketch: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """nodes (node, rep, n) and the (node, root) of those with links."""
    filled = sketch.where("node <> 0")
    nodes = saved(filled.groupBy("node").agg(F.min(F.struct("doc_key", "text_key")).alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = saved(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    # Most nodes are alone in most of their buckets.
    first = saved(likely(entries, buckets, ("bucket",)).join(buckets, "bucket"), "buckets")
    discarded(buckets)
    popular = first.groupBy("node").agg(F.sum("held").alias("popular"))
    entries = saved(led_by(first.drop("held").join(popular, "node")), "buckets")
    discarded(first)
    none = nodes.select("node", F.col("node").alias("root")).limit(0)
    if entries.isEmpty():
        return nodes, none
    sets = set_pieces(entries.select("node").distinct(), docs, nodes, size)
    as_pairs = lambda led: led.where(F.col("node") != F.col("leader")).where(LIKE).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    linked = lambda pairs: saved(compared(pairs, sets).where(f"100 * both >= {SHARE} * either").select("a", "b"), "linked")

    links = linked(as_pairs(entries))
    roots = components(links)
    again = saved(led_by(with_roots(entries, roots).drop("m").withColumnRenamed("leader", "before"), roots), "open")
    if not again.isEmpty():
        # A node is not held against one of its own component, nor the two leaders against each other once more.
        apart = again.where("node <> before and root <> lead_root")
        links = saved(links.unionByName(linked(as_pairs(apart))), "linked")
        roots = components(links)

    still = saved(with_roots(entries.drop("popular"), roots), "open")
    discarded(again, entries)
    if still.isEmpty():
        return nodes, roots
    alone = unshared(still.select("node").distinct(), sets)
    counted = still.join(alone, "node", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    # To be similar to a set of m shingles a set of n needs SHARE / (100 + SHARE) of n + m in common; m is SHARE % of n and
    # the bucket's smallest set at least. The leader itself was held against all that its size allows.
    enough = F.expr(f"node <> leader and {100 + SHARE} * c >= {SHARE} * (n + greatest({SHARE} * n / 100, least_n))")
    able = saved(with_roots(counted.where(enough), roots), "able")
    if able.isEmpty():
        return nodes, roots
    added = saved(lacking(able.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets), "added")
    n_added = added.groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n_added"))
    placed = able.join(n_added, ["node", "leader"], "left").withColumn("both", F.col("n") - F.coalesce("n_added", F.lit(0))).drop("n_added")
    placed, own = centred(placed, added)
    placed = saved(placed, "placed")
    members = saved(placed_members(placed, own), "members")
    rest = saved(pairs_by_added(members).unionByName(pairs_by_kept(placed, roots)).distinct(), "pairs")
    discarded(still, able, added, placed, members)
    if rest.isEmpty():
        return nodes, roots
    roots = components(saved(links.unionByName(linked(rest)), "linked"))
    discarded(rest, sets)
    return nodes, roots


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_key, text_key, n_shingles, component, root) of each row of docs, by shingles of size words.

    root is a node of the component: unlike the least doc_key it tells components of null or repeated doc_ids apart.
    """
    sketch = saved(sketches(docs, size), "sketches")
    nodes, roots = node_components(docs, sketch, size)
    ids = nodes.select("node", F.col("rep.doc_key").alias("least"))
    rooted = ids.join(roots, "node")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    linked = rooted.join(of_root, "root").select("node", "component", "root")
    named = saved(ids.join(linked, "node", "left").select("node", F.coalesce("component", "least").alias("component"), F.coalesce("root", "node").alias("root")), "components")
    discarded(nodes)
    return sketch.join(named, "node", "left").select("doc_key", "text_key", "n_shingles", F.coalesce("component", "doc_key").alias("component"), "root")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    out = found.select(known("doc_key").alias("doc_id"), "n_shingles", known("component").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, then the least hash of its text.

    A text without words is linked with nothing, so such rows all stay. Of rows that are equal in both one is kept.
    """
    least = near_duplicates(docs, size).where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_key", "text_key")).alias("least"))
    kept = least.select("least.doc_key", "least.text_key").distinct()
    # Maps can't be hashed; columns of any type come along in a struct, which min_by doesn't compare.
    plain = [f"row.`{f.name}`" for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString()]
    rows = rowed(docs, doc_key=F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text_key=F.coalesce(F.xxhash64("text"), F.lit(0)), filled=F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    one = rows.where("filled").join(kept, ["doc_key", "text_key"], "left_semi").groupBy("doc_key", "text_key").agg(F.min_by("row", F.xxhash64("doc_key", *plain)).alias("row"))
    return one.select("row.*").unionByName(rows.where(~F.col("filled")).select("row.*"))
