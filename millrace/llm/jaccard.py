"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct word shingles, hashed. Tokens are in classes by frequency: a count sketch of fixed size over all
documents says which are frequent. In one global order, rare before frequent and then by hash, two sets that reach the threshold share a
token in their prefixes. Prefixes that reach into the frequent tokens are extended, so that such sets share B + 1 tokens there: then either a rare one
is shared, or, frequent tokens being dealt into B classes by hash, two of one class. So rare tokens are indexed alone and frequent ones as pairs within their class. B
follows from a tier of the sets' sizes; a set takes part in the tier of every smaller size that it may be linked with.

Documents that share a signature meet at a centre, the smallest id among them. Postings of rare tokens, of which the sketch bounds the number for each, are sorted by signature and streamed;
those of pairs, which nothing bounds, are reduced to a centre before the shuffle and joined with it, which Spark can split. Each document is compared with its centre first: by bitmaps, one bit for each
token, that bound the overlap from above, then by whole sets. The links found connect the copies of a large group in work that follows their number. Only documents of a centre
that are still unconnected are compared with the others there, in tiles (pairs of blocks bounded by documents and by tokens), again by bitmaps and then by whole sets. Tiles give links to a
spanning root, never all pairs; so every link is found, or its ends are connected by others that were.

Documents with equal sets are one before all this. Null and empty texts have no tokens and link with nothing. Repeated rows (same id and text) are one class and give a row each;
ids are taken to be unique otherwise. Rows with a null id link with nothing and have no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, freed, matching, slices, table, tidy, written
from .components import components
from .neighbours import groups

#: Lower case for A-Z alone, in UTF-8.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SKETCH_BITS, BLOCK_BITS = 20, 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def token_sets(texts: list[str | None], width: int, memo: Bounded) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of `width` words; of the whole sequence where it has fewer words."""
    words = [(t or "").encode().translate(LOWER).split() for t in texts]  # bytes part at blanks of ASCII alone
    sizes = [len(w) for w in words]
    h = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    rolled = _shingled(h, width)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(_shingled(h[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def _shingled(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MIX + h[k : k + len(out)])
    return out


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    memo = Bounded(_word_hash, 150_000)
    for batch in slices(batches, 250):
        yield batch, token_sets(batch.column(1).to_pylist(), width, memo)


def described(documents: DataFrame, width: int) -> DataFrame:
    """One row for each document (doc_id, n, key, map; equal keys for equal sets only), and rows (block, counts) of each task's part of the sketch."""
    cells, size = 1 << SKETCH_BITS, 1 << BLOCK_BITS
    schema = "doc_id long, n long, key binary, map binary, block int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch, sets in _sets(batches, width):
            cell, often = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
            total[cell.astype(np.int64)] += often.astype(np.int32)
            key = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            none = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), key, pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        if total.any():
            n = cells // size
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, size)], pa.binary())], names=names)

    return documents.select("doc_id", "text").mapInArrow(tidy(run), schema)


def frequent(parts: DataFrame, above: int) -> np.ndarray:
    """Bits, one for each cell of the sketch: whether its tokens count as frequent. The sketch, and so what comes to the driver, has a fixed size."""
    cells, size = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    found = parts.where("block is not null").select("block", "counts").repartition("block").mapInArrow(tidy(add), "block int, counts binary").collect()
    total = np.zeros((cells // size, size), np.int64)
    for block, counts in found:
        total[block] = np.frombuffer(counts, np.int64)
    total = total.ravel()
    return np.packbits(total > np.median(total) + max(above, 6 * np.sqrt(np.median(total) + 1)))


def _tiers(n: int, percent: int) -> range:
    """Tiers of the sizes of sets that a set of n tokens may be linked with as the larger one."""
    return range(max(1, -(-n * percent // 100)).bit_length(), n.bit_length() + 1)


def _classes(tier: int, percent: int) -> int:
    """Classes of frequent tokens in a tier: as many as its smallest set has tokens in its prefix, so that a set's pairs are about twice its prefix and not half its square; fewer than such a set must share."""
    n = 1 << max(0, tier - 1)
    least = -(-n * percent // 100)
    return max(1, min(n - least + 1, least - 1))


def signatures(s: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures of a set: tokens alone, and pairs of frequent ones (with frequent tokens alone where there are too few of them)."""
    n = len(s)
    if not n:
        return s, s
    # hashes of 63 bits below the class, so one sort gives the global order
    hashed = np.sort((_mixed(s) >> np.uint64(1)) | (often[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(63)))
    common = hashed >> np.uint64(63) > 0
    least = -(-n * percent // 100)
    prefix = n - least + 1
    alone, pairs = [hashed[:0]], [hashed[:0]]
    for tier in _tiers(n, percent):
        if not common[:prefix].any():
            alone.append(hashed[:prefix])
            continue
        classes = _classes(tier, percent)
        p = min(n, prefix + classes)
        rare = ~common[:p]
        alone.append(hashed[:p][rare])
        rest = hashed[:p][~rare]
        if least < classes + 1:  # too few tokens to promise a second one
            pairs.append(rest)
        of = rest % np.uint64(classes)
        order = np.argsort(of, kind="stable")
        of, own = of[order], rest[order]
        for step in range(1, len(own)):
            same = of[step:] == of[:-step]
            if not same.any():
                break
            pairs.append(_mixed(own[:-step][same] * _MIX + own[step:][same] + np.uint64(tier)))
    return np.unique(np.concatenate(alone)), np.unique(np.concatenate(pairs))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the tokens' numbers in as many cells as there are tokens, to the next power of two (64 at least)."""
    size = max(64, 1 << int(len(s) - 1).bit_length() if len(s) else 64)
    return np.packbits(np.bincount((_mixed(s) >> np.uint64(20)) % np.uint64(size), minlength=size) & 1).tobytes()


def _folded(number: int, size: int, to: int) -> int:
    while size > to:
        size >>= 1
        number = (number >> size) ^ (number & ((1 << size) - 1))
    return number


def _may_link(n: int, a: bytes, m: int, b: bytes, percent: int) -> bool:
    """Whether sets of n and m tokens with these bitmaps can reach the threshold: the cells that differ are tokens that only one of them has."""
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    size = 8 * min(len(a), len(b))
    differ = (_folded(int.from_bytes(a), 8 * len(a), size) ^ _folded(int.from_bytes(b), 8 * len(b), size)).bit_count()
    return (100 + percent) * min((n + m - differ) // 2, n, m) >= percent * (n + m)


def postings(documents: DataFrame, width: int, percent: int, bits: np.ndarray) -> DataFrame:
    """signature, doc_id, and whether the signature is a pair of frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(bits).astype(bool)
        for batch, sets in _sets(batches, width):
            got = [signatures(s, often, percent) for s in sets]
            sizes = [len(alone) + len(pairs) for alone, pairs in got]
            if not sum(sizes):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.concatenate([y for x in got for y in x])
            paired = np.repeat(np.tile([False, True], len(got)), [len(y) for x in got for y in x])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(ids, sizes)), pa.array(paired)], names=["signature", "doc_id", "paired"])

    return documents.select("doc_id", "text").mapInArrow(tidy(run), "signature long, doc_id long, paired boolean")


MEMBER = "centre long, doc_id long"


def _at_centres(dealt: DataFrame) -> DataFrame:
    """centre and doc_id for the documents, other than the centre, of each signature; rows come in order of signature and doc_id. One row is held, whatever a signature's number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            signature, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(doc), bool)
            new[1:] = signature[1:] != signature[:-1]
            new[0] = last != signature[0]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            own = np.where(lead >= 0, doc[lead], centre)
            last, centre = signature[-1], own[-1]
            some = own != doc
            if some.any():
                found = np.unique(np.stack([own[some], doc[some]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["centre", "doc_id"])

    return dealt.mapInArrow(tidy(run), MEMBER)


def members(post: DataFrame) -> DataFrame:
    """centre and doc_id, once each, of the documents that share a signature with the smallest id that has it."""
    alone, pairs = (post.where(F.col("paired") == x).select("signature", "doc_id") for x in (False, True))
    bounded = _at_centres(alone.repartition("signature").sortWithinPartitions("signature", "doc_id"))
    centres = pairs.groupBy("signature").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("most")).where("centre < most").select("signature", "centre")
    return bounded.unionByName(pairs.join(centres, "signature").where("centre <> doc_id").select("centre", "doc_id")).distinct()


def _linked(a: np.ndarray, b: np.ndarray, ids: np.ndarray):
    """(id, root) of the nodes with an edge; the root is the smallest id of the component."""
    order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = order.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        low = np.minimum(low, low[np.argsort(order)[low]])
        if (low == before).all():
            break
    got = np.unique(np.concatenate([a, b]))
    return ids[got], ids[np.argsort(order)[low[got]]]


LINK = "a long, b long"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _star(near: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links between documents and their centres, by whole sets. A centre's documents are dealt into blocks of about `most` tokens, its own set goes to each block once."""
    sizes = near.join(sets.select("doc_id", "n"), "doc_id").groupBy("centre").agg(F.ceil(F.sum("n") / most).cast("int").alias("blocks"))
    own = near.join(sizes, "centre").join(sets, "doc_id").select("centre", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "doc_id", "n", "tokens")
    lead = sizes.join(sets, F.col("centre") == F.col("doc_id")).select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "doc_id", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, ids, n, tokens) in groups(batches, 2):
            if len(ids) < 2 or side[0]:
                continue
            centre, rest = np.frombuffer(tokens[0], np.uint64), np.frombuffer(b"".join(tokens[1:]), np.uint64)
            there = centre[np.minimum(np.searchsorted(centre, rest), len(centre) - 1)] == rest
            overlap = np.add.reduceat(there, np.concatenate([[0], np.cumsum(n[1:])[:-1]]), dtype=np.int64)
            linked = (100 + percent) * overlap >= percent * (n[1:] + n[0])
            if linked.any():
                yield _links(ids[1:][linked], np.full(int(linked.sum()), ids[0]))

    return own.unionByName(lead).repartition("centre", "block").sortWithinPartitions("centre", "block", "side", "doc_id").mapInArrow(tidy(run), LINK)


def _tiles(held: DataFrame, block: int, most: int, *columns: str) -> DataFrame:
    """Rows (centre, i, j, side, doc_id, comp, n, ...) of documents (centre, doc_id, comp, n, ...), so that each two of a centre in different components meet in a tile of two blocks.

    The largest component of a centre is its main one; what is outside of it meets the rest and the main one, and the main one doesn't meet itself. Blocks have about `block` documents and `most` tokens.
    """
    blocks = lambda: F.greatest(F.ceil(F.sum("docs") / block), F.ceil(F.sum("tokens") / most)).cast("int")
    of = held.groupBy("centre", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    largest = of.groupBy("centre").agg(F.max(F.struct("docs", "comp")).alias("main")).select("centre", F.col("main.comp").alias("main"))
    sizes = of.join(largest, "centre").withColumn("own", F.col("comp") == F.col("main")).groupBy("centre", "main", "own").agg(blocks().alias("blocks"))
    sizes = sizes.groupBy("centre", "main").agg(F.max(F.when(F.col("own"), F.col("blocks"))).alias("main_blocks"), F.max(F.when(~F.col("own"), F.col("blocks"))).alias("blocks")).where("blocks is not null")
    met = held.join(sizes, "centre").withColumn("outside", F.col("comp") != F.col("main"))
    met = met.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("outside"), F.col("blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("blocks") + F.col("main_blocks")).otherwise(F.col("blocks")) - 1)))
    inside = F.col("outside") & (F.col("other") < F.col("blocks"))
    i = F.when(inside, F.least("own", "other")).when(F.col("outside"), F.col("own")).otherwise(F.col("other"))
    j = F.when(inside, F.greatest("own", "other")).when(F.col("outside"), F.col("other")).otherwise(F.col("blocks") + F.col("own"))
    side = F.when(inside, (F.col("own") > F.col("other")).cast("int")).otherwise((~F.col("outside")).cast("int"))
    return met.select("centre", i.alias("i"), j.alias("j"), side.alias("side"), "doc_id", "comp", "n", *columns).repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "doc_id")


def _sides(i, j, side) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(side == 0)
    return left, left if i == j else np.flatnonzero(side == 1)


def _met(left, right, n, percent: int, rows: int = 256):
    """Blocks of two sides by sizes: only sizes within the threshold meet."""
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    for at in range(0, len(left), rows):
        some = left[at : at + rows]
        low, high = np.searchsorted(n[right] * 100, n[some[0]] * percent, "left"), np.searchsorted(n[right] * percent, n[some[-1]] * 100, "right")
        for to in range(int(low), int(high), rows):
            yield some, right[to : min(to + rows, int(high))]


def _unpacked(maps, rows, size: int) -> np.ndarray:
    """Bitmaps of equal size as rows of 0 and 1, folded to `size` cells."""
    bits = np.unpackbits(np.frombuffer(b"".join([maps[k] for k in rows]), np.uint8)).reshape(len(rows), -1, size)
    return (bits.sum(axis=1) & 1).astype(np.float32)


def _bitmap_pass(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: links to the smallest document of what may be linked in a tile, between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, ids, comp, n, maps) in groups(batches, 3):
            left, right = _sides(i, j, side)
            cells = np.array([8 * len(m) for m in maps])
            a, b = [], []
            for c in np.unique(cells[left]):
                for d in np.unique(cells[right]):
                    if max(c, d) > 2 * min(c, d):  # sizes beyond the threshold
                        continue
                    size = int(min(c, d))
                    for x, y in _met(left[cells[left] == c], right[cells[right] == d], n, percent, max(1, min(256, (1 << 21) // size))):
                        p, q = _unpacked(maps, x, size), _unpacked(maps, y, size)
                        differ = p.sum(axis=1)[:, None] + q.sum(axis=1)[None, :] - 2 * (p @ q.T)
                        total = n[x][:, None] + n[y][None, :]
                        most = np.minimum(np.floor((total - differ) / 2), np.minimum(n[x][:, None], n[y][None, :]))
                        p, q = np.nonzero(((100 + percent) * most >= percent * total) & (comp[x][:, None] != comp[y][None, :]))
                        a.append(x[p])
                        b.append(y[q])
            if sum(map(len, a)):
                yield _links(*_linked(np.concatenate(a), np.concatenate(b), ids))

    return tiles.mapInArrow(tidy(run), LINK)


def _exact_pass(tiles: DataFrame, percent: int) -> DataFrame:
    """a, b: links to the smallest document of what is connected in a tile, between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, ids, comp, n, sets) in groups(batches, 3):
            _, place, often = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
            shared = often > 1
            column = np.cumsum(shared) - 1
            owner = np.repeat(np.arange(len(sets)), n)
            keep = shared[place]
            owner, place = owner[keep], column[place[keep]]
            starts = np.searchsorted(owner, np.arange(len(sets) + 1))
            a, b = [], []
            for x, y in _met(*_sides(i, j, side), n, percent):
                apart = comp[x][:, None] != comp[y][None, :]
                if not apart.any():
                    continue
                overlap = np.zeros((len(x), len(y)), np.float32)
                for low in range(0, int(shared.sum()), 4096):  # columns in strips, so memory is bounded
                    left, right = (_strip(z, starts, place, low) for z in (x, y))
                    overlap += left @ right.T
                near = apart & ((100 + percent) * overlap.astype(np.int64) >= percent * (n[x][:, None] + n[y][None, :]))
                p, q = np.nonzero(near)
                a.append(x[p])
                b.append(y[q])
            if sum(map(len, a)):
                yield _links(*_linked(np.concatenate(a), np.concatenate(b), ids))

    return tiles.mapInArrow(tidy(run), LINK)


def _strip(rows, starts, place, low: int, width: int = 4096) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for k, r in enumerate(rows):
        own = place[starts[r] : starts[r + 1]] - low
        out[k, own[(own >= 0) & (own < width)]] = 1
    return out


def _whole_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, n and tokens of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "tokens"])

    return written(matching(documents, ids.distinct(), "left_semi").mapInArrow(tidy(run), "doc_id long, n long, tokens binary").dropDuplicates(["doc_id"]), "tokens")


def _may_meet(met: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The members whose bitmaps, and their centres', allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [_may_link(*row, percent) for row in zip(*[c.to_pylist() for c in batch.columns[2:]])]
            yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    both = met.join(maps, "doc_id").join(maps.select(F.col("doc_id").alias("centre"), F.col("n").alias("m"), F.col("map").alias("other")), "centre")
    return both.select("centre", "doc_id", "n", "map", "m", "other").mapInArrow(tidy(run), MEMBER)


def links(documents: DataFrame, maps: DataFrame, met: DataFrame, width: int, percent: int, block: int = 512, most: int = 1 << 18) -> DataFrame:
    """node and component of the documents with a link. maps: doc_id, n and map of one document for each set; met: members of centres."""
    near = written(_may_meet(met, maps, percent), "near")
    sets = _whole_sets(documents, near.select("doc_id").unionByName(near.select(F.col("centre").alias("doc_id"))), width)
    first = written(components(_star(near, sets, percent, most)), "first")
    freed(near, sets)
    known = first.select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    with_comp = lambda held: held.join(known, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    # a centre has been compared with all of its documents, so they meet without it
    held = with_comp(met).join(maps, "doc_id")
    rest = components(_bitmap_pass(_tiles(held, block, 8 * most, "map"), percent)).select(F.col("component").alias("centre"), F.col("node").alias("doc_id"))
    rest = written(rest, "rest")
    sets = _whole_sets(documents, rest.select("doc_id"), width)
    more = _exact_pass(_tiles(with_comp(rest).join(sets, "doc_id"), block, most, "tokens"), percent)
    found = components(more.unionByName(first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    freed(first, rest, sets)
    return found


def classes(documents: DataFrame, width: int = 4, percent: int = 85, above: int = 64, block: int = 512) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that can be reached by links) for every row.

    percent is the least similarity in hundredths, `above` the count from which a token is frequent.
    """
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = written(described(whole, width), "sets")
    bits = frequent(parts, above)
    keyed = parts.where("block is null").select("doc_id", "n", "key")
    heads = written(keyed.where("n > 0 and doc_id is not null").groupBy("n", "key").agg(F.min("doc_id").alias("doc_id")), "heads")
    others = keyed.where("n > 0 and doc_id is not null").select("doc_id").distinct().join(heads.select("doc_id"), "doc_id", "left_anti")
    post = written(postings(matching(whole.where("doc_id is not null"), others, "left_anti"), width, percent, bits), "postings")
    met = written(members(post), "members")
    freed(post)
    ids = met.select("doc_id").unionByName(met.select(F.col("centre").alias("doc_id"))).distinct()
    maps = written(parts.where("block is null").select("doc_id", "n", "map").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "maps")
    found = links(whole.where("doc_id is not null"), maps, met, width, percent, block)
    freed(met, maps)
    least = heads.join(found, F.col("doc_id") == F.col("node"), "left").select("n", "key", F.coalesce("component", "doc_id").alias("component_id"))
    told = keyed.join(least, ["n", "key"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return told.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of the smallest id in each class of near duplicates; rows without tokens or id stay."""
    found = classes(documents, width, percent)
    return matching(documents, found.where("doc_id <> component_id").select("doc_id").distinct(), "left_anti")


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by plain joins.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.o >= 85 * (na.n + nb.n - p.o)),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
