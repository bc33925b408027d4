"""Near-duplicates by b-bit MinHash: banded candidates, packed signatures, exact confirmation, connected components.

1. One pass over the texts gives each row a number, its shingle count, a digest of its shingle set, band keys and a signature
   that keeps the low b bits of every minimum, packed.
2. Rows of equal sets are one node from here on; that aggregation combines before the shuffle.
3. Nodes that share a band are candidates. A bucket's pairs are compared by the packed signatures, by XOR and bit count, and
   the similarity is corrected for chance agreement of b bits. The components of the pairs above `limit - margin` are the
   clusters within which links can lie.
4. Within each cluster links are confirmed on full shingle sets, made again from the texts of its members only, where they lie: no text
   is shuffled.
5. Components of the confirmed links give every row its class, named by the smallest id in it.

Groups (buckets in 3, clusters in 4) of any size: one that weighs more than `block` is dealt by hash into blocks of about that
weight, in which `anchors` members of the group stand every time. A block yields a forest, pairs already joined being
skipped, and what joins an anchor in one block joins all that joins it in the others: a group of copies is done in one pass
over its members. What the anchors leave apart is compared in a second pass: members outside the group's largest component
with those inside and with each other, block by block. So no pair that could be a link between different components is left out, and a
group of n members with m outside its largest component costs n + n*m comparisons, not n*n. A member's weight in 4 grows
with its shingles, so a block is bounded in bytes, but for a single text longer than that.

Missed links: with the standard settings a pair at the limit shares no band with probability 3e-6, less above it; the estimate
stays within the margin at 4.5 standard deviations.

Defined cases: a text that is null or has no word has no shingle, is linked with nothing and is kept; a text with fewer words
than a shingle is one shingle as a whole; repeated rows share their class; rows of the same id with different texts are told
apart; a row whose id is null is linked like others, but names its class only (by null) if no other row there has an id;
texts may have any length; other columns are ignored or kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, contraction
from .shared import beside, numbered, removed, scratch, slices, stored, words_of


class Settings(NamedTuple):
    shingle: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 32
    bits: int = 4
    margin: float = 0.15
    block: int = 256
    anchors: int = 4
    unit: int = 2048  # shingles that weigh as one member
    seed: int = 77

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


def multipliers(settings: Settings) -> np.ndarray:
    return np.random.RandomState(settings.seed).randint(0, 2**63, settings.hashes, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, hash of every word with A-Z lower-cased) of a batch of texts."""
    import xxhash

    rows, codes, words = words_of(texts)
    table = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in words.cast(pa.binary()).to_pylist()], np.uint64)
    return rows, table[codes] if len(codes) else np.array([], np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def digest_of(found: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.uint64(2**64 - 1), np.uint64)
    for a in range(0, len(found), 4096):
        np.minimum(out, (found[a : a + 4096, None] * factors[None, :]).min(axis=0), out=out)
    return out


def packed(least: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of mixed minima, packed in 64-bit words; slots never straddle words."""
    per = 64 // bits
    low = mixed(least) & np.uint64((1 << bits) - 1)
    low = np.concatenate([low, np.zeros(-len(low) % per, np.uint64)]).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1)


def similarity(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Estimates from packed signatures along the last axis, corrected for slots that agree by chance."""
    x, bits = a ^ b, settings.bits
    folded, shift = x, 1
    while shift < bits:
        folded = folded | (folded >> np.uint64(shift))
        shift *= 2
    ones = np.uint64(sum(1 << (k * bits) for k in range(64 // bits)))
    differ = np.bitwise_count(folded & ones).sum(axis=-1, dtype=np.int64)
    agree, chance = 1 - differ / settings.hashes, 0.5**bits
    return (agree - chance) / (1 - chance)


def band_keys(least: np.ndarray, settings: Settings) -> np.ndarray:
    grid = least.reshape(settings.bands, settings.rows)
    out = np.arange(settings.bands, dtype=np.uint64)
    for k in range(settings.rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return out.astype(np.int64)


def signed(docs: DataFrame, settings: Settings, text_col: str) -> DataFrame:
    """row (docs' columns), n_shingles, digest (null without shingles), signature, bands of every row."""
    if settings.bits not in (1, 2, 4, 8):
        raise ValueError("bits must be 1, 2, 4 or 8")
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).field(text_col)], names=["row", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(settings)
        for part in slices(paired(batches), 1):
            rows, hashes = word_hashes(part.column(1))
            counts, digests, signatures, bands = [], [], [], []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                found = shingles(hashes[a:b], settings.shingle)
                counts.append(len(found))
                digests.append(digest_of(found))
                if len(found):
                    least = minima(found, factors)
                    signatures.append(packed(least, settings.bits).tobytes())
                    bands.append(band_keys(least, settings))
                else:
                    signatures.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "n_shingles", "digest", "signature", "bands"])

    return docs.mapInArrow(run, f"row {dict(docs.dtypes)['row']}, n_shingles long, digest binary, signature binary, bands array<long>")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted record batches as tables of whole groups, with the offsets of the groups and their end; the first `keys` columns name them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        at = boundaries(table, keys)
        last = int(at[-1])
        if last:
            yield table.slice(0, last).combine_chunks(), at
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def boundaries(table: pa.Table, keys: int) -> np.ndarray:
    """Starts of the groups; the last one's start ends the list."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def tile_forest(sides: np.ndarray, labels: np.ndarray, diagonal: bool, matches: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A forest, by position, of the pairs that match: all pairs of a diagonal tile, else those of the two sides.

    Members with one label, or joined by a pair found before, aren't compared.
    """
    n = len(sides)
    apart = np.unique(labels, return_inverse=True)[1]
    left = np.arange(n) if diagonal else np.flatnonzero(sides == 0)
    right = np.arange(n) if diagonal else np.flatnonzero(sides == 1)
    a: list[int] = []
    b: list[int] = []
    for i in left:
        js = right[right > i] if diagonal else right
        js = js[apart[js] != apart[i]]
        if not len(js):
            continue
        for j in js[matches(int(i), js)]:
            if apart[j] != apart[i]:
                apart[apart == apart[j]] = apart[i]
                a.append(int(i))
                b.append(int(j))
    return a, b


#: Column order of a tile's rows: the first three name the tile.
TILE = ("key", "x", "y", "side", "node", "label", "payload")


def tiled_edges(tiles: DataFrame, kernel: Callable[[pa.Table, np.ndarray], tuple[list[int], list[int]]]) -> DataFrame:
    """Edges (a, b) between nodes: what kernel finds in tables of whole tiles, a task's edges contracted by the worker that finds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(slices(batches, len(TILE) - 1), 3):
            a, b = kernel(table, at)
            if len(a):
                nodes = table.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(c, pa.int64())) for c in (a, b)], names=["a", "b"])

    return tiles.select(*TILE).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(lambda batches: contraction(run(batches)), "a long, b long")


def estimated(settings: Settings):
    """Kernel over signatures: pairs whose estimates reach the limit less the margin."""
    least, words = settings.percent / 100 - settings.margin, -(-settings.hashes * settings.bits // 64)

    def kernel(table: pa.Table, at: np.ndarray) -> tuple[list[int], list[int]]:
        signatures = np.frombuffer(b"".join(table.column("payload").to_pylist()), "<u8").reshape(-1, words)
        x, y, sides, labels = (table.column(c).to_numpy() for c in ("x", "y", "side", "label"))
        starts, ends = at[:-1], at[1:]
        two = (ends - starts == 2) & (x[starts] == y[starts])
        first = starts[two]
        ok = first[similarity(signatures[first], signatures[first + 1], settings) >= least]
        a, b = ok.tolist(), (ok + 1).tolist()
        for s, e in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
            own = signatures[s:e]
            left, right = tile_forest(sides[s:e], labels[s:e], bool(x[s] == y[s]), lambda i, js: similarity(own[i][None, :], own[js], settings) >= least)  # noqa: B023
            a += [k + s for k in left]
            b += [k + s for k in right]
        return a, b

    return kernel


def alike(sets: list[np.ndarray], percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of the sets js are similar enough to set i, on full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(codes.max()) + 1, bool)

    def matches(i: int, js: np.ndarray) -> np.ndarray:
        out = 100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])
        near = js[out]
        if len(near):
            mine = codes[offsets[i] : offsets[i + 1]]
            marked[mine] = True
            spans = np.concatenate([[0], np.cumsum(sizes[near])])
            place = np.arange(spans[-1]) + np.repeat(offsets[near] - spans[:-1], sizes[near])
            both = np.add.reduceat(marked[codes[place]].astype(np.int64), spans[:-1])
            marked[mine] = False
            out[out] = 100 * both >= percent * (sizes[i] + sizes[near] - both)
        return out

    return matches


def confirmed(settings: Settings):
    """Kernel over shingle sets: true links."""

    def kernel(table: pa.Table, at: np.ndarray) -> tuple[list[int], list[int]]:
        x, y, sides, labels = (table.column(c).to_numpy() for c in ("x", "y", "side", "label"))
        found = table.column("payload").to_pylist()
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if e - s > 1:
                left, right = tile_forest(sides[s:e], labels[s:e], bool(x[s] == y[s]), alike([np.frombuffer(f, "<u8") for f in found[s:e]], settings.percent))
                a += [k + s for k in left]
                b += [k + s for k in right]
        return a, b

    return kernel


def block_of(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), node), blocks).cast("int")


def blocks_for(size: Column, block: int) -> Column:
    return F.ceil(size / block).cast("int")


def tile(x: Column, y: Column, side: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))


def joined(members: DataFrame, sizes: DataFrame, payloads: Callable[[DataFrame], DataFrame], kernel, settings: Settings, folder: str) -> DataFrame:
    """(a, b): every node that kernel joins to others of its groups but the least of its component, and that least.

    members: (key, node, weight), each in any number of groups; sizes: (key, size), a stored table of the groups' weights;
    payloads adds the column that kernel compares, by node.
    """
    sizes = sizes.select(F.col("key").alias("of_key"), "size")
    hot = sizes.where(F.col("size") > settings.block)
    any_hot = not hot.isEmpty()
    sized = members.join(sizes, F.col("key") == F.col("of_key")).drop("of_key")
    own = F.array(block_of(F.col("node"), blocks_for(F.col("size"), settings.block)))
    if any_hot:
        crowd = stored(members.join(hot, F.col("key") == F.col("of_key")).drop("of_key"), f"{folder}/crowd")
        cell = F.struct(F.xxhash64(F.lit(4), "key", "node").alias("h"), "node")
        cells = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(settings.anchors))
        anchors = crowd.groupBy(F.col("key").alias("of_key")).agg(*(F.min(F.when(cells == c, cell)).alias(f"c{c}") for c in range(settings.anchors)))
        anchors = stored(anchors.select("of_key", F.array(*(F.col(f"c{c}.node") for c in range(settings.anchors))).alias("anchors")), f"{folder}/anchors")
        sized = sized.join(anchors, F.col("key") == F.col("of_key"), "left").drop("of_key")
        everywhere = F.sequence(F.lit(0), blocks_for(F.col("size"), settings.block) - 1)
        own = F.when(F.array_contains("anchors", F.col("node")), everywhere).otherwise(own)
    tiles = payloads(sized.withColumn("tiles", F.transform(own, lambda k: tile(k, k, F.lit(0)))).select("key", "node", "tiles", F.col("node").alias("label")))
    exploded = lambda rows: rows.select("key", "node", "label", "payload", F.explode("tiles").alias("t")).select("key", "t.x", "t.y", "t.side", "node", "label", "payload")
    edges = tiled_edges(exploded(tiles), kernel)
    if not any_hot:
        return components(edges, f"{folder}/whole", forests=True)

    first = components(edges, f"{folder}/first", forests=True)
    roots = first.select(F.col("a").alias("of_node"), F.col("b").alias("root"))
    marked = crowd.join(roots, F.col("node") == F.col("of_node"), "left").select("key", "node", "weight", F.coalesce("root", "node").alias("label"))
    marked = stored(marked, f"{folder}/marked")
    shares = marked.groupBy("key", "label").agg(F.sum("weight").alias("n"))
    still = shares.groupBy(F.col("key").alias("of_key")).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    xs, ys = blocks_for(F.col("most.n"), settings.block), blocks_for(F.col("size") - F.col("most.n"), settings.block)
    still = stored(still.select("of_key", F.col("most.label").alias("major"), xs.alias("xs"), ys.alias("ys")), f"{folder}/still")
    if still.isEmpty():  # every group is one component
        removed(members.sparkSession, *(f"{folder}/{x}" for x in ("crowd", "anchors", "marked", "still")))
        return first

    left = marked.join(still, F.col("key") == F.col("of_key"))
    mine_x, mine_y = block_of(F.col("node"), F.col("xs")), block_of(F.col("node"), F.col("ys"))
    # Tiles of the largest component with the others bear x >= 0 and y < 0; tiles among the others x <= y, both from 0.
    of_major = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda k: tile(mine_x, -1 - k, F.lit(0)))
    with_major = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda k: tile(k, -1 - mine_y, F.lit(1)))
    with_others = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda k: tile(F.least(k, mine_y), F.greatest(k, mine_y), (mine_y > k).cast("int")))
    left = left.withColumn("tiles", F.when(F.col("label") == F.col("major"), of_major).otherwise(F.concat(with_major, with_others)))
    more = tiled_edges(exploded(payloads(left.select("key", "node", "tiles", "label"))), kernel)
    more = stored(more, f"{folder}/more")
    out = first if more.isEmpty() else components(first.unionByName(more), f"{folder}/whole", forests=True)
    removed(members.sparkSession, *(f"{folder}/{x}" for x in ("crowd", "anchors", "marked", "still", "more") + (() if out is first else ("first",))))
    return out


SET_COLUMNS = ("key", "node", "tiles", "label")


def shingle_sets(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches with key, node, tiles, label and body to the same with a payload, the text's shingle set, instead of the body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), batch.schema.get_field_index("body"), 2 << 20):
                at, hashes = word_hashes(part.column("body"))
                found = [shingles(hashes[a:b], settings.shingle).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in SET_COLUMNS), pa.array(found, pa.binary())], names=[*SET_COLUMNS, "payload"])

    return run


def resolved(docs: DataFrame, settings: Settings, id_col: str, text_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """A stored table (row, number, ...) whose rows have docs' columns, and (number, id, n_shingles, component_id, first) of every row.

    component_id is the smallest id of the row's class; first is true for exactly one row of each class, one with that id.
    """
    rows = numbered(signed(docs, settings, text_col), f"{folder}/signed")
    own_id = F.struct(F.col("row")[id_col].isNull().alias("without"), F.col("row")[id_col].alias("id"), F.col("number"))
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(own_id).alias("least"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    nodes = stored(nodes.select("digest", "least", "n_shingles", "signature", "bands", F.col("least.number").alias("node")), f"{folder}/nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"), F.lit(1).cast("long").alias("weight"))
    buckets = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"{folder}/buckets")
    signatures = nodes.select(F.col("node").alias("of"), F.col("signature").alias("payload"))
    clusters = joined(banded, buckets, lambda m: m.join(signatures, F.col("node") == F.col("of")).drop("of"), estimated(settings), settings, f"{folder}/clusters")

    members = clusters.select(F.col("a").alias("node"), F.col("b").alias("key")).unionByName(clusters.select(F.col("b").alias("node"), F.col("b").alias("key")).distinct())
    weights = nodes.select(F.col("node").alias("of"), (1 + F.floor(F.col("n_shingles") / settings.unit)).alias("weight"))
    members = stored(members.join(weights, F.col("node") == F.col("of")).select("key", "node", "weight"), f"{folder}/members")
    sizes = stored(members.groupBy("key").agg(F.sum("weight").alias("size")), f"{folder}/sizes")
    texts = rows.select("number", F.col("row")[text_col].alias("body"))
    turns = iter(range(9))  # a folder for each time that texts are marked

    def sets(m: DataFrame) -> DataFrame:
        marks = m.select(*SET_COLUMNS).withColumn("number", F.col("node"))
        return beside(texts, marks, f"{folder}/marked-{next(turns)}", shingle_sets(settings), f"key long, node long, tiles {dict(m.dtypes)['tiles']}, label long, payload binary")

    links = joined(members, sizes, sets, confirmed(settings), settings, f"{folder}/links")

    rooted = nodes.select("digest", "least", "node").join(links, F.col("node") == F.col("a"), "left").select("digest", "least", F.coalesce("b", "node").alias("root"))
    rooted = stored(rooted, f"{folder}/rooted")
    named = stored(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("name")), f"{folder}/named")
    found = rooted.join(named, F.col("root") == F.col("of")).select(F.col("digest").alias("of"), "name")
    out = rows.select(F.col("row")[id_col].alias("id"), "number", "n_shingles", "digest").join(found, F.col("digest") == F.col("of"), "left")
    alone = F.col("digest").isNull()
    return rows, out.select("number", "id", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("name.id")).alias("component_id"), (alone | (F.col("number") == F.col("name.number"))).alias("first"))


def classes(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, first of every row; component_id is the smallest id of its class."""
    folder = scratch(spark, "minhash")
    _, found = resolved(docs.select(id_col, text_col), settings, id_col, text_col, f"{folder}/work")
    out = stored(found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "first"), f"{folder}/out")
    removed(spark, f"{folder}/work")
    return out


def unique(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class with all its columns: one of the smallest id, whole as it was given."""
    folder = scratch(spark, "minhash")
    rows, found = resolved(docs, settings, id_col, text_col, f"{folder}/work")
    kept = found.where("first").select("number")
    out = stored(beside(rows.select("row", "number"), kept, f"{folder}/work/kept").select("row.*"), f"{folder}/out")
    removed(spark, f"{folder}/work")
    return out
