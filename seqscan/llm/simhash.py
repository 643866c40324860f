"""SimHash near-duplicates: 64-bit fingerprints, found within a Hamming radius by BK-trees.

A fingerprint pair that differs in at most three bits agrees in one of four 16-bit blocks, and the remaining 48 bits
agree in one of four 12-bit blocks; so each distinct fingerprint goes to the 16 shards named by such a pair of blocks.
Every shard is a BK-tree. A shard of more than SHARD fingerprints is divided by the 36 bits that it leaves open: of a
pair's, one of four 9-bit blocks agrees, so each fingerprint goes to four parts. Parts that are too large still are cut
into slices; each slice's tree is sent to the part's other slices by shuffling, so that no task holds an unbounded one.
What leaves a shard are links to the local component's first fingerprint, as many as it has fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .components import components

RADIUS = 3
#: Fingerprints in a slice of a shard.
SHARD = 4096
#: Hot shards known by name to all tasks at most; beyond that they are joined by shuffling.
HOT_BROADCAST = 50_000


def fingerprint(text: bytes | None) -> int:
    """SimHash of the text's 3-word shingles, repeats included; A-Z count as a-z. No word: 0."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z only, and exactly the six white-space characters
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-3] + 1)).tolist()
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in pieces
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> (doc_id, fp long). Null or wordless texts have fingerprint 0."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def shard_keys(fp: Column) -> Column:
    """The 16 shards of a fingerprint: key, a number of 32 bits (which blocks, and what they hold), and rest, the other 36 bits."""
    bits = lambda c, low, n: F.shiftrightunsigned(c, low).bitwiseAND((1 << n) - 1)
    keys = []
    for i in range(4):
        rest = [(j, bits(fp, 16 * j, 16)) for j in range(4) if j != i]
        wide = sum((F.shiftleft(b, 16 * k) for k, (_, b) in enumerate(rest)), F.lit(0).cast("long"))
        for j in range(4):
            key = F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(bits(fp, 16 * i, 16), 12) + bits(wide, 12 * j, 12)
            rest = F.shiftleft(F.shiftrightunsigned(wide, 12 * (j + 1)), 12 * j) + bits(wide, 0, 12 * j)
            keys.append(F.struct(key.alias("key"), rest.alias("rest")))
    return F.array(*keys)


def part_keys(key: Column, rest: Column) -> Column:
    """The four parts of a hot shard for a fingerprint whose other bits are `rest`; no part has a whole shard's number."""
    return F.array(*[F.shiftleft(key, 12) + (1 << 11) + (m << 9) + F.shiftrightunsigned(rest, 9 * m).bitwiseAND(511) for m in range(4)])


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (each the least member) after a[i] and b[i] are joined."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def linked_in_shards(shard: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, radius: int = RADIUS, chunk: int = 1024) -> np.ndarray:
    """For each row the first row of its local component. Rows are sorted by shard; a shard's fingerprints differ.

    One BK-tree per shard, built and searched level by level for all shards at once. A child hangs under its parent at
    their integer Hamming distance; a search at distance d from a node follows the edges d - radius to d + radius only.
    """
    label = np.arange(len(fp))
    points = np.flatnonzero(in_tree)
    if not len(points):
        return label
    _, first = np.unique(shard[points], return_index=True)
    root_of = np.full(int(shard.max()) + 1, -1)
    root_of[shard[points[first]]] = points[first]
    rest = np.delete(points, first)
    parent = root_of[shard[rest]]
    edges, nodes = [], []
    while len(rest):
        key = parent * 128 + np.bitwise_count(fp[rest] ^ fp[parent]).astype(np.int64)
        slots, first, slot = np.unique(key, return_index=True, return_inverse=True)
        edges.append(slots)
        nodes.append(rest[first])
        parent = rest[first][slot]
        left = np.ones(len(rest), bool)
        left[first] = False
        rest, parent = rest[left], parent[left]
    edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
    node = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
    order = np.argsort(edge)
    edge, node = edge[order], node[order]
    for at in range(0, len(fp), chunk):
        query = np.arange(at, min(at + chunk, len(fp)))
        here = root_of[shard[query]]
        query, here = query[here >= 0], here[here >= 0]
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[here]).astype(np.int64)
            hits.append((query[d <= radius], here[d <= radius]))
            low = np.searchsorted(edge, here * 128 + np.maximum(d - radius, 0))
            n = np.searchsorted(edge, here * 128 + d + radius, "right") - low
            query = np.repeat(query, n)
            here = node[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        for a, b in hits:
            label = merged(label, a, b)
    return label


def shard_links(keyed: DataFrame) -> DataFrame:
    """`keyed` (key, a, b, fp, in_tree) -> (u, v): each linked fingerprint and the first of its component in the shard."""
    import pyarrow as pa

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        columns = [rows.column(c).to_numpy() for c in ("key", "a", "b")]
        new = np.concatenate(([False], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))
        shard = np.cumsum(new)
        more = np.bincount(shard)[shard] > 1  # alone in its shard: no link
        fp = rows.column("fp").to_numpy()[more]
        if len(fp):
            _, dense = np.unique(shard[more], return_inverse=True)
            label = linked_in_shards(dense, fp.view(np.uint64), rows.column("in_tree").to_numpy(zero_copy_only=False)[more])
            linked = label != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("key", "a", "b")]
            same = np.logical_and.reduce([c == c[-1] for c in key])
            last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last shard begins
            if last:
                yield from emit([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "a", "b")):
                yield from emit(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from emit(held)

    dealt = keyed.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def hot_keys(keyed: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """The keys of more than `shard` fingerprints, into how many slices each would be cut, and the number of these keys."""
    hot = cut(keyed.groupBy("key").count().where(F.col("count") > shard).select("key", F.ceil(F.col("count") / shard).cast("int").alias("cuts")))
    n_hot = hot.count()
    return (F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot), n_hot


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """`docs` (doc_id, text, ...) -> one row per row: doc_id, fp, component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in three bits or fewer, itself included.
    Rows without doc_id get their component's smallest doc_id, null if nobody there has one. Equal fingerprints are one
    node, so a group of copies costs one row however large it is; repeated rows come back as often as they went in.
    Whole texts are read, very long ones in pieces of 65,536 hashes; null and wordless ones have fingerprint 0 and link
    like any other. An empty table gives an empty result; other columns are not looked at, whatever their names.
    """
    return grouped(docs, shard).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """`near_duplicates` with the fingerprint that names the component, as two components may have one smallest doc_id."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    keyed = nodes.select("fp", F.inline(shard_keys(F.col("fp"))))
    hot, n_hot = hot_keys(keyed, shard)
    if n_hot:
        divided = keyed.join(hot, "key", "left")
        keyed = divided.select("fp", F.explode(F.when(F.col("cuts").isNull(), F.array(F.shiftleft("key", 12))).otherwise(part_keys(F.col("key"), F.col("rest")))).alias("key"))
        hot, n_hot = hot_keys(keyed, shard)
    if n_hot:
        cuts = keyed.join(hot, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        met = cuts.select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        keyed = met.select("key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp", (F.col("mine") <= F.col("other")).alias("in_tree"))
    else:
        keyed = keyed.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp", F.lit(True).alias("in_tree"))
    roots = components(shard_links(keyed)).withColumnRenamed("node", "fp")
    found = nodes.join(roots, "fp")
    least = found.groupBy("root").agg(F.min("rep").alias("least"))
    classes = nodes.join(found.join(least, "root").select("fp", "root", "least"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    # Cut off, so that both sides are shuffled for this join alone and Spark may split the partition of a hot fingerprint.
    return rows.join(cut(classes), "fp").select("doc_id", "fp", "component_id", "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates, the one of least doc_id; columns stay as they are.

    A doc_id that stands on several rows keeps one row for each group whose least it is; where nobody in a group has a
    doc_id, one row of each distinct fingerprint stays.
    """
    marked = cut(grouped(docs))
    gone = marked.where("doc_id != component_id").select("doc_id").distinct()
    n_gone = gone.count()
    plain = marked.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if plain:
        return docs.join(F.broadcast(gone) if n_gone <= 500_000 else gone, "doc_id", "left_anti").select(docs.columns)
    # Rare: ids that repeat or are missing. The row is what counts then.
    packed = cut(fingerprint_rows(docs))
    ids = marked.where("doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    named = packed.join(ids, ["__id", "__fp"]).dropDuplicates(["__root"])
    orphans = packed.where("__id is null").join(marked.where("component_id is null").select(F.col("fp").alias("__fp")).distinct(), "__fp", "left_semi").dropDuplicates(["__fp"])
    return named.select("__row.*").unionByName(orphans.select("__row.*"))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Whole rows with their doc_id and fingerprint."""
    fp = F.udf(lambda t: int(np.array([fingerprint(bytes(t) if t is not None else None)], np.uint64).view(np.int64)[0]), "long")
    return docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), fp(F.col("text").cast("binary")).alias("__fp"))


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
