"""Near-duplicates by MinHash and a multi-index Hamming join.

Each set of shingles gets a signature of ``K`` positions of 8 bits. Two sets of
Jaccard similarity J differ in about ``(1 - J) K`` positions. The signature is
cut into ``m`` chunks with ``2 m > R``: if two signatures differ in at most
``R`` positions, some chunk differs in at most one. So every chunk is entered
once for each of its positions with that position left out, and all pairs
within ``R`` meet in an equal key, by pigeonhole. At J = 0.8 a pair differs in
25.5 of 128 positions on average with a deviation of 4.5; R = 45 misses about
one pair in 100,000 exactly at the threshold and far fewer above it.

Links are confirmed on the full sets. Equal sets are one class from the start.
In a bucket only its hub and each member's neighbour are tried; then
components whose members met in a bucket without a link are compared in blocks,
on full sets. So no group is expanded into all its pairs, and every pair that
met is either in one component or was compared itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewfold.llm.common import slices, stored, texts_of
from reviewfold.llm.components import components

K = 128
R = 45
CHUNKS = R // 2 + 1
BATCH_BYTES = 4 << 20
# Shingles of a block of sets that are compared with another block in one task.
BLOCK_ITEMS = 3_000_000
_BOUNDS = np.linspace(0, K, CHUNKS + 1).round().astype(int)


def _random(seed: int, *shape: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, shape, dtype=np.uint64)


_A, _B = _random(1, K) | np.uint64(1), _random(2, K)
_VALUE = _random(3, K, 256)


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hash of each word, kept for the words of a batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A-Z is lower-cased; words are split at U+0020 and U+0009 to U+000D. With
    fewer words than ``width`` the whole sequence is one shingle; without words
    the set is empty.
    """
    hash_of = _WordHash()
    sets = []
    for text in texts:
        words = text.lower().split()
        h = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
        if not len(h):
            sets.append(h)
            continue
        span = min(width, len(h))
        n = len(h) - span + 1
        with np.errstate(over="ignore"):
            value = np.full(n, np.uint64(span))
            for k in range(span):
                value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        sets.append(np.unique(value))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """8 bits of the smallest value of each of K permutations; sets not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), dtype=np.uint8)
    with np.errstate(over="ignore"):
        for k in range(K):
            least = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
            out[:, k] = (least >> np.uint64(16)) & np.uint64(255)
    return out


def _chunk_keys(signature: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of each signature, a column for each position, chunk by chunk."""
    with np.errstate(over="ignore"):
        for a, b in zip(_BOUNDS, _BOUNDS[1:], strict=False):
            parts = [_VALUE[p][signature[:, p]] for p in range(a, b)]
            whole = sum(parts[1:], parts[0])
            marks = (np.arange(a, b, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
            yield mix64(whole[:, None] - np.stack(parts, axis=1) + marks)


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """The K keys of each signature: for each position its chunk without it."""
    return np.hstack(list(_chunk_keys(signature)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, K)


def _sketches(base: DataFrame, width: int) -> DataFrame:
    """``(doc, n, klass, sig)``; texts without words have NULL klass and sig."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full) if full else [])
                sig = [next(rows).tobytes() if len(s) else None for s in sets]
                klass = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), n, pa.array(klass, pa.binary()), pa.array(sig, pa.binary())],
                    names=["doc", "n", "klass", "sig"],
                )

    kind = base.schema["doc"].dataType.simpleString()
    rows = base.select("doc", F.encode("body", "UTF-8").alias("body"))
    return rows.mapInArrow(sketch, f"doc {kind}, n long, klass binary, sig binary")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of ``(node, sig)``, as ``_meetings`` has them before the shuffle.

    A batch is keyed chunk by chunk: no bucket spans two chunks, and neither the
    worker nor the executor holds all K keys of a batch at once.
    """
    names = ["bucket", "node", "first", "prev"]
    for batch in batches:
        node = batch.column(0).to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        for keys in _chunk_keys(_matrix(batch.column(1))[order]) if len(node) else ():
            key = keys.view(np.int64).ravel()
            at = np.argsort(key, kind="stable")
            key, who = key[at], node[at // keys.shape[1]]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            starts = np.flatnonzero(new)
            first = who[starts][np.cumsum(new) - 1]
            prev = np.concatenate([who[:1], who[:-1]])
            columns = [pa.array(key), pa.array(who), pa.array(first, mask=new), pa.array(prev, mask=new)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _meetings(classes: DataFrame) -> DataFrame:
    """``(bucket, first, prev, node)`` for every member but the first of each bucket.

    A bucket's members of one batch meet before the shuffle, and only the first
    of them goes on, so a bucket that holds a third of all sets stays small.
    The rest is a sorted stream that holds one row at a time.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = first_node = last_node = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("bucket").to_numpy(), batch.column("node").to_numpy()
            done = batch.column("first").is_valid().to_numpy(zero_copy_only=False)
            pass_on = batch.filter(pa.array(done))
            key, node = key[~done], node[~done]
            if len(key):
                new = np.concatenate([[key[0] != last_key or last_key is None], key[1:] != key[:-1]])
                starts = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                first = np.where(group >= 0, node[starts][np.maximum(group, 0)] if len(starts) else 0, first_node or 0)
                prev = np.concatenate([[last_node if last_node is not None else node[0]], node[:-1]])
                keep = ~new
                last_key, first_node, last_node = key[-1], first[-1], node[-1]
                columns = [pa.array(x[keep]) for x in (key, node, first, prev)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "first", "prev"])
            if pass_on.num_rows:
                yield pass_on

    schema = "bucket long, node long, first long, prev long"
    keyed = classes.select("node", "sig").mapInArrow(_spread, schema)
    # Members that met in their batch need no order; they are dealt out by the node.
    where = F.when(F.col("first").isNull(), F.col("bucket")).otherwise(F.xxhash64("node"))
    dealt = keyed.repartition(where).sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(stream, schema)


def _first_tries(meetings: DataFrame) -> DataFrame:
    """Pairs tried first: every member with its neighbour and with the bucket's hub.

    The hub is the member that meets others in most buckets. The origin of a
    group of near copies shares more buckets with each of them than they do with
    one another, so links to it join the group without a try for every pair.
    """
    firsts = meetings.select("bucket", F.col("first").alias("node")).distinct()
    members = meetings.select("bucket", "node").unionAll(firsts)
    busy = members.groupBy("node").agg(F.count(F.lit(1)).alias("meets"))
    placed = members.join(busy, "node")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("top")).select("bucket", "top.node")
    with_hub = members.join(hubs.withColumnRenamed("node", "hub"), "bucket").filter("hub <> node")
    pairs = with_hub.select("hub", "node").unionAll(meetings.select("prev", "node"))
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a != b, axis=-1)


def _near_enough(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs within R positions whose sizes allow the similarity."""
    facts = classes.select("node", "n", "sig")
    left = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                close = _distance(_matrix(batch.column("sa")), _matrix(batch.column("sb"))) <= R
                yield batch.select(["a", "b"]).filter(pa.array(close))

    return sized.mapInArrow(near, "a long, b long")


def _full_sets(nodes: DataFrame, classes: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """``(node, items)``: the whole set of each of the ``nodes``, from its text."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", "klass", F.col("rep").alias("want"))
    texts = base.join(wanted, F.col("doc").eqNullSafe(F.col("want")))
    rows = texts.select("node", F.encode("body", "UTF-8").alias("body"), "klass")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, BATCH_BYTES):
                sets = shingle_sets(batch.column(1).to_pylist(), width)
                # Another text may have the same id; the class tells them apart.
                same = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k
                    for s, k in zip(sets, batch.column("klass").to_pylist(), strict=True)
                ]
                mine = [s.view(np.int64) for s, ok in zip(sets, same, strict=True) if ok]
                offsets = np.cumsum([0, *map(len, mine)]).astype(np.int32)
                values = np.concatenate(mine) if mine else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), lists], names=["node", "items"])

    return rows.mapInArrow(build, "node long, items array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, classes: DataFrame, base: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_full_sets(nodes, classes, base, width), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = pairs.join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("ia", "ib"))
    return both.filter(100 * shared >= threshold * (F.size("ia") + F.size("ib") - shared)).select("a", "b")


def _links_between(table: pa.Table, threshold: int) -> pa.Table:
    """Links that join different components of two blocks (or within one).

    For each set outside the largest component an index of the items counts its
    intersection with all others at once; a link merges two components, so there
    are fewer links than components.
    """
    items = table.column("items").combine_chunks()
    sizes = pc.list_value_length(items).to_numpy().astype(np.int64)
    node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
    code = np.unique(items.flatten().to_numpy(), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(node)), sizes)[np.argsort(code, kind="stable")]
    counts = np.bincount(code)
    starts, begins = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    roots, at, members = np.unique(table.column("root").to_numpy(), return_inverse=True, return_counts=True)
    largest = members.argmax()
    within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    found = []
    for probe in np.flatnonzero(at != largest) if len(roots) > 1 else []:
        mine = code[begins[probe] : begins[probe] + sizes[probe]]
        n = counts[mine]
        places = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[places], minlength=len(node))
        close = 100 * shared >= threshold * (sizes[probe] + sizes - shared)
        if not within:
            close &= block != block[probe]
        for other in np.flatnonzero(close & (at != at[probe])):
            if at[other] != at[probe]:
                found.append((node[probe], node[other]))
                at[at == at[probe]] = at[other]
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs.min(axis=1)), "b": pa.array(pairs.max(axis=1))})


def _across(
    meetings: DataFrame, roots: DataFrame, classes: DataFrame, base: DataFrame, width: int, threshold: int
) -> DataFrame | None:
    """Links between components whose members met in a bucket without a link.

    Such components are taken together as far as meetings connect them, and
    their full sets are compared in blocks of a bounded number of items.
    """
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    met = meetings.select("first", "node").join(of("first"), "first", "left").join(of("node"), "node", "left")
    edges = met.select(F.coalesce("first_root", "first").alias("a"), F.coalesce("node_root", "node").alias("b"))
    edges = stored(edges.filter("a <> b").distinct(), "unlinked")
    if not edges.limit(1).count():
        return None
    clusters = components(edges).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    members = classes.select("node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(members.join(clusters, "root"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    sets = _full_sets(members.select("node"), classes, base, width)
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = (
        dealt.join(sets, "node")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "root", "items")
    )
    joined = paired.groupBy("cluster", "i", "j").applyInArrow(lambda t: _links_between(t, threshold), "a long, b long")
    return joined.distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: int = 80,
) -> DataFrame:
    """One row per document with its class of near-duplicates.

    Columns: the id, ``n_shingles``, ``component_id`` (the smallest id that can
    be reached over links, its own included) and ``kept`` (id equal to that).
    Texts are linked with ``100 * intersection >= threshold * union`` of their
    sets of ``width``-word shingles. A NULL, empty or blank text has no
    shingles and is linked with nothing. Repeated rows are one class. An empty
    table gives no rows. The radius ``R`` holds for thresholds from 80 on; a
    lower one is an error.
    """
    if threshold < 80:
        raise ValueError("threshold must be 80 or more: the signatures do not reach less similar texts")
    base = texts_of(docs, id_col, text_col)
    sketches = stored(_sketches(base, width), "sketches")
    grouped = sketches.filter("n > 0").groupBy("klass").agg(
        F.min("doc").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")
    )
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    meetings = stored(_meetings(classes), "meetings")
    tried = _first_tries(meetings)
    near = stored(_near_enough(tried, classes, threshold), "near")
    links = stored(_confirmed(near, classes, base, width, threshold), "links")
    roots = components(links)
    across = _across(meetings, roots, classes, base, width, threshold)
    if across is not None:
        roots = components(links.unionAll(stored(across, "links")))
    named = classes.join(roots, "node", "left").select("klass", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(least, "root").select("klass", "component")
    found = sketches.select("doc", "n", "klass").join(of_class, "klass", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return found.select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each class of near-duplicates, all
    columns as they are.

    The document with the smallest id stays. A row is told apart by its id and a hash
    of its text, so an id (NULL too) that occurs with several texts stays with those
    that are no near copies. Rows without shingles stay, repeated rows stay together,
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumn("__key", F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text")))
    found = near_duplicates(keyed, "__key", text_col, width, threshold).filter("kept").select("__key").distinct()
    kept = found.select(F.col("__key.id").alias("__id"), F.col("__key.text").alias("__text"))
    same = keyed["__key.id"].eqNullSafe(kept["__id"]) & (keyed["__key.text"] == kept["__text"])
    return keyed.join(kept, same, "left_semi").drop("__key")
