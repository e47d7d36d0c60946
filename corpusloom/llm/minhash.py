"""Near-duplicates by circulant MinHash, banding and exact verification on full shingle sets.

1. Texts with equal shingle sets form one node, named by 128 bits of the set's hash. Each node has ``rows * bands``
   signature coordinates, all made by two permutations of which one is shifted circularly, and a code per band.
2. Nodes that share a band's code form a bucket. Buckets of equal members in several bands count once.
3. A bucket is cut into blocks of bounded weight (nodes and shingles), in every band otherwise. In each block,
   signatures leave groups of nodes that may be similar; a pair counts only in the first band that it shares, so it is
   not met again in the others. The groups' shingle sets are made from their whole texts and pairs are decided
   exactly, as matrix products. Only a spanning forest of the links leaves a task, never all pairs.
4. This is done for the first third of the bands. Of the other buckets, and of those with several blocks, only
   what is then in different components is compared: nodes outside the bucket's largest component against all
   others. A bucket of true copies is settled without this step.
5. Buckets in which that would be many blocks (many nodes of no link) are not compared by pairs. Their nodes are listed
   under the rarest shingles of their sets, as many as linked sets must share one of (the prefix filter, which is
   exact), and only those listed together are compared.
6. Components of the links give every document the smallest id that it is connected to.

A pair at the threshold is missed by banding with probability (1 - s**rows)**bands, 2e-8 for 0.85 and 4e-6 for 0.8, and
by the signature filter with at most 1e-9. Shingles are compared by 64 bits, sets by 128.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Tables, added, slices
from corpusloom.llm.components import components
from corpusloom.llm.shingles import band_codes, circulant_minhash, set_key, shingle_set

BANDS, ROWS = 24, 4
#: Bands whose buckets are compared before components are known.
FIRST_BANDS = 8
#: Weight of a bucket's nodes that are compared at once; a node weighs 1, and 1 more for each WEIGHT_SHINGLES of its set.
BLOCK, WEIGHT_SHINGLES = 1024, 4096
#: Half blocks of nodes outside a bucket's largest component up to which pairs of half blocks are compared.
FEW = 8
#: Columns of shingles in one matrix product.
COLUMNS = 16_384
#: Probability with which the signature filter may lose a pair at the threshold.
FILTER_MISS = 1e-9
#: Counters of the prefix filter's order of shingles.
COUNTERS = 1 << 16
#: Rows that repeat a null id and a text are dealt over so many tasks.
NULL_SALTS = 16


def least_agreement(share: float, k: int, miss: float = FILTER_MISS) -> int:
    """The largest number of k places such that fewer agree with probability of at most ``miss``, each agreeing with ``share``."""
    total = 0.0
    for n in range(k + 1):
        total += math.comb(k, n) * share**n * (1 - share) ** (k - n)
        if total > miss:
            return n
    return k


def signatures(docs: DataFrame, *, doc_id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sketch, bands) of each row; the last three null without a shingle."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("__text"))
    schema = added(source, ["doc_id", "text_hash"], "n_shingles long, node binary, sketch binary, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            count, node, sketch, codes = [], [], [], []
            for x in b.column("__text").to_pylist():
                s = shingle_set(x, words)
                count.append(len(s))
                if not len(s):
                    node.append(None), sketch.append(None), codes.append(None)
                    continue
                signature = circulant_minhash(s, bands * rows)
                node.append(set_key(s))
                codes.append(band_codes(signature, rows))
                sketch.append(signature.astype(np.uint8).tobytes() + codes[-1].astype(np.uint32).tobytes())
            arrays = [b.column("doc_id"), b.column("text_hash"), pa.array(count, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary()), pa.array(codes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return source.mapInArrow(run, schema)


def in_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one key after another, of batches sorted by key."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def clusters(links: np.ndarray) -> list[np.ndarray]:
    """Connected nodes, two or more, of a symmetric boolean matrix."""
    left, out = np.ones(len(links), bool), []
    for i in range(len(links)):
        if not left[i]:
            continue
        left[i] = False
        found, front = [i], links[i] & left
        while front.any():
            left &= ~front
            at = np.flatnonzero(front)
            found.extend(at.tolist())
            front = links[at].any(0) & left
        if len(found) > 1:
            out.append(np.array(found))
    return out


def plausible(rows: list[dict], least: int, bands: int) -> np.ndarray:
    """Pairs of different components whose signatures agree in at least so many places, and that share no earlier band.

    A band is shared if its code's 32 bits and its coordinates' lowest bytes are, 64 bits together.
    """
    every = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
    sketch, codes = every[:, : -4 * bands], np.ascontiguousarray(every[:, -4 * bands :]).view(np.uint32)
    at = np.unique([r["component"] for r in rows], return_inverse=True)[1]
    here = min(r["band_no"] for r in rows)
    out = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        same = sketch == sketch[i]
        earlier = (codes[:, :here] == codes[i, :here]) & same.reshape(len(rows), bands, -1)[:, :here].all(2)
        out[i] = (at != at[i]) & (same.sum(1) >= least) & ~earlier.any(1)
    return out


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections."""
    sizes = np.array([len(s) for s in sets])
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(count > 1) - 1
    keep = count[inverse] > 1
    owner, column = owner[keep], column[inverse[keep]]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
        x[owner[a:b], column[a:b] - begin] = 1
        out += x @ x.T
    np.fill_diagonal(out, sizes)
    return out


def linked(sets: list[np.ndarray], percent: float) -> np.ndarray:
    """Pairs with 100 * intersection >= percent * union."""
    shared = shared_shingles(sets)
    sizes = np.array([len(s) for s in sets])
    return 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)


def _mapped(rows: DataFrame, key: str, schema: str, groups: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """Applies groups to the rows of each key; a key's rows are a bounded block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for rows in in_groups(batches, key):
            out.extend(groups(rows))
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    kind = pa.schema([(c.split()[0], {"long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in schema.split(", ")])
    return rows.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def links_in_blocks(blocks: DataFrame, texts: DataFrame, tables: Tables, *, words: int, percent: float, bands: int, rows: int) -> DataFrame:
    """Spanning forest (a, b) of the links within blocks (block, band_no, node, component, sketch)."""
    least = least_agreement(percent / 100, bands * rows)

    def refine(rows: list[dict]) -> Iterator[dict]:
        for found in clusters(plausible(rows, least, bands)) if len(rows) > 1 else ():
            name = xxhash.xxh3_64_intdigest(b"%d " % rows[0]["block"] + rows[found[0]]["node"]) - (1 << 63)
            for i in found:
                yield {"part": name, "node": rows[i]["node"]}

    parts = tables.write(_mapped(blocks, "block", "part long, node binary", refine), "parts")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(x, words).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "codes"])

    sets = texts.join(parts.select("node").distinct(), "node", "left_semi").mapInArrow(gather, "node binary, codes binary")

    def verify(rows: list[dict]) -> Iterator[dict]:
        unique = {r["node"]: np.frombuffer(r["codes"], np.uint64) for r in rows}
        names = sorted(unique)
        for found in clusters(linked([unique[n] for n in names], percent)) if len(names) > 1 else ():
            first, *others = sorted(names[i] for i in found)
            for other in others:
                yield {"a": first, "b": other}

    return _mapped(parts.join(sets, "node"), "part", "a binary, b binary", verify)


def texts_of(members: DataFrame, nodes: DataFrame, docs: DataFrame, *, doc_id: str, text: str) -> DataFrame:
    """(node, text) of all nodes that are in a bucket: the only shuffle of texts, those in no bucket go no further.

    A node's text is that of one row, found by id and text hash, so that other rows of a null or repeated id do not meet
    it. What is left are rows equal in both; those of a null id are dealt over several tasks.
    """
    salts = F.when(F.col("first.doc_id").isNull(), F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(0)))
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("w_id"), F.col("first.text_hash").alias("w_hash"), F.explode(salts).alias("w_salt"))
    salt = F.when(F.col(doc_id).isNull(), F.pmod(F.spark_partition_id(), F.lit(NULL_SALTS))).otherwise(0)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), salt.alias("salt"), F.col(text).cast("binary").alias("text"))
    found = rows.join(wanted.hint("merge"), F.expr("doc_id <=> w_id AND text_hash = w_hash AND salt = w_salt"))  # one plan at every size
    return found.groupBy("node").agg(F.first("text").alias("text"))


def in_buckets(postings: DataFrame) -> DataFrame:
    """Of (band_no, band, node, weight) those under codes of two nodes or more, with n, the bucket's weight; equal buckets count once."""
    buckets = (
        postings.groupBy("band")
        .agg(F.count("*").alias("members"), F.sum("weight").alias("n"), F.min("band_no").alias("band_no"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("s"))
        .where("members > 1")
        .groupBy("members", "n", "x", "s")
        .agg(F.min(F.struct("band_no", "band")).alias("b"))
        .select("b.band", "n")
    )
    return postings.join(buckets, "band")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: float = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, few: int = FEW
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, root) of each row of docs.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable by links, kept says that it is the document's own. A null or empty text and one
    without words has no shingle, is linked with nothing and is kept. Rows that repeat an id stay rows of their
    own; if their texts differ each is linked by its own text. Null ids come after all others: a component of
    null ids only has a null component_id and its rows are kept. root names the component itself, which ids that
    are null or repeated do not; it is null without a shingle. Texts of any length are read whole. An empty table has
    an empty result. Columns other than id and text are not read, whatever their names.
    """
    tables = Tables(docs.sparkSession)
    seen = tables.write(signatures(docs, doc_id=doc_id, text=text, words=words, bands=bands, rows=rows), "signatures")
    nodes = tables.write(
        seen.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), (1 + F.floor(F.first("n_shingles") / WEIGHT_SHINGLES)).alias("weight"),
            F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    members = tables.write(in_buckets(nodes.select("node", "weight", F.posexplode("bands").alias("band_no", "band"))), "members")
    texts = tables.write(texts_of(members, nodes, docs, doc_id=doc_id, text=text), "texts")
    sketches = nodes.select("node", "sketch")

    def links(blocks: DataFrame) -> DataFrame:
        return tables.write(links_in_blocks(blocks.join(sketches, "node"), texts, tables, words=words, percent=percent, bands=bands, rows=rows), "links")

    cut = F.ceil(F.col("n") / block)
    first = members.where(F.col("band_no") < FIRST_BANDS)
    block_of = F.xxhash64("band", F.pmod(F.xxhash64("node", "band_no"), cut)).alias("block")
    edges = links(first.select(block_of, "band_no", "node", F.col("node").alias("component")))
    roots = components(edges, tables)
    near, far = _across(members.where((F.col("band_no") >= FIRST_BANDS) | (F.col("n") > block)), roots, block, few)
    edges = edges.unionByName(links(near))
    crowded = tables.write(far.select("node").distinct(), "crowded")
    if not crowded.isEmpty():
        listed = tables.write(in_buckets(_prefixes(texts, crowded, words=words, percent=percent).join(nodes.select("node", "weight"), "node")), "listed")
        edges = edges.unionByName(links(_across(listed, components(edges, tables), block, None)[0]))
    roots = components(edges, tables)

    named = nodes.select("node", "first_id").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = tables.write(named.join(least, "root").select("node", "component_id", "root"), "named")
    tables.drop(seen, named)
    # rows without a node have no match; however many they are, they are dealt over tasks
    dealt = seen.select("doc_id", "text_hash", "n_shingles", "node", F.when(F.col("node").isNull(), F.spark_partition_id()).otherwise(0).alias("salt"))
    own = dealt.join(named.withColumn("salt", F.lit(0)), ["node", "salt"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = own.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), "root")
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")


def _across(members: DataFrame, roots: DataFrame, block: int, few: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks that hold, for each bucket, all pairs of which one is outside the bucket's largest component; then the members of buckets too mixed for that.

    Buckets of one component are left out, others of a weight up to ``block`` are one block. In larger ones, nodes in
    and outside the largest component are cut into pieces of half a block; a block is a piece outside with another
    piece, so a node outside is in as many blocks as its bucket has pieces, one inside in as many as there are
    pieces outside. Buckets of over ``few`` pieces outside are not cut but given back. A large bucket's rows meet
    what is known of it in as many tasks as it has blocks.
    """
    half = block // 2
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = members.join(roots.withColumnRenamed("id", "node"), "node", "left").select("band", "band_no", "node", "weight", "n", F.coalesce("root", "node").alias("component"))
    sizes = rows.groupBy("band", "component").agg(F.sum("weight").alias("part"))
    split = (
        sizes.groupBy("band")
        .agg(F.max_by("component", F.struct("part", "component")).alias("main"), F.max("part").alias("n_in"), F.sum("part").alias("n"))
        .where("n > n_in")
        .select("band", "main", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.ceil(F.col("n_in") / half).cast("int").alias("cut_in"), F.ceil((F.col("n") - F.col("n_in")) / half).cast("int").alias("cut_out"))
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")).join(split, ["band", "salt"]).withColumn("outside", F.col("component") != F.col("main"))
    mixed = (F.col("n") > block) & (F.col("cut_out") > few) if few is not None else F.lit(False)
    piece = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("outside"), F.col("cut_out")).otherwise(F.col("cut_in"))).cast("int")
    cut = rows.where(~mixed).withColumn("piece", piece)
    others = F.sequence(F.lit(0), F.col("cut_out") - 1)
    with_out = F.transform(others, lambda k: F.struct(F.lit("o").alias("kind"), F.least(k, "piece").alias("i"), F.greatest(k, "piece").alias("j")))
    with_in = F.transform(F.sequence(F.lit(0), F.col("cut_in") - 1), lambda k: F.struct(F.lit("m").alias("kind"), F.col("piece").alias("i"), k.alias("j")))
    inside = F.transform(others, lambda k: F.struct(F.lit("m").alias("kind"), k.alias("i"), F.col("piece").alias("j")))
    whole = F.array(F.struct(F.lit("w").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    pairs = F.when(F.col("n") <= block, whole).when(F.col("outside"), F.concat(with_out, with_in)).otherwise(inside)
    cut = cut.select("band", "band_no", "node", "component", F.explode(pairs).alias("p"))
    return cut.select(F.xxhash64("band", "p.kind", "p.i", "p.j").alias("block"), "band_no", "node", "component"), rows.where(mixed).select("node")


def _prefixes(texts: DataFrame, wanted: DataFrame, *, words: int, percent: float) -> DataFrame:
    """(band_no 0, band, node): the first shingles of each wanted set, rarest first, of which linked sets share one at least.

    Sets of n that are linked share ceil(percent / 100 * n) shingles or more, so in any order that is the same for all
    sets, the first n - that + 1 have one in common. The order is by counters of shingles, then by hash; the counters
    are a fixed number, the only thing that is gathered.
    """
    rows = texts.join(wanted, "node", "left_semi")

    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes % np.uint64(COUNTERS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            for x in b.column("text").to_pylist():
                n += np.bincount(slot(shingle_set(x, words)), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # at most COUNTERS rows
        counts[r["slot"]] = r["n"]
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, codes = [], []
            for node, x in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingle_set(x, words)
                n = len(s) + 1 - max(1, math.ceil(percent * len(s) / 100 - 1e-9))
                codes.append(s[np.lexsort((s, shared.value[slot(s)]))][:n].view(np.int64))
                names += [node] * n
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(np.concatenate([*codes, np.zeros(0, np.int64)]))], ["node", "band"])

    return rows.mapInArrow(first, "node binary, band long").withColumn("band_no", F.lit(0))
