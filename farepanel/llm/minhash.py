"""MinHash fingerprints of documents, their likeness, and near-duplicate classes by joined signature bands."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel.llm.common import (
    NULL_ID, PRIME, id_key, ids_of, key_filter, may_hold, mix, sequence_hashes, shared_table, signed, slices, spent, word_hashes, words_of,
)
from farepanel.llm.graph import components

SHINGLE, PERMUTATIONS, BANDS = 5, 128, 32
THRESHOLD = 0.8
CHUNK = 1024
GROUP, LOAD = 256, 1 << 21  # texts and shingles of a bucket that are compared within one row
TURNS = 4  # parts of the bands that are compared one after the other
WORDLESS = 0  # node of all texts without words


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of x -> a x + b modulo 2^64, one pair per permutation."""
    steps = np.arange(1, count + 1, dtype=np.uint64)
    return mix(steps * PRIME) | np.uint64(1), mix(steps * PRIME + np.uint64(7))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, a text without words has none."""
    words = word_hashes(words_of(text))
    return sequence_hashes(words, min(size, len(words))) if len(words) else np.empty(0, np.uint64)


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of the smallest permuted hash per permutation, zero for a text without shingles."""
    if not len(hashes):
        return np.zeros(len(factors), np.uint16)
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        part = factors[:, None] * hashes[None, i : i + CHUNK] + offsets[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def signature_of(text: str | None, count: int = PERMUTATIONS) -> np.ndarray:
    return signature(shingles(text), *permutations(count))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries: an unbiased estimate of the Jaccard similarity of the shingle sets."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, node long"
NAMES = [part.split()[0] for part in ROW.split(", ")]
FIRST, LAST = 1, 2


def _row(doc: int, text: str, sig: np.ndarray, tie: int, next_text: str, next_sig: np.ndarray) -> tuple:
    other = edited(text, next_text)
    other_sig = signature_of(other)
    return (
        None if doc == NULL_ID else doc, len(text), hashlib.sha256(other.encode("utf-8")).hexdigest(), sig.tobytes(),
        other_sig.tobytes(), likeness(sig, other_sig), likeness(sig, next_sig), _node(sig, tie),
    )


def _node(sig: np.ndarray, tie: int) -> int:
    """Key of a text: its hash, or one key for all texts without words."""
    return tie if sig.any() else WORDLESS


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema)


def _schema(*more: tuple[str, pa.DataType]) -> pa.Schema:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
    return pa.schema([*zip(NAMES, kinds), *more])


def with_neighbours(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document in ascending id: its fingerprint, and those of its edited text and of the next document.

    The edited text has its last floor(n/4) code points replaced by the first as many of the next document; after
    the last comes the first, and a single document is its own next. Null counts as empty; two texts without words
    have likeness 1, since they have equal fingerprints. ``node`` is the key that equal texts share. A null id comes first; equal ids follow each other in the
    order of a hash of their texts. Other columns are ignored. An empty table gives no rows.

    Texts are dealt out once, by ranges of ids. Within a range a document's successor is the next row; only the last
    row of every range waits for the first one of the next range, and these few rows are joined afterwards.
    """
    docs = df.select(id_key(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))

    def walk(batches):
        schema = _schema(("part", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("text", pa.string()), ("tie", pa.int64()), ("head", pa.string()))
        part, before, first_text = TaskContext.get().partitionId(), None, None
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc, text, tie in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "tie"))):
                sig = signature_of(text)
                if before is None:
                    first_text = text
                else:
                    rows.append((*_row(*before, text, sig), part, 0, before[0], None, None, None))
                before = (doc, text, sig, tie)
            if rows:
                yield _batch(rows, schema)
        if before is not None:
            doc, text, sig, tie = before
            yield _batch([(doc, len(text), None, sig.tobytes(), None, None, None, _node(sig, tie), part, LAST, doc, text, tie, first_text)], schema)

    walked = shared_table(
        docs.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").mapInArrow(
            walk, f"{ROW}, part int, role int, id long, text string, tie long, head string"
        ),
        "minhash",
    )
    last = walked.where(F.col("role") == LAST)
    # one row per range, without texts
    order = Window.orderBy("part")
    links = last.select("part").select(
        "part", F.coalesce(F.lead("part").over(order), F.min("part").over(order)).alias("next_part")
    )
    heads = last.select(F.col("part").alias("next_part"), F.col("head").alias("next_text"))

    def finish(batches):
        schema = _schema()
        for batch in slices(batches, "text"):
            rows = [_row(d, t, signature_of(t), k, n, signature_of(n)) for d, t, k, n in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "tie", "next_text")))]
            if rows:
                yield _batch(rows, schema)

    ends = last.select("part", "id", "text", "tie").join(links, "part").join(heads, "next_part").select("id", "text", "tie", "next_text")
    return walked.where(F.col("role") == 0).select(*NAMES).unionByName(ends.mapInArrow(finish, ROW))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint): MinHash signature of every document, 16 bits per permutation; null counts as empty."""

    def run(batches):
        for batch in slices(batches, "text"):
            sigs = [signature_of(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs, pa.binary())], names=["doc_id", "fingerprint"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint binary"
    )


def band_keys(fingerprint: str | Column, bands: int = BANDS) -> Column:
    """One key per band of a binary fingerprint: its number and a hash of its bytes."""
    width = 2 * PERMUTATIONS // bands
    column = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.array(*[F.xxhash64(F.lit(b), F.substring(column, b * width + 1, width)) for b in range(bands)])


def _forest(sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links from the first set of every component to its others, over the pairs of non-empty sets with at least this
    Jaccard similarity."""
    lengths = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    seen, mark = np.zeros(len(sets), bool), np.zeros(len(values), bool)
    u, v = [], []
    for i in range(len(sets)):
        if seen[i]:
            continue
        front, seen[i] = [i], True
        while front and not seen.all():
            j = front.pop()
            own = place[starts[j] : starts[j] + lengths[j]]
            mark[own] = True
            common = np.add.reduceat(mark[place], starts, dtype=np.int64)
            mark[own] = False
            near = np.flatnonzero(~seen & (common / (lengths + lengths[j] - common) >= threshold)).tolist()
            seen[near] = True
            front += near
            u += [i] * len(near)
            v += near
    return u, v


def _bucket_links(buckets: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links inside rows of (members array<struct<node, shingles>>)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members").slice(i, 1).flatten()
                nodes, lists = members.field("node").to_numpy(zero_copy_only=False), members.field("shingles")
                order = np.argsort(nodes)
                nodes = nodes[order]
                u, v = _forest([lists[k].values.to_numpy(zero_copy_only=False) for k in order.tolist()], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    return buckets.select("members").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity; one row holds two sets."""
    common = F.size(F.array_intersect("a", "b"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return both.where(common / (F.size("a") + F.size("b") - common) >= threshold).select("u", "v")


def _rooted(nodes: DataFrame, contracted: DataFrame) -> DataFrame:
    """(..., root): a node's component by ``_contracted`` links; a node without a link is its own."""
    roots = contracted.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _contracted(links: DataFrame) -> DataFrame:
    """(u, v): one link from every linked node to the smallest of its component."""
    roots = components(links)
    found = roots.withColumnRenamed("root", "v")
    found.table_path = roots.table_path
    return found


def band_links(points: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, group: int = GROUP, load: int = LOAD) -> DataFrame:
    """(u, v): links that connect just the nodes that pairs sharing a band and of at least ``threshold`` connect.

    ``points`` has (node, least, fingerprint) per node, ``texts`` (id, tie, text) rows where ``least`` and ``node``
    find the text of a node. Only sets of nodes that share a band are made. A bucket of at most ``group`` nodes and ``load`` shingles is compared
    whole within one row. A larger one is first dealt into such rows by a hash and compared with its smallest node, which joins most of what is
    alike; what is still apart is then found without loss by prefixes: with the shingles of a set ordered from rare
    to frequent, two sets of similarity t share one of the first |x| - ceil(t |x|) + 1, and their sizes differ by at
    most the factor t.
    """
    banded = points.select("node", "least", F.explode(band_keys("fingerprint")).alias("band"))
    shared = shared_table(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "minhash-bands")
    members = shared_table(banded.join(shared, "band"), "minhash-members")  # one row per node and shared band
    spent(shared)
    needed = members.select(F.col("node").alias("tie"), F.col("least").alias("id")).distinct()

    def made(batches):
        for batch in slices(batches, "text"):
            found = [signed(np.unique(shingles(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tie"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    needed = shared_table(needed, "minhash-needed")
    bitmap = key_filter(needed, "tie", "id")

    def wanted(batches):
        for batch in batches:
            hit = may_hold(bitmap, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("tie", "id")))
            if hit.any():
                yield batch.filter(pa.array(hit))

    # only texts that may be needed are exchanged; repeated rows of one id and text give the same set
    few = texts.select("tie", "id", "text").mapInArrow(wanted, "tie long, id long, text string")
    sets = few.join(needed, ["tie", "id"]).select("tie", "text").mapInArrow(made, "node long, shingles array<long>")
    sets = shared_table(sets.where(F.size("shingles") > 0).dropDuplicates(["node"]), "minhash-sets")
    sized = members.join(sets.select("node", F.size("shingles").alias("size")), "node")
    spent(needed)
    loads = shared_table(sized.groupBy("band").agg(F.sum("size").alias("load"), F.first("n").alias("n"), F.first("head").alias("head")), "minhash-loads")
    large = (F.col("n") > group) | (F.col("load") > load)
    rows = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / group), F.ceil(F.col("load") * 2 / load))
    written, members = members, members.select("node", "band").join(loads, "band")
    found = None
    for turn in range(TURNS):
        # bands whose members earlier turns have already joined need no comparison
        part = members.where(F.pmod(F.xxhash64("band"), F.lit(TURNS)) == turn)
        part = _rooted(part, found) if found is not None else part.withColumn("root", F.col("node"))
        dealt = part.withColumn("row", F.when(large, F.pmod(F.xxhash64("node", F.lit(turn)), rows)).otherwise(F.lit(0)))
        lists = dealt.groupBy("band", "row").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.min("root").alias("a"), F.max("root").alias("b"))
        # bands of near copies have the same members again and again, which are compared once
        lists = lists.where("a <> b").select("nodes").distinct().select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))
        buckets = lists.join(sets, "node").groupBy("bucket").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
        links = shared_table(_bucket_links(buckets, threshold).distinct(), "minhash-links")
        # what is joined becomes one link a node, to the smallest of its component
        last, found = found, _contracted(links if found is None else found.unionByName(links))
        spent(links, last)
    over = shared_table(members.where(large).select("node", "band", "head"), "minhash-large")
    spent(written, loads)
    if over.isEmpty():
        return found
    stars = _rooted(over.select("node", "head").where("node <> head").distinct(), found).withColumnsRenamed({"node": "u", "root": "own", "head": "node"})
    stars = _rooted(stars, found).where("own <> root").select("u", F.col("node").alias("v"))
    last, found = found, _contracted(found.unionByName(_verified(stars, sets, threshold)))
    spent(last)
    apart = shared_table(_rooted(over.select("node").distinct(), found).join(sets, "node"), "minhash-apart")
    tokens = apart.select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = tokens.join(often, "token", "left").groupBy("node", "root", "size").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "token"))).alias("order")
    )
    least = F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    head = ranked.select("node", "root", "size", F.explode(F.slice("order", F.lit(1), F.col("size") - least + 1)).alias("at"))
    head = shared_table(head.where("at.often > 1").select("node", "root", "size", "at.token"), "minhash-prefixes")
    other = head.select(F.col("node").alias("v"), F.col("root").alias("other_root"), F.col("size").alias("other_size"), "token")
    close = (F.col("size") >= F.col("other_size") * threshold - 1e-9) & (F.col("other_size") >= F.col("size") * threshold - 1e-9)
    pairs = head.join(other, "token").where((F.col("node") < F.col("v")) & (F.col("root") != F.col("other_root")) & close)
    pairs = pairs.select(F.col("node").alias("u"), "v").distinct()
    bands = over.groupBy("node").agg(F.collect_set("band").alias("bands"))  # at most one per band of the fingerprint
    pairs = pairs.join(bands.select(F.col("node").alias("u"), F.col("bands").alias("x")), "u").join(bands.select(F.col("node").alias("v"), F.col("bands").alias("y")), "v")
    return found.unionByName(_verified(pairs.where(F.arrays_overlap("x", "y")).select("u", "v"), sets, threshold))


def with_class(rows: DataFrame, df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, group: int = GROUP, load: int = LOAD) -> DataFrame:
    """``rows`` of (doc_id, node, fingerprint, ...) over the texts of ``df``, with class_id as in ``near_classes``."""
    points = rows.groupBy("node").agg(F.min(id_key("doc_id")).alias("least"), F.min("doc_id").alias("doc"), F.first("fingerprint").alias("fingerprint"))
    points = shared_table(points, "minhash-nodes")
    texts = df.select(id_key(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    named = _rooted(points.select("node", "doc"), _contracted(shared_table(band_links(points, texts, threshold, group, load), "minhash-found")))
    smallest = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    return rows.join(named.select("node", "root").join(smallest, "root").drop("root"), "node")


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, group: int = GROUP, load: int = LOAD) -> DataFrame:
    """(doc_id, class_id): documents linked by shared bands and a verified Jaccard similarity of five-word shingles.

    Equal texts are one node, and so are all texts without words. All pairs of a band count, whatever the size of
    its bucket: ``group`` and ``load`` change the work, not the result. class_id is the smallest doc_id of the class.
    Null ids count as unknown: they join classes, but never name one unless all are null.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def hashed(batches):
        for batch in slices(batches, "text"):
            sigs = [signature_of(t) for t in batch.column("text").to_pylist()]
            keys = [_node(sig, tie) for sig, tie in zip(sigs, ids_of(batch, "tie").tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary())], names=["doc_id", "node", "fingerprint"]
            )

    rows = docs.withColumn("tie", F.xxhash64("text")).mapInArrow(hashed, "doc_id long, node long, fingerprint binary")
    return with_class(shared_table(rows, "minhash-rows"), df, doc_id, text, threshold, group, load).select("doc_id", "class_id")
