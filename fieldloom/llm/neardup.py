"""Near-duplicate documents by MinHash: banded candidates, confirmed links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.batches import U, mix64, shingles, texts, words
from fieldloom.llm.staging import staged

SHINGLE_WORDS = 5
#: A pair is a link if 100 * |intersection| >= THRESHOLD * |union|.
THRESHOLD = 75
#: 40 bands of 5 minima each: a pair at the threshold shares no band in 2 of 100,000 cases.
BANDS, ROWS = 40, 5
#: Pairs whose minima agree in a smaller share aren't compared in full; at the threshold 200 minima do so in
#: less than one case in a billion.
LEAST_AGREE = 0.55
#: Pairs with both their sets, or sets, that travel to Python at once.
BATCH_ROWS = 500
#: Rows that share a key in a join before they are dealt to several tasks, and rows of a block of a large bucket.
SALT_ROWS, BLOCK_ROWS = 256, 512


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions modulo 2^64."""
    k = np.arange(1, n + 1, dtype=U)
    return mix64(k * U(0x9E3779B97F4A7C15)) | U(1), mix64(k * U(0xC2B2AE3D27D4EB4F))


def shingle_sets(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_hash, minima, bands) of each row's distinct shingles.

    set_hash is a hash of the whole set, minima holds 8 bits of each minimum, bands a hash of each `rows`
    minima. Without words the set is empty and the last three are null.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(bands * rows)
        salt = mix64(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            for t in texts(batch.column(1)):
                values, first = _distinct(*shingles(words(t), SHINGLE_WORDS))
                size = np.diff(first)
                full = np.flatnonzero(size)
                low = np.empty((len(full), bands * rows), U)
                for k in range(bands * rows if len(full) else 0):
                    low[:, k] = np.minimum.reduceat(values * a[k] + b[k], first[full])
                low = mix64(low)
                keys = np.zeros((len(full), bands), U)
                for k in range(rows):
                    keys = mix64(keys ^ low[:, k::rows])
                keys = mix64(keys + salt)
                minima = (low >> U(56)).astype(np.uint8)
                place = np.full(len(t), -1)
                place[full] = np.arange(len(full))
                take = pa.array(place, mask=place < 0)
                lists = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * bands, keys.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, len(t)),
                        pa.array(size),
                        pa.array(_set_hash(values, first[full])).take(take),
                        pa.array([m.tobytes() for m in minima], pa.binary()).take(take),
                        lists.take(take),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "minima", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_hash long, minima binary, bands array<long>")


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and where they begin."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[keep], np.searchsorted(text[keep], np.arange(len(first)))


def _set_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set that isn't empty (first: where those begin)."""
    return np.add.reduceat(mix64(values ^ U(0x5851F42D4C957F2D)), first).view(np.int64) if len(first) else np.zeros(0, np.int64)


def _full_sets(found: DataFrame) -> DataFrame:
    """(node, shingles) of rows (node, text): the sorted distinct shingle hashes, where they are those of the
    class `node`."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for t in texts(batch.column(1)):
                values, first = _distinct(*shingles(words(t), SHINGLE_WORDS))
                full = np.flatnonzero(np.diff(first))
                own = full[_set_hash(values, first[full]) == nodes[t.first + full]]
                lists = pa.ListArray.from_arrays(first.astype(np.int32), values.view(np.int64)).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[t.first + own], pa.int64()), lists], names=["node", "shingles"])

    return found.select("node", "text").mapInArrow(sets, "node long, shingles array<long>")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap, n_a, n_b) of the pairs (a, b), from their full sets. A class that is b of many pairs is dealt out:
    its set goes to one task for every SALT_ROWS pairs."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("parts"))
    right = sets.join(many, sets["node"] == many["b"]).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("set_b"))
    left = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(c).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())])) for c in ("set_a", "set_b")]
            (x, at), (y, to) = sides
            found = [_overlap(x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]) for i in range(batch.num_rows)]
            columns = [batch.column("a"), batch.column("b"), pa.array(found, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(np.diff(to), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "overlap", "n_a", "n_b"])

    return left.join(right, ["b", "part"]).select("a", "b", "set_a", "set_b").mapInArrow(count, "a long, b long, overlap long, n_a long, n_b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): the smallest node that can be reached.

    Large-star joins each node's larger neighbours to its smallest neighbour, small-star its smaller ones; both
    alternate until every edge points at its component's smallest node. Rounds are staged, so a lost executor
    costs one round at most.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = staged(edges, "star"), None
    for _ in range(most_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = staged(small.where("u <> v").distinct(), "star")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").toDF("node", "component")).distinct()


def _agreeing(pairs: DataFrame, minima: DataFrame, least: float, count: int) -> DataFrame:
    """Pairs (a, b) of which the given share of minima agrees, looked at in batches."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, count) for c in ("m_a", "m_b"))
            good = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    of = lambda c: minima.select(F.col("node").alias(c), F.col("minima").alias(f"m_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Words are lower-cased A-Z and cut at ASCII white space; a document's set is its distinct 5-word shingles
    (fewer words: the whole sequence; none, or a null text: empty and linked with nothing). Links are confirmed
    on full sets. component_id is the smallest doc_id that can be reached over links. Rows with the same doc_id
    are one document that has the links of each; a row with a null doc_id links nothing, its component_id is
    null and it is kept. No rows give no rows; other columns are not looked at.

    Equal sets are one class, told apart by a hash of the set. In every band bucket first each class is paired
    with one, the centre: that with the smallest share of shingles that no other candidate class has, the likely
    origin of a group of copies. In buckets that then still hold several components the classes of different
    components are paired, but for those pairs whose overlap cannot reach the threshold: it is at most what both
    share with the centre, and what both share with any class outside it. These bounds are looked at pair by pair, in
    blocks that many tasks share; only pairs within them are made. The rest is sifted by minima before full sets are
    compared.
    """
    sketches = staged(shingle_sets(docs), "sketches", 4 * BATCH_ROWS)
    usable = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    members = usable.select(F.col("set_hash").alias("c"), F.explode("bands").alias("key")).distinct()
    several = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    shared = staged(members.join(several, "key"), "buckets")
    classes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("first_doc"))
    sets = _class_sets(docs, classes, shared.select(F.col("c").alias("node")).distinct())
    sizes = _sizes(sets)
    sized = shared.join(sizes.withColumnRenamed("node", "c"), "c").select("key", "c", "n", "common")

    def reaches(overlap: Column, a: str, b: str) -> Column:
        """Whether sets of sizes n_a and n_b with so many common shingles are linked."""
        return overlap * (100 + threshold) >= (F.col(a) + F.col(b)) * threshold

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where(reaches(F.col("overlap"), "n_a", "n_b")).select("a", "b")

    middle = F.min(F.struct((1 - F.col("common") / F.col("n")).alias("alone"), "c"))
    centred = staged(sized.join(sized.groupBy("key").agg(middle["c"].alias("centre")), "key"), "centred")
    star = staged(overlaps(centred.where("c <> centre").select(F.col("c").alias("a"), F.col("centre").alias("b")).distinct(), sets), "star-overlaps", BATCH_ROWS)
    links = staged(linked(star), "star-links")
    found = staged(components(links).withColumnRenamed("node", "c"), "components")
    # a class with too few common shingles for any size of partner has no links
    alive = centred.where(F.col("common") * 100 >= F.col("n") * threshold)
    labelled = alive.join(found, "c", "left").select("key", "c", "centre", "n", "common", F.coalesce("component", "c").alias("label"))
    unsettled = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    rest = labelled.join(unsettled, "key").join(star.select(F.col("a").alias("c"), F.col("b").alias("centre"), "overlap"), ["c", "centre"], "left")
    near = F.coalesce("overlap", "n")
    rest = staged(rest.select("key", "c", "n", "label", near.alias("near"), F.greatest(F.col("common") - near, F.lit(0)).alias("far")), "unsettled")
    # a pair that shares several buckets is taken in the one with the smallest key
    keys = rest.groupBy("c").agg(F.collect_set("key").alias("keys"))
    left, right = _block_sides(rest.join(keys, "c"))
    most = F.least("near_a", "near_b") + F.least("far_a", "far_b")
    once = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    other = (F.col("label_a") < F.col("label_b")) | ((F.col("block") < F.col("other")) & (F.col("label_a") > F.col("label_b")))
    across = left.join(right, ["key", "block", "other"]).where(other & reaches(most, "n_a", "n_b") & once)
    across = staged(across.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), "across")
    # one row for each class and task before the shuffle, so many copies of a set don't meet
    minima = usable.groupBy(F.col("set_hash").alias("node")).agg(F.first("minima").alias("minima"))
    minima = staged(minima.join(across.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "minima")
    likely = staged(_agreeing(across, minima, LEAST_AGREE, BANDS * ROWS), "across-likely")
    more = staged(linked(overlaps(likely, sets)), "across-links", BATCH_ROWS)
    # rows of one doc_id tie their classes; they and the new links join whole components
    several_sets = usable.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("last")).where("a < last")
    tied = usable.join(staged(several_sets.select("doc_id", "a"), "tied"), "doc_id").select("a", F.col("set_hash").alias("b")).distinct()
    first = components(_relabelled(more.unionAll(tied), found)).toDF("label", "joined")
    label = F.coalesce("joined", "label")
    whole = classes.join(found.withColumnRenamed("c", "set_hash"), "set_hash", "left").withColumn("label", F.coalesce("component", "set_hash"))
    whole = whole.join(first, "label", "left").select("set_hash", "first_doc", label.alias("label"))
    least = whole.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    ids = whole.join(least, "label").select("set_hash", "component_id")
    out = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(ids, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _block_sides(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of each key's rows with one another, on key, block and other: the rows of a key are dealt
    to blocks of about BLOCK_ROWS, and each pair of blocks, or block with itself, is a join key of its own, so the pairs of
    a large bucket are looked at in many tasks."""
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("c", "n", "label", "near", "far", "keys")]
    left = dealt.select("key", F.col("own").alias("block"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("other"), *of("a"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.col("own").alias("other"), *of("b"))
    return left, right


def _relabelled(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The edges between the components (c, component) of their ends; a class in none is its own."""
    a, b = found.toDF("a", "label_a"), found.toDF("b", "label_b")
    return edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))


def _sizes(sets: DataFrame) -> DataFrame:
    """(node, n, common): the size of each set, and how many of its shingles another of the sets has."""
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("n")).distinct()
    return staged(sizes.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common")), "sizes")


def _class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes, from the text of each one's first document."""
    first = classes.withColumnRenamed("set_hash", "node").join(wanted, "node", "left_semi")
    text = docs.select(F.col("doc_id").cast("long").alias("first_doc"), "text")
    return staged(_full_sets(first.join(text, "first_doc").select("node", "text").distinct()), "sets", BATCH_ROWS)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that a component has a smaller doc_id for."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(words) - {SHINGLE_WORDS - 1}) + 1), lambda i: array_to_string(words[i:i + {SHINGLE_WORDS - 1}], ' '))) AS shingles
    FROM w WHERE len(words) > 0
),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {THRESHOLD} * (x.n + y.n - count(*))
),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT links.b, reach.other FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(len(s.shingles), 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""
