"""MinHash near-dedup with SuperMinHash signatures.

1. One pass over the texts gives each document its shingle set's size and
   fingerprint and the band keys of its SuperMinHash signature.
2. Equal sets collapse to one representative, by an aggregate.
3. Bucket members are compared with the bucket's most typical member (a star,
   not all pairs), on full sets.  What a star leaves apart inside a bucket is
   then compared, all but its largest group with the rest, in blocks of
   bounded work.
4. Components come from table-based union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import drop, materialised
from .textops import HashCache, as_signed, list_array, mix, shingle_set, texts

SHINGLE_WORDS = 5
#: Rows of a band, and the chance that a pair at the threshold meets in no band.
ROWS, MISSED = 4, 1e-6
#: Texts, and bytes of them, whose sets are sketched at once.
SKETCH_ROWS, SKETCH_BYTES = 400, 2 << 20
#: Comparisons a block of a bucket is meant to hold.
BLOCK_WORK = 20_000_000
#: Members a lead's text is sent with.
BLOCK_MEMBERS = 500
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 16


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of many sets at once, as float32 rows.

    Element d permutes 0..size-1 by its own random numbers (a Fisher-Yates
    shuffle run one swap a level); the slot it reaches at level j gets j + r.
    A slot keeps its minimum, so once all of a set's slots hold less than j,
    later levels cannot change them and the set's elements stop.  Levels run
    over all sets together; large sets end after one or two of them.
    Rows of empty sets hold infinity.
    """
    n = len(sets)
    out = np.full(n * size, np.inf)
    lengths = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), lengths)
    perm: np.ndarray | None = None
    for level in range(size):
        if not len(elements):
            break
        bits = mix(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniform = (bits >> np.uint64(40)).astype(np.float64) / (1 << 24)
        target = level + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = target
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, target].astype(np.int64)
            perm[rows, target] = perm[rows, level]
            perm[rows, level] = slot
        np.minimum.at(out, owner * size + slot, level + uniform)
        open_sets = out.reshape(n, size).max(axis=1) >= level + 1
        stay = open_sets[owner]
        if level == 0:
            first = target[stay]
            perm = np.tile(np.arange(size, dtype=np.uint8), (len(first), 1))
            rows = np.arange(len(first))
            perm[rows, first] = 0
            perm[:, 0] = first
        else:
            perm = perm[stay]
        elements, owner = elements[stay], owner[stay]
    return out.reshape(n, size).astype(np.float32)


def band_count(percent: int) -> int:
    """Bands so that a pair at ``percent`` meets in none with a chance of MISSED."""
    return int(np.ceil(np.log(MISSED) / np.log(1 - (percent / 100) ** ROWS))) if percent < 100 else 1


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number included."""
    bands = signatures.shape[1] // ROWS
    words = signatures.view(np.uint32).astype(np.uint64).reshape(len(signatures), bands, ROWS)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), words.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + words[:, :, r])
    return key


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap in which a bit is odd or even as that many shingles fall on it.

    Two sets' bitmaps differ in at most as many bits as the sets differ in
    elements, however large the sets are.
    """
    at = shingles % np.uint64(64 * PARITY_WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITY_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most SKETCH_ROWS texts, of fewer where texts are long; a slice's sets are held at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(sizes):
        until = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SKETCH_BYTES))
        until = max(at + 1, min(until, at + SKETCH_ROWS))
        yield batch.slice(at, until - at)
        at = until


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for part in _parts(batch):
                sets = [shingle_set(t, SHINGLE_WORDS, cache) for t in texts(part)]
                keys = _band_keys(superminhash(sets, bands * ROWS))
                place = [np.arange(1, len(s) + 1, dtype=np.uint64) for s in sets]
                prints = [[int((mix(s * np.uint64(k) + p)).sum(dtype=np.uint64).astype(np.int64)) for s, p in zip(sets, place)] for k in (3, 5)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints[0], pa.int64()),
                        pa.array(prints[1], pa.int64()),
                        list_array([as_signed(k) if len(s) else np.empty(0, np.int64) for k, s in zip(keys, sets)], pa.int64()),
                        list_array([parity(s) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "bands", "parity"],
                )

    return run


def _similar(percent: int):
    """Pairs (a, b) out of rows in order of b and block, the lead's own row before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        lead = np.empty(0, np.uint64)
        for batch in batches:
            own = batch.column("own").to_pylist()
            keep = np.zeros(len(own), bool)
            for i, (mine, text) in enumerate(zip(own, texts(batch))):
                shingles = shingle_set(text, SHINGLE_WORDS, cache)
                if mine:
                    lead = shingles
                    continue
                both = len(np.intersect1d(lead, shingles, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(lead) + len(shingles) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach ``percent``; ``held``: rep, text.

    The text of b is sent once with every BLOCK_MEMBERS of its a.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    dealt = materialised(pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(5)), F.col("blocks")).cast("int").alias("block")))
    members = dealt.join(held.select(F.col("rep").alias("a"), "text"), "a").select("b", "block", F.lit(False).alias("own"), "a", "text")
    leads = dealt.select("b", "block").distinct().join(held.select(F.col("rep").alias("b"), "text"), "b").select("b", "block", F.lit(True).alias("own"), F.col("b").alias("a"), "text")
    rows = members.union(leads).repartition("b", "block").sortWithinPartitions("b", "block", F.desc("own"))
    out = materialised(rows.mapInArrow(_similar(percent), "a long, b long"))
    drop(dealt)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of ``docs``.

    Reads ``doc_id`` and ``text`` only.  Null, empty and word-less texts have
    no shingles and link with nothing.  doc_id is a key: rows that repeat one
    must be equal, and get equal results.  Rows with a null doc_id stand alone,
    with a null component and kept = true, whatever their text.
    An empty table gives an empty one.  Runs Spark jobs before it returns.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialised(docs.mapInArrow(_sketch(band_count(percent)), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, parity array<long>"))
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    classes = materialised(classes)
    member = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    sizes = materialised(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    sized = materialised(member.join(sizes, "bucket"))
    drop(sizes)
    member = sized
    # the texts that can be in a pair; everything later reads these alone.
    # The hint keeps the plan the same whether few or many are wanted.
    wanted = member.select("rep").distinct()
    held = docs.select(F.col("doc_id").alias("rep"), "text").hint("merge").join(wanted, "rep")
    held = materialised(held.dropDuplicates(["rep"]))
    score = member.groupBy("rep").agg(F.sum("size").alias("score"))
    member = materialised(member.join(score, "rep").select("bucket", "rep", "n_shingles", "score"))
    drop(sized)
    lead = member.groupBy("bucket").agg(F.max(F.struct("score", F.negative("rep").alias("rank"), "n_shingles")).alias("lead"))
    star = (
        member.join(lead, "bucket")
        .select("rep", F.negative("lead.rank").alias("lead"), "n_shingles", F.col("lead.n_shingles").alias("lead_n"))
        .where("rep <> lead")
        .where(_sizes_allow("n_shingles", "lead_n", percent))
        .select(F.col("rep").alias("a"), F.col("lead").alias("b"))
        .distinct()
    )
    links = _confirmed(star, held, percent)
    first = components(links, "a", "b")
    more = _across(member, first, classes, held, percent)
    drop(member, held)
    final = components(links.union(more), "a", "b").select(F.col("node").alias("rep"), "component")
    drop(links, more)
    named = classes.join(final, "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    named = materialised(named)
    drop(classes)
    joined = sketches.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _sizes_allow(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _across(member: DataFrame, found: DataFrame, classes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links between parts of a bucket that its star left apart.

    Only buckets with members in several components matter, and there only
    pairs across components.  Such a pair is dropped if its parity bitmaps
    differ in more bits than the sets of a link may differ in elements.  This
    test, in the join's condition, is exact: no link is lost, and what passes
    is nearly all links.
    """
    own = found.select(F.col("node").alias("rep"), "component")
    whole = materialised(member.join(own, "rep", "left").select(F.col("bucket").alias("key"), "rep", F.coalesce("component", "rep").alias("component")))
    torn = materialised(_torn(whole))
    drop(whole, found)
    words = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY_WORDS)]
    width = float(-np.log(percent / 100))
    part = torn.join(classes.select("rep", "n_shingles", *words), "rep")
    part = materialised(part.withColumn("cls", F.floor(F.log("n_shingles") / width)))
    sides = []
    for side in "ab":
        keep = [F.col(f"p{i}").alias(f"{side}{i}") for i in range(PARITY_WORDS)]
        # a grid of blocks: each member is copied along one side of it
        own = part.withColumn("grid", F.ceil(F.sqrt(F.col("work") / BLOCK_WORK)).cast("int"))
        dealt, every = F.pmod(F.xxhash64("rep", F.lit(ord(side))), F.col("grid")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
        if side == "a":
            own = own.where(F.col("component") != F.col("main")).withColumn("down", dealt).withColumn("along", every)
        else:
            own = own.withColumn("along", dealt).withColumn("down", every).withColumn("cls", F.explode(F.array(F.col("cls") - 1, "cls", F.col("cls") + 1)))
        sides.append(own.select("key", "down", "along", "cls", F.col("rep").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("component").alias(f"c{side}"), F.col("main").alias(f"m{side}"), *keep))
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(PARITY_WORDS)), F.lit(0))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb"))
    once = (F.col("a") < F.col("b")) | (F.col("cb") == F.col("mb"))
    meet = once & (F.col("ca") != F.col("cb")) & _sizes_allow("na", "nb", percent) & near
    one, two = sides
    pairs = one.join(two, (one["key"] == two["key"]) & (one["down"] == two["down"]) & (one["along"] == two["along"]) & (one["cls"] == two["cls"]) & meet).select("a", "b").distinct()
    out = _confirmed(pairs, held, percent)
    drop(torn, part)
    return out


def _torn(keyed: DataFrame) -> DataFrame:
    """(key, rep, component, main, work): members of buckets in several components; main is the largest one's.

    A bucket's work is its members outside of the main component times all of them.
    """
    parts = keyed.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).where("n > main.n")
    keys = materialised(keys.select("key", F.col("main.component").alias("main"), ((F.col("n") - F.col("main.n")) * F.col("n")).alias("work")))
    return keyed.join(keys, "key").select("key", "rep", "component", "main", "work")
