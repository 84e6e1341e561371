"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint is cut into segments.  In each, the words of a perfect Hamming code are the anchors:
every 31-bit word is within covering radius 1 of exactly one, its home.  Two segments that differ in
at most one bit meet if one is at home at an anchor within radius 1 + 1 of the other, so a segment is
sent to all anchors within 2: its home, and the 15 that two flips reach (none if it is an anchor
itself).  Pairs that differ in one bit differ in parity, so only even segments are sent; odd ones stay
at home.

Fingerprints of 64 bits with at most 3 differing bits have a half with at most one: two segments of
31 + 1 bits (the last bit stands for itself) find every such pair.

Equal fingerprints are one member.  Null and empty texts have fingerprint zero, linked like any other;
repeated rows share a component; null ids never are a component's name unless all are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, arrow_rows, discard, forget, keyed, partitions, slices, stash, whole
from .graph import EDGES_EACH, anchored_links, components

ROWS_AT_A_TIME = 1 << 15


def _votes(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """How many hashes have each bit set, bit 0 first."""
    out = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), ROWS_AT_A_TIME):
        part = hashes[lo : lo + ROWS_AT_A_TIME]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        out += bits.sum(0, dtype=np.int64)
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view("<u8")


def shingles(text: bytes, size: int) -> list[bytes]:
    """Each run of ``size`` words, repeats included; all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return [joined[s:e] for s, e in zip(starts, ends)]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, 42) for s in shingles(text, size)], "<u8")


def fingerprint(text: bytes, size: int) -> int:
    h = shingle_hashes(text, size)
    return int(_pack(2 * _votes(h) > len(h))[0]) if len(h) else 0


def homes_and_visits(segment: np.ndarray, r: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of segments of 2**r bits: all but the top one in a Hamming code, which stands for itself."""
    top = np.int64(1) << ((1 << r) - 1)
    word = segment.astype(np.int64) & (top - 1)
    extra = segment.astype(np.int64) & top
    syndrome = np.zeros(len(word), np.int64)
    ones = (extra > 0).astype(np.int64)
    for p in range(1, 1 << r):
        bit = (word >> (p - 1)) & 1
        syndrome ^= bit * p
        ones += bit
    home = np.where(syndrome > 0, word ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), word)
    every = np.arange(len(word))
    rows, anchors, at_home = [every], [home | extra], [np.ones(len(word), bool)]
    even = np.flatnonzero(ones % 2 == 0)
    rows.append(even)
    anchors.append(home[even] | (extra[even] ^ top))
    at_home.append(np.zeros(len(even), bool))
    off = even[syndrome[even] > 0]
    for p in range(1, 1 << r):
        q = p ^ syndrome[off]
        pair = off[(q > p)]
        q = q[q > p]
        rows.append(pair)
        anchors.append((word[pair] ^ (1 << (p - 1)) ^ (np.int64(1) << (q - 1))) | extra[pair])
        at_home.append(np.zeros(len(pair), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(at_home)


def anchor_records(ids: np.ndarray) -> pd.DataFrame:
    """Records (anchor, id, home) of fingerprints at both halves; an anchor's bit 33 tells the half."""
    parts = []
    for k in range(2):
        rows, anchor, home = homes_and_visits((ids.view(np.uint64) >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF))
        parts.append(pd.DataFrame({"anchor": anchor | (k << 33), "id": ids[rows], "home": home}))
    return pd.concat(parts)


def quarter_records(anchors: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """Records (anchor, sub, id, home) of fingerprints at one anchor, at both quarters of the other half.

    Two that meet at an anchor of one half differ in at most 3 bits of the other, so one quarter has at most 1.
    """
    other = np.where(anchors >> 33, 0, 32).astype(np.uint64)
    parts = []
    for k in range(2):
        rows, sub, home = homes_and_visits((ids.view(np.uint64) >> (other + np.uint64(16 * k))) & np.uint64(0xFFFF), 4)
        parts.append(pd.DataFrame({"anchor": anchors[rows], "sub": sub | (k << 17), "id": ids[rows], "home": home}))
    return pd.concat(parts)


RECORD = "anchor bigint, id bigint, home boolean"
#: Anchors with more members are split by the anchors of the other half's quarters.
HOT_ANCHOR = 512


def fingerprint_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links among the distinct fingerprints (fp) that give the components of all of up to ``bits`` bits."""
    if bits > 3:
        raise ValueError("two halves find pairs of up to 3 differing bits")

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield anchor_records(b["fp"].to_numpy(np.int64))

    def quarters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield quarter_records(b["anchor"].to_numpy(np.int64), b["id"].to_numpy(np.int64))

    def meeting(records: DataFrame, place: list[str]) -> DataFrame:
        shared = records.groupBy(*place).agg(F.min(F.when(F.col("home"), F.col("id"))).alias("leader"), F.count("*").alias("n"))
        return records.join(shared.where("n > 1 and leader is not null"), place)

    met = stash(meeting(prints.mapInPandas(halves, RECORD), ["anchor"]))
    split = met.where(F.col("n") > HOT_ANCHOR).select("anchor", "id").mapInPandas(quarters, f"{RECORD}, sub int")
    place = ["anchor", "sub"]
    cool = met.where(F.col("n") <= HOT_ANCHOR).withColumn("sub", F.lit(-1))
    both = stash(cool.unionByName(meeting(split, place)).drop("n"))
    links = anchored_links(both, place, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits)
    discard(met, both)
    return links


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint((t or "").encode(), size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def simhash_components(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: fingerprint and the smallest id among the documents it is linked with."""
    fps = stash(fingerprints(docs, size))
    members = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(members.select("fp"), bits)
    linked = components(links)
    named = members.join(linked, members["fp"] == linked["id"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    named = stash(named.join(least, "c").select("fp", "component_id"))
    discard(members, links, linked)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies of whole texts: word shingles of five, similarity (Jaccard) of 0.8 or more.
#
# Fingerprints by anchors, as above, meet the closest of them.  A fingerprint of 64 bits cannot meet all
# pairs at 0.8 (they differ in about ten bits), so a prefix filter adds every pair that is left.  Order the
# shingles of all texts in one way.  If x has n shingles and shares c with y, their first common shingle is
# among the first n - c + 1 of x.  Similarity s needs c >= s / (1 + s) * (n + m), which is s * n at least,
# and 2 s / (1 + s) * m at least for the smaller set of m.  So a pair meets at a shingle in the first
# n - s * n + 1 of the larger set that the smaller one has among fewer still, its home: no pair is missed,
# whatever the order.  An order by rarity makes few others meet.

#: Texts of the sample that tells which shingles are frequent, and the most frequent ones that are held.
#: Both bear on the order alone, and so on how many pairs are compared but not on which are found.
ORDER_ROWS = 20_000
ORDER_SHINGLES = 200_000
#: So many row keys are broadcast (about 24 MB), more are shuffled.
SMALL_ROWS = 1_000_000
#: Texts in an Arrow batch, and texts whose first shingles make one partition: both bound the memory of a task.
BATCH_ROWS = 1024
ROWS_EACH = 2000
#: Members of an anchor up to which they are compared without another order.
GROUP = 32
#: Bytes of a shingle's hash that are compared: two sets of 20,000 have a false match with chance 4e-4.
HASH_BYTES = 5


def least_common(similarity: float, n: int, m: int) -> int:
    """Shingles that sets of n and m have in common at least, if they are that similar."""
    return math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def frequent(texts: DataFrame, share: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count): the shingles that stand in three or more texts of a sample, by hash."""
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [np.unique(shingle_hashes((t or "").encode(), size)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype("<u8").view(np.int64))], ["shingle"])

    n = some.select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    top = n.where("n > 2").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toPandas()
    shingle, count = top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], count[order]


def first_shingles(own: np.ndarray, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a sorted set: the rare before the frequent, equals by hash."""
    n, (shingle, count) = len(own), often
    if not n:
        return own
    if len(shingle):
        at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
        own = own[np.argsort(np.where(shingle[at] == own, count[at], 0), kind="stable")]
    return own[: n - math.ceil(similarity * n - 1e-9) + 1]


def packed_set(own: np.ndarray) -> bytes:
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_set(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(held, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8")[:, 0]


def similar(x: bytes, y: bytes, similarity: float) -> bool:
    n, m = len(x) // HASH_BYTES, len(y) // HASH_BYTES
    if min(n, m) < similarity * max(n, m):
        return False
    common = n + m - len(np.unique(np.concatenate([unpacked_set(x), unpacked_set(y)])))
    return common > 0 and common >= similarity * (n + m - common) - 1e-9


def may_be_close(n: Column, pos: Column, m: Column, at: Column, similarity: float) -> Column:
    """Whether sets of n and m may be that similar if the first shingle they have in common is at pos and at."""
    # Enough shingles must be left from here on: that holds at the first one that a true pair has in common.
    need = F.lit(similarity / (1 + similarity)) * (n + m) - 1e-9
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (F.least(n - pos, m - at) >= need)


def to_compare(here: Callable[[str], Column], there: Callable[[str], Column], similarity: float) -> Column:
    """Whether two members of an anchor are a pair to compare, the smaller id here."""
    return (
        (here("id") < there("id"))
        & (here("label") != there("label"))
        & (here("home") | there("home"))
        & may_be_close(here("n"), here("pos"), there("n"), there("pos"), similarity)
    )


def joined_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs to compare of ``met`` (anchor, id, n, pos, home, label), once for each anchor."""
    here, there = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    met = met.alias("l").join(met.alias("r"), (here("anchor") == there("anchor")) & to_compare(here, there, similarity))
    return met.select(here("id").alias("a"), there("id").alias("b"))


def group_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """The same pairs, each once, where anchors are few members each (``GROUP``).

    Texts that share a run of shingles meet at as many anchors.  So each member brings a list of its partners at an
    anchor, equal lists count once, and only a member's whole list becomes rows.
    """
    who = met.groupBy("anchor").agg(F.collect_list(F.struct("id", "n", "pos", "home", "label")).alias("who"))

    def partners(x: Column) -> Column:
        close = F.filter("who", lambda y: to_compare(x.getField, y.getField, similarity))
        return F.struct(x["id"].alias("a"), F.array_sort(F.transform(close, lambda y: y["id"])).alias("bs"))

    lists = who.select(F.filter(F.transform("who", partners), lambda p: F.size(p["bs"]) > 0).alias("lists")).select(F.inline("lists"))
    whole_lists = lists.distinct().groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    return whole_lists.select("a", F.explode("bs").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(_file, _at, doc_id, component, keep) of ``docs`` (_file, _at, doc_id, text), where the first two are a key.

    Texts equal word by word are one member; members link at Jaccard similarity of their shingle sets
    from ``similarity``; of each component the row with the smallest id, then key, is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        forget()
        for b in slices(batches):
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            h = [xxh3_128_intdigest(b" ".join(t.lower().split())) for t in texts]
            h1 = np.array([x & (2**64 - 1) for x in h], np.uint64).view(np.int64)
            h2 = np.array([x >> 64 for x in h], np.uint64).view(np.int64)
            fp = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "doc_id")), *map(pa.array, (h1, h2, fp))], [*KEY, "doc_id", "h1", "h2", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = stash(docs.mapInArrow(run, f"_file bigint, _at bigint, doc_id {kind}, h1 bigint, h2 bigint, fp bigint"))
    first = hashed.groupBy("h1", "h2", "fp").agg(F.min(F.struct(*KEY)).alias("f"))
    members = stash(first.select("h1", "h2", "fp", "f.*", F.monotonically_increasing_id().alias("id")))
    n_members = members.count()

    def texts_of(ids: DataFrame, n: int) -> DataFrame:
        # Few keys are broadcast, so that texts stay where they are.
        return docs.select(*KEY, "text").join(F.broadcast(ids) if n <= SMALL_ROWS else ids, KEY).select("id", "text")

    texts = texts_of(members.select(*KEY, "id"), n_members)
    often = docs.sparkSession.sparkContext.broadcast(frequent(texts, min(1.0, ORDER_ROWS / max(1, n_members)), size))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in slices(batches):
            own = [np.unique(shingle_hashes((t or "").encode(), size)) for t in b.column("text").to_pylist()]
            first = [first_shingles(x, similarity, often.value) for x in own]
            long = np.array([len(x) for x in first])
            cols = [
                np.concatenate(first).astype("<u8").view(np.int64),
                np.repeat(b.column("id").to_numpy(), long),
                np.repeat(np.array([len(x) for x in own], np.int64) << 32, long) + np.concatenate([np.arange(k) for k in long]).astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["anchor", "id", "place"])

    def verify(edges: DataFrame) -> DataFrame:
        """The links among the pairs (a, b)."""
        edges = stash(edges)
        tasks = 1 + edges.count() // EDGES_EACH
        ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = stash(members.select(*KEY, "id").join(ids, "id", "left_semi").coalesce(tasks))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                own = [packed_set(np.unique(shingle_hashes((t or "").encode(), size))) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], ["id", "own"])

        held = stash(texts_of(ids, ids.count()).mapInArrow(sets, "id bigint, own binary"))
        x, y = held.select(F.col("id").alias("a"), F.col("own").alias("x")), held.select(F.col("id").alias("b"), F.col("own").alias("y"))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ok = [similar(p, q, similarity) for p, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        links = stash(edges.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint"))
        discard(edges, ids, held)
        return links

    # The operator's own method: anchors of fingerprints.
    chosen = members.groupBy("fp").agg(F.min("id").alias("one"))
    by_print = stash(members.join(chosen, "fp").where("id <> one").select(F.col("id").alias("a"), F.col("one").alias("b")))
    by_anchor = fingerprint_links(chosen.select("fp"), 3)
    names = chosen.select("fp", "one")
    by_anchor = by_anchor.join(names.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(names.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    closest = verify(by_print.union(by_anchor.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    discard(by_print)
    known = components(closest)

    found = texts.mapInArrow(records, "anchor bigint, id bigint, place bigint")
    found = found.repartition(max(partitions(docs.sparkSession), n_members // ROWS_EACH), "anchor")
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    at_home = pos < n - F.ceil(F.lit(similarity / (1 + similarity)) * 2 * n - 1e-9) + 1
    # Most shingles stand in one text; a text has one record at an anchor, so no anchor holds a large part of them.
    anchor = Window.partitionBy("anchor")
    # The leader of an anchor is the member with the fewest rarer shingles for its size: an original rather than one of
    # its copies, which are nearer to it than to one another.
    head = F.struct((pos / n).alias("rarer"), "id", n.alias("n"), pos.alias("pos"))
    met = found.withColumns({"met": F.count("*").over(anchor), "lead": F.min(F.when(at_home, head)).over(anchor)})
    met = met.where("met > 1 and lead is not null")
    rows = stash(met.select("anchor", "id", n.alias("n"), pos.alias("pos"), at_home.alias("home"), "lead", F.col("lead.id").alias("leader"), "met"))

    def apart(known: DataFrame) -> DataFrame:
        """``rows`` with the component of each member, and of its anchor's leader as ``chief``."""
        label = known.withColumnRenamed("component", "label")
        chief = label.select(F.col("id").alias("leader"), F.col("label").alias("chief"))
        out = rows.join(label, "id", "left").join(chief, "leader", "left")
        return out.withColumns({"label": F.coalesce("label", "id"), "chief": F.coalesce("chief", "leader")})

    # Each member that is not linked with its anchors' leaders is compared with the one that it shares most anchors with.
    some = apart(known).where("label <> chief").where(may_be_close(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), similarity))
    best = some.groupBy("id", "leader").agg(F.count("*").alias("k")).groupBy(F.col("id").alias("a"))
    tried = stash(best.agg(F.max_by("leader", F.struct("k", -F.col("leader"))).alias("b")))
    led = verify(tried)
    discard(known)
    known = components(closest.union(led))

    # Where members are still apart, all of the anchor are compared: at once if they are few.  Those of larger groups get
    # the best order first: by the number of them that hold a shingle.  A shingle that only one holds meets nothing
    # but counts as a place.
    left = apart(known).withColumn("some", F.max(F.col("label") != F.col("chief")).over(anchor)).where("some")
    left = stash(left.select("anchor", "id", "n", "pos", "home", "label", "met"))
    now = left.where(F.col("met") > GROUP)
    asked = stash(now.select("id", "n", "label").distinct())
    n_asked = asked.count()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [np.unique(shingle_hashes((t or "").encode(), size)) for t in b.column("text").to_pylist()]
            ids = np.repeat(b.column("id").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype("<u8").view(np.int64)), pa.array(ids)], ["anchor", "id"])

    shown = texts_of(members.join(asked, "id", "left_semi").select(*KEY, "id"), n_asked).mapInArrow(every, "anchor bigint, id bigint")
    shown = shown.withColumn("df", F.count("*").over(anchor)).where("df > 1")
    of_id = Window.partitionBy("id")
    shown = shown.withColumns({"shared": F.count("*").over(of_id), "turn": F.row_number().over(of_id.orderBy("df", "anchor"))}).join(asked, "id")
    place = F.col("n") - F.col("shared") + F.col("turn") - 1
    first = place < F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    home = place < F.col("n") - F.ceil(F.lit(similarity / (1 + similarity)) * 2 * F.col("n") - 1e-9) + 1
    fine = stash(shown.where(first).select("anchor", "id", "n", place.alias("pos"), home.alias("home"), "label"))
    rest = group_pairs(left.where(F.col("met") <= GROUP), similarity).union(joined_pairs(fine, similarity)).distinct()
    more = verify(rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    discard(rows, tried, known, left, asked, fine)
    linked = components(closest.union(led).union(more))
    discard(closest, led, more)

    named = members.join(linked, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    rows = hashed.join(named, ["h1", "h2"]).select(*KEY, "doc_id", "component")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *KEY)).alias("best"))
    is_best = (F.col("best._file") == F.col("_file")) & (F.col("best._at") == F.col("_at"))
    out = stash(rows.join(best, "component").select(*KEY, "doc_id", "component", is_best.alias("keep")))
    discard(hashed, members, linked)
    return out


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component; columns as they were.

    Rows without words are equal word by word, so one of them stays.
    """
    rows = keyed(docs)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        judged = near_duplicates(rows.select(*KEY, F.col("r")["doc_id"].alias("doc_id"), whole(F.col("r")["text"]).alias("text")), size, similarity)
    gone = judged.where("not keep").select(*KEY)
    # Few keys are broadcast, so that texts stay where they are.
    gone = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    return rows.join(gone, KEY, "left_anti").select("r.*")
