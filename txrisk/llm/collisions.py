"""Near-duplicate vectors by collision-counting projections.

Two vectors link if their labels are equal and their cosine reaches the threshold, that is, if their
angle is at most t.  Linked unit vectors differ by at most ``2 sin(t / 2)``, and by a normal share of
it on a random line.

1. *Balls.*  Vectors of one label are dealt to blocks of bounded size by a coarse cell, and there
   vectors within 0.45 t of a leader make a ball, with a centre and a radius (0 for a single vector).
   Any two of a ball are linked, so a group of near copies is one class row from here on, however
   large; its pairs are counted, not listed.
2. *Rounds.*  In each round class rows get the cell of K projections cut into steps with random offsets;
   K follows from the label's row count, the number of rounds from the chance that a pair at the very
   threshold shares a cell, so that the chance to miss it in all rounds is ``MISS``.  Up to ``CELL``
   rows a label needs no cut (K is 0), and cells miss nothing there.
3. *Counting.*  Inside a cell class rows carry their projections alone, in bytes.  They are sorted along
   the first line; partners are all that are no farther there than linked members can be, and on
   every line the partners inside the query-centred window score a collision.  Windows are as wide as
   the angle t and both radii ask for.  Pairs with as many collisions as all but ``MISS`` of pairs at the
   threshold have (calibrated by simulation) go on, and no other pair does.
4. *Verification.*  The pairs get their centres: two class rows are linked as a whole, not at all, or,
   in the narrow ring between, by the cosines of their members in double precision, in bounded blocks
   of which each gives counts per row, so no list of pairs grows with the square of a ball.

Null labels, and vectors that are null, zero or hold null or non-finite components, link with nothing,
nor do vectors of different lengths.  Each row is a vector of its own, also where ids repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .graph import components
from .vectors import stacked, usable

CELL = 2048
BLOCK = 4096
PROJECTIONS = 32
#: Lines that are counted for every pair; the others only where these leave enough collisions possible.
FIRST_LINES = 16
WINDOW = 2.5
MISS = 1e-4
STEP = 2.0
CHUNK = 256
#: Steps of a projection's byte in a window of single vectors; what a byte cannot tell widens the windows.
STEPS = 24
#: Angles from double-precision cosines near 1 are off by up to 2e-8.
SAFE = 1e-6
#: Members of a ball that are compared with members of another at a time.
MEMBERS = 256


def lines(d: int, n: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((d, n))
    return x / np.linalg.norm(x, axis=0)


def orthogonal(d: int, n: int, seed: int = 3) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q[:, : min(n, d)]


def least_collisions(d: int, angle: float, n: int, miss: float = MISS) -> tuple[float, int]:
    """(window, count): pairs at ``angle`` have at least ``count`` collisions but for a share of ``miss``."""
    gap = 2 * math.sin(angle / 2)
    window = WINDOW * gap / math.sqrt(d)
    x = np.random.default_rng(11).standard_normal((50_000, d))
    x *= gap / np.linalg.norm(x, axis=1, keepdims=True)
    hits = (np.abs(x[:, : min(n, d)]) <= window).sum(1)
    return window, int(np.quantile(hits, miss, method="lower"))


class Cells:
    """Cells of rounds: K projections, cut into steps with random offsets."""

    def __init__(self, d: int, angle: float, most_rows: int):
        self.step = STEP / math.sqrt(d)
        # Chance that a pair at the threshold falls into one step of a projection.
        self.share = 1 - 2 * math.sin(angle / 2) * math.sqrt(2 / math.pi / d) / self.step
        self.k = self.depth(most_rows)
        self.rounds = self.count(self.k)
        self.lines = lines(d, (self.rounds + 1) * max(1, self.k), 17)
        self.offset = np.random.default_rng(19).random(self.lines.shape[1])

    def depth(self, rows: int) -> int:
        """Projections that leave about CELL rows to a cell, if one step holds half of the rows at most."""
        return max(0, math.ceil(math.log2(rows / CELL))) if rows > CELL else 0

    def count(self, k: int) -> int:
        return 1 if k == 0 else math.ceil(math.log(MISS) / math.log(1 - self.share**k))

    def of(self, u: np.ndarray, k: np.ndarray, at: int) -> np.ndarray:
        """The cell of unit vectors in round ``at``; rows use their first ``k`` projections."""
        lo = at * max(1, self.k)
        out = np.zeros(len(u), np.int64)
        if self.k:
            steps = np.floor(u @ self.lines[:, lo : lo + self.k] / self.step + self.offset[lo : lo + self.k]).astype(np.int64)
            for j in range(self.k):
                out = np.where(k > j, out * 1_000_003 + steps[:, j] + 512, out)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / big
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def arccos(x):
    return np.arccos(np.clip(x, -1, 1))


def make_balls(rows: np.ndarray, u: np.ndarray, angle: float) -> tuple[np.ndarray, list]:
    """(ball of each row, [(ball, size, radius, centre)]); a ball is named by its smallest row."""
    order = np.argsort(rows)
    ball, made = np.full(len(rows), -1, np.int64), []
    reach = math.cos(0.45 * angle)
    free = order
    while len(free):
        lead, near = free[0], u[free] @ u[free[0]] >= reach
        near[0] = True
        own = free[near]
        ball[own] = rows[lead]
        if len(own) == 1:
            made.append((rows[lead], 1, 0.0, u[lead]))
        else:
            c = u[own].mean(0)
            c /= np.linalg.norm(c)
            made.append((rows[lead], len(own), float(arccos(u[own] @ c).max()) + SAFE, c))
        free = free[~near]
    return ball, made


def projected(u: np.ndarray, axes: np.ndarray, window: float) -> np.ndarray:
    """Projections in whole steps of a window's ``STEPS``-th part; far ones are drawn in, which brings none apart."""
    return np.clip(np.rint(u @ axes * (STEPS / window)), -127, 127).astype(np.int8)


def collisions(p: np.ndarray, radius: np.ndarray, angle: float, window: float, least: int) -> np.ndarray:
    """Pairs (i, j) of class rows with at least ``least`` collisions, each once.

    ``p``: projections in steps, one row each.  Linked members of balls whose centres are ``angle`` and both
    radii apart at most are as single vectors at that angle, so windows grow with the gap.
    """
    order = np.argsort(p[:, 0], kind="stable")
    p, r = p[order].astype(np.int16), radius[order]
    gap = 2 * math.sin(angle / 2)
    per_gap = STEPS / gap  # steps of a window for each unit of the gap
    unit_steps = STEPS / window  # steps of a projection for each unit of length
    first, n, lines = p[:, 0], len(p), p.shape[1]
    most = r.max(initial=0.0)
    out = []
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        wide = 2 * math.sin(min(math.pi, angle + r[lo:hi].max() + most) / 2)
        # Later rows only: each pair is met once, from its lower end.
        b = np.searchsorted(first, first[hi - 1] + wide * unit_steps + 1, side="right")
        q, x = p[lo:hi], p[lo:b]
        if most or r[lo:hi].any():
            apart = 2 * np.sin(np.minimum(math.pi, angle + r[lo:hi, None] + r[None, lo:b]) / 2)
            w = np.ceil(apart * per_gap).astype(np.int16) + 1
        else:
            w = np.int16(STEPS + 1)
        hits = np.zeros((hi - lo, b - lo), np.int8)
        for k in range(min(FIRST_LINES, lines)):
            hits += np.abs(q[:, k, None] - x[None, :, k]) <= w
        i, j = np.nonzero(hits >= least - max(0, lines - FIRST_LINES))
        keep = j > i
        i, j = i[keep], j[keep]
        if lines > FIRST_LINES:
            own = w[i, j][:, None] if isinstance(w, np.ndarray) and w.ndim else w
            more = (np.abs(q[i, FIRST_LINES:] - x[j, FIRST_LINES:]) <= own).sum(1)
            keep = hits[i, j] + more >= least
            i, j = i[keep], j[keep]
        out.append(np.stack([order[i + lo], order[j + lo]], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def near_vectors(df: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per vector: ``n_links``, ``component_id`` and whether it is kept."""
    angle = math.acos(cosine)
    rows = df.select("vec_id", "embedding", "label").withColumn("_row", F.monotonically_increasing_id())
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = stash(rows.withColumn("_d", F.when(fit, F.size("embedding"))))
    good = rows.where("_d is not null")
    group = good.groupBy("label", "_d").agg(F.count("*").alias("n"))
    shape = {r["_d"]: r["most"] for r in group.groupBy("_d").agg(F.max("n").alias("most")).collect()}
    alone = rows.where("_d is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    for d, most in sorted(shape.items()):
        own = good.where(F.col("_d") == d).join(group.where(F.col("_d") == d).select("label", "n"), "label")
        alone = alone.unionByName(_linked(own.select("_row", "vec_id", "label", "embedding", "n"), d, most, angle, cosine))
    return alone


def _linked(rows: DataFrame, d: int, most: int, angle: float, cosine: float) -> DataFrame:
    cells = Cells(d, angle, most)
    axes = orthogonal(d, PROJECTIONS)
    window, least = least_collisions(d, angle, PROJECTIONS)

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = unit(stacked(b["embedding"]))
            k = np.array([cells.depth(n) for n in b["n"]], np.int64)
            yield pd.DataFrame(
                {"_row": b["_row"], "label": b["label"], "k": k, "cell": cells.of(u, k, 0), "u": [x.tobytes() for x in u]}
            )

    ids = rows.select("_row", "vec_id")  # they stay out of pandas, which has no integers with nulls
    rows = stash(rows.drop("vec_id").mapInPandas(coarse, "_row bigint, label int, k bigint, cell bigint, u binary"))
    sizes = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")))

    def balls(b: pd.DataFrame) -> pd.DataFrame:
        row, u = b["_row"].to_numpy(), stacked(b["u"])
        ball, made = make_balls(row, u, angle)
        info = {m[0]: m for m in made}
        lead = [info[x] if x == r else None for x, r in zip(ball, row)]
        return pd.DataFrame(
            {
                "_row": row, "label": b["label"], "k": b["k"], "u": b["u"], "ball": ball,
                "size": [m and m[1] for m in lead], "radius": [m and m[2] for m in lead], "c": [m and m[3].tobytes() for m in lead],
            }
        )

    members = stash(
        dealt.groupBy("label", "cell", "block").applyInPandas(
            balls, "_row bigint, label int, k bigint, u binary, ball bigint, size bigint, radius double, c binary"
        )
    )
    heads = stash(members.where("size is not null").select("ball", "label", "size", "radius", "c"))

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u, k = stacked(b["u"]), b["k"].to_numpy()
            rounds = np.array([cells.count(x) for x in k])
            for at in range(1, cells.rounds + 1):
                on = rounds >= at
                if on.any():
                    yield pd.DataFrame({"label": b["label"][on], "round": at, "cell": cells.of(u[on], k[on], at), "ball": b["ball"][on]})

    def on_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = projected(stacked(b["c"]), axes, window)
                yield b.drop(columns="c").assign(p=[x.tobytes() for x in p])

    # A ball stands in the cells of all its members.
    place = ["label", "round", "cell"]
    entered = members.select("label", "k", "u", "ball").mapInPandas(enter, "label int, round int, cell bigint, ball bigint")
    lines_of = heads.select("ball", "radius", "c").mapInPandas(on_lines, "ball bigint, radius double, p binary")
    entries = stash(entered.distinct().join(lines_of, "ball"))
    split = entries.groupBy(*place).agg(F.ceil(F.count("*") / CELL).alias("parts"))
    split = (
        entries.join(split, place)
        .withColumn("own", F.pmod(F.xxhash64("ball"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    )

    def count(b: pd.DataFrame) -> pd.DataFrame:
        ids, own = b["ball"].to_numpy(), b["own"].to_numpy()
        p = np.frombuffer(b"".join(b["p"]), np.int8).reshape(len(b), -1)
        found = collisions(p, b["radius"].to_numpy(), angle, window, least)
        if b["lo"].iloc[0] != b["hi"].iloc[0]:  # pairs of one part are met where both numbers are its own
            found = found[own[found[:, 0]] != own[found[:, 1]]]
        x, y = ids[found[:, 0]], ids[found[:, 1]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    counted = stash(split.groupBy(*place, "lo", "hi").applyInPandas(count, "a bigint, b bigint").distinct())
    discard(entries)

    def side(name: str, to: str) -> DataFrame:
        return heads.select(F.col("ball").alias(name), F.col("c").alias(f"c{to}"), F.col("radius").alias(f"r{to}"), (F.col("size") == 1).alias(f"one{to}"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cos = np.einsum("ij,ij->i", stacked(b["cx"]), stacked(b["cy"]))
                r = (b["rx"] + b["ry"]).to_numpy()
                single = (b["onex"] & b["oney"]).to_numpy()
                apart = arccos(cos)
                whole = np.where(single, cos >= cosine, apart + r <= angle - SAFE)
                keep = np.where(single, whole, apart - r <= angle + SAFE)
                yield b.loc[keep, ["a", "b"]].assign(whole=whole[keep])

    pairs = stash(counted.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(decide, "a bigint, b bigint, whole boolean"))

    size = heads.select("ball", "size")
    whole = pairs.where("whole").select("a", "b")
    both = whole.union(whole.select("b", "a"))
    by_ball = both.join(size.withColumnRenamed("ball", "b"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("size").alias("more"))

    # The ring between: blocks of members against blocks of members.
    ring = pairs.where("not whole").select("a", "b")
    ringed = ring.select(F.col("a").alias("ball")).union(ring.select(F.col("b").alias("ball"))).distinct()
    dealt = members.join(ringed, "ball", "left_semi").join(size.withColumn("blocks", F.ceil(F.col("size") / MEMBERS)).drop("size"), "ball")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")))
    # A block holds about MEMBERS rows, whatever the ball.
    blocks = dealt.groupBy("ball", "block").agg(F.collect_list(F.struct("_row", "u")).alias("rows"))
    blocks = stash(blocks.select("ball", F.col("rows._row").alias("rows"), F.col("rows.u").alias("us")))
    left = blocks.select(F.col("ball").alias("a"), F.col("rows").alias("x"), F.col("us").alias("ux"))
    right = blocks.select(F.col("ball").alias("b"), F.col("rows").alias("y"), F.col("us").alias("uy"))

    def members_linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for one in b.itertuples(index=False):
                near = stacked(one.ux) @ stacked(one.uy).T >= cosine
                for rows, some in ((one.x, near.sum(1)), (one.y, near.sum(0))):
                    on = some > 0
                    yield pd.DataFrame({"a": one.a, "b": one.b, "_row": np.asarray(rows)[on], "some": some[on]})

    listed = stash(ring.join(left, "a").join(right, "b").mapInPandas(members_linked, "a bigint, b bigint, _row bigint, some bigint"))
    by_row = listed.groupBy("_row").agg(F.sum("some").alias("some"))

    joined = components(whole.union(listed.select("a", "b").distinct())).select(F.col("id").alias("ball"), "component")
    per_row = (
        members.select("_row", "ball")
        .join(ids, "_row")
        .join(size, "ball")
        .join(by_ball, "ball", "left")
        .join(joined, "ball", "left")
        .join(by_row, "_row", "left")
        .withColumn("component", F.coalesce("component", "ball"))
    )
    least_id = per_row.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    links = F.col("size") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("some", F.lit(0))
    out = per_row.join(least_id, "component").select(
        "vec_id", links.cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
    out = stash(out)
    discard(rows, members, heads, counted, pairs, blocks, listed)
    return out
