"""Links and connected components as joins, for groups of any size.

Members of a group (an anchor) may be linked if at least one of them is at home there.  A group can be
a large part of all rows, so its pairs are never listed: first each member is compared with its groups'
leaders; then, only where members of one group are still apart, those outside the leader's component
are compared with the whole group.  No pair of different components goes uncompared, so the components
are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


#: Edges that a task takes when labels travel along them.
EDGES_EACH = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    Smallest labels travel along the edges and then along the labels, which halves path lengths; the
    state is written to the shared folder after every round, and the last round's is deleted.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    n = both.count()
    if not n:
        out = both.select(F.col("a").alias("id"), F.col("b").alias("component"))
        out.stash_path = both.stash_path
        return out
    tasks = 1 + n // EDGES_EACH  # few edges are not worth many small files
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")).coalesce(tasks))
    while True:
        heard = both.join(labels, both["a"] == labels["id"]).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "id").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("end"))
        new = stash(lower.join(jump, "mid", "left").select("id", "old", F.least("mid", "end").alias("component")).coalesce(tasks))
        changed = new.where("old <> component").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            out = new.drop("old")
            out.stash_path = new.stash_path
            return out


def anchored_links(met: DataFrame, place: list[str], close: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): links that give the components of all links.

    ``met``: the columns ``place`` that name a group, id, home, and leader, the group's least id at home.
    ``close(x, y)`` tells from two ids whether they link.
    """
    first = met.where((F.col("id") != F.col("leader")) & close(F.col("id"), F.col("leader")))
    first = stash(first.groupBy(F.col("id").alias("a")).agg(F.min("leader").alias("b")))
    label = components(first).withColumnRenamed("component", "label")
    chief = label.select(F.col("id").alias("leader"), F.col("label").alias("chief"))
    labelled = met.join(label, "id", "left").join(chief, "leader", "left")
    labelled = stash(
        labelled.select(*place, "id", "home", F.coalesce("label", "id").alias("label"), F.coalesce("chief", "leader").alias("chief"))
    )
    here, there = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    apart = labelled.where("label <> chief").drop("chief")
    same = here(place[0]) == there(place[0])
    for c in place[1:]:
        same &= here(c) == there(c)
    second = (
        apart.alias("l")
        .join(labelled.drop("chief").alias("r"), same & (here("label") != there("label")) & (here("home") | there("home")) & close(here("id"), there("id")))
        .select(F.least(here("id"), there("id")).alias("a"), F.greatest(here("id"), there("id")).alias("b"))
        .distinct()
    )
    links = stash(second.union(first))
    discard(first, labelled)
    return links
