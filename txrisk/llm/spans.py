"""Code-point spans of regular-expression matches, as plain column expressions.

Spark has no function that returns all match positions.  The matches and the gaps between them
come from one expression each (``regexp_extract_all`` and ``split`` scan alike, leftmost and
non-overlapping), and the positions are running sums of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Matches whose lengths are summed at a time; two levels keep the running sums near-linear.
BLOCK = 64

#: Element type of every span array: order of the kind, its name and the matched text.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,m:string>>"


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def _total(lengths: Column, first: Column, count: Column) -> Column:
    return F.when(count <= 0, F.lit(0)).otherwise(
        F.aggregate(F.slice(lengths, first, F.greatest(count, F.lit(1))), F.lit(0), lambda a, x: a + x)
    )


def _positions(hits: Column, gaps: Column) -> Column:
    """The 0-based start of each match, from the matches and the gaps before them."""
    n = F.size(hits)

    def starts(lengths: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), ((n - 1) / F.lit(BLOCK)).cast("int")),
            lambda b: _total(lengths, b * BLOCK + 1, F.lit(BLOCK)),
        )
        return let(
            blocks,
            lambda sums: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: _total(sums, F.lit(1), (i / F.lit(BLOCK)).cast("int"))
                + _total(lengths, (i / F.lit(BLOCK)).cast("int") * BLOCK + 1, i % BLOCK)
                + F.length(gaps[i]),
            ),
        )

    return let(F.transform(hits, lambda m, i: F.length(gaps[i]) + F.length(m)), starts)


def match_spans(text: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Spans of ``pattern`` in ``text`` whose matched text satisfies ``keep``.

    Starts count code points from 0; ends are exclusive.  No match gives an empty array.
    """

    def found(hits: Column) -> Column:
        located = let(
            F.split(text, pattern, -1),
            lambda gaps: let(
                _positions(hits, gaps),
                lambda at: F.transform(
                    hits,
                    lambda m, i: F.struct(
                        at[i].alias("start"),
                        F.lit(rank).alias("rank"),
                        (at[i] + F.length(m)).alias("end"),
                        F.lit(kind).alias("kind"),
                        m.alias("m"),
                    ),
                ),
            ),
        )
        return F.when(F.size(hits) > 0, located).otherwise(no_spans())

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return F.filter(spans, lambda s: keep(s["m"])) if keep else spans


def in_order(spans: Column) -> Column:
    """Sorted by start, then by the rank of the kind."""
    return F.array_sort(spans)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: Column, spans: Column, mask) -> Column:
    """``text`` with every span replaced by ``mask(span)``; a span inside an earlier one is dropped.

    Overlapping spans are merged into the first one's mask.
    """
    merged = F.aggregate(
        spans,
        F.from_json(F.lit('{"end":0,"out":[]}'), "struct<end:int,out:array<struct<lo:int,from:int,to:int,mask:string>>>"),
        lambda a, s: F.when(
            s["start"] >= a["end"],
            F.struct(
                s["end"].alias("end"),
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            a["end"].alias("lo"), s["start"].alias("from"), s["end"].alias("to"), mask(s).alias("mask")
                        )
                    ),
                ).alias("out"),
            ),
        ).when(
            s["end"] > a["end"],
            F.struct(
                s["end"].alias("end"),
                F.concat(
                    F.slice(a["out"], 1, F.size(a["out"]) - 1),
                    F.array(
                        let(
                            F.element_at(a["out"], -1),
                            lambda t: F.struct(t["lo"].alias("lo"), t["from"].alias("from"), s["end"].alias("to"), t["mask"].alias("mask")),
                        )
                    ),
                ).alias("out"),
            ),
        ).otherwise(a),
    )
    pieces = lambda a: F.concat(
        F.array_join(
            F.transform(a["out"], lambda t: F.concat(F.substring(text, t["lo"] + 1, t["from"] - t["lo"]), t["mask"])), ""
        ),
        F.substring(text, a["end"] + 1, F.length(text)),
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(merged, pieces))
