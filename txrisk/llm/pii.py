"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.  Each distinct base
value is a protected entity.  Terms of a document that holds an entity may reveal it: over the whole
corpus, with N documents, df(t) documents that hold the term, df(e) that hold the entity and co(t, e)
that hold the entity and the term outside of its base spans, the disclosure of e by t is

    log2(N * co / (df(t) * df(e))) / log2(N / df(e)),

the share of the entity's information that the term gives away; 1 means that the term is only seen
with it.  A term is generalised from ``GENERALISE`` and removed from ``REMOVE``, wherever it stands in a
document that holds the entity.  Every pair is judged, also one that meets in a single document.

Since co is df(e) at most, a term with df(t) > df(e) * (N / df(e)) ** (1 - GENERALISE) reaches
``GENERALISE`` with no entity of that df(e); such pairs, which are most, are left out before counting.

All of it is column expressions and joins.  Null and empty texts have no spans; rows that repeat count
as often as they occur and get the same spans; a null ``doc_id`` is an id like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, discard, keyed, let, stash, whole
from .spans import count_kind, digest, in_order, match_spans, no_spans, replaced

# The possessive forms match what the plain patterns match, in linear time and without recursion: a
# local part is found from its first character or from the end of the match before it.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE_KINDS = ("email", "ip", "card", "phone")

TERM = "\\p{L}{3,}"
GENERALISE = 0.5
REMOVE = 0.8
#: A joined side is broadcast up to so many rows (about 10 MB), and shuffled beyond.
SMALL_ROWS = 100_000
#: Terms of more than this share of the documents are left out before words are shuffled, if they can reveal nothing.
HOT_SHARE = 0.001


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def total(d: Column) -> Column:
        n = F.size(d)
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.lit(0),
            lambda a, i: a
            + let(
                d[n - 1 - i].cast("int") * (1 + i % 2),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )

    return let(F.filter(F.split(digits, ""), lambda c: c != ""), total) % 10 == 0


def _card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> Column:
    def when(cond: Column, spans: Column) -> Column:
        return F.when(cond, spans).otherwise(no_spans())

    digit = F.regexp_like(text, F.lit("[0-9]"))
    return in_order(
        F.concat(
            when(F.contains(text, F.lit("@")), match_spans(text, EMAIL, "email", 0)),
            when(digit & F.contains(text, F.lit(".")), match_spans(text, IP, "ip", 1, lambda m: F.regexp_like(m, F.lit(f"^(?:{PART}\\.){{3}}{PART}$")))),
            when(digit, match_spans(text, CARD, "card", 2, _card)),
            when(F.contains(text, F.lit("+")), match_spans(text, PHONE, "phone", 3, _phone)),
        )
    )


def terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case: what ``TERM`` matches."""
    runs = F.filter(F.split(text, "\\P{L}+"), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.transform(runs, F.lower))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``right`` is broadcast behind a check of its size, else both sides are shuffled."""
    return left.join(F.broadcast(right) if right.count() <= SMALL_ROWS else right, on, how)


def protected(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row number and base spans per row; and the added term spans by row number."""
    text = whole(F.col(f"`{text_col}`"))
    rows = docs.select(F.col("*"), text.alias("_t")).withColumn("_base", base_spans(F.col("_t")))
    rows = stash(
        rows.withColumn("_text", F.when(F.size("_base") > 0, F.col("_t")))
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_t", text_col)
    )
    found = rows.where("size(_base) > 0")
    n = float(rows.count())
    values = F.array_distinct(F.transform("_base", lambda b: F.concat_ws(":", b["kind"], F.lower(b["m"]))))
    holds = found.select("_row", F.explode(values).alias("entity"))
    entities = holds.groupBy("entity").agg(F.count("*").alias("df_e"))
    holds = stash(holds.join(entities, "entity"))
    # Each row's terms outside of its base spans, and in how many documents they stand.
    own = stash(found.select("_row", F.explode(terms(replaced(F.col("_text"), F.col("_base"), lambda b: F.lit(" ")))).alias("term")))
    words = docs.select(F.explode(terms(text)).alias("term"))
    df = words.groupBy("term").agg(F.count("*").alias("df_t"))
    df = stash(df.join(own.select("term").distinct(), "term", "left_semi"))
    # No entity of the row is so frequent that a more frequent term could reveal it; 1e-9 is for rounding.
    bound = F.col("df_e") * F.pow(F.lit(n) / F.col("df_e"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    most_df = stash(holds.groupBy("_row").agg(F.max(bound).alias("most_df")))
    # Words like "the" stand in most rows.  They are few: a text of w terms on average has w / HOT_SHARE at most.
    top = most_df.agg(F.max("most_df")).first()[0] or 0.0
    hot = df.where(F.col("df_t") > max(top, n * HOT_SHARE)).select("term")
    rare = own.join(F.broadcast(hot), "term", "left_anti")
    rare = _joined(rare, df, ["term"]).join(most_df, "_row").where("df_t <= most_df").select("_row", "term", "df_t")
    meet = stash(rare.join(holds, "_row").where(F.col("df_t") <= bound))
    discard(own, df, most_df)
    bits = F.log2(F.lit(n) * F.col("co") / (F.col("df_t").cast("double") * F.col("df_e")))
    most = F.log2(F.lit(n) / F.col("df_e"))
    judged = stash(
        meet.groupBy("entity", "term", "df_t", "df_e")
        .agg(F.count("*").alias("co"))
        .withColumn("disclosure", F.when(most > 0, bits / F.when(most > 0, most)).otherwise(0.0))
        .where(F.col("disclosure") >= GENERALISE)
        .select("entity", "term", F.when(F.col("disclosure") >= REMOVE, "term_removed").otherwise("term_general").alias("kind"))
    )
    marks = (
        _joined(meet.select("_row", "entity", "term"), judged, ["entity", "term"])
        .groupBy("_row", "term")
        .agg(F.max("kind").alias("kind"))  # "removed" wins over "general"
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("_kinds"))
    )
    # Every occurrence that no base span covers.
    held = found.select("_row", "_text", "_base").join(marks, "_row")
    kinds, base = F.col("_kinds"), F.col("_base")
    spans = F.filter(
        match_spans(F.col("_text"), TERM, "term", 4),
        lambda t: F.map_contains_key(kinds, F.lower(t["m"])) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])),
    )

    def marked(t: Column) -> Column:
        kind = F.element_at(kinds, F.lower(t["m"]))
        return F.struct(t["start"], F.when(kind == "term_removed", 5).otherwise(4).alias("rank"), t["end"], kind.alias("kind"), F.lit("").alias("m"))

    added = stash(held.select("_row", F.transform(spans, marked).alias("_added")))
    discard(holds, meet, judged)
    return rows.drop("_text"), added


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts per pattern, digest of the base spans and all spans."""
    rows, added = protected(docs.select("doc_id", "text"))
    s = rows.join(added, "_row", "left").withColumn("_all", in_order(F.concat("_base", F.coalesce("_added", no_spans()))))
    return s.select(
        "doc_id",
        *[count_kind(F.col("_base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(digest(F.col("_base")), 256).alias("base_sha256"),
        digest(F.col("_all")).alias("spans"),
    )


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base spans masked by kind, general terms by ``<TERM>`` and removed terms left out.

    All rows count in the corpus statistics, repeated ones too, as in ``pii_digest``, and spans come back to
    their rows by key.
    """
    packed = keyed(docs)
    rows, added = protected(packed.select(*KEY, F.col("r")[text_col].alias("text")))
    s = rows.join(added, "_row", "left").withColumn("_all", in_order(F.concat("_base", F.coalesce("_added", no_spans()))))
    marked = _joined(packed, stash(s.where("size(_all) > 0").select(*KEY, "_all")), KEY, "left")
    mask = lambda x: F.when(x["kind"] == "term_removed", F.lit("")).when(
        x["kind"] == "term_general", F.lit("<TERM>")
    ).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    old = F.col("r")[text_col]
    clean = F.when(F.col("_all").isNull(), old).otherwise(replaced(old, F.col("_all"), mask))
    return marked.select(*[(clean if c == text_col else F.col("r")[c]).alias(c) for c in docs.columns])
