"""Secret scans: pattern spans plus sliding-window entropy, in column expressions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns.  The entropy method
adds candidate strings: over each maximal run of a character class a window slides one character at a
time, and the scan carries the count of every character in it.  With counts c in a window of W, its
Shannon entropy is ``log2 W - (sum c log2 c) / W``; a step changes two counts, so the sum is updated by
their two differences.  Windows that reach the class's entropy and hold a digit and a letter are
suspect; those that overlap a match of the allow-list are suppressed, and those that overlap one
another make one span.  Runs already inside a base span are left out.

Null or empty texts have no spans (counts 0, digest of the empty string); rows repeat as they are;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole
from .spans import count_kind, digest, in_order, match_spans, no_spans, replaced

#: The look-ahead and look-behinds change no match: a keyword starts with one of these letters, and a
#: long run is found from its first character.
ASSIGN = (
    "(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """A character class, its window and the entropy (bits per character) from which it is suspect."""

    kind: str
    chars: str
    window: int
    bits: float


#: A uniformly random window of 20 has 3.3 bits over 16 symbols, 3.9 over 36 and 4.1 over 64 on average.
CLASSES = (
    CharClass("entropy_hex", "0-9A-F", 20, 2.9),
    CharClass("entropy_upper", "0-9A-Z", 20, 3.4),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.7),
)

#: What looks random but is public: digests, placeholders, alphabets, one character again and again.
ALLOW = "(?i)example|placeholder|sha(?:1|256|384|512)[-_=:][A-Za-z0-9+/=]{0,128}|0123456789|abcdefghij|(.)\\1{9,}"

FOUND = "array<struct<first:int,last:int>>"


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def symbols(chars: str) -> tuple[str, int, int]:
    """(all characters of a class, digits first and then letters; how many digits; how many digits and letters)."""
    out = sorted({chr(c) for lo, hi in re.findall("(\\w)-(\\w)", chars) for c in range(ord(lo), ord(hi) + 1)} | set(re.sub("\\w-\\w", "", chars)))
    digits, letters = [c for c in out if c.isdigit()], [c for c in out if c.isalpha()]
    rest = [c for c in out if not c.isalnum()]
    return "".join(digits + letters + rest), len(digits), len(digits) + len(letters)


def suspect_windows(run: Column, cls: CharClass, allowed: Column) -> Column:
    """``[struct(first, last)]``, 0-based and end-exclusive: where windows of ``run`` are suspect.

    ``allowed``: spans of ``run`` that suppress the windows that they overlap.
    """
    w = cls.window
    most = w * (math.log2(w) - cls.bits) + 1e-9
    letters, n_digits, n_plain = symbols(cls.chars)

    def scan(codes: Column) -> Column:
        def step(a: Column, j: Column) -> Column:
            into, out = F.get(codes, j), F.coalesce(F.get(codes, j - w), F.lit(-1))

            def moved(into: Column, out: Column) -> Column:
                left = F.coalesce(F.get(a["counts"], out), F.lit(0))
                here = F.get(a["counts"], into) - (into == out).cast("int")
                s = a["s"] + _clog(left - 1) - _clog(left) + _clog(here + 1) - _clog(here)
                digits = a["digits"] + (into < n_digits).cast("int") - out.between(0, n_digits - 1).cast("int")
                plain = a["plain"] + (into < n_plain).cast("int") - out.between(0, n_plain - 1).cast("int")
                counts = F.transform(a["counts"], lambda c, k: c + (k == into).cast("int") - (k == out).cast("int"))
                return F.struct(counts.alias("counts"), s.alias("s"), digits.alias("digits"), plain.alias("plain"))

            def judged(m: Column) -> Column:
                first, last = j - w + 1, j + 1
                suspect = (first >= 0) & (m["s"] <= most) & (m["digits"] > 0) & (m["plain"] > m["digits"])
                suspect &= ~F.exists(allowed, lambda x: (x["start"] < last) & (x["end"] > first))
                span = lambda lo: F.array(F.struct(lo.alias("first"), last.alias("last")))
                before = F.get(a["found"], F.size(a["found"]) - 1)
                found = (
                    F.when(~suspect, a["found"])
                    .when(before["last"] >= first, F.concat(F.slice(a["found"], 1, F.size(a["found"]) - 1), span(before["first"])))
                    .otherwise(F.concat(a["found"], span(first)))
                )
                return F.struct(m["counts"].alias("counts"), m["s"].alias("s"), m["digits"].alias("digits"), m["plain"].alias("plain"), found.alias("found"))

            return let(let(into, lambda x: let(out, lambda y: moved(x, y))), judged)

        start = F.struct(
            F.array_repeat(F.lit(0), len(letters)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("digits"), F.lit(0).alias("plain"),
            F.from_json(F.lit("[]"), FOUND).alias("found"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["found"])

    chars = F.filter(F.split(run, ""), lambda x: x != "")
    return let(F.transform(chars, lambda c: F.instr(F.lit(letters), c) - 1), scan)


def base_spans(text: Column) -> Column:
    """The pattern spans, in order."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return in_order(
        F.concat(
            F.when(assigns, match_spans(text, ASSIGN, "assign", 0, long_value)).otherwise(no_spans()),
            match_spans(text, ACCESS, "access", 1),
            match_spans(text, HEX, "hex", 2),
        )
    )


def entropy_spans(text: Column, base: Column, classes=CLASSES, allow: str = ALLOW) -> Column:
    """High-entropy runs that neither the allow-list nor a base span covers."""

    def suspects(k: int, cls: CharClass) -> Column:
        runs = match_spans(text, f"(?<![{cls.chars}])[{cls.chars}]{{{cls.window},}}", cls.kind, len(BASE_KINDS) + k)

        def spans(s: Column) -> Column:
            named = F.when(F.regexp_like(s["m"], F.lit(allow)), match_spans(s["m"], allow, "allow", 0)).otherwise(no_spans())
            return F.transform(
                let(named, lambda a: suspect_windows(s["m"], cls, a)),
                lambda e: F.struct(
                    (s["start"] + e["first"]).alias("start"),
                    s["rank"].alias("rank"),
                    (s["start"] + e["last"]).alias("end"),
                    s["kind"].alias("kind"),
                    F.substring(s["m"], e["first"] + 1, e["last"] - e["first"]).alias("m"),
                ),
            )

        fit = F.filter(runs, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
        return F.flatten(F.transform(fit, spans))

    found = [suspects(k, cls) for k, cls in enumerate(classes)]
    return in_order(F.concat(*found))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` packed in a struct ``r``, with ``base`` and ``added`` span arrays."""
    packed = docs.select(F.struct("*").alias("r"), whole(F.col(f"`{text_col}`")).alias("t"))
    based = packed.withColumn("base", base_spans(F.col("t")))
    return based.withColumn("added", entropy_spans(F.col("t"), F.col("base")))


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts per pattern, digest of the base spans and all spans."""
    s = scan_secrets(docs.select("doc_id", "text"))
    return s.select(
        F.col("r.doc_id").alias("doc_id"),
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(in_order(F.concat("base", "added"))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``<KIND>``; ``length_col``, if there, follows the new text.

    Texts without a span, null ones too, stay as they are.
    """
    s = scan_secrets(docs, text_col).withColumn("spans", in_order(F.concat("base", "added")))
    s = s.withColumn(
        "clean",
        F.when(F.size("spans") > 0, replaced(F.col("t"), F.col("spans"), lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))),
    )
    out = []
    for c in docs.columns:
        old = F.col("r")[c]
        if c == text_col:
            old = F.coalesce(F.col("clean"), old)
        elif c == length_col:
            old = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return s.select(*out)
