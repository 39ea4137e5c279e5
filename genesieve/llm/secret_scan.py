r"""Secret scan with SQL functions only: patterns, and sliding-window entropy.

Base kinds are leftmost non-overlapping matches: ``assign`` (a key word, an assignment
sign, a value of six characters or more), ``access`` and ``hex``.  Beside them, every run
of at least ``WINDOW`` key characters is a candidate.  A window of ``WINDOW`` characters
slides over it, once per character class; counts per symbol are kept as the window moves,
and the sum of n log n moves with the two counts that change.  Where the Shannon entropy
reaches the class's limit, the stretch from the first to the last such window is a span of
kind ``entropy``.  Candidates that match the allow list are suppressed; base spans stay.

Positions come from the lengths of the matches and of the gaps between them, summed up in
blocks, so a text with many matches costs little more than their number.

Edge cases: a null or empty text has no spans; equal spans of different kinds stay both;
repeated rows get equal results; a null id is kept; no rows in, no rows out.  Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds and the least lengths that count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# Character classes and the bits per character that a window of each must reach.
CLASSES = (
    ("0123456789abcdef", 3.2),
    ("0123456789ABCDEF", 3.2),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
)
# Words that mark a made-up value, plain sequences, and two path steps of small letters in a row.
ALLOW = r"(?i:example|sample|dummy|placeholder|changeme|0123456789|abcdefghij)|(?:/[a-z_-]{3,}){2}"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _starts(matched: Column, gaps: Column) -> Column:
    """Start of each match, from the lengths of matches and of the gaps before them."""
    steps = F.zip_with(matched, F.slice(gaps, F.lit(1), F.size(matched)), lambda m, g: m + g)

    def in_blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), last),
            lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x),
        )
        ahead = F.aggregate(
            sums, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")),
        )["all"]
        return let(ahead, lambda ahead: F.transform(
            gaps_of(steps),
            lambda gap, i: ahead[F.floor(i / BLOCK).cast("int")] + gap + F.aggregate(
                F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x
            ),
        ))

    def gaps_of(steps: Column) -> Column:
        return F.slice(gaps, F.lit(1), F.size(steps))

    return let(steps, in_blocks)


def spans(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of a pattern whose ``group`` has ``least`` characters: start, kind, end."""
    lengths = lambda strings: F.transform(strings, F.length)
    parts = F.struct(
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("matched"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("value"),
        lengths(F.split(text, pattern, -1)).alias("gaps"),
    )

    def placed(p: Column) -> Column:
        rows = F.arrays_zip(_starts(p["matched"], p["gaps"]).alias("start"), p["matched"].alias("n"), p["value"].alias("v"))
        return F.transform(
            F.filter(rows, lambda r: r["v"] >= least),
            lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), (r["start"] + r["n"]).alias("end")),
        )

    return F.when(text.rlike(pattern), let(parts, placed))


def _log_term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def entropy_stretch(candidate: Column, symbols: str, limit: float, window: int = WINDOW) -> Column:
    """First start and last end of the windows of one class that reach ``limit`` bits.

    The state holds the counts of the window's symbols, how many characters it has, and
    the sum of n log2 n over the counts: entropy is log2(window) - sum / window.
    """
    width = len(symbols)
    most = window * (math.log2(window) - limit)
    codes = F.transform(F.split(candidate, "", -1), lambda c: F.when(c != "", F.instr(F.lit(symbols), c)).otherwise(0))

    def slide(codes: Column) -> Column:
        empty = F.array_repeat(F.lit(0), width)
        start = F.struct(
            empty.alias("counts"), F.lit(0).alias("filled"), F.lit(0.0).alias("sum"),
            F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )

        def step(state: Column, at: Column) -> Column:
            entering = codes[at]
            full = state["filled"] >= window
            leaving = F.when(full, codes[at - window]).otherwise(F.lit(0))
            n_in = F.element_at(state["counts"], F.greatest(entering, F.lit(1)))
            n_out = F.when(full, F.element_at(state["counts"], F.greatest(leaving, F.lit(1))))
            moved = state["sum"] + F.when(
                full, F.when(leaving == entering, F.lit(0.0)).otherwise(
                    _log_term(n_out - 1) - _log_term(n_out) + _log_term(n_in + 1) - _log_term(n_in))
            ).otherwise(_log_term(n_in + 1) - _log_term(n_in))
            filled = F.least(state["filled"] + 1, F.lit(window))
            counts = F.transform(
                state["counts"],
                lambda n, i: n + F.when(i + 1 == entering, 1).otherwise(0) - F.when(i + 1 == leaving, 1).otherwise(0),
            )
            hit = (filled == window) & (moved <= most + 1e-9)
            within = F.struct(
                counts.alias("counts"), filled.alias("filled"), moved.alias("sum"),
                F.coalesce(state["first"], F.when(hit, at - window + 1)).alias("first"),
                F.when(hit, at + 1).otherwise(state["last"]).alias("last"),
            )
            outside = F.struct(
                empty.alias("counts"), F.lit(0).alias("filled"), F.lit(0.0).alias("sum"),
                state["first"].alias("first"), state["last"].alias("last"),
            )
            return F.when(entering > 0, within).otherwise(outside)

        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), start, step,
            lambda s: F.when(s["first"].isNotNull(), F.struct(s["first"].alias("first"), s["last"].alias("last"))),
        )

    return let(codes, slide)


def entropy_spans(text: Column) -> Column:
    """Spans of kind ``entropy``: candidates with windows over a class's limit, not allowed."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("strings"), F.split(text, CANDIDATE, -1).alias("gaps")
    )

    def stretch_of(symbols: str, limit: float) -> Callable[[Column], Column]:
        return lambda r: let(entropy_stretch(r["string"], symbols, limit), lambda e: F.when(
            e.isNotNull(),
            F.struct((r["start"] + e["first"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + e["last"]).alias("end")),
        ))

    def placed(p: Column) -> Column:
        starts = _starts(F.transform(p["strings"], F.length), F.transform(p["gaps"], F.length))
        rows = F.filter(
            F.arrays_zip(starts.alias("start"), p["strings"].alias("string")), lambda r: ~r["string"].rlike(ALLOW)
        )
        found = [F.transform(rows, stretch_of(symbols, limit)) for symbols, limit in CLASSES]
        return F.array_distinct(F.filter(F.concat(*found), lambda s: s.isNotNull()))

    return F.when(text.rlike(CANDIDATE), let(parts, placed))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")),
    ), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, found``: arrays of (start, kind, end), base kinds and all kinds."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    t = F.col("text")
    found = source.select(
        "doc_id",
        F.coalesce(spans(t, ASSIGN, 0, ASSIGN_CHARS, 2), none).alias("assign"),
        F.coalesce(spans(t, ACCESS, 1, ACCESS_CHARS), none).alias("access"),
        # a run of fewer than 24 never counts, so only longer ones are looked for
        F.coalesce(spans(t, HEX[:-1] + "{%d,}" % HEX_CHARS, 2, HEX_CHARS), none).alias("hex"),
        F.coalesce(entropy_spans(t), none).alias("entropy"),
    )
    return found.select("doc_id", F.concat("assign", "access", "hex").alias("base"), F.concat("assign", "access", "hex", "entropy").alias("found"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    """Counts and digest of the base spans, from the lengths of matches and of the gaps between them."""
    quoted = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX)]
    parts = " UNION ALL ".join(
        f"""SELECT row, {kind} AS kind, {least} AS least, regexp_extract_all(text, '{pattern}') AS m,
          regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS g FROM d"""
        for kind, (pattern, least, group) in enumerate(zip(quoted, (ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS), (2, 0, 0), strict=True))
    )
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({parts}),
each AS (SELECT row, kind, least, i, length(m[i]) AS n, length(v[i]) AS value, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
placed AS (SELECT *, sum(n + gap) OVER (PARTITION BY row, kind ORDER BY i) AS upto FROM each),
spans AS (SELECT row, kind, CAST(upto - n AS BIGINT) AS a, CAST(upto AS BIGINT) AS b FROM placed WHERE value >= least),
listed AS (SELECT row, string_agg(CASE kind {names} END || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
  {", ".join(f"count(*) FILTER (kind = {i}) AS n{i}" for i in range(3))} FROM spans GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN listed USING (row)
"""


SQL = _sql()
