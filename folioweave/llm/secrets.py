"""Secret scans: patterns, and Shannon entropy in sliding windows, with an allow-list.  DataFrame functions only.

Base kinds (patterns, leftmost non-overlapping, failing matches dropped): assign, access, hex.
Method kinds: entropy_hex and entropy_b64.  Maximal runs of a character class of at least WINDOW characters are
candidates; a window of WINDOW characters slides over each, its character counts are kept by adding what enters and taking off
what leaves (in constant work, see hot_in), and with them the sum of c*log2(c), in millionths, so that every engine gets the same integers.  Windows whose
entropy reaches the class's threshold are merged into spans.  A candidate on the allow-list, and a
span that a base span covers already, is suppressed.

Defined cases: null text counts as empty (no spans, sha256 of nothing); rows are independent, so repeated ids or texts give
equal rows each; an empty table gives no rows; other columns, whatever they are called, are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPAN, as_spans, fold_out, joined, joined_sql, let, matches_sql, quoted, redacted, span, stepped, table, with_matches

NAMED = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?"
)
ASSIGN = NAMED + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of [0-9a-f]+ that are long enough
WINDOW = 20
SCALE = 1_000_000
#: Class: its characters as a regular expression, its alphabet (the counts' order), and the least entropy in bits.
CLASSES = {
    "entropy_hex": ("[0-9a-f]", "0123456789abcdef", 2.9),
    "entropy_b64": ("[A-Za-z0-9+/_-]", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.6),
}
#: Candidates that match one of these as a whole are no secrets: words, numbers, UUIDs, placeholders.
ALLOW = (
    r"[A-Za-z][A-Za-z_/+-]*",
    r"[0-9_/+-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i).*(?:example|changeme|placeholder|xxxxxxxx|01234567|abcdefgh).*",
)


def sum_table(window: int) -> list[int]:
    return [round(SCALE * c * math.log2(c)) if c else 0 for c in range(window + 1)]


def sum_limit(window: int, bits: float) -> int:
    """Entropy >= bits if and only if the sum of c*log2(c) is at most this."""
    return math.floor(SCALE * window * (math.log2(window) - bits) + 1e-6)


#: A character's count is a field of so many bits in one of several whole numbers; WINDOW is below 1 << BITS.
BITS, PER_WORD = 5, 12


def hot_in(characters: Column, alphabet: str, window: int, bits: float) -> Column:
    """Merged windows of an array of characters (offsets in it) whose entropy reaches bits: array<struct<start:int,end:int>>.

    The counts of a window's characters are fields of a few whole numbers, so that a step adds what enters and takes off what leaves in constant work.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    codes = F.transform(characters, lambda c: F.instr(F.lit(alphabet), c) - 1)
    sums = F.array(*[F.lit(x).cast("bigint") for x in sum_table(window)])
    units = F.array(*[F.lit(1 << BITS * k).cast("bigint") for k in range(PER_WORD)])
    limit, words = sum_limit(window, bits), -(-len(alphabet) // PER_WORD)
    one = lambda begin, end: F.array(F.struct(begin.alias("start"), end.alias("end")))

    def slide(a: Column, t: Column, u: Column) -> Column:
        word = lambda code: F.floor(code / PER_WORD).cast("int")
        counted = lambda n, code: F.call_function("shiftright", n[word(code)], code % PER_WORD * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        first = F.struct(
            F.array_repeat(F.lit(0).cast("bigint"), words).alias("n"), F.lit(0).cast("bigint").alias("s"), F.lit(-1).alias("from"), F.lit(-1).alias("to"),
        )

        def step(acc: Column, i: Column) -> Column:
            enters, full = a[i], i >= window
            leaves = F.when(full, a[F.greatest(i - window, F.lit(0))]).otherwise(F.lit(-1))
            return let(F.struct(enters.alias("enters"), leaves.alias("leaves")), lambda x: counts(acc, i, x.enters, x.leaves, full))

        def counts(acc: Column, i: Column, enters: Column, leaves: Column, full: Column) -> Column:
            out_word, out_unit = F.when(full, word(leaves)).otherwise(F.lit(-1)), u[F.greatest(leaves, F.lit(0)) % PER_WORD]
            was = F.when(full, counted(acc.n, F.greatest(leaves, F.lit(0)))).otherwise(F.lit(1))
            now = counted(acc.n, enters) - F.when(leaves == enters, F.lit(1)).otherwise(F.lit(0))
            s = acc.s - F.when(full, let(was, lambda c: t[c] - t[c - 1])).otherwise(F.lit(0).cast("bigint")) + let(now, lambda c: t[c + 1] - t[c])
            add = F.lit(0).cast("bigint")
            n = F.transform(acc.n, lambda v, j: v + F.when(j == word(enters), u[enters % PER_WORD]).otherwise(add) - F.when(j == out_word, out_unit).otherwise(add))
            begin = i - (window - 1)

            def moved(x: Column) -> Column:
                hot = (begin >= 0) & (x.s <= limit)
                apart = hot & (begin > acc["to"])
                after = F.struct(x.n.alias("n"), x.s.alias("s"), F.when(apart, begin).otherwise(acc["from"]).alias("from"), F.when(hot, i + 1).otherwise(acc["to"]).alias("to"))
                return stepped(after, F.when(apart & (acc["to"] >= 0), one(acc["from"], acc["to"])).otherwise(empty))

            return let(F.struct(n.alias("n"), s.alias("s")), moved)

        done = fold_out(F.sequence(F.lit(0), F.size(a) - 1), first, step, "struct<start:int,end:int>")
        return let(done, lambda d: F.when(d.state["to"] >= 0, F.concat(d.out, one(d.state["from"], d.state["to"]))).otherwise(d.out))

    return let(codes, lambda a: let(sums, lambda t: let(units, lambda u: slide(a, t, u))))


def characters_of(value: Column) -> Column:
    return F.slice(F.split(value, ""), F.lit(1), F.length(value))


def hot_windows(value: Column, alphabet: str, window: int, bits: float) -> Column:
    """hot_in() of a string."""
    return let(characters_of(value), lambda cs: hot_in(cs, alphabet, window, bits))


def in_candidate(kind: str, rank: int, alphabet: str, bits: float):
    def spans(m: Column) -> Column:
        def cut(cs: Column) -> Column:
            at = lambda w: span(m.start + w.start, m.start + w.end, rank, kind, F.array_join(F.slice(cs, w.start + 1, w.end - w.start), ""))
            return F.transform(hot_in(cs, alphabet, WINDOW, bits), at)

        return let(characters_of(m.value), cut)

    return spans


def not_covered(found: Column, base: Column) -> Column:
    """The spans of found that no base span covers, by one pass over both in the order of their starts."""
    row = lambda s, own: F.struct(s.start.alias("start"), F.lit(own).alias("own"), s.end.alias("end"), s.alias("span"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: row(b, 0)), F.transform(found, lambda s: row(s, 1))))

    def step(reach: Column, x: Column) -> Column:
        bare = (x.own == 1) & (x.end > reach)
        return stepped(F.when(x.own == 0, F.greatest(reach, x.end)).otherwise(reach), F.when(bare, F.array(x.span)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))

    return fold_out(events, F.lit(-1), step, SPAN).out


def find_secrets(df: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df's id-like columns are the caller's: adds `base` and `added`, arrays of SPAN, to df[text_col] (null: empty)."""
    df = df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX} | {f"_{k}": f"{c}{{{WINDOW},}}" for k, (c, _, _) in CLASSES.items()}
    df = with_matches(df, text_col, patterns)
    base = F.concat(
        as_spans(F.filter("_assign", lambda m: F.length(F.regexp_replace(m.value, f"^{NAMED}", "")) >= 8), 0, "assign"),
        as_spans(F.filter("_access", lambda m: F.length(m.value) >= 16), 1, "access"),
        as_spans(F.col("_hex"), 2, "hex"),
    )
    df = df.withColumn("base", base)
    listed = "|".join(f"(?:{x})" for x in allow)
    added = []
    for rank, (kind, (_, alphabet, bits)) in enumerate(CLASSES.items(), 3):
        kept = F.filter(f"_{kind}", lambda m: ~m.value.rlike(f"^(?:{listed})$")) if allow else F.col(f"_{kind}")
        found = F.flatten(F.transform(kept, in_candidate(kind, rank, alphabet, bits)))
        added.append(F.when(F.size(kept) > 0, not_covered(found, F.col("base"))).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")))
    return df.withColumn("added", F.concat(*added)).drop(*patterns)


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: one row per document."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by [SECRET]; n_chars follows the new text."""
    columns = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("body"))
    found = find_secrets(inner, "body")
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(redacted(F.col("body"), F.concat("base", "added"), "[SECRET]"))
    found = found.select("row", text.alias("body"))
    new = {"text": F.col("body"), "n_chars": F.length("body").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def oracle() -> str:
    """SQL for scan(): every window's characters are counted anew, and hot windows merge as islands."""
    named = {"assign": (0, ASSIGN), "access": (1, ACCESS), "hex": (2, "[0-9a-f]+")}
    classes = {k: (rank, f"{c}{{{WINDOW},}}") for rank, (k, (c, _, _)) in enumerate(CLASSES.items(), 3)}
    limits = " ".join(f"WHEN '{k}' THEN {sum_limit(WINDOW, bits)}" for k, (_, _, bits) in CLASSES.items())
    listed = quoted("|".join(f"(?:{x})" for x in ALLOW))
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({matches_sql(named)}) WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(value, {quoted("^" + NAMED)}, '')) >= 8 WHEN 'access' THEN length(value) >= 16 ELSE length(value) >= 32 END),
runs AS (SELECT * FROM ({matches_sql(classes)}) WHERE NOT regexp_full_match(value, {listed})),
windows AS (SELECT rid, rank, kind, i, start + w AS b, list_sum(list_transform(map_values(list_histogram(string_split(substr(value, w + 1, {WINDOW}), ''))), lambda n: {sum_table(WINDOW)}[n::BIGINT + 1])) AS s
  FROM runs, unnest(range(0, length(value) - {WINDOW - 1})) AS u(w)),
hot AS (SELECT *, coalesce(b > lag(b) OVER (PARTITION BY rid, rank, i ORDER BY b) + {WINDOW}, true) AS fresh FROM windows WHERE s <= CASE kind {limits} END),
islands AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid, rank, i ORDER BY b) AS island FROM hot),
added AS (SELECT rid, rank, kind, min(b) AS start, max(b) + {WINDOW} AS "end" FROM islands GROUP BY rid, rank, kind, i, island),
spans AS (SELECT rid, rank, kind, start, "end" FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = a.rid AND b.start <= a.start AND b."end" >= a."end"))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({joined_sql("rank < 3", 'start, rank, "end"')}) AS base_sha256, {joined_sql("rank IS NOT NULL", 'start, rank, "end"')} AS spans FROM docs LEFT JOIN spans USING (rid) GROUP BY rid"""


ORACLE = oracle()
