"""Personal data: patterns propose, checksums confirm, context words adjust the score.  DataFrame functions only.

Base kinds: email, ip, card (16 to 19 digits, Luhn), phone; leftmost non-overlapping, failing matches dropped, always kept.
Added kinds, kept from THRESHOLD on: iban (mod-97), short_card (13 to 15 digits, Luhn, context), ssn (context).
A score is the kind's PRIOR, plus BOOST if a context word stands within CONTEXT characters before the span, minus BOOST if a word that speaks
against it does (whole words; `in order` is none).  IBANs are looked for in runs of groups of capitals and digits: from each group that may begin one,
the longest of its country's registered length (any from 15 to 34 for unregistered ones) that ends at a group and passes mod-97.

The quantifiers are possessive or bounded on the left, which matches the same spans and keeps long runs linear and off the stack.

Defined cases: null text counts as empty; rows are independent, so repeated ids or texts give equal rows; an empty table
gives no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MATCH, fold_out, joined, joined_sql, last_characters, let, matches_sql, quoted, redacted, stepped, table, with_matches
from .secrets import count

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: All capitals and digits, in groups, from a possible IBAN on: it may hold several, and other words.
IBAN_RUN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
#: Registered lengths by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT, BOOST, THRESHOLD = 40, 0.4, 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "short_card": 0.3, "ssn": 0.3}
NEAR = {
    "email": r"mail|contact|courriel|correo",
    "ip": r"\bip\b|address|adresse|host|server",
    "card": r"card|credit|debit|visa|carte|karte|tarjeta",
    "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "short_card": r"card|credit|debit|visa|amex|carte|karte|tarjeta",
    "ssn": r"ssn|social security|tax id",
}
#: After `in order` has been taken out.
AGAINST = r"(?:^|[^a-z0-9])(?:version|isbn|order|invoice|serial|example)s?(?:$|[^a-z0-9])"
IN_ORDER = "in order"
#: An IBAN has at most so many groups, of one character at least beyond the first.
GROUPS = 31


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = d.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + n - F.when(n > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(F.reverse(number), total)


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks has check digits of remainder 1."""

    def rest(c: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c.substr(i, F.lit(1))) - 1
            return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), add) == 1

    return let(F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4))), rest)


def parts_fit(value: Column) -> Column:
    """Every dotted part is at most 255, leading zeros aside."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise(F.lit("0")).cast("int") <= 255))


def find_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `base` and `added`, arrays of spans with a score, to df[text_col] (null: empty)."""
    df = df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    patterns = {"_email": EMAIL, "_ip": IP, "_digits": DIGITS, "_phone": PHONE, "_iban": IBAN_RUN, "_ssn": SSN}
    df = with_matches(df, text_col, patterns, CONTEXT)
    numbers = F.filter("_digits", lambda m: F.length(m.value) >= 13)
    df = df.withColumn("_digits", F.transform(numbers, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.value.alias("value"), m.before.alias("before"), digits(m.value).alias("d"))))
    card = lambda low, high: F.filter("_digits", lambda m: F.length(m.d).between(low, high) & luhn(m.d))

    base = F.concat(
        scored(F.col("_email"), 0, "email"), scored(F.filter("_ip", lambda m: parts_fit(m.value)), 1, "ip"), scored(card(16, 19), 2, "card"),
        scored(F.filter("_phone", lambda m: F.length(digits(m.value)).between(8, 15)), 3, "phone"),
    )
    ibans = F.when(F.size("_iban") > 0, F.flatten(F.transform("_iban", ibans_in_run))).otherwise(F.expr(f"cast(array() as array<{MATCH}>)"))
    added = F.concat(scored(ibans, 4, "iban"), scored(card(13, 15), 5, "short_card"), scored(F.col("_ssn"), 6, "ssn"))
    return df.withColumns({"base": base, "added": F.filter(added, lambda s: s.score >= THRESHOLD)}).drop(*patterns)


def scored(matches: Column, rank: int, kind: str) -> Column:
    """Spans of matches, with the score that the words before them give."""

    def one(m: Column) -> Column:
        def add(before: Column) -> Column:
            near, against = before.rlike(NEAR[kind]), F.replace(before, F.lit(IN_ORDER), F.lit("")).rlike(AGAINST)
            return F.lit(PRIOR[kind]) + F.when(near, BOOST).otherwise(0.0) - F.when(against, BOOST).otherwise(0.0)

        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(F.lower(m.before), add)))
        return F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.value.alias("value"), score.alias("score"))

    return F.transform(matches, one)


def ibans_in_run(m: Column) -> Column:
    """IBANs as matches that begin and end at groups of the run m."""
    lengths = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])
    place = "struct<at:int,before:string>"

    def step(s: Column, g: Column) -> Column:
        tail = last_characters(F.concat(s.before, last_characters(g, CONTEXT), F.lit(" ")), CONTEXT)
        return stepped(F.struct((s["at"] + F.length(g) + 1).alias("at"), tail.alias("before")), F.array(s))

    def from_group(groups: Column, places: Column, i: Column) -> Column:
        def fits(k: Column) -> Column:
            def right(code: Column) -> Column:
                n = F.length(code)
                return F.when(n.between(15, 34) & (n == F.coalesce(F.element_at(lengths, code.substr(1, 2)), n)), mod97(code)).otherwise(F.lit(False))

            return let(F.array_join(F.slice(groups, i, k), ""), right)

        most = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(GROUPS), F.size(groups) - i + 1)), fits))

        def found(k: Column) -> Column:
            value, p = F.array_join(F.slice(groups, i, k), " "), F.element_at(places, i)
            start = m.start + p["at"]
            one = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), p.before.alias("before"))
            return F.when(k.isNotNull(), F.array(one)).otherwise(F.expr(f"cast(array() as array<{MATCH}>)"))

        return let(most, found)

    def in_groups(groups: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(groups)), lambda i: F.element_at(groups, i).rlike("^[A-Z]{2}[0-9]{2}"))
        first = F.struct(F.lit(0).alias("at"), m.before.alias("before"))
        return let(fold_out(groups, first, step, place).out, lambda places: F.flatten(F.transform(begins, lambda i: from_group(groups, places, i))))

    return let(F.split(m.value, " "), in_groups)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: one row per document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(count("base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(joined(F.col("base"), by_kind=True), 256).alias("base_sha256"), joined(F.concat("base", "added"), by_kind=True).alias("spans"),
        count("added", "iban").alias("n_iban"),
    )


def mask_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row stays; personal data in its text is replaced by [PII]."""
    found = find_pii(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body")), "body")
    text = F.when(F.col(f"row.`{text_col}`").isNull(), F.lit(None)).otherwise(redacted(F.col("body"), F.concat("base", "added"), "[PII]"))
    masked = found.select("row", text.alias("body"))
    return masked.select(*[F.col("body").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def fenced_sql(kind: str, rank: int, core: str, inside: str) -> str:
    """Matches of core with no character of the class `inside` on either side.

    This SQL's patterns can't look around, so each other character is written twice: one may end a match and the other begin the next.
    """
    pattern = f"(?:^|[^{inside}])(?:{core})(?:$|[^{inside}])"
    other = lambda c: f"length(regexp_replace({c}, '[{inside}]', '', 'g'))"
    real = lambda c: f"(length({c}) - {other(c)} // 2)"
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, value, start, start + length(value) AS "end" FROM (
  SELECT rid, replace(core, '  ', ' ') AS value, ({real("substr(twice, 1, cut)")})::BIGINT AS start FROM (
    SELECT m.rid, twice, regexp_replace(value, '^[^{inside}]|[^{inside}]$', '', 'g') AS core, start + (NOT regexp_matches(value, '^[{inside}]'))::INT AS cut
    FROM ({matches_sql({kind: (rank, pattern)}, f"(SELECT rid, regexp_replace(text, '([^{inside}])', chr(92) || '1' || chr(92) || '1', 'g') AS text FROM docs)")}) m
    JOIN (SELECT rid, regexp_replace(text, '([^{inside}])', chr(92) || '1' || chr(92) || '1', 'g') AS twice FROM docs) t ON t.rid = m.rid))"""


def oracle() -> str:
    """SQL for scan(), with the contract's patterns as they stand."""
    plain = {
        "email": (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": (1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "card": (2, r"[0-9](?:[\x20-]?[0-9])+"), "phone": (3, PHONE),
    }
    fits = "list_bool_and(list_transform(string_split(value, '.'), lambda p: coalesce(TRY_CAST(nullif(regexp_replace(p, '^0+', ''), '') AS HUGEINT) <= 255, regexp_full_match(p, '0+'))))"
    doubled = "list_transform(range(1, length(d) + 1), lambda k: substr(reverse(d), k, 1)::INT * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END))"
    luhn = f"list_sum(list_transform({doubled}, lambda n: CASE WHEN n > 9 THEN n - 9 ELSE n END)) % 10 = 0"
    values = "list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x)::INT - 1)"
    mod97 = f"list_reduce({values}, lambda a, n: ((a * (CASE WHEN n > 9 THEN 100 ELSE 10 END) + n) % 97)::INT) = 1"
    registered = " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items())
    prior = " ".join(f"WHEN '{k}' THEN {PRIOR[k]}::DOUBLE" for k in ("iban", "short_card", "ssn"))
    near = " ".join(f"WHEN '{k}' THEN regexp_matches(before, {quoted(NEAR[k])})" for k in ("iban", "short_card", "ssn"))
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({matches_sql(plain)})),
numbers AS (SELECT * FROM found WHERE kind = 'card' AND length(d) BETWEEN 13 AND 19 AND {luhn}),
base AS (SELECT rid, rank, kind, start, "end" FROM found WHERE kind = 'email' OR (kind = 'ip' AND {fits}) OR (kind = 'phone' AND length(d) BETWEEN 8 AND 15)
  UNION ALL SELECT rid, rank, kind, start, "end" FROM numbers WHERE length(d) >= 16),
runs AS (SELECT rid, start, string_split(value, ' ') AS g FROM ({matches_sql({"run": (4, "[A-Za-z0-9]+(?: [A-Za-z0-9]+)*")})})),
begins AS (SELECT rid, start, g, unnest(range(1, len(g) + 1)) AS j FROM runs),
lengthened AS (SELECT rid, j, start + length(array_to_string(g[1:j - 1], ' ')) + (j > 1)::INT AS start, g, unnest(range(1, least({GROUPS}, len(g) - j + 1) + 1)) AS k FROM begins WHERE regexp_matches(g[j], '^[A-Z]{{2}}[0-9]{{2}}')),
codes AS (SELECT rid, start, array_to_string(g[j:j + k - 1], ' ') AS value, array_to_string(g[j:j + k - 1], '') AS c FROM lengthened),
fitting AS (SELECT * FROM codes WHERE regexp_full_match(c, '[A-Z0-9]+') AND length(c) BETWEEN 15 AND 34 AND length(c) = CASE left(c, 2) {registered} ELSE length(c) END),
ibans AS (SELECT rid, 4 AS rank, 'iban' AS kind, start, start + max(length(value)) AS "end" FROM fitting WHERE {mod97} GROUP BY rid, start),
proposed AS (SELECT rid, rank, kind, start, "end" FROM ibans UNION ALL SELECT rid, 5, 'short_card', start, "end" FROM numbers WHERE length(d) < 16
  UNION ALL SELECT rid, rank, kind, start, "end" FROM ({fenced_sql("ssn", 6, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "0-9-")})),
seen AS (SELECT p.*, lower(substr(text, greatest(start - {CONTEXT}, 0) + 1, least(start, {CONTEXT}))) AS before FROM proposed p JOIN docs USING (rid)),
scored AS (SELECT *, CASE kind {prior} END + CASE WHEN CASE kind {near} END THEN {BOOST}::DOUBLE ELSE 0 END - CASE WHEN regexp_matches(replace(before, '{IN_ORDER}', ''), {quoted(AGAINST)}) THEN {BOOST}::DOUBLE ELSE 0 END AS score FROM seen),
spans AS (SELECT * FROM base UNION ALL SELECT rid, rank, kind, start, "end" FROM scored WHERE score >= {THRESHOLD})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "iban"))},
  sha256({joined_sql("rank < 4", 'rank, start, "end"')}) AS base_sha256, {joined_sql("rank IS NOT NULL", 'rank, start, "end"')} AS spans FROM docs LEFT JOIN spans USING (rid) GROUP BY rid"""


ORACLE = oracle()
