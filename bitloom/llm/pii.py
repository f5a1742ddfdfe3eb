r"""Personal data: regular expressions propose, checksums confirm, context scores; DataFrame functions only.

Kinds, in this order: email, ip, card, phone (the base kinds) and iban, which
is added. Matches of a kind are leftmost and do not overlap; those that fail
their check are dropped without another try.

The proposing patterns find the same matches as the plain ones of the
contract, without their repeated tries on long runs: an email starts where a
run of its characters starts or the last match ended, an ip where a run of
digits starts, and a card is a whole run of digits with at most a space or
hyphen between two. Repeats are possessive wherever giving back cannot help: a
repeated group that may give back takes a stack frame for each turn, and a long
enough text would end the executor. A kind is looked for only in texts that
hold a character it needs.

Positions come from the pieces between the matches, in code points, end
exclusive. Nothing is shuffled, and a row's work is in proportion to its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.let import let

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
#: Code points on either side of a match that are searched for context words.
CONTEXT = 48
#: Added kinds (not the base ones) below this score are left out.
LEAST = 0.5
#: Matches whose positions are summed up together.
STEP = 256

# The patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
# A kind's score without context, and words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7}
FOR = {
    "email": "e-?mail|mail|contact|write|address",
    "ip": "ip|host|server|login|client|address",
    "card": "card|credit|debit|visa|mastercard|amex|payment|cvv|expir",
    "phone": "phone|tel|call|mobile|cell|fax|contact|whatsapp",
    "iban": "iban|account|bank|swift|bic|transfer|konto|compte|cuenta",
}
AGAINST = {
    "email": "example",
    "ip": "version|release|section|chapter",
    "card": "isbn|order|serial|tracking|invoice",
    "phone": "version|order|serial",
    "iban": "serial|model|part",
}


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    compact = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: What confirms a match of a kind.
CHECKS = {"email": "pattern", "ip": "range", "card": "luhn", "phone": "length", "iban": "mod97"}
CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda part: F.rlike(part, F.lit("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))),
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & _mod97(m),
}


def _near(words: str) -> str:
    """A pattern of words that begin in a lower-cased context."""
    return f"(?:^|[^a-z0-9])(?:{words})"


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<kind, start, end, score, confirmed_by>> of a kind's confirmed matches.

    The context of a match is the ``CONTEXT`` code points on either side, at
    most as far as its second neighbour of the same kind.
    """
    kinds = "array<struct<start:int,end:int,match:string,around:string>>"

    def measured(v: Column) -> Column:
        def part(match: Column, i: Column) -> Column:
            piece, n, nothing = F.get(v["pieces"], i), F.lit(CONTEXT), F.lit("")
            before = F.concat(F.right(F.coalesce(F.get(v["pieces"], i - 1), nothing), n), F.right(F.coalesce(F.get(v["matches"], i - 1), nothing), n), F.right(piece, n))
            after = F.concat(F.left(F.get(v["pieces"], i + 1), n), F.left(F.coalesce(F.get(v["matches"], i + 1), nothing), n), F.left(F.coalesce(F.get(v["pieces"], i + 2), nothing), n))
            around = F.concat_ws(" ", F.right(before, n), F.left(after, n))
            return F.struct(F.length(piece).alias("gap"), F.length(match).alias("own"), match.alias("match"), F.lower(around).alias("around"))

        return F.transform(v["matches"], part)

    def place(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["own"]).alias("end"), p["match"], p["around"])
        return F.struct((start + p["own"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(v: Column) -> Column:
        """Positions are running sums. An array grows by copying, so they are summed up by ``STEP`` matches, then within each step."""

        def step(no: Column) -> Column:
            return F.slice(v["parts"], no * STEP + 1, STEP)

        numbers = F.sequence(F.lit(0), F.floor((F.size(v["parts"]) - 1) / STEP).cast("int"))
        sums = F.transform(numbers, lambda no: F.aggregate(step(no), F.lit(0), lambda n, p: n + p["gap"] + p["own"]))
        nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sums, nothing, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])

        def within(at: Column, no: Column) -> Column:
            return F.aggregate(step(no), F.struct(at.alias("at"), F.array().cast(kinds).alias("spans")), place, lambda s: s["spans"])

        return F.flatten(F.transform(starts, within))

    parts = let(measured, pieces=F.split(text, PATTERNS[kind], -1), matches=matches)
    confirmed = F.filter(let(placed, parts=parts), lambda s: CONFIRM[kind](s["match"]))

    def scored(s: Column) -> Column:
        near = F.rlike(s["around"], F.lit(_near(FOR[kind]))).cast("int") * 0.3 - F.rlike(s["around"], F.lit(_near(AGAINST[kind]))).cast("int") * 0.3
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(SCORES[kind]) + near))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.cast("double").alias("score"), F.lit(CHECKS[kind]).alias("confirmed_by"))

    out = F.transform(confirmed, scored)
    return out if kind in BASE_KINDS else F.filter(out, lambda s: s["score"] >= LEAST)


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` with the column _bitloom_pii of the spans in their column _bitloom_text, which has no nulls."""
    text = F.col("_bitloom_text")
    digit = F.rlike(text, F.lit("[0-9]"))
    needs = {
        "email": F.contains(text, F.lit("@")),
        "ip": digit,
        "card": digit,
        "phone": F.contains(text, F.lit("+")),
        "iban": digit & F.rlike(text, F.lit("[A-Z]{2}[0-9]{2}")),
    }
    none = F.array().cast("array<string>")
    found = {k: f"_bitloom_{k}" for k in KINDS}
    rows = rows.select("*", *(F.when(needs[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), 0)).otherwise(none).alias(found[k]) for k in KINDS))
    no_span = F.array().cast("array<struct<kind:string,start:int,end:int,score:double,confirmed_by:string>>")
    spans = [F.when(F.size(found[k]) > 0, _spans(k, text, F.col(found[k]))).otherwise(no_span) for k in KINDS]
    return rows.withColumn("_bitloom_pii", F.concat(*spans)).drop(*found.values())


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and pii, an array of (kind, start, end, score, confirmed_by) by kind, then start, for every row of ``docs``.

    Offsets count code points of text from 0, end exclusive. Null and empty
    texts have an empty array. Rows are handled one by one, so repeated rows
    and null ids come back as they are; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_bitloom_text"))
    return _found(rows).select("doc_id", F.col("_bitloom_pii").alias("pii"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each match in text replaced by its kind in angle brackets; overlapping spans are replaced as one, named by the first.

    Null texts stay null; all other columns stay as they are. Each match is cut
    out of the whole text, so work grows with matches times length.
    """
    rows = _found(docs.withColumn("_bitloom_text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    ordered = F.array_sort(F.transform("_bitloom_pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("_bitloom_text")

    def cut(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        inside = s["start"] < state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``find_pii``; n_pii counts all spans, scores has theirs in the same order, to one decimal."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.filter("pii", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_pii"), scores.alias("scores"))


def oracle_sql() -> str:
    """The contract's columns for ``documents`` in DuckDB SQL, with the plain patterns."""
    # The contract's patterns, and the one of the added kind.
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": PATTERNS["iban"],
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    compact = "replace(m, ' ', '')"
    turned = f"(substr({compact}, 5) || substr({compact}, 1, 4))"
    confirm = {
        "email": "true",
        "ip": r"regexp_full_match(m, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(list_reverse(string_split({digits}, '')), lambda x, i: CASE WHEN i % 2 = 0 THEN (x::INT * 2) // 10 + (x::INT * 2) % 10 ELSE x::INT END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({compact}) BETWEEN 15 AND 34 AND array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN (ord(c) - 55)::VARCHAR ELSE c END), '')::HUGEINT % 97 = 1",
    }
    n = CONTEXT
    before = f"right(right(coalesce(gs[i - 1], ''), {n}) || right(coalesce(ms[i - 1], ''), {n}) || right(gs[i], {n}), {n})"
    after = f"left(left(gs[i + 1], {n}) || left(coalesce(ms[i + 1], ''), {n}) || left(coalesce(gs[i + 2], ''), {n}), {n})"
    parts = []
    for no, kind in enumerate(KINDS):
        score = f"least(1, greatest(0, {SCORES[kind]} + 0.3 * regexp_matches(a, '{_near(FOR[kind])}')::INT - 0.3 * regexp_matches(a, '{_near(AGAINST[kind])}')::INT))::DOUBLE"
        parts.append(f"""
  SELECT * FROM (SELECT doc_id, {no} AS k, '{kind}' AS kind, s, e, {score} AS score FROM (
    SELECT doc_id, m, e - length(m) AS s, e, a FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: lower({before} || ' ' || {after}))) AS a, unnest(list_transform(ms, lambda x, i: list_sum(list_transform(gs[:i], lambda g: length(g))) + list_sum(list_transform(ms[:i], lambda y: length(y)))))::BIGINT AS e FROM (
        SELECT doc_id, regexp_extract_all(text, '{plain[kind]}') AS ms, string_split_regex(text, '{plain[kind]}') AS gs FROM documents WHERE text IS NOT NULL)))
  WHERE {confirm[kind]}) WHERE {no} < 4 OR score >= {LEAST}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH f AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT doc_id, {counts},
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, count(*) AS n_pii, string_agg(printf('%.1f', score), ',' ORDER BY k, s) AS scores
  FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_pii, 0) AS n_pii, coalesce(scores, '') AS scores
FROM documents d LEFT JOIN g USING (doc_id)"""
