"""Personal data: expressions propose spans, checksums confirm them, context words adjust their score. DataFrame functions only.

A rule's matches come from regexp_extract_all and the texts between them from split by the same expression, so running
lengths give each match's place; they are summed in stretches of `_STRETCH` matches, so that a text of very many costs little more than
their number. Expressions are written so that a long run of one kind of character is tried once:
possessive repeats, and a start only where a run starts or the last match ended; that leaves the leftmost matches as they
are. Validators are Luhn for cards, mod 97 for IBANs (of their country's length), bounds for addresses and phone numbers, and the numbers
that are never given out for social security numbers.

Score, in percent: a rule's own (higher with a checksum) plus `CONTEXT`, 100 at most, if one of its words stands within `NEAR` characters before the
match or after it, up to the next match of the kind. The base kinds stay whatever their score; the added kinds need `LEAST`.

How it scales: one streaming pass without a shuffle.

Cases: a null text is empty. Rows that share a doc_id each get a row. Spans of one kind don't overlap, of different kinds they may;
ties of start go by the order of kinds. Positions are code points, end exclusive. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.sql import said, spans_sql

NEAR, CONTEXT, LEAST = 40, 40, 60
_STRETCH = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Is the number of these digits valid: doubled every second digit from the right, less nine if over nine, in sum a multiple of ten."""
    reverse = F.reverse(digits)
    value = lambda i: F.ascii(F.substring(reverse, i, F.lit(1))) - 48
    term = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """Is an IBAN valid: its first four characters moved to the end, letters read as 10 to 35, the number is 1 modulo 97."""
    plain = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    step = lambda rest, i: F.when(code(i) < 58, rest * 10 + code(i) - 48).otherwise(rest * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


@dataclass(frozen=True)
class Rule:
    """`needs`: a text without this character has no match. `holds` confirms a match. `score` in percent, `context`: words, by |."""

    kind: str
    pattern: str
    needs: str
    holds: Callable[[Column], Column]
    score: int
    context: str

    @property
    def near(self) -> str:
        """Finds a context word as a whole."""
        return f"(?:^|[^a-z0-9])(?:{self.context})(?:$|[^a-z0-9])"


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """Countries of one length share a branch: country, two digits, groups of four and the rest, each after a space or not."""

    def branch(length: int) -> str:
        fours, rest = divmod(length - 4, 4)
        countries = "|".join(c for c, n in sorted(IBAN_LENGTHS.items()) if n == length)
        return f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")

    return rf"(?:{'|'.join(map(branch, sorted(set(IBAN_LENGTHS.values()))))})\b"


_always: Callable[[Column], Column] = lambda m: F.lit(True)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Area, group and serial numbers that are never given out.
_NO_SOCIAL = "^(?:000|666|9)|-00-|-0000$"
#: The base kinds, in the order that ties go by.
BASE = (
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _always, 80, "mail|email|e-mail|contact|write"),
    Rule("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 50, "ip|server|host|address"),
    Rule("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False), 80, "card|visa|credit|payment"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(10, 15), 60, "phone|call|tel|mobile"),
)
ADDED = (
    Rule("iban", r"\b(?=[A-Z]{2}[0-9]{2})" + _iban(), "", mod97, 90, "iban|account|bank"),
    Rule("social", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", lambda m: ~m.rlike(_NO_SOCIAL), 30, "ssn|social"),
)
RULES = BASE + ADDED


def _starts(lengths: Column) -> Column:
    """Running sums of an array of numbers, each without its own: in stretches, then over the stretches."""
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("done"))
    stretch = lambda c: F.slice(lengths, c * _STRETCH + 1, _STRETCH)
    listed = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["done"], F.array(a["at"])).alias("done"))
    many = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STRETCH).cast("int"))
    sums = F.transform(many, lambda c: F.aggregate(stretch(c), F.lit(0).cast("bigint"), lambda a, x: a + x))
    bases = F.aggregate(sums, nothing, listed, lambda a: a["done"])
    within = lambda base, c: F.aggregate(stretch(c), F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("done")), listed, lambda a: a["done"])
    return F.flatten(F.transform(bases, within))


def find_personal(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans: array of (start, k, kind, end, score, context) by start, then k, the rule's number) for each row of docs."""
    text = F.col("text")
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = []
    for rule in rules:
        may = F.contains(text, F.lit(rule.needs)) if rule.needs else F.lit(True)
        some.append(may if rule.kind == "email" else may & text.rlike("[0-9]"))
    none = F.array().cast("array<string>")
    df = df.select("doc_id", "text", *[F.when(may, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"_m{k}") for k, (r, may) in enumerate(zip(rules, some, strict=True))])
    df = df.select("doc_id", *[x for k, r in enumerate(rules) for x in (f"_m{k}", F.when(F.size(f"_m{k}") > 0, F.split(text, r.pattern, -1)).otherwise(none).alias(f"_b{k}"))])
    lengths = lambda k: F.zip_with(F.slice(f"_b{k}", 1, F.size(f"_m{k}")), f"_m{k}", lambda b, m: (F.length(b) + F.length(m)).cast("bigint"))
    df = df.select("*", *[lengths(k).alias(f"_l{k}") for k in range(len(rules))])
    # A column of its own for each: nothing that a lambda repeats is computed again.
    df = df.select("*", *[F.when(F.size(f"_l{k}") > 0, _starts(F.col(f"_l{k}"))).otherwise(F.array().cast("array<bigint>")).alias(f"_s{k}") for k in range(len(rules))])
    return df.select("doc_id", F.array_sort(F.concat(*[_spans(k, r, r in BASE) for k, r in enumerate(rules)])).alias("spans"))


def _spans(k: int, rule: Rule, base: bool) -> Column:
    n = F.size(f"_m{k}")
    found = F.arrays_zip(F.col(f"_m{k}").alias("m"), F.slice(f"_b{k}", 1, n).alias("b"), F.slice(f"_b{k}", 2, n).alias("a"), F.col(f"_s{k}").alias("s"))
    found = F.filter(found, lambda x: rule.holds(x["m"]))

    def span(x: Column) -> Column:
        start = x["s"] + F.length(x["b"])
        near = F.lower(F.concat(F.substring(x["b"], -NEAR, NEAR), F.lit(" . "), F.substring(x["a"], 1, NEAR)))
        context = near.rlike(rule.near)
        score = F.when(context, F.lit(min(100, rule.score + CONTEXT))).otherwise(F.lit(rule.score))
        return F.struct(start.alias("start"), F.lit(k).alias("k"), F.lit(rule.kind).alias("kind"), (start + F.length(x["m"])).alias("end"), score.alias("score"), context.alias("context"))

    spans = F.transform(found, span)
    return spans if base else F.filter(spans, lambda x: x["score"] >= LEAST)


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    out = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k, name: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long").alias(f"n_{name}")
    return out.select(
        "doc_id",
        *[count(k, r.kind) for k, r in enumerate(BASE)],
        F.sha2(F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["k"] < len(BASE)), text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
        F.size(F.filter("spans", lambda s: s["context"])).cast("long").alias("n_context"),
    )


_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: case when i % 2 = 1 then cast(reverse({_D})[i] as int) when cast(reverse({_D})[i] as int) > 4 then cast(reverse({_D})[i] as int) * 2 - 9 else cast(reverse({_D})[i] as int) * 2 end)) % 10 = 0"
_PLAIN = "replace(m, ' ', '')"
_MOVED = f"({_PLAIN}[5:] || {_PLAIN}[:4])"
_MOD97 = f"""list_reduce(list_prepend(cast(0 as bigint), list_transform(range(1, length({_MOVED}) + 1), lambda i: cast(ascii({_MOVED}[i]) as bigint))),
    lambda rest, c: case when c < 58 then (rest * 10 + c - 48) % 97 else (rest * 100 + c - 55) % 97 end) = 1"""
_CONTEXT = "regexp_matches(lower(right(b, {near}) || ' . ' || left(c, {near})), '{pattern}')"
_SCORE = "case k " + " ".join(f"when {k} then case when {_CONTEXT.format(near=NEAR, pattern=r.near)} then {min(100, r.score + CONTEXT)} else {r.score} end" for k, r in enumerate(RULES)) + " end"
_SQL_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: cast(x as hugeint) <= 255))"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_D}) between 14 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) between 10 and 15"),
    ("iban", r"\b" + _iban(), _MOD97),
    ("social", ADDED[1].pattern, f"not regexp_matches(m, '{_NO_SOCIAL}')"),
]
OP3_SQL = f"""
with {spans_sql(_SQL_RULES, "every")}, scored as (
  select *, {_SCORE} as score from every
), span as (
  select * from scored where k < {len(BASE)} or score >= {LEAST}
), told as (
  select r, {", ".join(f"count(*) filter (where k = {k}) as n_{x.kind}" for k, x in enumerate(BASE))}, {said([x.kind for x in BASE])} as base, {said()} as spans,
    string_agg(cast(score as varchar), ',' order by s, k) as scores, count(*) filter (where score > [{", ".join(str(r.score) for r in RULES)}][k + 1]) as n_context
  from span group by r
)
select doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) as n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(scores, '') as scores, coalesce(n_context, 0) as n_context
from doc left join told on doc.r = told.r
"""
