"""Secret scans behind a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that any match must hold: a literal gives the
conjunction of its trigrams, an alternation the disjunction of its branches, a concatenation the conjunction of its parts,
and anything else no demand. The queries are derived from the expression itself. Texts are indexed in shards (one for each
batch of rows, as a document-partitioned index is): for every trigram that some query names, the ascending list of rows that
hold it, letters folded to lower case. A rule's query is answered by intersecting and uniting postings; only its candidates
are verified, by the expression over the whole text. A rule without mandatory trigrams scans every text.

How it scales: shards are built and searched where the rows are; nothing is shuffled, and a shard's postings hold the rules'
trigrams only.

Cases: a null text is empty. Rows that share a doc_id each get a row. Matches are leftmost and don't overlap within a rule;
those that fail its check are dropped without another try; spans of different rules may overlap. Positions are code points,
end exclusive. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shared import bounded_batches
from siltbed.llm.sql import said, spans_sql
from siltbed.llm.words import LOWER, small_batches, utf8


@dataclass(frozen=True)
class Rule:
    """`least`: of the length of group `group` of a match. `body`: what masking takes along with a match, from its end on."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    body: str = ""


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEY = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), f"{any_case('api')}_?{any_case('key')}"])
#: The base rules in the order that ties of start go by, then the added ones.
BASE = (
    Rule("assign", rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What stands between the lines of a key in quotes, comments and escapes; _SIDE: on one line.
_MARKS = r"[\"'`,;+>#*|]"
_GAP, _SIDE, _TURN = rf"(?:\s|\\++[nrt]|{_MARKS})", rf"(?:[^\S\n]|\\++[rt]|{_MARKS})", r"(?:\n|\\++n)"
#: All up to the END line, if no other BEGIN or END line stands before it; else header fields, then runs of base64; a last
#: one of under 16 characters counts only as a line by itself.
_KEY_BODY = (
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\S\n]*+[^\s\\]++)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
    rf"(?:{_SIDE}*+{_TURN}{_GAP}*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?={_MARKS}*+(?:[^\S\n]*+(?:\n|\Z)|\\)))?)"
)
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", body=_KEY_BODY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("code_host", r"(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
)
RULES = BASE + ADDED

#: A query: None demands nothing; ("all" | "any", queries); or a trigram of folded bytes.
Query = tuple | bytes | None


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "any":
        return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))
    parts = [x for x in parts if x is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _literal_runs(tree: object) -> list[tuple[str, object]]:
    """A sequence's items, neighbouring fixed characters (folded; also classes of one letter's two cases) as one run."""
    out: list[tuple[str, object]] = []
    for op, arg in tree:
        chars = None
        if op is sre.LITERAL:
            chars = chr(arg).lower()
        elif op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len({chr(c).lower() for _, c in arg}) == 1:
            chars = chr(arg[0][1]).lower()
        if chars is not None and chars.isascii():
            if out and out[-1][0] == "run":
                out[-1] = ("run", out[-1][1] + chars)
            else:
                out.append(("run", chars))
        else:
            out.append(("item", (op, arg)))
    return out


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern must hold, as a Boolean query over folded trigrams."""

    def of(tree: object) -> Query:
        parts: list[Query] = []
        for kind, x in _literal_runs(tree):
            if kind == "run":
                raw = x.encode()
                parts.append(_join("all", [raw[i : i + 3] for i in range(len(raw) - 2)]))
                continue
            op, arg = x
            if op is sre.SUBPATTERN:
                # Beyond ASCII other letters match k and s whatever the case: a part without regard to case demands nothing.
                parts.append(None if arg[1] & re.IGNORECASE else of(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(_join("any", [of(branch) for branch in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
            elif op is sre.ATOMIC_GROUP:
                parts.append(of(arg))
        return _join("all", parts)

    tree = parser.parse(pattern)
    return None if tree.state.flags & re.IGNORECASE else of(tree)


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Shard:
    """Postings of the named trigrams over the rows of one batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, named: list[bytes]) -> None:
        self.rows = np.arange(len(offsets) - 1)
        codes = [a << 16 | b << 8 | c for a, b, c in named]
        self.postings = {x: np.empty(0, np.int64) for x in named}
        if len(data) < 3 or not named:
            return
        low = LOWER[data]
        # Only where a named trigram's first two bytes stand is the third looked at.
        first = np.zeros(1 << 16, bool)
        first[[c >> 8 for c in codes]] = True
        two = low[:-1].astype(np.uint16) << np.uint16(8) | low[1:]
        at = np.flatnonzero(first[two[:-1]])
        code = two[at].astype(np.int64) << 8 | low[at + 2]
        order = np.argsort(codes)
        known = np.array(codes)[order]
        slot = np.minimum(np.searchsorted(known, code), len(known) - 1)
        same = known[slot] == code
        at, slot = at[same], order[slot[same]]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pair = np.unique(slot[inside].astype(np.int64) * len(offsets) + row[inside])
        for k, rows in zip(named, np.split(pair % len(offsets), np.searchsorted(pair // len(offsets), np.arange(1, len(named)))), strict=True):
            self.postings[k] = rows

    def answer(self, query: Query) -> np.ndarray:
        """Ascending rows that may match."""
        if query is None:
            return self.rows
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        found = sorted(map(self.answer, parts), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if kind == "all" else np.union1d(out, x)
        return out


def _spans(rule: Rule, search: re.Pattern[str], text: str) -> Iterator[tuple[int, int]]:
    for m in search.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _masked_spans(rule: Rule, search: re.Pattern[str], text: str) -> Iterator[tuple[int, int]]:
    """_spans, each with its body."""
    body = re.compile(rule.body)
    for a, b in _spans(rule, search, text):
        more = body.match(text, b)
        yield a, more.end() if more else b


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans: array of (start, kind, end) by start, then by the rules' order) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [re.compile(r.pattern) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        named = sorted(set().union(*map(trigrams, queries)))
        for batch in small_batches(batches):
            column = batch.column("text")
            shard = Shard(*utf8(column), named)
            texts: dict[int, str] = {}
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for k, (rule, search, query) in enumerate(zip(rules, searches, queries, strict=True)):
                for row in shard.answer(query).tolist():
                    if row not in texts:
                        texts[row] = column[row].as_py() or ""
                    found[row] += [(a, k, b) for a, b in _spans(rule, search, texts[row])]
            spans = [[{"start": a, "kind": rules[k].kind, "end": b} for a, k, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start: long, kind: string, end: long>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def masked(spark_text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by [kind]; of overlapping spans the joint range is replaced once, by the first's kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [spark_text[done:start], f"[{kind}]"]
        done = end
        k += 1
    return "".join(out) + spark_text[done:]


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret's span in `text` replaced by its kind in brackets; all other columns and texts as they are.

    A private key goes from its header over the body to its END line; find_secrets gives the place of the header, as the SQL does.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [re.compile(r.pattern) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        named = sorted(set().union(*map(trigrams, queries)))
        for batch in small_batches(batches):
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            shard = Shard(*utf8(column), named)
            found: dict[int, list[tuple[int, int, str, int]]] = {}
            texts: dict[int, str] = {}
            for k, (rule, search, query) in enumerate(zip(rules, searches, queries, strict=True)):
                for row in shard.answer(query).tolist():
                    if row not in texts:
                        texts[row] = column[row].as_py() or ""
                    for a, b in _masked_spans(rule, search, texts[row]):
                        found.setdefault(row, []).append((a, k, rule.kind, b))
            if found:
                new = column.to_pylist()
                for row, spans in found.items():
                    new[row] = masked(texts[row], [(a, kind, b) for a, _, kind, b in sorted(spans)])
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, column.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said: Callable = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return out.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", said)).alias("spans"),
    )


#: For each rule: the same expression, and the least length of its group as a condition.
_LEAST = {"assign": f"length(regexp_extract(m, '{RULES[0].pattern.replace(chr(39), chr(39) * 2)}', 2)) >= 6"}
OP8_SQL = f"""
with {spans_sql([(r.kind, r.pattern, _LEAST.get(r.kind, f"length(m) >= {r.least}")) for r in RULES])}, told as (
  select r, {", ".join(f"count(*) filter (where k = {k}) as n_{x.kind}" for k, x in enumerate(BASE))}, {said([x.kind for x in BASE])} as base, {said()} as spans
  from span group by r
)
select doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) as n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from doc left join told on doc.r = told.r
"""
