"""DuckDB SQL shared by the oracles of span operators."""

from __future__ import annotations


def spans_sql(rules: list[tuple[str, str, str]], name: str = "span") -> str:
    """CTEs `doc` (r, doc_id, t) and `name` (r, k, kind, s, e, m, b, c: match and texts before and after it): rules are (kind, pattern, condition on m)."""

    def rule(k: int, kind: str, pattern: str, holds: str) -> str:
        quoted = pattern.replace("'", "''")
        return f"""
  select r, {k} as k, '{kind}' as kind, s, s + length(m) as e, m, b, c from (
    select r, a[i] as m, q[i] as b, q[i + 1] as c, list_sum(list_transform(q[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda x: length(x))), 0) as s, t
    from (select r, t, a, q, unnest(range(1, len(a) + 1)) as i from (select r, t, regexp_extract_all(t, '{quoted}') as a, string_split_regex(t, '{quoted}') as q from doc) where len(a) > 0)
  ) where {holds}"""

    parts = "\n  union all".join(rule(k, *x) for k, x in enumerate(rules))
    return f"""doc as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), {name} as ({parts}
)"""


def said(names: list[str] | None = None) -> str:
    """The comma-joined spans of a group of `span` rows, of some kinds or all."""
    only = f" filter (where kind in ({', '.join(repr(x) for x in names)}))" if names else ""
    return f"coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k){only}, '')"
