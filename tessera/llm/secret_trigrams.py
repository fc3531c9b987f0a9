"""Secret scans through a trigram inverted index, in native columns throughout.

Each rule is a regular expression. From its parse a Boolean trigram query is derived: an
OR of alternatives, each an AND of trigrams that every match of the alternative contains.
An index pass posts, for each row, which trigrams of the queries its lower-cased text
holds; joining the postings with the alternatives and counting intersects them, which
gives candidate rows per rule; only candidates run the rule's regular expression. A rule
with no mandatory trigram (a run of hexadecimal digits) scans every text.

Rows are told apart in the index by a hash of id and text, so null or repeated ids do no
harm: equal rows share their postings, and a chance collision only adds a candidate that
the expression then refutes. The candidate list is broadcast to the verifying pass while it has at most
``BROADCAST_ROWS`` rows; beyond that the pass joins by shuffle on the hash, which is even.

Positions come from splitting a text at a rule's matches: the lengths of the gaps and of
the matches, summed up, are the offsets in code points.

Null text: empty, no span. Repeated rows: one result each. Empty table: empty result.
Several kinds may match one place; each is reported. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, quoted, table, whole_row

BROADCAST_ROWS = 1_000_000  # of a hash and a few rule numbers: some 50 MB


@dataclass(frozen=True)
class Rule:
    """``min_length`` is asked of ``group`` of each match; a failing match is dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


BASE_RULES = (
    Rule("assign",
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a maximal run of at least 16 is what a greedy run of any length with 16 or more is
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)
#: What the index makes cheap to add: published formats with literal parts.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
)
RULES = BASE_RULES + MORE_RULES

Query = frozenset[frozenset[str]]  # OR of ANDs; an empty AND holds for every text
ALL: Query = frozenset([frozenset()])
_MAX_STRINGS = 32


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simplify(q: set[frozenset[str]]) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(a: Query, b: Query) -> Query:
    both = {x | y for x, y in itertools.product(a, b)}
    return _simplify(both) if len(both) <= 64 else a


def _of_strings(strings: set[str]) -> Query:
    return _simplify({_trigrams(s) for s in strings})


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings the nodes can match, or None if not few; a query every match satisfies)."""
    strings: set[str] = {""}
    exact, query = True, ALL

    def extend(more: set[str] | None, its_query: Query) -> None:
        nonlocal strings, exact, query
        joined = {a + b for a, b in itertools.product(strings, more)} if more is not None else None
        if joined is not None and len(joined) <= _MAX_STRINGS:
            strings = joined
        else:  # what came so far ends here; what follows starts anew
            query = _and(_and(query, _of_strings(strings)), its_query)
            strings, exact = (more if more is not None and len(more) <= _MAX_STRINGS else {""}), False

    for op, value in nodes:
        if op is rc.LITERAL:
            extend({chr(value).lower()}, ALL)
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in value) and len(value) <= 8:
            extend({chr(v).lower() for _, v in value}, ALL)
        elif op is rc.SUBPATTERN:
            extend(*_walk(value[-1]))
        elif op is rc.ATOMIC_GROUP:
            extend(*_walk(value))
        elif op is rc.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in parts):
                extend(set().union(*(s for s, _ in parts)), ALL)
            else:
                extend(None, _simplify(set().union(*(_and(q, _of_strings(s)) if s else q for s, q in parts))))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, inner = value
            found, its_query = _walk(inner)
            if (least, most) == (0, 1) and found is not None:
                extend(found | {""}, ALL)
            elif least == most == 1:
                extend(found, its_query)
            else:
                extend(None, _and(its_query, _of_strings(found or {""})) if least else ALL)
        elif op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):
            continue  # takes no characters
        else:
            extend(None, ALL)
    return (strings, query) if exact else (None, _and(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, over lower-cased text; ``ALL`` if no trigram is mandatory."""
    strings, query = _walk(rp.parse(pattern))
    return _and(query, _of_strings(strings)) if strings is not None else query


def postings(docs: DataFrame, trigrams: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """``key, trigram``: the inverted index of ``docs`` for the given trigrams."""
    low = docs.select(key, F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(key, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query], key: str = "key") -> DataFrame:
    """``key, rules``: intersect the postings of every alternative, and list the rules that have one in full."""
    needs = [
        {"trigram": trigram, "rule": rule, "alternative": n, "size": len(alternative)}
        for rule, query in queries.items()
        for n, alternative in enumerate(sorted(query, key=sorted))
        for trigram in sorted(alternative)
    ]
    kinds = pa.schema([("trigram", pa.string()), *((c, pa.int32()) for c in ("rule", "alternative", "size"))])
    # as an Arrow table: a list would start Python workers, which then wait beside the next stages
    needs = index.sparkSession.createDataFrame(pa.Table.from_pylist(needs, kinds))
    # the alternatives' trigrams are a few dozen rows, fixed by the rules
    full = (
        index.join(F.broadcast(needs), "trigram")
        .groupBy(key, "rule", "alternative").agg(F.count("*").alias("held"), F.max("size").alias("size"))
        .where("held >= size")
    )
    return full.groupBy(key).agg(F.collect_set("rule").alias("rules"))


_SPANS = "array<struct<start:bigint,rule:int,end:bigint>>"


def _spans(n: int, rule: Rule, text: str, hits: str) -> Column:
    """Spans of one rule from its matches (column ``hits``) and the gaps between them."""
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = f"regexp_extract_all({text}, '{pattern}', {rule.group})" if rule.group else hits
    return F.expr(f"""
        if(coalesce(size({hits}), 0) <= 0, cast(array() as {_SPANS}), aggregate(
          zip_with(split({text}, '{pattern}', -1), zip_with({hits}, {group}, (h, g) -> struct(h as hit, g as part)),
                   (gap, x) -> struct(gap as gap, x.hit as hit, x.part as part)),
          named_struct('at', 0L, 'found', cast(array() as {_SPANS})),
          (acc, x) -> named_struct(
            'at', acc.at + length(x.gap) + coalesce(length(x.hit), 0),
            'found', if(x.hit is not null and length(x.part) >= {rule.min_length},
              concat(acc.found, array(named_struct('start', acc.at + length(x.gap), 'rule', {n},
                                                   'end', acc.at + length(x.gap) + length(x.hit)))),
              acc.found)),
          acc -> acc.found))""")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row of ``docs`` as ``row``, a struct, and its ``spans``: those of all rules, ordered by start, then by rule.

    Rows are carried whole, so columns may have any names.
    """
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q != ALL}
    row_key = F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)))
    trigrams = sorted({t for q in indexed.values() for a in q for t in a})

    found = None
    if indexed:
        index = postings(docs.select(row_key.alias("key"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")), trigrams).distinct()
        found = cut(candidates(index, indexed))
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
    keyed = docs.select(row_key.alias("key"), whole_row(docs).alias("row"))
    keyed = keyed.join(found, "key", "left") if found is not None else keyed.withColumn("rules", F.lit(None).cast("array<int>"))

    def hits(n: int) -> Column:
        wanted = F.lit(True) if n not in indexed else F.coalesce(F.array_contains("rules", n), F.lit(False))
        return F.when(wanted, F.regexp_extract_all("text", F.lit(rules[n].pattern), F.lit(0)))

    texts = keyed.select("row", "rules", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"))
    matched = texts.select("row", "text", *[hits(n).alias(f"hits{n}") for n in range(len(rules))])
    spans = F.array_sort(F.concat(*[_spans(n, r, "text", f"hits{n}") for n, r in enumerate(rules)]))
    return matched.select("row", spans.alias("__spans")).select("row", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars: str = "n_chars",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]`` (overlapping spans by one) and the length set anew."""
    scanned = scan(docs, id_col, text_col, rules).select("row", "spans", F.col("row").getField(text_col).alias("text"))
    pieces = F.expr("""aggregate(spans, named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (acc, x) -> if(x.start >= acc.at,
          named_struct('at', x.end, 'out',
            concat(acc.out, array(substring(text, cast(acc.at + 1 as int), cast(x.start - acc.at as int)), '[SECRET]'))),
          named_struct('at', greatest(acc.at, x.end), 'out', acc.out)),
        acc -> concat(array_join(acc.out, ''), substring(text, cast(acc.at + 1 as int))))""")
    dirty = F.size("spans") > 0
    out = scanned.select("row", dirty.alias("dirty"), F.when(dirty, pieces).otherwise(F.col("text")).alias("new"))

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == n_chars:
            return F.when(F.col("dirty"), F.length("new").cast(docs.schema[c].dataType)).otherwise(old)
        return F.col("new") if c == text_col else old

    return out.select(*[column(c).alias(c) for c in docs.columns])


def op10_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["start"], x["end"])), ",")

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["rule"] == n)).cast("long")

    base = F.filter("spans", lambda x: x["rule"] < len(BASE_RULES))
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL of the query: every rule over every text, without an index."""
    plain = {"hex": "[0-9a-f]{16,}"}  # RE2 has no look-behind; a leftmost match starts where its run does
    parts = []
    for n, rule in enumerate(RULES):
        pattern = plain.get(rule.kind, rule.pattern.replace("}+", "}")).replace("'", "''")
        parts.append(f"""
  SELECT rid, {n} AS rule, '{rule.kind}' AS kind, i, hits, gaps FROM (
    SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts,
           string_split_regex(t, '{pattern}') AS gaps FROM d), unnest(range(1, len(hits) + 1)) AS u(i)
  WHERE length(parts[i]) >= {rule.min_length}""")
    base = f"rule < {len(BASE_RULES)}"
    listed = "string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rule)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT rid, rule, kind, length(hits[i]) AS n,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access,
       count(*) FILTER (rule = 2) AS n_hex, sha256(coalesce({listed} FILTER ({base}), '')) AS base_sha256,
       coalesce({listed} FILTER (rule IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid
"""
