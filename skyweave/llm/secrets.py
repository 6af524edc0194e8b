"""Secret scans by a trigram inverted index, with SQL functions alone (operator 5).

From each rule's regular expression a Boolean trigram query is derived: an OR of
alternatives, each an AND of the trigrams of its literals. The index has postings
(trigram, document) for the trigrams that queries name; a query's postings are intersected
by counting, per document, how many trigrams of an alternative it has. Only candidates are
matched against a rule; rules without mandatory trigrams scan every text.

The index holds lower-cased trigrams, so it may give more candidates than a rule needs,
never fewer. Rows that cannot be candidates, by a sieve of the candidates' ids, are not
moved to be joined to them.

Groups in rules are repeated a bounded number of times, so texts of any length and make-up
can be matched: a key's label has up to four words of 20 letters before PRIVATE. Characters
are repeated without a bound.

Defined results: a null text counts as empty; texts without secrets have empty span lists;
rows without id are not looked up in the index but scanned by all rules; rows that share an
id share their candidates and are verified each on its own text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sieve, table, written
from .spans import matches

_sre = re._parser  # the parse tree that the standard library matches by


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A group of the pattern and the least length of what it matched.
    group: int = 0
    least: int = 0
    #: What a span begins with, if the pattern takes in more before it.
    lead: str = ""


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base rules come first; a run of enough characters is the same match as a run that is measured afterwards.
BASE = (Rule("assign", ASSIGN, 2, 12), Rule("access", r"AKIA[A-Z0-9]{14,}"), Rule("hex", r"[0-9a-f]{16,}"))
WEB_TAIL = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,20} ){0,4}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}"),
    # of a run of characters only the first eyJ can begin a token, so each run is read once
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{8,}+\." + WEB_TAIL, lead="eyJ"),
)
RULES = BASE + MORE
ALTERNATIVES = 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which a match has all trigrams of one; empty if some match needs none."""
    out = []
    for runs in _literals(_sre.parse(pattern)):
        found = frozenset(run[i : i + 3].lower() for run in runs for i in range(len(run) - 2))
        if not found:
            return []
        out.append(found)
    return [a for a in set(out) if not any(b < a for b in out)]


def _literals(tree) -> list[tuple[str, ...]]:
    """Runs of literals of each alternative; ends of runs are empty strings between them."""
    done: list[tuple[str, ...]] = [("",)]
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [(chr(value),)]
        elif name == "SUBPATTERN":
            parts = _literals(value[-1])
        elif name == "BRANCH":
            parts = [x for branch in value[1] for x in _literals(branch)]
        elif name == "IN" and len(value) <= 8 and all(str(kind) == "LITERAL" for kind, _ in value):
            parts = [(chr(c),) for _, c in value]
        elif name == "AT":
            continue
        elif name == "MAX_REPEAT" and value[0] >= 1:
            inside = _literals(value[2])
            parts = inside if value[:2] == (1, 1) else [(*x, x[-1]) for x in inside]  # the first copy follows what is before, the last is before what follows
        elif name == "MAX_REPEAT" and value[1] == 1:
            parts = [*_literals(value[2]), ("",)]
        else:
            parts = [("", "")]
        if len(done) * len(parts) > ALTERNATIVES:
            parts = [("", "")]
        done = [(*a[:-1], a[-1] + b[0], *b[1:]) for a in done for b in parts]
    return done


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (trigram, doc_id), where trigram is a place in ``trigrams``."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"))
    there = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return rows.select(F.explode(there).alias("trigram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rules): a bit for each rule of which the postings intersect in the document."""
    queries = [(r, tuple(sorted(q))) for r, rule in enumerate(rules) for q in sorted(map(sorted, trigram_query(rule.pattern)))]
    trigrams = sorted({t for _, q in queries for t in q})
    index = postings(docs, trigrams, id_col, text_col)
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))  # no more than there are trigrams
    mask = F.lit(0).cast("bigint")
    for r, q in queries:
        mask = mask.bitwiseOR(F.when(_all_in(F.col("have"), [trigrams.index(t) for t in q]), F.lit(1 << r)).otherwise(F.lit(0)).cast("bigint"))
    return have.select("doc_id", mask.alias("rules")).where("rules <> 0")


def _all_in(have: Column, wanted: list[int]) -> Column:
    return F.size(F.array_intersect(have, F.array(*map(F.lit, wanted)))) == len(wanted)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one array of (start, end, value) for each kind), a row for each row of ``docs``."""
    found = written(candidates(docs, rules, id_col, text_col).toDF("__id", "rules"), "candidates")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some, others = sieve(rows, F.col("doc_id"), found.select("__id"))
    rows = some.join(found, F.col("doc_id") == F.col("__id"), "left").drop("__id").unionByName(others.withColumn("rules", F.lit(0).cast("bigint")))
    ask = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.coalesce("rules", F.lit(0)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    columns = []
    for r, rule in enumerate(rules):
        each = matches(F.col("text"), rule.pattern)
        if rule.least:
            each = F.filter(each, _long_enough(rule))
        if rule.lead:
            each = F.transform(each, _led(rule.lead))
        if trigram_query(rule.pattern):
            each = F.when(ask.bitwiseAND(F.lit(1 << r)) != 0, each).otherwise(none)
        columns.append(each.alias(rule.kind))
    return rows.select("doc_id", *columns)


def _long_enough(rule: Rule) -> Callable[[Column], Column]:
    return lambda m: F.char_length(F.regexp_extract(m["value"], rule.pattern, rule.group)) >= rule.least


def _led(lead: str) -> Callable[[Column], Column]:
    def cut(m: Column) -> Column:
        at = F.instr(m["value"], lead)
        return F.struct((m["start"] + at - 1).cast("bigint").alias("start"), m["end"].alias("end"), F.substr(m["value"], at).alias("value"))

    return cut


def _said(kind: str, place: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), F.concat_ws(":", F.lit(kind), m["start"], m["end"]).alias("said"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of these kinds, by start, then as the kinds are listed."""
    tagged = [F.transform(F.col(k), _said(k, i)) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*tagged)), lambda m: m["said"]), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base, every = tuple(r.kind for r in BASE), tuple(r.kind for r in RULES)
    return found.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in base), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans")
    )


def _sql() -> str:
    """The same spans in DuckDB: what lies between matches and the matches, by regular expressions over whole texts."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    either = "".join(c for c in ASSIGN)
    either = either.replace("(?i:password|passwd|secret|token|api_?key)", "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
    own = {"assign": either, "web_token": r"eyJ[A-Za-z0-9_-]{8,}\." + WEB_TAIL}
    patterns = {r.kind: own.get(r.kind, r.pattern) for r in RULES}
    parts = []
    for i, (kind, p) in enumerate(patterns.items()):
        keep = f"WHERE length(regexp_extract(value, {quoted(p)}, 2)) >= 12" if kind == "assign" else ""
        parts.append(f"""SELECT doc_id, row_no, {i} AS place, '{kind}' AS kind, start, start + length(value) AS stop FROM (
  SELECT doc_id, row_no, m[k] AS value, coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS start FROM (
    SELECT doc_id, row_no, m, g, unnest(range(1, len(m) + 1)) AS k FROM (
      SELECT doc_id, row_no, regexp_extract_all(body, {quoted(p)}) AS m, string_split_regex(body, {quoted(p)}) AS g FROM t WHERE regexp_matches(body, {quoted(p)})))) {keep}""")
    said = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS body FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT row_no, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  string_agg({said}, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg({said}, ',' ORDER BY start, place) AS spans FROM s GROUP BY row_no)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (row_no)
"""


OP5_SQL = _sql()
