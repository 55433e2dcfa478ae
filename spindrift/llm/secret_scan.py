"""Secret scans with corpus-wide ownership frequency.

Base patterns give spans that always stay.  Besides, long opaque strings (letters and digits mixed)
are candidates: every candidate's hash is counted over the corpus by distinct repositories and
distinct owners.  What few owners hold looks like a live credential and its span is added; what
many owners hold is a copied example and is not.

Spans come from native functions only: ``split`` gives the pieces between the matches of a
pattern and ``regexp_extract_all`` the matches, so running lengths give starts and ends in code
points; they are summed in blocks, so a text's time grows with its matches and not their square.

Defined cases: a null text is empty and has no spans; a null source is an owner of its own; rows
that repeat a doc_id are scanned each on its own, and an identical row repeats its result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import apart, cut

#: Fixed by the contract.  The bounds stand in the last two patterns: a maximal run is one match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
#: Entries of a running sum that are summed in one piece.
BLOCK = 256
SPAN = "array<struct<start:int,order:int,end:int,value:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(steps: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` from 0, as an aggregate: it copies its result once per entry."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = op(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def running(steps: Column, op: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """Running sums (or another associative ``op`` with 0 as its neutral element) of an array of
    ints, in blocks of ``BLOCK``: time grows with the array's length, and with its square only at
    1 / BLOCK**2."""
    many = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
    blocks = F.transform(
        F.when(F.size(steps) > 0, F.sequence(F.lit(0), many)).otherwise(F.array().cast("array<int>")),
        lambda k: _scan(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)), op),
    )

    def placed(inner: Column) -> Column:
        ends = _scan(F.transform(inner, lambda x: F.element_at(x, -1)), op)
        return _let(
            ends,
            lambda e: F.flatten(
                F.transform(inner, lambda x, k: F.transform(x, lambda v: op(F.coalesce(F.get(e, k - 1), F.lit(0)), v)))
            ),
        )

    return _let(blocks, placed)


def spans_of(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """All matches whose ``group`` has ``least`` characters or more, as structs of
    (start, order, end, value); empty if there is none."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def found(x: Column) -> Column:
        sizes = F.transform(x["whole"], lambda w: F.length(w))
        gaps = F.transform(F.slice(x["gap"], F.lit(1), F.size(x["whole"])), lambda g: F.length(g))
        before = F.concat(F.array(F.lit(0)), sizes)
        steps = F.zip_with(gaps, F.slice(before, F.lit(1), F.size(x["whole"])), lambda g, w: g + w)
        rows = F.arrays_zip(running(steps).alias("at"), sizes.alias("n"), x["value"].alias("value"))
        return F.transform(
            F.filter(rows, lambda r: F.length(r["value"]) >= least),
            lambda r: F.struct(
                r["at"].alias("start"), F.lit(kind).alias("order"), (r["at"] + r["n"]).alias("end"), r["value"].alias("value")
            ),
        )

    return F.when(text.rlike(pattern), _let(parts, found)).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """One row per document, without its text: doc_id, row (a hash that tells its text), repo,
    owner, base and extra spans.  Extra spans overlap no base span."""
    t = docs.select(
        "doc_id",
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        F.coalesce("text", F.lit("")).alias("t"),
    )
    text = F.col("t")
    t = t.select(
        "doc_id",
        "repo",
        "owner",
        F.xxhash64(text).alias("row"),
        F.concat(
            spans_of(text, ASSIGN, 0, 2, 8), spans_of(text, ACCESS, 1, 0, 16), spans_of(text, HEX, 2, 0, 32)
        ).alias("base"),
        spans_of(text, OPAQUE, 3, 0, 24).alias("opaque"),
    )
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    t = t.withColumn("opaque", F.filter("opaque", lambda c: mixed(c["value"]))).withColumn("base", F.sort_array("base"))
    free = F.when((F.size("base") > 0) & (F.size("opaque") > 0), _apart_from("opaque", "base")).otherwise(F.col("opaque"))
    return t.select("doc_id", "repo", "owner", "row", _hashed(F.col("base")).alias("base"), _hashed(free).alias("extra"))


def _apart_from(spans: str, others: str) -> Column:
    """The ``spans`` that overlap none of ``others``, in one sweep: what begins before a span's end
    must have ended by its start."""
    event = lambda at, kind, top, start, value: F.struct(
        at.alias("at"), F.lit(kind).alias("kind"), top.alias("top"), start.alias("start"), value.alias("value")
    )
    events = F.sort_array(
        F.concat(
            F.transform(others, lambda b: event(b["start"], 1, b["end"], b["start"], F.lit(""))),
            F.transform(spans, lambda o: event(o["end"], 0, F.lit(0), o["start"], o["value"])),
        )
    )

    def swept(e: Column) -> Column:
        tops = running(F.transform(e, lambda x: x["top"]), F.greatest)
        free = F.filter(F.arrays_zip(e.alias("e"), tops.alias("top")), lambda x: (x["e"]["kind"] == 0) & (x["top"] <= x["e"]["start"]))
        return F.transform(
            free,
            lambda x: F.struct(x["e"]["start"].alias("start"), F.lit(3).alias("order"), x["e"]["at"].alias("end"), x["e"]["value"].alias("value")),
        )

    return _let(events, swept)


def _hashed(spans: Column) -> Column:
    """Spans with their values' digests: no secret is written anywhere."""
    return F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"], F.sha2(s["value"], 256).alias("value")))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's hash: distinct repositories and owners.  Rows are reduced to the
    distinct (value, owner, repository) before they are counted, so a hot value shrinks at once."""
    c = found.where((F.size("base") > 0) | (F.size("extra") > 0)).select(
        "repo", "owner", F.explode(F.concat("base", "extra")).alias("s")
    )
    c = c.select(F.col("s.value").alias("hash"), "repo", "owner")
    by_repo = c.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repos"))
    by_owner = (
        c.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    )
    return by_repo.join(by_owner, "hash")


def scan(
    docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 2, max_repos: int | None = 8
) -> DataFrame:
    """doc_id, base, added (spans as arrays of structs) and n_live: how many distinct candidate
    values of the document are owner-specific.  Without ``max_repos`` owners alone decide, however
    often an owner's documents repeat a value."""
    found = cut(find(docs, repo_col, owner_col))
    few = F.col("n_owners") <= max_owners
    if max_repos is not None:
        few &= F.col("n_repos") <= max_repos
    live = ownership(found).where(few).select("hash")
    c = (
        found.where((F.size("base") > 0) | (F.size("extra") > 0))
        .select("doc_id", "row", F.explode(F.concat("base", "extra")).alias("s"))
        .withColumn("hash", F.col("s.value"))
    )
    per_doc = (
        c.join(apart(live, "hash"), "hash")  # plain exchanges, so that a hot value can be split
        .groupBy("doc_id", "row")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("s.order") == 3, F.col("s")))).alias("added"),
            F.count_distinct("hash").alias("n_live"),
        )
        .withColumnsRenamed({"doc_id": "d2", "row": "r2"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row") == F.col("r2"))
    return found.join(per_doc, same, "left").select(
        "doc_id",
        "base",
        F.coalesce("added", F.array().cast(SPAN)).alias("added"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"], s["end"])), ","
    )


def secrets_query(docs: DataFrame, max_repos: int | None = 8) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_live of every document."""
    s = scan(docs.select("doc_id", "text", "source"), max_repos=max_repos)
    count = lambda k: F.size(F.filter("base", lambda x: x["order"] == k)).cast("long")
    return s.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        "n_live",
    )


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
p(k, pat, g, least_) AS (VALUES (0, '{_sql(ASSIGN)}', 2, 8), (1, '{_sql(ACCESS)}', 0, 16), (2, '{_sql(HEX)}', 0, 32), (3, '{_sql(OPAQUE)}', 0, 24)),
m AS (
  SELECT rid, k, least_, string_split_regex(t, '{_sql(ASSIGN)}') AS gaps, regexp_extract_all(t, '{_sql(ASSIGN)}') AS whole, regexp_extract_all(t, '{_sql(ASSIGN)}', 2) AS val FROM d, p WHERE k = 0
  UNION ALL SELECT rid, k, least_, string_split_regex(t, '{_sql(ACCESS)}'), regexp_extract_all(t, '{_sql(ACCESS)}'), regexp_extract_all(t, '{_sql(ACCESS)}') FROM d, p WHERE k = 1
  UNION ALL SELECT rid, k, least_, string_split_regex(t, '{_sql(HEX)}'), regexp_extract_all(t, '{_sql(HEX)}'), regexp_extract_all(t, '{_sql(HEX)}') FROM d, p WHERE k = 2
  UNION ALL SELECT rid, k, least_, string_split_regex(t, '{_sql(OPAQUE)}'), regexp_extract_all(t, '{_sql(OPAQUE)}'), regexp_extract_all(t, '{_sql(OPAQUE)}') FROM d, p WHERE k = 3
),
e AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m WHERE len(whole) > 0),
s AS (
  SELECT rid, k, val[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(whole[i]) AS n
  FROM e WHERE length(val[i]) >= least_
),
b AS (SELECT * FROM s WHERE k < 3),
x AS (SELECT * FROM s WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = s.rid AND b.a < s.a + s.n AND s.a < b.a + b.n)),
c AS (SELECT * FROM b UNION ALL SELECT * FROM x),
live AS (SELECT v FROM c JOIN d USING (rid) GROUP BY v HAVING count(DISTINCT doc_id) <= 8 AND count(DISTINCT source) <= 2),
kept AS (SELECT * FROM b UNION ALL SELECT * FROM x WHERE v IN (SELECT v FROM live)),
names(k, name) AS (VALUES (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'opaque'))
SELECT doc_id, (SELECT count(*) FROM b WHERE b.rid = d.rid AND k = 0) AS n_assign, (SELECT count(*) FROM b WHERE b.rid = d.rid AND k = 1) AS n_access, (SELECT count(*) FROM b WHERE b.rid = d.rid AND k = 2) AS n_hex,
  sha256(coalesce((SELECT string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FROM b JOIN names USING (k) WHERE b.rid = d.rid), '')) AS base_sha256,
  coalesce((SELECT string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FROM kept JOIN names USING (k) WHERE kept.rid = d.rid), '') AS spans,
  (SELECT count(DISTINCT v) FROM c WHERE c.rid = d.rid AND v IN (SELECT v FROM live)) AS n_live
FROM d
"""


def brute_force(texts: list[str | None]) -> list[list[tuple[int, int, int, str]]]:
    """Base spans by Python's ``re``, for tests: (start, kind, end, value), sorted."""
    out = []
    for t in texts:
        one = []
        for k, p, g, least in (
            (0, ASSIGN, 2, 8),
            (1, "AKIA[A-Z0-9]+", 0, 16),
            (2, "[0-9a-f]+", 0, 32),
        ):
            one += [(m.start(), k, m.end(), m[g]) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= least]
        out.append(sorted(one))
    return out
