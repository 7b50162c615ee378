"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 or more characters: such runs are maximal, so both find the same
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 or more
ASSIGN_LEAST = 12
#: Classes of characters: name, pattern of a candidate string (a letter-only string is a word, not a candidate), least entropy.
WINDOW = 20
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{20,}", 2.8),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 3.6),
)
#: Candidates that hold one of these (in lower case) are known to be harmless.
ALLOW = r"example|placeholder|xxxxxxxx|00000000|12345678|abcdefgh|deadbeefdeadbeef|your[_-]?(key|token|secret)"
CHUNK = 512


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, s), s a group if one is given: between matches lie the split parts."""
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    kind = "struct<at:int,out:array<struct<start:int,end:int,s:string>>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out")).cast(kind)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["s"].alias("s")))).alias("out"),
    ).cast(kind)
    zipped = F.arrays_zip(parts.alias("gap"), matches.alias("m"), words.alias("s"))
    zipped = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z: F.struct(z["gap"].alias("gap"), z["m"].alias("m"), z["s"].alias("s")))
    return F.when(text.rlike(pattern), F.aggregate(zipped, empty, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,s:string>>"))


def _sum_term(c: Column) -> Column:
    """c log2 c, of a count from 0 up to the window."""
    return F.element_at(F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(WINDOW + 2)]), c + 1)


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def _hot(piece: Column, limit: float) -> Column:
    """First start and last end of the windows of a piece whose entropy reaches the limit: (first, last), first null if none.

    Moving the window by one changes two counts, so only their terms of sum(c log2 c) are replaced.
    """
    most = (math.log2(WINDOW) - limit) * WINDOW + 1e-9  # entropy >= limit means sum(c log2 c) <= most
    begin = F.substring(piece, 1, WINDOW)
    start = F.aggregate(F.array_distinct(F.split(begin, "")), F.lit(0.0), lambda a, ch: a + F.when(ch == "", 0.0).otherwise(_sum_term(_count(begin, ch))))
    kind = "struct<sum:double,first:int,last:int>"
    state = F.struct(start.alias("sum"), F.when(start <= most, 0).alias("first"), F.when(start <= most, WINDOW).alias("last")).cast(kind)

    def step(a: Column, i: Column) -> Column:
        gone, mid, new = F.substr(piece, i, F.lit(1)), F.substr(piece, i + 1, F.lit(WINDOW - 1)), F.substr(piece, i + WINDOW, F.lit(1))
        left, came = _count(mid, gone), _count(mid, new)
        total = a["sum"] - _sum_term(left + 1) + _sum_term(left) - _sum_term(came) + _sum_term(came + 1)
        hot = total <= most
        return F.struct(total.alias("sum"), F.coalesce(a["first"], F.when(hot, i)).alias("first"), F.when(hot, i + WINDOW).otherwise(a["last"]).alias("last")).cast(kind)

    steps = F.filter(F.sequence(F.lit(0), F.length(piece) - WINDOW), lambda i: i > 0)
    return F.aggregate(steps, state, step)


def _entropy(text: Column, pattern: str, limit: float) -> Column:
    """Spans (start, end) over the hot windows of each candidate; long candidates are read in overlapping chunks."""
    candidates = F.filter(_found(text, pattern), lambda c: ~F.lower(c["s"]).rlike(ALLOW))

    def span(c: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c["s"]) - WINDOW, F.lit(0)), F.lit(CHUNK)), lambda o: F.struct(o.alias("o"), _hot(F.substr(c["s"], o + 1, F.lit(CHUNK + WINDOW - 1)), limit).alias("h")))
        hot = F.filter(chunks, lambda x: x["h"]["first"].isNotNull())
        return F.struct((c["start"] + F.array_min(F.transform(hot, lambda x: x["o"] + x["h"]["first"]))).alias("start"), (c["start"] + F.array_max(F.transform(hot, lambda x: x["o"] + x["h"]["last"]))).alias("end"))

    return F.filter(F.transform(candidates, span), lambda s: s["start"].isNotNull())


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text of docs (doc_id, text), a row for each row.

    Base spans (assign, access, hex) are the patterns' leftmost non-overlapping matches that are long enough, as whole
    matches; entropy spans are added for candidate strings of a character class with a window of 20 characters whose
    Shannon entropy reaches the class's limit, unless the allow list knows the candidate. Returns doc_id and spans, an
    array of (start, ord, kind, end): code points, end exclusive, sorted by start and kind. Null and empty texts have no
    spans; repeated rows are scanned each; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_found(text, ASSIGN, 2), lambda m: F.length(m["s"]) >= ASSIGN_LEAST)
    kinds = [("assign", assign), ("access", _found(text, ACCESS)), ("hex", _found(text, HEX)), *((name, _entropy(text, pattern, limit)) for name, pattern, limit in CLASSES)]

    def tagged(i: int, name: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("ord"), F.lit(name).alias("kind"), m["end"].alias("end")))

    return docs.select("doc_id", F.array_sort(F.concat(*[tagged(i, *x) for i, x in enumerate(kinds)])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_entropy_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of base spans, and all spans, of every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["ord"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same by other means: candidates without look-around, every window's entropy afresh."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    runs = (("entropy_hex", "[0-9A-Fa-f]{20,}", "[A-Fa-f]", CLASSES[0][2]), ("entropy_base64", "[A-Za-z0-9+/_-]{20,}={0,2}", "[A-Za-z]", CLASSES[1][2]))
    kinds = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), *((name, p, 0) for name, p, _, _ in runs)]
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{name}' AS kind, string_split_regex(t, {quote(p)}) AS g, regexp_extract_all(t, {quote(p)}, 0) AS m, regexp_extract_all(t, {quote(p)}, {group}) AS s FROM d" for i, (name, p, group) in enumerate(kinds))
    most = {i + 3: (math.log2(WINDOW) - limit) * WINDOW + 1e-9 for i, (_, _, _, limit) in enumerate(runs)}
    wanted = " OR ".join(f"(ord = {i + 3} AND regexp_matches(c, '[0-9]') AND regexp_matches(c, '{letter}') AND NOT regexp_matches(lower(c), '{ALLOW}'))" for i, (_, _, letter, _) in enumerate(runs))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({found}),
x AS (SELECT doc_id, ord, kind, g, m, s, unnest(range(1, len(m) + 1)) AS i FROM k),
y AS (SELECT doc_id, ord, kind, (list_sum(list_transform(g[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda p: length(p))), 0))::bigint AS start, length(m[i]) AS n, s[i] AS c FROM x),
w AS (SELECT doc_id, ord, kind, start, c, unnest(range(1, n - {WINDOW - 2})) AS j FROM y WHERE {wanted}),
h AS (SELECT doc_id, ord, kind, start, j FROM (SELECT *, list_sum(list_transform(list_distinct(string_split(substr(c, j, {WINDOW}), '')), lambda ch: ({WINDOW} - length(replace(substr(c, j, {WINDOW}), ch, ''))) * log2({WINDOW}::double - length(replace(substr(c, j, {WINDOW}), ch, ''))))) AS total FROM w)
      WHERE total <= CASE ord WHEN 3 THEN {most[3]!r} ELSE {most[4]!r} END),
a AS (SELECT doc_id, ord, kind, start, start + n AS stop FROM y WHERE (ord = 0 AND length(c) >= {ASSIGN_LEAST}) OR ord IN (1, 2)
      UNION ALL SELECT doc_id, ord, kind, start + min(j) - 1, start + max(j) - 1 + {WINDOW} FROM h GROUP BY doc_id, ord, kind, start),
z AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
      string_agg(kind || ':' || start::varchar || ':' || stop::varchar, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg(kind || ':' || start::varchar || ':' || stop::varchar, ',' ORDER BY start, ord) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)
"""


OP8_SQL = _sql()
