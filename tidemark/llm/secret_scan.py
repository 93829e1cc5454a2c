"""Secret scans: multipart credential linking, in DataFrame functions only.

Base spans are assignments (``password = ...``), access identifiers (``AKIA...``) and long hexadecimal strings. Matches
carry no positions in SQL, so a text is split at a pattern and the lengths of the pieces between and of the matches are
summed up: one pass for the pieces and one for the matches, both linear.

Two kinds of weak candidates are too common to report alone: 40-character base64 strings (what the secret half of an
access key looks like) and endpoints (URLs and host names, see endpoint()). They are joined by position with their complements: a weak
candidate is reported only when its interval, widened by SCOPE code points, meets the interval of an access identifier,
or of an assigned secret for an endpoint, of the same document. The join runs inside a row, between the arrays of a
text's parts, so no text and no pair is shuffled.

Defined results: a null text counts as the empty text and has no spans; repeated rows and null ids are kept; spans of
different kinds may overlap; an empty table gives an empty result; other columns are ignored (redact keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points between complementary parts, at most.
SCOPE = 300
#: Matches whose spans are put into one array before the arrays of a text are joined.
CHUNK = 512
#: Weak candidates that are linked together.
NEAR = 128
MASK = "[SECRET]"

# fixed values: the contract's patterns, letters of the key words in either case
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
# runs as long as needed: the same spans as a run of any length that is then measured
ACCESS_LONG, HEX_LONG = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KEY40 = "[A-Za-z0-9/+]{40,}"
# one class without a repeated group, so that no text is too long for it; endpoint() decides which of its runs count
ENDPOINT = "[A-Za-z0-9][A-Za-z0-9+.:/_-]*[A-Za-z0-9/]"
URL, HOST = "://[A-Za-z0-9]", "^([a-z0-9-]+[a-z0-9.-]*)(:[0-9]+)?(/|$)"
DOMAINS = ("com", "net", "org", "io")


def endpoint(m: Column) -> Column:
    """Whether a run is an endpoint: a URL of any scheme and host, or, in small letters, a host name with two dots, with a port,
    or with one dot before one of DOMAINS."""
    host, port = F.regexp_extract(m, HOST, 1), F.regexp_extract(m, HOST, 2)
    labels = F.regexp_count(host, F.lit("\\."))
    named = host.rlike("[a-z][a-z0-9-]*[a-z0-9]$") & (labels > 0) & ~host.contains("..")
    return m.rlike(URL) | (named & ((labels > 1) | (port != "") | F.substring_index(host, ".", -1).isin(*DOMAINS)))


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end>> of a pattern's leftmost non-overlapping matches (end exclusive, code points). keep is a
    predicate on the match's text; matches that fail it are dropped."""
    # one lambda for matches and pieces: their lengths only, then a running sum
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    measured = F.zip_with(
        whole,
        F.slice(pieces, F.lit(1), F.size(whole)),
        lambda m, p: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), (keep(m) if keep else F.lit(True)).alias("ok")),
    )
    empty = F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)")

    def chunk(part: Column) -> Column:
        """Length and spans of up to CHUNK matches, from the start of the first one's gap."""
        return F.aggregate(
            part,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["len"]).alias("at"),
                F.when(x["ok"], F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["len"]).alias("e")))))
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )

    def whole_text(m: Column) -> Column:
        """The chunks one behind the other: appending to an array copies it, so arrays that grow are kept short."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda i: chunk(F.slice(m, i * CHUNK + 1, F.lit(CHUNK))))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<struct<s: bigint, e: bigint>>>)").alias("out"))
        placed = F.aggregate(
            chunks,
            start,
            lambda acc, c: F.struct(
                (acc["at"] + c["at"]).alias("at"),
                F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"))))).alias("out"),
            ),
        )
        return F.flatten(placed["out"])

    # a one-element array holds the matches, so that they are found once for each text
    summed = F.get(F.transform(F.array(measured), whole_text), F.lit(0))
    return F.when(text.rlike(pattern), summed).otherwise(empty)


def linked(weak: Column, strong: Column, scope: int, wanted: bool) -> Column:
    """The intervals of weak that meet (or, if not wanted, don't meet) one of strong, widened by scope.

    weak comes sorted, as spans() gives it. It is taken NEAR intervals at a time, and each meets only the strong ones that
    its run can reach, so the work is about linear in the longer array and not their product.
    """

    def reaches(s: Column, first: Column, last: Column) -> Column:
        return (s["s"] < last["e"] + scope) & (s["e"] + scope > first["s"])

    def run(i: Column) -> Column:
        own = F.slice(weak, i * NEAR + 1, F.lit(NEAR))
        ends = F.struct(own.alias("own"), F.get(own, F.lit(0)).alias("first"), F.element_at(own, -1).alias("last"))
        # one-element arrays hold what the lambdas below use, so that it is made once for each run
        close = F.transform(F.array(ends), lambda r: F.struct(r["own"].alias("own"), F.filter(strong, lambda s: reaches(s, r["first"], r["last"])).alias("close")))
        return F.get(F.transform(close, lambda r: F.filter(r["own"], lambda w: F.exists(r["close"], lambda s: reaches(s, w, w)) == F.lit(wanted))), F.lit(0))

    runs = F.sequence(F.lit(0), F.floor((F.size(weak) - 1) / NEAR).cast("int"))
    return F.when(F.size(weak) > 0, F.flatten(F.transform(runs, run))).otherwise(weak)


def near(weak: Column, strong: Column, scope: int = SCOPE) -> Column:
    """The intervals of weak that meet one of strong, widened by scope."""
    return linked(weak, strong, scope, True)


def partners(weak: Column, strong: Column, scope: int = SCOPE) -> Column:
    """For each interval of weak the nearest of strong (k, s, e) within scope, then the first: array<struct<d, s, e, k>>. weak
    comes sorted and is taken NEAR intervals at a time, as in linked()."""

    def gap(s: Column, w: Column) -> Column:
        return F.greatest(s["s"] - w["e"], w["s"] - s["e"], F.lit(0).cast("long"))

    def run(i: Column) -> Column:
        own = F.slice(weak, i * NEAR + 1, F.lit(NEAR))
        ends = F.struct(own.alias("own"), F.get(own, F.lit(0)).alias("first"), F.element_at(own, -1).alias("last"))
        reach = lambda s, r: (s["s"] < r["last"]["e"] + scope) & (s["e"] + scope > r["first"]["s"])
        close = F.transform(F.array(ends), lambda r: F.struct(r["own"].alias("own"), F.filter(strong, lambda s: reach(s, r)).alias("close")))
        one = lambda w, r: F.array_min(F.transform(r["close"], lambda s: F.struct(gap(s, w).alias("d"), s["s"].alias("s"), s["e"].alias("e"), s["k"].alias("k"))))
        return F.get(F.transform(close, lambda r: F.transform(r["own"], lambda w: one(w, r))), F.lit(0))

    runs = F.sequence(F.lit(0), F.floor((F.size(weak) - 1) / NEAR).cast("int"))
    empty = F.expr("cast(array() as array<struct<d: bigint, s: bigint, e: bigint, k: int>>)")
    return F.when(F.size(weak) > 0, F.flatten(F.transform(runs, run))).otherwise(empty)


def outside(weak: Column, strong: Column) -> Column:
    """The intervals of weak that overlap none of strong."""
    return linked(weak, strong, 0, False)


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with the columns __assign, __access, __hex, __key, __endpoint: arrays of spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("__text", text).withColumns(
        {
            "__assign": spans(F.col("__text"), ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            "__access": spans(F.col("__text"), ACCESS_LONG),
            "__hex": spans(F.col("__text"), HEX_LONG),
            "__key": spans(F.col("__text"), KEY40, lambda m: (F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")),
            "__endpoint": F.when(
                F.col("__text").rlike(ACCESS_LONG) | F.col("__text").rlike(ASSIGN),
                spans(F.col("__text"), ENDPOINT, endpoint),
            ).otherwise(F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)")),
        }
    )
    # columns that later ones refer to are materialised once by the projections above
    found = found.withColumn("__key", near(F.col("__key"), F.col("__access"), scope))
    found = found.withColumn("__key", outside(F.col("__key"), F.concat("__assign", "__access", "__hex")))
    return found.withColumn("__endpoint", near(F.col("__endpoint"), F.concat("__access", "__assign"), scope))


#: Kinds in the order of the contract, the added ones last.
KINDS = (("assign", "__assign"), ("access", "__access"), ("hex", "__hex"), ("key40", "__key"), ("endpoint", "__endpoint"))


def joined(kinds) -> Column:
    """'kind:start:end' of all spans, by start, then kind as listed (then end), comma-joined."""

    def named(i: int, kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k")))

    parts = [named(i, *k) for i, k in enumerate(kinds)]
    return F.array_join(
        F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def links(scope: int = SCOPE) -> Column:
    """'kind:start:end>kind:start:end' for each weak span that find() reports and the complement nearest to it, by start, then
    kind, comma-joined: which parts of a credential belong together."""

    def numbered(i: int) -> Column:
        return F.transform(F.col(KINDS[i][1]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("k")))

    def text(i: Column, s: Column, e: Column) -> Column:
        names = F.array(*(F.lit(k) for k, _ in KINDS))
        return F.concat_ws(":", F.element_at(names, i + 1), s.cast("string"), e.cast("string"))

    def pairs(i: int, strong: Column) -> Column:
        weak = F.col(KINDS[i][1])
        return F.zip_with(weak, partners(weak, strong, scope), lambda w, p: F.struct(w["s"].alias("s"), F.lit(i).alias("i"), w["e"].alias("e"), p.alias("p")))

    every = F.array_sort(F.concat(pairs(3, numbered(1)), pairs(4, F.concat(numbered(0), numbered(1)))))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(">", text(x["i"], x["s"], x["e"]), text(x["p"]["k"], x["p"]["s"], x["p"]["e"]))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, links for every row of docs."""
    found = find(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{k}") for k, c in KINDS[:3]),
        F.sha2(joined(KINDS[:3]), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        links().alias("links"),
    )


def masked(text: Column, every: Column) -> Column:
    """The text with MASK in the place of each interval of a sorted array (of those that overlap: of their union). The text is
    cut once for CHUNK intervals and each of these parts by its own intervals, so that the work does not grow with the square
    of their number."""
    zero = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda i: F.slice(every, i * CHUNK + 1, F.lit(CHUNK)))
    ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda x: x["e"])))
    # where each chunk's part of the text begins: behind the last end of all chunks before it
    begins = F.aggregate(ends, F.array(zero), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))

    def cut(part: Column, at: Column, own: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        step = lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.substring(part, (acc["at"] - at + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(MASK))))
            .alias("out"),
        )
        return F.array_join(F.aggregate(own, start, step)["out"], "")

    def piece(own: Column, at: Column, end: Column) -> Column:
        # a one-element array holds the part, so that it is cut out once
        part = F.array(F.substring(text, (at + 1).cast("int"), F.greatest(zero, end - at).cast("int")))
        return F.get(F.transform(part, lambda p: cut(p, at, own)), F.lit(0))

    def whole(b: Column) -> Column:
        placed = F.zip_with(chunks, F.zip_with(b, ends, lambda x, y: F.struct(x.alias("b"), y.alias("e"))), lambda c, x: F.when(c.isNotNull(), piece(c, x["b"], x["e"])))
        return F.concat(F.array_join(placed, ""), F.substring(text, (F.element_at(b, -1) + 1).cast("int"), F.length(text)))

    return F.get(F.transform(F.array(begins), whole), F.lit(0))


def redact(docs: DataFrame) -> DataFrame:
    """docs, columns unchanged, with every reported span but endpoints replaced by MASK (overlapping spans by one MASK).
    n_chars, if there, is set to the new length of the texts that changed."""
    # the documents travel in one column, so that no name of theirs meets one made here
    found = find(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")))
    every = F.array_sort(F.concat("__assign", "__access", "__hex", "__key"))
    done = masked(F.col("__text"), every)
    found = found.withColumn("__new", F.when(F.size(every) > 0, done))
    own = {c: F.col("__doc")[c] for c in docs.columns}
    changed = {"text": F.coalesce("__new", "text")} | ({"n_chars": F.coalesce(F.length("__new").cast("long"), own["n_chars"])} if "n_chars" in own else {})
    return found.select(*(changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else own[c].alias(c) for c in docs.columns))


def _duck_spans(name: str, pattern: str, ok: str = "true", when: str = "true") -> str:
    """DuckDB: the same split-and-sum for one kind."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT * FROM (
    SELECT '{name}' AS k, rid, i, sum(gap) OVER w + coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, len, m
    FROM (SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(list_transform(ms, lambda x: length(x))) AS len,
                 unnest(list_transform(ps[1:len(ms)], lambda x: length(x))) AS gap
          FROM (SELECT rid, regexp_extract_all(text, '{p}', 0) AS ms, string_split_regex(text, '{p}') AS ps FROM docs WHERE {when}))
    WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {ok}"""


_DUCK_HOST, _DUCK_DOTS = f"regexp_extract(m, '{HOST}', 1)", f"len(regexp_extract_all(regexp_extract(m, '{HOST}', 1), '[.]'))"
_DUCK_ENDPOINT = f"""(regexp_matches(m, '{URL}') OR (regexp_matches({_DUCK_HOST}, '[a-z][a-z0-9-]*[a-z0-9]$') AND {_DUCK_DOTS} > 0 AND NOT contains({_DUCK_HOST}, '..')
    AND ({_DUCK_DOTS} > 1 OR regexp_extract(m, '{HOST}', 2) <> '' OR list_contains({list(DOMAINS)}, string_split({_DUCK_HOST}, '.')[-1]))))"""


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
assign AS ({_duck_spans("assign", ASSIGN, "length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6")}),
access AS ({_duck_spans("access", ACCESS, "len >= 20")}),
hexes AS ({_duck_spans("hex", HEX, "len >= 24", "regexp_matches(text, '[0-9a-f]{24,}')")}),
key40 AS ({_duck_spans("key40", KEY40, "len = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")}),
ends AS ({_duck_spans("endpoint", ENDPOINT, _DUCK_ENDPOINT, when="regexp_matches(text, '" + ACCESS_LONG + "') OR regexp_matches(text, '" + ASSIGN.replace("'", "''") + "')")}),
base AS (SELECT 0 AS o, * FROM assign UNION ALL SELECT 1, * FROM access UNION ALL SELECT 2, * FROM hexes),
added AS (
    SELECT 3 AS o, w.* FROM key40 w
    WHERE EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.o = 1 AND b.s < w.s + w.len + {SCOPE} AND b.s + b.len + {SCOPE} > w.s)
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.s + w.len AND b.s + b.len > w.s)
    UNION ALL
    SELECT 4 AS o, w.* FROM ends w
    WHERE EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.o <= 1 AND b.s < w.s + w.len + {SCOPE} AND b.s + b.len + {SCOPE} > w.s)),
texts AS (SELECT *, k || ':' || CAST(s AS BIGINT) || ':' || CAST(s + len AS BIGINT) AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
nearest AS (
    SELECT a.rid, a.o, a.s, a.len, a.k || ':' || CAST(a.s AS BIGINT) || ':' || CAST(a.s + a.len AS BIGINT) || '>' || b.k || ':' || CAST(b.s AS BIGINT) || ':' || CAST(b.s + b.len AS BIGINT) AS t,
           row_number() OVER (PARTITION BY a.rid, a.o, a.s ORDER BY greatest(b.s - a.s - a.len, a.s - b.s - b.len, 0), b.s, b.s + b.len, b.o) AS n
    FROM added a JOIN base b ON b.rid = a.rid AND b.o <= 1 AND (a.o = 4 OR b.o = 1) AND b.s < a.s + a.len + {SCOPE} AND b.s + b.len + {SCOPE} > a.s),
linked AS (SELECT rid, string_agg(t, ',' ORDER BY s, o, len) AS links FROM nearest WHERE n = 1 GROUP BY rid),
per_doc AS (
    SELECT rid, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS c, count(*) FILTER (o = 2) AS h,
           string_agg(t, ',' ORDER BY s, o, len) FILTER (o < 3) AS base, string_agg(t, ',' ORDER BY s, o, len) AS every
    FROM texts GROUP BY rid)
SELECT d.doc_id, coalesce(p.a, 0) AS n_assign, coalesce(p.c, 0) AS n_access, coalesce(p.h, 0) AS n_hex,
       sha256(coalesce(p.base, '')) AS base_sha256, coalesce(p.every, '') AS spans, coalesce(l.links, '') AS links
FROM docs d LEFT JOIN per_doc p USING (rid) LEFT JOIN linked l USING (rid)"""
