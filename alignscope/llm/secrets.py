"""Secret scan with built-in functions only.

Base kinds come from three patterns. The method adds `entropy` spans: over candidate strings a window slides for each
character class; the counts of its symbols are kept up to date by one step in and one step out, and with them the
sum of c * log2(c) from which Shannon's entropy follows. Candidates of an allow-list are suppressed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: patterns, kinds in the order that breaks ties
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"  # the same as 16 characters or more of AKIA[A-Z0-9]+: a later start in a run is a shorter one
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Character classes: alphabet (after `fold`), window, least entropy in bits, whether case is folded.
CLASSES = {"hex": ("0123456789abcdef", 20, 3.05, True), "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=", 20, 3.7, False)}
#: A candidate that contains one of these is no secret: placeholders, counted-up samples, words and bare numbers.
ALLOW = "(?i:example|sample|placeholder|changeme|xxxxxx|0123456789|abcdefghij)|^[A-Za-z+/_=-]+$|^[0-9+/_=-]+$"
#: Nor is a path of words: separated, and nowhere broken. Every segment holds letters or digits alone, as random keys
#: hardly do. No pattern repeats a group, which would take stack for every repeat.
SEPARATOR = "[+/_=-]"
BROKEN = "^[+/_=-]|[+/_=-]{2}|[A-Za-z0-9]{20}|[A-Za-z][0-9]|[0-9][A-Za-z]"

_EMPTY = "cast(array() as array<struct<start:int,rank:int,stop:int>>)"


def _spans(matches: str, gaps: str, rank: int, keep: str = "true", lo: str = "0", hi: str | None = None, block: int = 256) -> str:
    """Spans of matches from the lengths of what lies between; `keep` may use i (0-based).

    Appending copies an array, so spans are gathered in blocks and the blocks joined once: the work grows with the matches.
    """
    hi = hi or f"length({matches}[i])"
    inner = f"""aggregate(sequence(b * {block}, least(size({matches}), (b + 1) * {block}) - 1), named_struct('at', s.at, 'out', {_EMPTY}),
        (p, i) -> named_struct('at', p.at + length({gaps}[i]) + length({matches}[i]),
            'out', case when {keep} then array_append(p.out, named_struct('start', p.at + length({gaps}[i]) + {lo}, 'rank', {rank}, 'stop', p.at + length({gaps}[i]) + {hi})) else p.out end))"""
    return f"""case when size({matches}) > 0 then aggregate(sequence(0, int((size({matches}) - 1) div {block})), named_struct('at', 0, 'out', cast(array() as array<array<struct<start:int,rank:int,stop:int>>>)),
        (s, b) -> element_at(transform(array({inner}), r -> named_struct('at', r.at, 'out', array_append(s.out, r.out))), 1),
        s -> flatten(s.out)) else {_EMPTY} end"""


def _entropy(kind: str) -> str:
    """For a candidate x: struct(lo, hi), the hull of its windows of this class with enough entropy; lo = -1 if none.

    The hull is taken over windows whose characters all belong to the class.
    """
    alphabet, width, least, fold = CLASSES[kind]
    text = "lower(x)" if fold else "x"
    symbols = f"transform(split({text}, ''), ch -> if(ch = '', 0, instr('{alphabet}', ch)))"
    f = lambda c: f"({c} * log2(greatest({c}, 1)))"
    # one step: symbol `a` enters, symbol `b` (0: none) leaves; t is the sum of c * log2(c), n the symbols of the class
    return f"""aggregate(
        transform({symbols}, (a, i) -> named_struct('a', a, 'i', i, 'b', 0)),
        named_struct('c', array_repeat(0, {len(alphabet)}), 't', 0D, 'n', 0, 'last', cast(array() as array<int>), 'lo', -1, 'hi', -1),
        (s, e) -> {_step(width, least, f)},
        s -> named_struct('lo', s.lo, 'hi', s.hi))"""


def _step(width: int, least: float, f) -> str:
    leave = f"if(e.i >= {width}, s.last[0], 0)"
    # a struct of what the step changes, then the new state from it
    inner = f"""element_at(transform(array(named_struct('a', e.a, 'b', {leave})), d ->
        named_struct('d', d,
            'ca', if(d.a > 0, s.c[d.a - 1], 0), 'cb', if(d.b > 0, s.c[d.b - 1], 0))), 1)"""
    moved = f"""element_at(transform(array({inner}), g -> named_struct('g', g,
        't', s.t + case when g.d.a = g.d.b then 0D else if(g.d.a > 0, {f('(g.ca + 1)')} - {f('g.ca')}, 0D) + if(g.d.b > 0, {f('(g.cb - 1)')} - {f('g.cb')}, 0D) end,
        'n', s.n + int(g.d.a > 0) - int(g.d.b > 0))), 1)"""
    high = f"(m.n = {width} and log2({width}D) - m.t / {width} >= {least}D)"
    return f"""element_at(transform(array({moved}), m -> named_struct(
        'c', if(m.g.d.a = m.g.d.b, s.c, transform(s.c, (c, k) -> c + int(k + 1 = m.g.d.a) - int(k + 1 = m.g.d.b))),
        't', m.t, 'n', m.n,
        'last', array_append(if(e.i >= {width}, slice(s.last, 2, {width} - 1), s.last), e.a),
        'lo', if(s.lo < 0 and {high}, e.i - {width - 1}, s.lo),
        'hi', if({high}, e.i + 1, s.hi))), 1)"""


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: str = ALLOW, broken: str = BROKEN) -> DataFrame:
    """One row per row of docs: (doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans).

    spans lists kind:start:end in code points by start, then kind, comma-joined; base_sha256 is the digest of the
    base kinds alone. Null and empty texts have no spans (empty strings, zero counts). Repeated rows give repeated
    results, a null id is returned as null, an empty table gives an empty table; other columns are not read.
    """
    q = lambda rx: "r'" + rx.replace("'", "\\x27") + "'"
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for name, rx in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("x", CANDIDATE)):
        t = t.withColumn(name, F.expr(f"regexp_extract_all(t, {q(rx)}, 0)"))
    empty = "cast(array() as array<string>)"
    t = t.withColumn("av", F.expr(f"case when size(a) > 0 then regexp_extract_all(t, {q(ASSIGN)}, 2) else {empty} end"))
    for name, rx in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("x", CANDIDATE)):
        t = t.withColumn(f"{name}g", F.expr(f"case when size({name}) > 0 then split(t, {q(rx)}, -1) else {empty} end"))
    # the windows of each candidate that the allow-list lets through
    none = "named_struct('lo', -1, 'hi', -1)"
    scored = ", ".join(f"{_entropy(k)}" for k in CLASSES)
    t = t.withColumn("xe", F.expr(f"transform(x, x -> case when x rlike {q(allow)} or x rlike {q(SEPARATOR)} and not x rlike {q(broken)} then array({', '.join([none] * len(CLASSES))}) else array({scored}) end)"))
    t = t.withColumn("xl", F.expr("transform(xe, w -> array_min(transform(filter(w, v -> v.lo >= 0), v -> v.lo)))")).withColumn("xh", F.expr("transform(xe, w -> array_max(transform(w, v -> v.hi)))"))
    t = t.select(
        "doc_id",
        F.expr(_spans("a", "ag", 1, "length(av[i]) >= 8")).alias("s1"),
        F.expr(_spans("k", "kg", 2)).alias("s2"),
        F.expr(_spans("h", "hg", 3)).alias("s3"),
        F.expr(_spans("x", "xg", 4, "xl[i] is not null", "xl[i]", "xh[i]")).alias("s4"),
    )
    names = ", ".join(f"'{k}'" for k in KINDS)
    said = lambda spans: f"array_join(transform(array_sort({spans}), v -> concat(element_at(array({names}), v.rank), ':', v.start, ':', v.stop)), ',')"
    return t.select(
        "doc_id",
        *(F.expr(f"cast(size({s}) as bigint)").alias(f"n_{k}") for s, k in zip(("s1", "s2", "s3", "s4"), KINDS, strict=True)),
        F.expr(f"sha2({said('concat(s1, s2, s3)')}, 256)").alias("base_sha256"),
        F.expr(said("concat(s1, s2, s3, s4)")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _duck_spans(kind: int, rx: str, keep: str = "true") -> str:
    rx = rx.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{rx}', 0)) + 1), lambda i: struct_pack(
        start := list_sum(list_transform(string_split_regex(t, '{rx}')[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{rx}', 0)[1:i - 1], lambda v: length(v))), 0),
        rank := {kind}, m := regexp_extract_all(t, '{rx}', 0)[i], g := {"regexp_extract_all(t, '" + rx + "', 2)[i]" if "Pp" in rx else "''"})), lambda v: {keep})"""


def _duck_hull(kind: str) -> str:
    """1-based starts of the windows with enough entropy, by definition."""
    alphabet, width, least, fold = CLASSES[kind]
    text = "lower(m)" if fold else "m"
    return f"list_filter(range(1, length(m) - {width} + 2), lambda j: translate(substr({text}, j, {width}), '{alphabet}', '') = '' and list_aggregate(string_split(substr({text}, j, {width}), ''), 'entropy') >= {least})"


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as (select doc_id, t, {_duck_spans(1, ASSIGN, "length(v.g) >= 8")} as s1, {_duck_spans(2, ACCESS)} as s2, {_duck_spans(3, HEX)} as s3 from d),
candidate as (select doc_id, unnest({_duck_spans(4, CANDIDATE)}) as c from d),
hull as (select doc_id, c.start as pos0, {_duck_hull("hex")} as jh, {_duck_hull("base64")} as jb from (select doc_id, c, c.m as m from candidate where not regexp_matches(c.m, '{ALLOW}') and (not regexp_matches(c.m, '{SEPARATOR}') or regexp_matches(c.m, '{BROKEN}')))),
found as (select doc_id, list(struct_pack(start := pos0 + least(coalesce(list_min(jh), 1e9), coalesce(list_min(jb), 1e9))::bigint - 1, rank := 4,
    stop := pos0 + greatest(coalesce(list_max(jh) + {CLASSES["hex"][1]}, 0), coalesce(list_max(jb) + {CLASSES["base64"][1]}, 0)) - 1)) as s4 from hull where len(jh) + len(jb) > 0 group by doc_id),
-- base spans with stops
b as (select doc_id, list_transform(s1, lambda v: struct_pack(start := v.start::bigint, rank := 1, stop := (v.start + length(v.m))::bigint)) as s1,
    list_transform(s2, lambda v: struct_pack(start := v.start::bigint, rank := 2, stop := (v.start + length(v.m))::bigint)) as s2,
    list_transform(s3, lambda v: struct_pack(start := v.start::bigint, rank := 3, stop := (v.start + length(v.m))::bigint)) as s3 from base),
e as (select b.*, coalesce(list_transform(s4, lambda v: struct_pack(start := v.start::bigint, rank := v.rank, stop := v.stop::bigint)), []) as s4 from b left join found using (doc_id))
select doc_id, len(s1)::bigint as n_assign, len(s2)::bigint as n_access, len(s3)::bigint as n_hex, len(s4)::bigint as n_entropy,
    sha256(array_to_string(list_transform(list_sort(s1 || s2 || s3), lambda v: ['assign', 'access', 'hex', 'entropy'][v.rank] || ':' || v.start || ':' || v.stop), ',')) as base_sha256,
    array_to_string(list_transform(list_sort(s1 || s2 || s3 || s4), lambda v: ['assign', 'access', 'hex', 'entropy'][v.rank] || ':' || v.start || ':' || v.stop), ',') as spans
from e
"""
