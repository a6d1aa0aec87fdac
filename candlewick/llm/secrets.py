"""Secret scan over whole texts, in DataFrame functions only.

Base kinds are found by regular expressions, leftmost and non-overlapping; matches that are too short are dropped. A match's position
is the length of all gaps and matches before it. The method adds `entropy` spans: candidate strings (runs of key characters with a
digit, 20 or more) over which a window slides. The window's character counts are kept: what enters adds one, what leaves takes one away,
and the entropy's sum changes by these two counts alone. The highest entropy is held against a threshold of the string's character class;
every candidate is in one class. Candidates that overlap a base span or match the allow-list are suppressed; base spans always stay.

Defined cases: a null text counts as empty; no spans give empty strings (and the digest of one); repeated rows give repeated results;
an empty table gives no rows; other columns of the input are not read, but for redact(), which keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds' expressions, and their least lengths (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
#: Never reported as entropy: UUIDs, runs of separators and digits (dates, rules, numbers), keys that end as documentation's examples do.
ALLOWED = r"^((?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})|[0-9+/_=-]+|.*EXAMPLE(KEY)?)$"
WINDOW = 20
#: Bits in a window of 20 characters, by class (hex digits and separators; lower or upper case alone; both cases); such a window holds 4.32
#: at most. Set so that of random strings of 20 characters at most 3 % stay below (simulated, 60,000 each): hex 3.0 %, base36 (lower)
#: 0.9 %, base32 (upper) 1.9 %, base62 (mixed) 2.3 %.
BITS = {"hex": 3.0, "lower": 3.4, "upper": 3.4, "mixed": 3.7}
#: Candidates' characters lie between these codes.
FIRST, LAST = ord("+"), ord("z")
#: Spans are gathered in blocks of so many, as an array that grows by one is copied each time.
BLOCK = 256
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"


def _quoted(pattern: str) -> str:
    """For a SQL string literal."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _found(df: DataFrame, text: str, pattern: str, prefix: str, group: int = 0) -> DataFrame:
    """Adds the matches, their parts (a group, or the matches again) and the gaps before them; nothing more is looked for without matches."""
    df = df.withColumn(f"{prefix}_all", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    any_ = F.size(f"{prefix}_all") > 0
    part = F.when(any_, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))) if group else F.col(f"{prefix}_all")
    return df.select("*", part.alias(f"{prefix}_part"), F.when(any_, F.split(F.col(text), pattern, -1)).alias(f"{prefix}_gap"))


def _spans(prefix: str, kind: str, keep: str) -> Column:
    """Spans (start, kind number, stop) of the matches for which `keep` holds (m: the match, p: its part)."""
    kind_of = "struct<start:int,kind:int,stop:int,m:string>"
    m, at = f"{prefix}_all[i]", f"a.at + length({prefix}_gap[i])"
    span = f"named_struct('start', {at}, 'kind', {KINDS.index(kind)}, 'stop', {at} + length({m}), 'm', {m})"
    keep = keep.replace("{m}", m).replace("{p}", f"{prefix}_part[i]")
    block = f"""aggregate(sequence(k * {BLOCK}, least(k * {BLOCK} + {BLOCK - 1}, size({prefix}_all) - 1)), named_struct('at', o.at, 'out', CAST(array() AS array<{kind_of}>)),
        (a, i) -> named_struct('at', {at} + length({m}), 'out', IF({keep}, array_append(a.out, {span}), a.out)))"""
    return F.expr(f"""CASE WHEN size({prefix}_all) = 0 THEN CAST(array() AS array<{kind_of}>)
        ELSE aggregate(sequence(0, (size({prefix}_all) - 1) DIV {BLOCK}), named_struct('at', 0, 'out', CAST(array() AS array<array<{kind_of}>>)),
            (o, k) -> transform(array({block}), b -> named_struct('at', b.at, 'out', array_append(o.out, b.out)))[0], o -> flatten(o.out)) END""")


def _highest_entropy(string: str) -> str:
    """SQL of the highest window entropy of `string`, in bits.

    n: how often each character is in the window; s: the sum of c log2 c over these counts, which changes with the two that change. The string
    is ASCII and read as bytes, as a character of a string is looked for from its start.
    """
    f = "element_at(array(0D, 0D, {}), {{}} + 1)".format(", ".join(f"{c}D * log2({c}D)" for c in range(2, WINDOW + 2)))
    place = f"ascii(CAST(substring(bytes, {{}}, 1) AS string)) - {FIRST - 1}"
    put = lambda n, j, v: f"concat(slice({n}, 1, {j} - 1), array({v}), slice({n}, {j} + 1, {LAST - FIRST + 1}))"
    bound = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    grown = f"named_struct('s', a.s + {f.format('c + 1')} - {f.format('c')}, 'n', {put('a.n', 'j', 'c + 1')})"
    enters = bound("j", place.format("i"), bound("c", "element_at(a.n, j)", grown))
    shrunk = f"named_struct('s', e.s + {f.format('c - 1')} - {f.format('c')}, 'n', {put('e.n', 'j', 'c - 1')})"
    leaves = bound("j", place.format(f"i - {WINDOW}"), bound("c", "element_at(e.n, j)", shrunk))
    step = bound("e", enters, bound("w", f"IF(i > {WINDOW}, {leaves}, e)", f"named_struct('s', w.s, 'n', w.n, 'top', IF(i >= {WINDOW}, greatest(a.top, log2({WINDOW}D) - w.s / {WINDOW}), a.top))"))
    fold = f"aggregate(sequence(1, length({string})), named_struct('s', 0D, 'n', array_repeat(0, {LAST - FIRST + 1}), 'top', 0D), (a, i) -> {step}, a -> a.top)"
    return bound("bytes", f"CAST({string} AS binary)", fold)


def with_spans(docs: DataFrame, text: str, base: str = "base_spans", added: str = "added_spans", allowed: str = ALLOWED) -> DataFrame:
    """docs with two more columns: base and added spans as arrays of (start, kind, stop, m), in code points, end exclusive."""
    t = "__text"
    df = docs.withColumn(t, F.coalesce(F.col("`" + text.replace("`", "``") + "`").cast("string"), F.lit("")))
    for pattern, prefix, group in ((ASSIGN, "__as", 2), (ACCESS, "__ac", 0), (HEX, "__hx", 0)):
        df = _found(df, t, pattern, prefix, group)
    # Positions of candidates are wanted only where one of them is long enough.
    df = _found(df.withColumn("__run", F.expr(f"IF(exists(regexp_extract_all({t}, '{_quoted(CANDIDATE)}', 0), m -> length(m) >= {WINDOW}), {t}, '')")), "__run", CANDIDATE, "__ca")
    df = df.select(
        "*",
        F.concat(_spans("__as", "assign", f"length({{p}}) >= {LEAST_ASSIGN}"), _spans("__ac", "access", f"length({{m}}) >= {LEAST_ACCESS}"), _spans("__hx", "hex", "true")).alias("__base"),
        _spans("__ca", "entropy", f"length({{m}}) >= {WINDOW}").alias("__cand"),
    )
    rule = _quoted(allowed)
    df = df.withColumn("__cand", F.expr(f"filter(__cand, s -> NOT exists(__base, b -> b.start < s.stop AND s.start < b.stop) AND NOT s.m RLIKE '{rule}')"))
    bits = f"CASE WHEN s.m RLIKE '^[0-9a-fA-F+/_=-]+$' THEN {BITS['hex']}D WHEN NOT s.m RLIKE '[A-Z]' THEN {BITS['lower']}D WHEN NOT s.m RLIKE '[a-z]' THEN {BITS['upper']}D ELSE {BITS['mixed']}D END"
    df = df.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns], F.sort_array("__base").alias(base), F.expr(f"filter(__cand, s -> {_highest_entropy('s.m')} >= {bits})").alias(added))
    return df


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans as kind:start:end."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", allowed=allowed)
    found = found.select("doc_id", "base_spans", F.sort_array(F.concat("base_spans", "added_spans")).alias("all_spans"))
    n = lambda kind: F.expr(f"CAST(size(filter(base_spans, s -> s.kind = {KINDS.index(kind)})) AS long)").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans"), (F.size("all_spans") - F.size("base_spans")).cast("long").alias("n_entropy")
    )


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """docs with every span of the text (overlapping ones as one) replaced by `mask`; a null text stays null."""
    found, t = with_spans(docs, text, "__b", "__a"), "`" + text.replace("`", "``") + "`"
    found = found.withColumn("__every", F.sort_array(F.concat("__b", "__a")))
    cut = F.expr(f"""
        aggregate(sequence(0, (size(__every) - 1) DIV {BLOCK}), named_struct('at', 0, 'out', CAST(array() AS array<string>)),
            (o, k) -> transform(array(aggregate(slice(__every, k * {BLOCK} + 1, {BLOCK}), named_struct('at', o.at, 'out', CAST(array() AS array<string>)),
                (a, s) -> named_struct('at', greatest(a.at, s.stop), 'out', IF(s.start < a.at, a.out, array_append(a.out, concat(substring({t}, a.at + 1, s.start - a.at), '{_quoted(mask)}')))))),
                b -> named_struct('at', b.at, 'out', array_append(o.out, array_join(b.out, ''))))[0],
            o -> concat(array_join(o.out, ''), substring({t}, o.at + 1)))""")
    return found.withColumn(text, F.when(F.size("__every") > 0, cut).otherwise(F.col(t))).select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
