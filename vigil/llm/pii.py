"""Personal data in text, with DataFrame and SQL functions only.

Regular expressions propose spans, validators confirm them (octets of an IP
address, digit count of a phone number, Luhn for cards, mod 97 for IBANs), and
words near a span adjust its score. All matching runs in the JVM.

Positions come from splitting the text at the matches: a match starts after
the pieces and matches before it, so running sums of lengths give its place in
code points. The sums go by blocks, which keeps long match lists near linear.
Patterns are anchored to the start of a run (or to the end of the last match)
and possessive, so no text makes them quadratic or deep; they match what the
plain greedy patterns match.

Defined results: null and empty texts have no spans; repeated rows keep their
multiplicity; a null id stays null; other input columns are ignored (those of
``mask`` are kept); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds whose spans stay whatever their score, in output order.
BASE = ("email", "ip", "card", "phone")
#: Kinds the method adds; kept from ``MIN_SCORE`` on.
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
MIN_SCORE = 0.5
NEAR = 40
NEAR_BONUS = 0.3

# Patterns (Java regular expressions).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Cheap tests a text must pass before the pattern is tried.
MUST_HAVE = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
# Score of a confirmed span without context, and the context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
}
BLOCK = 256


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substring({d}, -k, 1) as int)"
    return (f"aggregate(sequence(1, length({d})), 0, (s, k) -> s + "
            f"if(k % 2 = 0, 2 * {digit} - if({digit} > 4, 9, 0), {digit})) % 10 = 0")


def _mod97(x: str) -> str:
    turned = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    value = "ascii(c) - if(ascii(c) > 57, 55, 48)"
    return (f"length({x}) between 15 and 34 and aggregate(split({turned}, ''), 0, (s, c) -> "
            f"if(c = '', s, (s * if(ascii(c) > 57, 100, 10) + {value}) % 97)) = 1")


def _valid(kind: str, x: str) -> str:
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> cast(p as double) <= 255)"
    if kind == "phone":
        return f"length({_digits(x)}) between 8 and 15"
    if kind == "card":
        return f"if(length({_digits(x)}) between 16 and 19, {_luhn(_digits(x))}, false)"
    if kind == "iban":
        return _mod97(f"replace({x}, ' ', '')")
    return "true"


def find(text: Column | str, df: DataFrame, out: str = "_spans") -> DataFrame:
    """Add ``out``: a struct with one array of (kind, start, end, score) per
    kind, start and end in code points, end exclusive."""
    df = df.withColumn("_t", F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))
    empty = F.array().cast("array<string>")
    matches, gaps = {}, {}
    for k in KINDS:
        found = F.regexp_extract_all("_t", F.lit(PATTERNS[k]), F.lit(0))
        if k in MUST_HAVE:
            found = F.when(F.contains("_t", F.lit(MUST_HAVE[k])), found).otherwise(empty)
        else:
            found = F.when(F.col("_t").rlike("[0-9]"), found).otherwise(empty)
        matches[f"_m_{k}"] = found
    df = df.withColumns(matches)
    for k in KINDS:
        pieces = F.transform(F.split("_t", PATTERNS[k]), F.length)
        gaps[f"_g_{k}"] = F.when(F.size(f"_m_{k}") > 0, pieces).otherwise(F.array().cast("array<int>"))
    df = df.withColumns(gaps)
    df = df.withColumns({f"_l_{k}": F.expr(
        f"zip_with(_m_{k}, slice(_g_{k}, 1, size(_m_{k})), (x, y) -> cast(length(x) + y as bigint))") for k in KINDS})
    df = df.withColumns({f"_b_{k}": F.expr(
        f"aggregate(sequence(1, cast(ceil((size(_l_{k}) + 1) / {BLOCK}) as int)), array(0L), (a, b) -> "
        f"concat(a, array(element_at(a, -1) + aggregate(slice(_l_{k}, (b - 1) * {BLOCK} + 1, {BLOCK}), 0L, "
        f"(s, v) -> s + v))))") for k in KINDS})
    spans = {}
    for k in KINDS:
        start = (f"_b_{k}[i div {BLOCK}] + aggregate(slice(_l_{k}, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK}), 0L, "
                 f"(s, v) -> s + v) + _g_{k}[i]")
        spans[f"_s_{k}"] = F.expr(
            f"filter(transform(_m_{k}, (x, i) -> if({_valid(k, 'x')}, "
            f"named_struct('kind', '{k}', 'start', {start}, 'n', length(x)), null)), s -> s is not null)")
    df = df.withColumns(spans)
    scored = []
    for k in KINDS:
        near = (f"lower(substring(_t, cast(greatest(s.start - {NEAR}, 0) as int) + 1, "
                f"cast(least(s.start, {NEAR}) as int)))")
        scored.append(F.expr(
            f"transform(_s_{k}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.start + s.n, 'score', "
            f"{PRIOR[k]}D + if({near} rlike '\\\\b({CONTEXT[k]})\\\\b', {NEAR_BONUS}D * (1 - {PRIOR[k]}D), 0D)"
            f" + if({near} rlike '\\\\b({CONTEXT[k]})\\\\b' and '{k}' = 'ssn', 0.3D, 0D)))").alias(k))
    df = df.withColumn("_scored", F.struct(*scored))
    kept = [F.col(f"_scored.{k}").alias(k) for k in BASE]
    kept += [F.expr(f"filter(_scored.{k}, s -> s.score >= {MIN_SCORE})").alias(k) for k in ADDED]
    own = [f"_{c}_{k}" for c in "mglbs" for k in KINDS]
    return df.withColumn(out, F.struct(*kept)).drop("_scored", *own, *(["_t"] if out != "_t" else []))


def _joined(kinds: tuple[str, ...]) -> Column:
    each = F.concat(*[F.col(f"_spans.{k}") for k in kinds])
    return F.array_join(F.transform(each, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text: ``id_col``, n_email, n_ip, n_card,
    n_phone, base_sha256 (of the base spans), spans (all), score (largest)."""
    df = find("text", docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    df = df.drop("text")
    every = F.concat(*[F.col(f"_spans.{k}") for k in KINDS])
    return df.select(
        F.col("id").alias(id_col),
        *[F.size(f"_spans.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(BASE), 256).alias("base_sha256"),
        _joined(KINDS).alias("spans"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["score"])), F.lit(0.0)).alias("score"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that
    overlap become one mask named after the first. A null text stays null."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # no input name can clash with a helper column
    at = inner[names.index(text_col)]
    df = find(at, docs.toDF(*inner))
    every = F.array_sort(F.transform(F.concat(*[F.col(f"_spans.{k}") for k in KINDS]), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))))
    df = df.withColumn("_all", every)
    # kept[i]: text between masks; a span inside the last mask adds nothing
    built = F.expr(
        f"aggregate(_all, named_struct('at', 0L, 'parts', cast(array() as array<string>)), (a, s) -> "
        f"named_struct('at', greatest(a.at, -s.stop), 'parts', if(s.start >= a.at, concat(a.parts, "
        f"array(substring({at}, cast(a.at as int) + 1, cast(s.start - a.at as int)), "
        f"concat('[', upper(s.kind), ']'))), a.parts)), "
        f"a -> concat(array_join(a.parts, ''), substring({at}, cast(a.at as int) + 1)))")
    df = df.withColumn("_new", F.when(F.size("_all") > 0, built).otherwise(F.col(at).cast("string")))
    return df.select(*[(F.col("_new") if c == at else F.col(c)).alias(n) for c, n in zip(inner, names)])
