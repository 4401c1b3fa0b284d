"""Personal data by patterns, checksums and context (operator 8, DataFrame functions only).

A pattern proposes spans, a validator confirms them (digit counts, Luhn, IP
parts, mod-97), and words near the span move a score.  The four base kinds are
kept by pattern and validator alone; the kinds that the method adds need a
score of at least ``MIN_SCORE``.

Matches are found left to right without overlap per kind, whole, in one pass
over each text (account numbers: among the strings that pass their check, since
only length and checksum tell where one ends); positions are running sums of the pieces between matches.
The patterns are written with possessive runs and anchored starts, which match
the same spans as the plain forms in time proportional to the text (no
backtracking over long runs, no recursion in the matcher).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of context on each side of a span.
CONTEXT = 40
#: Score that the kinds added by the method need.
MIN_SCORE = 0.6
CONTEXT_BONUS = 0.4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


def _char(x: Column, i: Column) -> Column:
    return F.substr(x, i, F.lit(1))


def _luhn(m: Column) -> Column:
    """Every second digit from the right is doubled, less 9 above 9; the sum is a multiple of 10."""
    d = _digits(m)

    def add(total, i):
        v = _char(d, F.length(d) - i + 1).cast("int")
        return total + F.when(i % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    return F.when(_digit_count(13, 19)(m), _luhn(m)).otherwise(False)


def _ip(m: Column) -> Column:
    """Four parts of at most 255; leading zeros do not count."""
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) <= 3, F.concat(F.lit("0"), bare).cast("int") <= 255).otherwise(False)
    return F.forall(F.split(m, "[.]"), small)


def _iban(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters become 10 to 35, the number is 1 modulo 97."""
    x = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))

    def step(r, i):
        c = _char(turned, i)
        return F.when(c.between("0", "9"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97

    return F.when(F.length(x).between(15, 34), F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step) == 1).otherwise(False)


def _ssn(m: Column) -> Column:
    return ~(m.startswith("000") | m.startswith("666") | m.startswith("9") | (F.substr(m, F.lit(5), F.lit(2)) == "00") | m.endswith("0000"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                          # matches the same spans as the plain form; with ``found``, any text that has one
    valid: Callable[[Column], Column]
    score: float                          # before context
    context: str                          # words that raise the score
    must: str | None = None               # a substring that every match has
    base: bool = True
    found: Callable[[Column], Column] | None = None  # the distinct valid strings of a text, where a pattern alone cannot tell their ends


#: Lengths of the IBAN by country code (registry and published national forms).
IBAN_LENGTHS = {c: int(n) for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
_IBAN_START, _END = "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})", "(?![A-Za-z0-9])"


def _iban_of_length(n: int) -> str:
    return f"[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}{_END}"


def _ibans(t: Column) -> Column:
    """Distinct valid IBANs that start anywhere in a text, overlapping proposals too.

    A country code gives the length; for other codes every prefix of 15 to 34
    characters that ends at a word's end is tried.
    """
    by_length = {n: "|".join(c for c, m in IBAN_LENGTHS.items() if m == n) for n in sorted(set(IBAN_LENGTHS.values()))}
    known = "|".join(f"(?:{codes}){_iban_of_length(n)}" for n, codes in by_length.items())
    runs = F.regexp_extract_all(t, F.lit(f"{_IBAN_START}(?=({known}))"), F.lit(1))
    others = F.regexp_extract_all(t, F.lit(f"{_IBAN_START}(?!{'|'.join(IBAN_LENGTHS)})(?=([A-Z0-9](?: ?[A-Z0-9]){{14,33}}))"), F.lit(1))
    after = F.regexp_extract_all(t, F.lit(f"{_IBAN_START}(?!{'|'.join(IBAN_LENGTHS)})(?=[A-Z0-9](?: ?[A-Z0-9]){{14,33}}([A-Za-z0-9]?))"), F.lit(1))
    # the character behind a run tells whether its last word ends there
    others = F.zip_with(others, after, lambda run, c: F.concat(run, F.lower(c)))

    def prefixes(run):
        return F.array(*[F.regexp_extract(run, f"^[A-Z0-9](?: ?[A-Z0-9]){{{n - 1}}}{_END}", 0) for n in range(15, 35)])

    others = F.filter(F.flatten(F.transform(others, prefixes)), lambda x: x != "")
    return F.array_distinct(F.filter(F.concat(runs, others), _iban))


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

KINDS: tuple[Kind, ...] = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", lambda m: F.lit(True), 0.9, "mail|contact|write|address", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", _card, 0.8, "card|visa|master|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _digit_count(9, 15), 0.7, "phone|tel|call|mobile|fax|fon", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]", _iban, 0.7, "iban|account|bank|konto|compte|cuenta", None, False, _ibans),
    Kind("ssn", r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _ssn, 0.3, r"\bssn\b|social security", None, False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _score(k: Kind, near: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(k.score) + F.when(near.rlike(k.context), CONTEXT_BONUS).otherwise(0.0))


def _confirmed(k: Kind, m: Column, near: Column) -> Column:
    return k.valid(m) if k.base else k.valid(m) & (_score(k, near) >= MIN_SCORE)


def _near(before: Column, after: Column) -> Column:
    """Lower-case context of a match from the pieces around it."""
    return F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(F.coalesce(after, F.lit("")), F.lit(CONTEXT))))


def _with_matches(df: DataFrame, k: Kind, text: str, m: str, p: str) -> DataFrame:
    """Adds the matches of a kind and the pieces between them (one more piece than matches); null without a match."""
    t = F.col(text)
    if k.found:  # one pattern per text: its valid strings, the longest first where one starts another
        valid = F.when(t.rlike(k.pattern), F.sort_array(k.found(t), asc=False))
        df = df.withColumn(p, F.when(F.size(valid) > 0, F.concat(F.lit("(?<![A-Za-z0-9])(?:"), F.array_join(valid, "|"), F.lit(f"){_END}"))))
        df = df.withColumn(m, F.regexp_extract_all(t, F.col(p), F.lit(0)))
        return df.withColumn(p, F.split(t, F.col(p), -1))
    found = F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))
    df = df.withColumn(m, F.when(t.contains(k.must), found) if k.must else found)
    return df.withColumn(p, F.when(F.size(m) > 0, F.split(t, k.pattern, -1)))


def _proposals(n: int, m: str, p: str) -> Column:
    """Array of the matches of kind n: order, length of the piece before, match, context."""
    def one(e, i):
        return F.struct(F.lit(n).alias("kind"), i.alias("i"), F.length(e[p]).alias("gap"), e[m].alias("m"),
                        _near(e[p], F.get(F.col(p), i + 1)).alias("near"))

    found = F.filter(F.transform(F.arrays_zip(m, p), one), lambda e: e["m"].isNotNull())
    return F.coalesce(found, F.array().cast("array<struct<kind:int,i:int,gap:int,m:string,near:string>>"))


def _rebuilt(k: Kind) -> Column:
    """The text of __p and __m with the confirmed matches replaced."""
    def joined(piece, i):
        m = F.get(F.col("__m"), i)
        near = _near(piece, F.get(F.col("__p"), i + 1))
        return F.concat(piece, F.when(m.isNull(), "").otherwise(F.when(_confirmed(k, m, near), f"[{k.name.upper()}]").otherwise(m)))

    return F.concat_ws("", F.transform("__p", joined))


def pii_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans: __row, ``keep`` columns, kind (number in KINDS), start, end (code points, end exclusive), score.

    Every input row keeps at least one row (kind null where nothing was confirmed).
    """
    df = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    for n, k in enumerate(KINDS):
        df = _with_matches(df, k, "__t", f"__m{n}", f"__p{n}")
    lists = [_proposals(n, f"__m{n}", f"__p{n}") for n in range(len(KINDS))]
    rows = df.select("__row", *keep, F.explode_outer(F.concat(*lists)).alias("e")).select("__row", *keep, "e.*")
    # positions: running sums over the matches of one kind in one row; both steps below share this partitioning
    order = Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("__row").withColumn("end", F.sum(F.col("gap") + F.length("m")).over(order))
    ok, score = F.lit(False), F.lit(0.0)
    for n, k in enumerate(KINDS):
        ok = F.when(F.col("kind") == n, _confirmed(k, F.col("m"), F.col("near"))).otherwise(ok)
        score = F.when(F.col("kind") == n, _score(k, F.col("near"))).otherwise(score)
    rows = rows.withColumn("ok", ok).withColumn("score", score)
    only = lambda c, name: F.when(F.col("ok"), c).alias(name)
    return rows.select("__row", *keep, only(F.col("kind"), "kind"), only(F.col("end") - F.length("m"), "start"), only(F.col("end"), "end"), only(F.col("score"), "score"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, max_score) for every document row.

    ``spans`` lists kind:start:end of all kinds (base kinds first, in the order
    email, ip, card, phone, then the added ones), by start within a kind;
    ``base_sha256`` is the hash of the same list of base kinds only.  Null or
    empty texts have none.  Rows are told apart by position, so repeated rows
    and null ids give their own results; other columns are not read.
    """
    s = pii_spans(docs.select("doc_id", "text"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = F.struct("kind", "start", "end")
    per = s.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"),
                                 F.max("score").alias("max_score"))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))

    def count(test):
        return F.size(F.filter("all", test)).cast("bigint")

    def of_kind(n):
        return count(lambda x: x["kind"] == n)

    counts = [of_kind(n).alias(f"n_{name}") for n, name in enumerate(BASE)]
    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    return per.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
                      count(lambda x: x["kind"] >= len(BASE)).alias("n_added"), "max_score")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every confirmed span replaced by its kind in brackets, kind after kind.

    A map: the text is rebuilt from the pieces between matches.  Null texts
    stay null.  Other columns pass through whatever their names.
    """
    names = docs.columns
    out = docs.select(F.struct(*[F.col(c) for c in names]).alias("__row"), F.col(text).alias("__t"))
    for k in KINDS:
        out = _with_matches(out, k, "__t", "__m", "__p")
        out = out.select("__row", F.when(F.col("__p").isNotNull(), _rebuilt(k)).otherwise(F.col("__t")).alias("__t"))
    return out.select(*[F.col("__t").alias(c) if c == text else F.col("__row")[c].alias(c) for c in names])
