"""Personal data: regular expressions propose, checksums confirm, context adjusts. SQL functions only.

Method. For each kind a pattern proposes spans; validators confirm them (parts of an IP
address up to 255, Luhn and length for cards, length for phones, mod-97 for IBANs,
letters and digits for secrets). Words of the kind within CONTEXT characters before a span
raise its score by STEP, words of something else lower it. Base kinds (email, ip, card,
phone) stay whatever their score; the kinds that the method adds are reported at LEAST or more:

- iban: as long as its country says, so that words after it stay outside. It counts unless
  words before it say that it is a number of another kind. One of a country that LENGTHS
  doesn't know is a weaker proposal of any length, which counts only with a word of context.
- secret: 32 or more hexadecimal digits, which count only after a word such as token or key
  (a checksum or a commit looks the same).

Patterns are written with possessive repeats and look-behind, so that each text is
passed over once whatever it holds (no backtracking over long runs, no recursion over
many groups); they match what the plain ones of BASE match, which SQL below uses as
they are. Positions come from the lengths of the matches and of what lies between.

Rows: a null text counts as empty: no spans. Rows are treated one by one, so repeated
rows and null ids return as they come. Offsets are code points, end exclusive. Columns of
the input may have any names; working columns get names that none of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spare

CONTEXT, STEP, LEAST = 40, 30, 70
#: Length of an IBAN by country.
LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_KNOWN = "|".join(c for codes in LENGTHS.values() for c in codes)
#: Kinds of spans: four base ones, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
ADDED = KINDS[4:]


def _other_countries() -> str:
    """Two capitals that are no country of LENGTHS."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    held = set(_KNOWN.split("|"))
    return "|".join(f"{a}[{''.join(b for b in letters if a + b not in held)}]" for a in letters)


def _iban() -> str:
    """A country's IBANs by length, and those of other countries."""
    tail = lambda n: rf"\x20?[A-Z0-9]{{{n}}}" if n else ""
    known = [rf"(?:{'|'.join(codes)})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{tail(n % 4)}" for n, codes in LENGTHS.items()]
    other = rf"(?:{_other_countries()})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?"
    return "|".join([*known, other])


_HEX = "[0-9A-Fa-f]{32,}"
_LOCAL = "A-Za-z0-9._%+-"
#: A cheap test, and the pattern.
PATTERNS = {
    "email": (lambda t: t.contains("@"), rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"),
    "phone": (lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), rf"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_iban()})(?![A-Za-z0-9_])"),
    "secret": (lambda t: t.rlike(r"[0-9A-Fa-f]{32}"), rf"(?<![A-Za-z0-9_]){_HEX}+(?![A-Za-z0-9_])"),
}
#: Score of an IBAN of a country that LENGTHS doesn't know, without context.
IBAN_OTHER = 50
#: Score without context in hundredths, words that raise it, and words that lower it.
SCORES = {
    "email": (70, "mail|contact|write|kontakt|correo|courriel", "@"),
    "ip": (50, "ip|host|server|address|adresse", "version|release|section"),
    "card": (60, "card|credit|visa|karte|carte|tarjeta", "isbn|tracking|serial"),
    "phone": (50, "phone|tel|call|mobile|fax|anruf", "isbn|serial|order"),
    "iban": (70, "iban|account|bank|konto|compte|cuenta", "serial|part|order|model|tracking|voucher"),
    "secret": (40, "token|secret|password|passwd|api|key|credential|auth", "sha|md5|checksum|hash|digest|commit|revision"),
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda total, c: (total * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Fa-f]")
    return F.lit(True)


def _confirmed(kind: str, proposed: Column, text: Column) -> Column:
    """The valid ones of some matches, as spans with scores."""
    base, more, less = SCORES[kind]
    said = lambda near, words: F.when(near.rlike(_word(words)), STEP).otherwise(0)

    def scored(x: Column) -> Column:
        near = F.lower(F.substr(text, F.greatest(F.lit(1), x["start"] - CONTEXT + 1), F.least(x["start"], F.lit(CONTEXT))))
        alone = F.when(x["m"].rlike(f"^(?:{_KNOWN})"), base).otherwise(IBAN_OTHER) if kind == "iban" else F.lit(base)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (alone + said(near, more) - said(near, less)).alias("score"))

    spans = F.transform(F.filter(proposed, lambda x: _valid(kind, x["m"])), scored)
    return F.filter(spans, lambda x: x["score"] >= LEAST) if kind in ADDED else spans


def _word(words: str) -> str:
    return f"(?:^|[^a-z0-9_])(?:{words})"


def find_spans(docs: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """docs with a column more: array<struct<kind,start,end,score>>, by kind as in KINDS, then start; scores are hundredths."""
    result, to = to, spare([*docs.columns, to], "_pii")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for kind, (likely, pattern) in PATTERNS.items():
        none = F.array().cast("array<string>")
        docs = docs.withColumn(f"{to}_{kind}_m", F.when(likely(t), F.regexp_extract_all(t, F.lit(f"({pattern})"), 1)).otherwise(none))
    for kind, (_, pattern) in PATTERNS.items():
        docs = docs.withColumn(f"{to}_{kind}_g", F.when(F.size(f"{to}_{kind}_m") > 0, F.transform(F.split(t, pattern, -1), lambda x: F.length(x))).otherwise(F.array().cast("array<int>")))
    empty = F.array().cast("array<struct<m:string,start:int,end:int>>")
    for kind in PATTERNS:
        zipped = F.arrays_zip(F.col(f"{to}_{kind}_m").alias("m"), F.slice(f"{to}_{kind}_g", 1, F.size(f"{to}_{kind}_m")).alias("g"))

        def place(state: Column, x: Column) -> Column:
            start = (state["at"] + x["g"]).cast("int")
            end = (start + F.length(x["m"])).cast("int")
            return F.struct(end.alias("at"), F.concat(state["all"], F.array(F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end")))).alias("all"))

        start = F.struct(F.lit(0).alias("at"), empty.alias("all"))
        docs = docs.withColumn(f"{to}_{kind}_p", F.when(F.size(zipped) > 0, F.aggregate(zipped, start, place, lambda s: s["all"])).otherwise(empty))
    docs = docs.withColumn(result, F.concat(*[_confirmed(kind, F.col(f"{to}_{kind}_p"), t) for kind in PATTERNS]))
    return docs.drop(*[f"{to}_{kind}_{x}" for kind in PATTERNS for x in "mgp"])


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; columns as they are."""
    own = spare(docs.columns, "_mask")
    spans, sorted_spans, done, new = (f"{own}_{x}" for x in ("spans", "sorted", "done", "text"))
    rows = find_spans(docs, to=spans)
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def step(state: Column, x: Column) -> Column:
        over = x["start"] < state["at"]  # inside a span that has gone already
        more = F.concat(F.substr(t, state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(over, state["out"]).otherwise(F.concat(state["out"], more)).alias("out"))

    some = F.size(sorted_spans) > 0
    rows = rows.withColumn(sorted_spans, ordered)
    rows = rows.withColumn(done, F.when(some, F.aggregate(sorted_spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)))
    rows = rows.withColumn(new, F.when(some, F.concat(F.col(f"{done}.out"), F.substr(t, F.col(f"{done}.at") + 1))).otherwise(F.col("text")))
    out = {c: F.col(c) for c in docs.columns} | {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(some, F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[x.alias(c) for c, x in out.items()])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, said), ",")
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: ~x["kind"].isin(*ADDED))
    scores = F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores")
    return docs.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *[count(k) for k in ADDED], scores)


#: The plain patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Those of the added kinds, for an engine without look-behind; `\b` beside a letter or digit is the same test.
MORE = {"iban": rf"\b(?:{_iban()})\b", "secret": rf"\b{_HEX}\b"}


def _sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    double = lambda i: f"CAST(substr(d, len(d) - {i}, 1) AS INTEGER)"
    plain = "replace(m, ' ', '')"
    number = "list_transform(string_split(" + f"substr({plain}, 5) || substr({plain}, 1, 4)" + ", ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN {double('i')} > 4 THEN {double('i')} * 2 - 9 ELSE {double('i')} * 2 END ELSE {double('i')} END)) % 10 = 0",
        "phone": "len(d) BETWEEN 9 AND 15",
        "iban": f"len({plain}) BETWEEN 15 AND 34 AND list_reduce({number}, lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1",
        "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Fa-f]')",
    }
    parts = []
    for n, (kind, pattern) in enumerate((BASE | MORE).items()):
        base, more, less = SCORES[kind]
        alone = f"CASE WHEN regexp_matches(m, '^(?:{_KNOWN})') THEN {base} ELSE {IBAN_OTHER} END" if kind == "iban" else str(base)
        score = f"{alone} + CASE WHEN regexp_matches(near, '{_word(more)}') THEN {STEP} ELSE 0 END - CASE WHEN regexp_matches(near, '{_word(less)}') THEN {STEP} ELSE 0 END"
        parts.append(
            f"""SELECT * FROM (SELECT {n} AS k, '{kind}' AS kind, rid, m, start, {score} AS score FROM (
  SELECT rid, m, start, lower(substr(t, CAST(greatest(1, start - {CONTEXT - 1}) AS BIGINT), CAST(least(start, {CONTEXT}) AS BIGINT))) AS near FROM (
    SELECT rid, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT))) AS start
    FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)
  )
) x, LATERAL (SELECT {digits} AS d) y WHERE {valid[kind]}){f" WHERE score >= {LEAST}" if kind in ADDED else ""}"""
        )
    union = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in KINDS)
    names = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)
    said = "kind || ':' || start || ':' || (start + len(m))"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({union}),
g AS (SELECT rid, {counts}, string_agg({said}, ',' ORDER BY k, start) AS spans, string_agg({said}, ',' ORDER BY k, start) FILTER (WHERE k < 4) AS base, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, start) AS scores FROM s GROUP BY rid)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (rid)"""


OP10_SQL = _sql()
