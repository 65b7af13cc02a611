"""Personal data by weak supervision, with DataFrame functions only.

Base kinds (email, ip, card, phone) follow fixed rules and always stay. Other kinds (secret, ssn, local_phone, name) are
candidates from looser patterns. Three labelers vote on every candidate of any kind (for, against, or nothing): a strict
pattern, a gazetteer of telling words beside or in the span, and the wider context. Expectation-maximisation on the
counts of vote patterns estimates the labelers' reliabilities without labels, for each kind by itself with the rates of all kinds together as
a prior of ``PRIOR`` candidates, and gives each kind's patterns a probability; a logistic span classifier is then trained on these probabilities with features that the labelers don't use alone (kind,
length and share of digits besides the votes). Candidates that it accepts become added spans.

How offsets come about without a UDF: ``split`` and ``regexp_extract_all`` give the gaps and the matches of a pattern, and
running sums over their lengths, in code points, give the places. Running sums work in blocks of about the square root of
the number of matches, so that texts with very many matches stay cheap. Patterns are possessive or anchored by
look-behind where that changes no match, so that none takes quadratic time or deep recursion on long runs.

Scale: texts are read once and never shuffled; the candidates' table is written to the shared folder (it cuts the second pass over the
texts); what reaches the driver are counts by (kind, votes, length class, digit class), at most ``8 * 27 * 4 * 4`` rows
whatever the corpus. A source or group of copies that holds many rows stays spread as it was read.

Nulls and odd input: a null text is empty; a null id is kept; repeated rows each give a row; empty tables give an empty
result (no model is trained, nothing is added); other columns are carried by ``find_spans`` in one struct, ``row``, so that
none can clash with its own, and are ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

#: The gazetteer of first names.
FIRST_NAMES = ("James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica", "Thomas", "Sarah", "Carlos", "Maria", "Hans", "Anna", "Pierre", "Marie")

#: Kind to pattern. The first four are the base kinds, in their listed order.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9_]{24,}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+()-])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+|(?:" + "|".join(FIRST_NAMES) + r") [A-Z][a-z]+)(?: [A-Z][a-z]+)?\b",
}
BASE = ("email", "ip", "card", "phone")
#: Candidates that the rates over all kinds count for where a kind's own rates are estimated.
PRIOR = 20.0
KINDS = tuple(PATTERNS)
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "phone": "+"}
#: Strict pattern, telling words (gazetteer; for names in the span itself) and context that speaks for or against, by kind.
STRICT = {
    "email": r"\.[A-Za-z]{2,24}$", "ip": r"^(?!0)(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "card": r"^[2-6]", "phone": r"^\+[1-9]",
    "secret": r"^(?=.*[0-9])(?=.*[a-zA-Z])[A-Za-z0-9_]+$", "ssn": r"^(?!000|666|9)", "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", "name": r" [A-Z][a-z]+$",
}
GAZETTEER = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|contact|write)\b", "ip": r"(?i)\b(?:ip|addr|address|host|server|client)\b", "card": r"(?i)\b(?:card|visa|mastercard|amex|payment)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "secret": r"(?i)(?:token|secret|api[_-]?key|passw(?:or)?d|bearer|credential)", "ssn": r"(?i)\b(?:ssn|social security)\b", "local_phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b", "name": r"\b(?:" + "|".join(FIRST_NAMES) + r")\b",
}
CONTEXT_FOR = {
    "email": r"[\s:<(\"']$|^$", "ip": r"[\s:(\"'/]$|^$", "card": r"[\s:(\"']$|^$", "phone": r"[\s:(\"']$|^$",
    "secret": r"[:=]\s*[\"']?$", "ssn": r"[:#]\s*$", "local_phone": r"[:(]\s*$", "name": r"(?i)\b(?:by|from|dear|name|contact|author)\W*$",
}
CONTEXT_AGAINST = r"(?i)(?:\b(?:version|isbn|issue|page|chapter|no)\W*|[A-Za-z0-9_./\\-])$"


def running(values: Column, kind: str = "bigint") -> Column:
    """Exclusive running sums of an array, in blocks of about its square root."""

    def scan(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(block, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"]).alias("out")), lambda a: a["out"])

    n = F.size(values)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    count = F.greatest(F.ceil(n / width).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * width + 1, width))
    total = lambda block: F.aggregate(block, F.lit(0).cast(kind), lambda a, x: a + x)
    starts = scan(F.transform(blocks, total), F.lit(0).cast(kind))
    return F.when(n == 0, F.array().cast(f"array<{kind}>")).otherwise(F.flatten(F.zip_with(blocks, starts, scan)))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, match: Column, left: Column) -> list[Column]:
    strict = F.when(match.rlike(STRICT[kind]), 1).otherwise(-1)
    gazetteer = F.when((match if kind == "name" else left).rlike(GAZETTEER[kind]), 1).otherwise(0)
    context = F.when(left.rlike(CONTEXT_FOR[kind]), 1).when(left.rlike(CONTEXT_AGAINST), -1).otherwise(0)
    return [v.cast("int") for v in (strict, gazetteer, context)]


SPAN = "array<struct<kind:int,start:bigint,end:bigint,v1:int,v2:int,v3:int,size:int,digits:int>>"


def find_candidates(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(row, text, candidates): row is a struct of all columns but the text; valid base spans, and candidates of the other kinds, with votes and features."""
    row = F.struct(*([F.col(f"`{c}`") for c in documents.columns if c != text_col] or [F.lit(0).alias("none")]))
    out = documents.select(row.alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    for kind, pattern in PATTERNS.items():
        needed = F.instr("_t", NEEDS[kind]) > 0 if kind in NEEDS else F.col("_t").rlike("[0-9]") if kind in ("ip", "card", "ssn", "local_phone") else F.lit(True)
        out = out.withColumn(f"_m_{kind}", F.when(needed, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, pattern in PATTERNS.items():
        out = out.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    spans = []
    for i, kind in enumerate(KINDS):
        match, gap = F.col(f"_m_{kind}"), F.slice(f"_g_{kind}", 1, F.size(f"_m_{kind}"))
        both = F.zip_with(gap, match, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        before = running(F.transform(both, lambda x: (F.length(x["g"]) + F.length(x["m"])).cast("bigint")))

        def span(x: Column, at: Column) -> Column:  # called at once, with this kind
            left, start, n = F.right(x["g"], F.lit(48)), at + F.length(x["g"]), F.length(x["m"])
            v1, v2, v3 = _votes(kind, x["m"], left)
            share = F.length(F.regexp_replace(x["m"], "[^0-9]", "")) / n
            size = F.when(n < 12, 0).when(n < 20, 1).when(n < 36, 2).otherwise(3)
            return F.when(_valid(kind, x["m"]), F.struct(F.lit(i).alias("kind"), start.cast("bigint").alias("start"), (start + n).cast("bigint").alias("end"), v1.alias("v1"), v2.alias("v2"), v3.alias("v3"), size.alias("size"), F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("digits")))

        spans.append(F.when(F.size(match) > 0, F.filter(F.zip_with(both, before, span), lambda s: s.isNotNull())).otherwise(F.array().cast(SPAN)))
    return out.select("row", "text", F.concat(*spans).cast(SPAN).alias("candidates"))


VOTES = (-1, 0, 1)


def fit_votes(counts: dict[tuple[int, int, int], float], rounds: int = 100, prior: tuple[float, list] | None = None) -> tuple[dict[tuple[int, int, int], float], tuple[float, list]]:
    """Probability that a candidate with these votes is personal data, by expectation-maximisation, and the rates it rests on.

    Labelers are independent given the truth; each has a chance for every vote under either truth. The first guess trusts
    the majority. ``prior`` are rates that count like PRIOR candidates.
    """
    guess = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in counts}
    rate, chance = prior or (0.5, [[{v: 1 / 3 for v in VOTES} for _ in range(2)] for _ in range(3)])
    start_rate, start_chance, weight = rate, chance, PRIOR if prior else 3.0
    for _ in range(rounds):
        yes = sum(counts[p] * guess[p] for p in counts)
        no = sum(counts[p] * (1 - guess[p]) for p in counts)
        rate = (yes + weight * start_rate) / (yes + no + weight)
        chance = [[{v: (sum(n * (guess[p] if truth else 1 - guess[p]) for p, n in counts.items() if p[j] == v) + weight * start_chance[j][truth][v]) / ((yes if truth else no) + weight) for v in VOTES} for truth in (0, 1)] for j in range(3)]
        for p in counts:
            odds = math.log(rate / (1 - rate)) + sum(math.log(chance[j][1][p[j]] / chance[j][0][p[j]]) for j in range(3))
            guess[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return guess, (rate, chance)


def truths(rows: list[tuple]) -> dict[tuple[int, int, int, int], float]:
    """Probability by kind and votes, of rows (kind, v1, v2, v3, size, digits, count): first over all kinds, then for each with that as its prior."""
    by: dict[int, dict[tuple[int, int, int], float]] = {}
    every: dict[tuple[int, int, int], float] = {}
    for kind, a, b, c, _, _, n in rows:
        for counts in (by.setdefault(kind, {}), every):
            counts[a, b, c] = counts.get((a, b, c), 0.0) + n
    _, prior = fit_votes(every)
    return {(kind, *votes): g for kind, counts in by.items() for votes, g in fit_votes(counts, prior=prior)[0].items()}


def features_of(kind: int, votes: tuple[int, int, int], size: int, digits: int) -> list[str]:
    return ["bias", f"kind{kind}", *(f"v{j + 1}:{v}" for j, v in enumerate(votes)), f"size{size}", f"digits{digits}"]


def fit_classifier(rows: list[tuple[list[str], float, float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Logistic weights of (features, target probability, count) rows, by gradient steps over all of them."""
    total, weights = sum(n for _, _, n in rows) or 1.0, {}
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, target, n in rows:
            score = sum(weights.get(f, 0.0) for f in names)
            miss = n / total * (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + miss
        for f, s in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * (s - decay * weights.get(f, 0.0))
    return weights


def train(candidates: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from the counts of every candidate's votes and features."""
    x = candidates.select(F.explode("candidates").alias("c")).select("c.*")
    rows = x.groupBy("kind", "v1", "v2", "v3", "size", "digits").count().collect()  # of fixed size at most
    rows = sorted(tuple(r) for r in rows)
    truth = truths(rows)
    return fit_classifier([(features_of(kind, (a, b, c), size, digits), truth[kind, a, b, c], float(n)) for kind, a, b, c, size, digits, n in rows])


def _accepted(c: Column, weights: dict[str, float]) -> Column:
    def weight(prefix: str, value: Column, values) -> Column:
        out = F.lit(0.0)
        for v in values:
            if f"{prefix}{v}" in weights:
                out = F.when(value == v, weights[f"{prefix}{v}"]).otherwise(out)
        return out

    score = F.lit(weights.get("bias", -1.0)) + weight("kind", c["kind"], range(len(KINDS))) + weight("size", c["size"], range(4)) + weight("digits", c["digits"], range(4))
    for j in (1, 2, 3):
        score = score + weight(f"v{j}:", c[f"v{j}"], (-1, 0, 1))
    return (c["kind"] < len(BASE)) | (score >= 0)


def find_spans(documents: DataFrame, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, text, spans): row is a struct of the other columns, spans an array of (kind, start, end) by kind and start; kind is a place in KINDS."""
    found = find_candidates(documents, text_col=text_col)
    found = materialize(found if keep_text else found.drop("text"), "candidates")
    weights = train(found)
    kept = F.filter("candidates", lambda c: _accepted(c, weights))
    plain = F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.withColumn("spans", F.sort_array(plain)).drop("candidates")


def listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    return found.select("row.doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """(row, text): texts with each span, or run of overlapping ones, replaced by the name of its first kind in angle brackets."""
    by_place = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>").alias("out"), F.lit(-1).cast("bigint").alias("till"))
    last = lambda a: F.element_at(a["out"], -1)

    def merge(a: Column, s: Column) -> Column:
        longer = F.struct(last(a)["start"].alias("start"), F.greatest(a["till"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))
        joined = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(longer))
        return F.struct(F.when(s["start"] < a["till"], joined).otherwise(F.concat(a["out"], F.array(s))).alias("out"), F.greatest(a["till"], s["end"]).alias("till"))

    merged = F.aggregate(by_place, empty, merge, lambda a: a["out"])
    text, name = F.col("text"), lambda s: F.element_at(F.array(*(F.lit(f"<{k}>") for k in KINDS)), s["kind"] + 1)
    out = found.withColumn("_s", F.when(F.size("spans") > 0, merged))
    till = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("_s", i)["end"])
    parts = F.transform("_s", lambda s, i: F.concat(F.substring(text, (till(i) + 1).cast("int"), (s["start"] - till(i)).cast("int")), name(s)))
    rest = F.substring(text, (F.element_at("_s", -1)["end"] + 1).cast("int"), F.length(text))
    return out.select("row", F.when(F.size("spans") > 0, F.concat(F.concat_ws("", parts), rest)).otherwise(text).alias("text"))


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    return digest(find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False))
