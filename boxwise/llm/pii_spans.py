"""Operator 1: personal data by weak supervision.

Candidates are the base spans (fixed patterns and checks) and looser ones: spelt-out e-mail addresses, dotted quads out of range and IPv6
addresses, numbers that fail the card check, national phone numbers, and secrets (keys and tokens), a kind without base spans. Six labelers
vote on each: the check, a gazetteer (domains, number ranges, known forms of keys), cue words around it (English, German, French, Spanish), the
words that it stands between, its borders, and its shape. Expectation-maximisation over the table of votes estimates each labeler's
reliability by kind. The posteriors train a logistic span classifier on the votes and on inputs of its own: length, share of digits, share of
distinct characters, and the hashed word before. It decides on the looser candidates; base spans always stay.

All of it is DataFrame and SQL functions: positions come from the pieces between matches, and both EM and gradient descent are folds over
an array of vote and input patterns in one row, whose number is bounded by VOTERS and INPUTS. The model, a row of numbers for each kind, is
read once and written into the plan as constants.

Edge cases: a null text is an empty text without spans; positions are code points, end exclusive; repeated rows give equal rows; an
empty table trains nothing and gives an empty result; further columns are ignored by report() and kept by annotate() and redact(), whatever
their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import fresh, or_empty

KINDS = ["email", "ip", "card", "phone", "secret"]
_MAIL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that no match is retried and no run of characters is scanned twice: a match can only begin at the
#: start of such a run or at the end of the match before.
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}+(?:[0-9A-Fa-f]{1,4}|(?::[0-9A-Fa-f]{1,4}){1,7}+)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:00[1-9][0-9]{1,2}[ /.-]|\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-](?=[0-9]{3}[ .-][0-9]{4}))[0-9]++(?:[ .-][0-9]++)*+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"at[)\]]", "ip": r":[0-9A-Fa-f:]", "phone": r"[0-9][ ).-]+[0-9]", "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}"}
CUES = {
    "email": r"(?i)(?:e-?mail|courriel|correo|contact|contacto|kontakt|write|reach|address)",
    "ip": r"(?i)(?:\bip|host|server|serveur|servidor|address|adresse|login|client)",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|amex|credit|debit|payment|account|konto)",
    "phone": r"(?i)(?:phone|telefon|tel\b|teléfono|téléphone|call|fax|mobile|móvil|handy|contact|whatsapp)",
    "secret": r"(?i)(?:token|secret|passw|api.?key|auth|credential|bearer|private|clave|schlüssel)",
}
FOILS = r"(?i)(?:version|order|invoice|sku|serial|isbn|build|commit|sha|md5|digest|checksum|no\.|number of|rechnung|factura|facture)"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|test|example)$",
    "ip": r"^(?!0*(?:0|127|255)\.)(?:[0-9.]+$|2[0-9a-f]{3}:|f[cde])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+[1-9]|00[1-9]|0[1-9]|\([0-9]|[2-9][0-9]{2})",
    "secret": r"^(?:AKIA|ghp_|gho_|sk[_-]|pk[_-]|xox|eyJ|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$)",
}
SHAPES = {
    "email": r"(?i)[a-z]{2,}$",
    "ip": r"[0-9]{2}\.|\.[0-9]{2}|:",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}|00[0-9]{1,3}|0[0-9]{1,4}|[0-9]{3})?[ /.-]?\(?[0-9]{1,5}\)?(?:[ /.-]?[0-9]{2,})+$",
    "secret": r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9].*[0-9]).*)$",
}
#: Characters looked at before and after a candidate.
AROUND = 32
ADD_AT = 0.9
ROUNDS, STEPS = 20, 80
VOTERS = 6
#: What each labeler's reliability is taken to be before counting (its votes for true and for false candidates), as so many candidates.
#: That of the check is the anchor: it is given by what the check is, so that the others can be told from it.
PRIOR_TRUE, PRIOR_FALSE, PRIOR_ROWS = [0.97, 0.7, 0.8, 0.6, 0.7, 0.6], [0.02, 0.4, 0.1, 0.5, 0.5, 0.5], 10
#: Values of the classifier's own inputs: length, share of digits, share of distinct characters, hashed word before.
INPUTS = (4, 3, 2, 8)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches: their places follow from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    lengths = F.filter(lengths, lambda x: x["m"].isNotNull())
    none = F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")

    def on(done, x):
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["e"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"))))

    return F.aggregate(lengths, none, on)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled; a doubled digit counts by its cross sum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _checked(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _candidate(kind: str, text: Column, x: Column, base: Column, loose: bool) -> Column:
    """struct<kind, s, e, base, v, x>; a vote is 1 for, 0 against, -1 without opinion."""
    m = x["m"]
    before = F.substr(text, F.greatest(x["s"] + 1 - AROUND, F.lit(1)), F.least(x["s"], F.lit(AROUND)))
    after = F.substr(text, x["e"] + 1, F.lit(AROUND))
    digits = F.length(_digits(m))
    if kind == "secret":  # given as a value
        check = before.rlike(r"[=:]\s*[\"']?$").cast("int")
    elif loose:
        check = F.when(digits.between(7, 15), -1).otherwise(0) if kind == "phone" else F.lit(-1)
    else:
        check = base.cast("int")
    known = (_digits(m) if kind == "card" else m).rlike(GAZETTEER[kind]).cast("int")
    cue = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(FOILS), 0).when(after.rlike(CUES[kind]), 1).otherwise(-1)
    beside = before.rlike(r"(?:^|\s)[^\s\p{N}]*\p{L}[^\s\p{N}]*\W*$").cast("int") + after.rlike(r"^\W*[^\s\p{N}]*\p{L}[^\s\p{N}]*(?:\s|$)").cast("int")
    between = F.when(beside == 2, 1).when(beside == 0, 0).otherwise(-1)
    edge = r"[\p{L}\p{N}_=/#]"
    free = (~F.substr(before, F.greatest(F.length(before), F.lit(1)), F.lit(1)).rlike(edge) & ~F.substr(after, F.lit(1), F.lit(1)).rlike(edge)).cast("int")
    shape = m.rlike(SHAPES[kind]).cast("int")
    n = F.length(m)
    distinct = F.size(F.array_distinct(F.split(F.substr(m, F.lit(1), F.lit(AROUND)), "")))
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
    own = F.array(
        F.least(F.floor(n / 12), F.lit(3)).cast("int"),
        F.when(digits * 3 < n, 0).when(digits < n, 1).otherwise(2),
        (distinct * 2 > F.least(n, F.lit(AROUND))).cast("int"),
        F.when(word == "", 0).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(INPUTS[3] - 1)).cast("int")),
    )
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), F.array(check, known, cue, between, free, shape).alias("v"), own.alias("x"))


def _candidates_of(kind: str, text: Column, none: Column) -> list[Column]:
    parts = []
    if kind in BASE:
        found = _matches(text, BASE[kind])
        if kind == "card":  # those that fail the check, and quads out of range, stay as loose candidates
            found = F.filter(found, lambda x: F.length(_digits(x["m"])).between(13, 19))
        elif kind == "phone":
            found = F.filter(found, lambda x: _checked(kind, x["m"]))
        parts.append(F.when(text.rlike(NEEDS[kind]), F.transform(found, lambda x: _candidate(kind, text, x, _checked(kind, x["m"]), False))).otherwise(none))
    if kind in LOOSE:
        parts.append(F.when(text.rlike(LOOSE_NEEDS[kind]), F.transform(_matches(text, LOOSE[kind]), lambda x: _candidate(kind, text, x, F.lit(False), True))).otherwise(none))
    return parts


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with the column out, all candidates in the column text, array<struct<kind, s, e, base, v, x>>, sorted. Loose candidates that
    overlap a base span go, secrets apart.

    The array is a column before it is filtered, so it is made once for a row, not once for each of its elements."""
    none = F.expr("cast(array() as array<struct<kind: int, s: int, e: int, base: boolean, v: array<int>, x: array<int>>>)")
    every, base = fresh(docs, "every"), fresh(docs, "base")
    parts = [part for kind in KINDS for part in _candidates_of(kind, F.col(f"`{text}`"), none)]
    made = docs.withColumn(every, F.concat(*parts)).withColumn(base, F.filter(every, lambda c: c["base"]))
    apart = lambda c: c["base"] | (c["kind"] == KINDS.index("secret")) | ~F.exists(base, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]))
    return made.withColumn(out, F.when(F.size(every) > 0, F.array_sort(F.filter(every, apart))).otherwise(none)).drop(every, base)


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _em() -> str:
    """SQL for the EM fold over pats, array<struct<v array<int>, n double>>: struct<p, s array, f array>, the share of true spans and
    each labeler's chance to vote for a true and for a false one."""
    voters = f"sequence(0, {VOTERS - 1})"
    like = lambda side: f"aggregate({voters}, 1D, (a, l) -> a * CASE q.v[l] WHEN 1 THEN m.{side}[l] WHEN 0 THEN 1D - m.{side}[l] ELSE 1D END)"
    posterior = f"transform(pats, q -> named_struct('v', q.v, 'n', q.n, 'g', {_let('t', like('s') + ' * m.p', f't / (t + {like("f")} * (1D - m.p))')}))"
    total = lambda value, when: f"aggregate(h, 0D, (a, q) -> a + CASE WHEN {when} THEN {value} ELSE 0D END)"
    prior = lambda rates: f"array({', '.join(f'{r}D' for r in rates)})"
    share = lambda g, rates: f"transform({voters}, l -> CASE l WHEN 0 THEN {rates[0]}D ELSE ({total(f'q.n * {g}', 'q.v[l] = 1')} + {PRIOR_ROWS}D * {prior(rates)}[l]) / ({total(f'q.n * {g}', 'q.v[l] >= 0')} + {PRIOR_ROWS}D) END)"
    new = f"named_struct('p', ({total('q.n * q.g', 'true')} + 1D) / ({total('q.n', 'true')} + 2D), 's', {share('q.g', PRIOR_TRUE)}, 'f', {share('(1D - q.g)', PRIOR_FALSE)})"
    start = f"named_struct('p', 0.5D, 's', {prior(PRIOR_TRUE)}, 'f', {prior(PRIOR_FALSE)})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (m, i) -> {_let('h', posterior, new)})"


def _logistic() -> str:
    """SQL for gradient descent over rows, array<struct<x array<double>, n double, g double>>."""
    width = f"sequence(0, {VOTERS + sum(INPUTS)})"
    margin = f"aggregate({width}, 0D, (a, j) -> a + w[j] * r.x[j])"
    errors = f"transform(rows, r -> named_struct('x', r.x, 'd', r.n * (1D / (1D + exp(-({margin}))) - r.g)))"
    step = f"transform(w, (o, j) -> o - 0.5D * (aggregate(u, 0D, (a, r) -> a + r.d * r.x[j]) / total + 0.001D * o))"
    return f"aggregate(sequence(1, {STEPS}), transform({width}, j -> 0D), (w, i) -> {_let('u', errors, step)})"


def reliabilities(votes: DataFrame) -> DataFrame:
    """votes(kind, v, x, n) -> kind, pats, total and m, struct<p, s, f>: the share of true spans, and each labeler's chance to vote for
    a true and for a false one where it votes."""
    pats = votes.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "x", "n"))).alias("pats"), F.sum("n").alias("total"))
    return pats.withColumn("m", F.expr(_em()))


def fit(docs: DataFrame) -> list[tuple[int, list[float]]]:
    """(kind, weights of the span classifier), from the candidates of all documents; at most one row per kind reaches the driver."""
    text = or_empty(F.col("text").cast("string"))
    made = candidates(docs.select(text.alias("text")), "text", "made").select(F.explode("made").alias("c"))
    votes = made.groupBy("c.kind", "c.v", "c.x").agg(F.count("*").cast("double").alias("n"))
    like = lambda side: f"aggregate(sequence(0, {VOTERS - 1}), 1D, (a, l) -> a * CASE q.v[l] WHEN 1 THEN m.{side}[l] WHEN 0 THEN 1D - m.{side}[l] ELSE 1D END)"
    one_hot = [f"transform(sequence(0, {size - 1}), b -> CASE WHEN q.x[{k}] = b THEN 1D ELSE 0D END)" for k, size in enumerate(INPUTS)]
    x = f"concat(array(1D), transform(q.v, o -> CASE o WHEN 1 THEN 1D WHEN 0 THEN -1D ELSE 0D END), {', '.join(one_hot)})"
    rows = f"transform(pats, q -> named_struct('x', {x}, 'n', q.n, 'g', {_let('t', like('s') + ' * m.p', f't / (t + {like("f")} * (1D - m.p))')}))"
    weights = reliabilities(votes).withColumn("rows", F.expr(rows)).select("kind", F.expr(_logistic()).alias("w"))
    return [(r["kind"], list(r["w"])) for r in sorted(weights.collect())]


def _score(c: Column, w: list[float]) -> Column:
    margin = F.lit(float(w[0]))
    for j in range(VOTERS):
        v = F.get(c["v"], F.lit(j))
        margin = margin + F.lit(float(w[j + 1])) * F.when(v == 1, 1.0).when(v == 0, -1.0).otherwise(0.0)
    at = VOTERS + 1
    for k, size in enumerate(INPUTS):
        margin = margin + F.get(F.array(*(F.lit(float(x)) for x in w[at : at + size])), F.get(c["x"], F.lit(k)))
        at += size
    return 1 / (1 + F.exp(-margin))


def annotate(docs: DataFrame, model: list[tuple[int, list[float]]], out: str = "found") -> DataFrame:
    """docs with out, array<struct<kind, s, e, base, score>> sorted by kind and start: the base spans and what the classifier adds."""

    def score(c):
        by_kind = F.lit(0.0)
        for kind, w in model:
            by_kind = F.when(c["kind"] == kind, _score(c, w)).otherwise(by_kind)
        return by_kind

    text, made = fresh(docs, "whole"), fresh(docs, "made")
    rows = candidates(docs.withColumn(text, or_empty(F.col("text").cast("string"))), text, made)
    scored = F.transform(made, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"), score(c).alias("score")))
    return rows.withColumn(out, F.filter(scored, lambda c: c["base"] | (c["score"] >= ADD_AT))).drop(text, made)


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(name, c["kind"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def report(docs: DataFrame, model: list[tuple[int, list[float]]]) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans, their number, and the number of spans added."""
    rows = annotate(docs.select(F.col("doc_id").cast("long"), "text"), model)
    base = F.filter("found", lambda c: c["base"])
    count = lambda k: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == k))).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), (F.size("found") - F.size(base)).alias("n_added"))


def redact(docs: DataFrame, model: list[tuple[int, list[float]]]) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first. Columns stay."""
    found = fresh(docs, "found")
    rows = annotate(docs, model, found)
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<string>))")
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("text").cast("string")

    def on(done, c):
        apart = F.struct(c["e"].alias("at"), F.concat(done["out"], F.array(F.substr(text, done["at"] + 1, c["s"] - done["at"]), F.get(name, c["kind"]))).alias("out"))
        over = F.struct(F.greatest(done["at"], c["e"]).alias("at"), done["out"].alias("out"))
        return F.when((c["s"] >= done["at"]), apart).otherwise(over)

    by_start = F.array_sort(F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    clean = F.aggregate(by_start, start, on, lambda done: F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1)))
    columns = [F.when(F.size(found) > 0, clean).otherwise(text).alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns)
