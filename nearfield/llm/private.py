"""Personal data in texts, with DataFrame and SQL functions only.

Base spans are email addresses, IP addresses, card and phone numbers by fixed patterns and checks. Weak supervision adds secrets: each word of at
least eight letters, digits, ``_ + / -`` that holds a digit is a candidate, and labelers vote on it: shapes by
regex, a gazetteer of words before it, and its context. Expectation-maximisation over the counts of vote patterns of all texts
estimates how reliable each labeler is in each class and how likely each pattern is a secret; a log-linear classifier over votes
and shape, trained on those probabilities, decides the spans. Vote patterns are few whatever the input, so only their
counts come to the driver.

Offsets are code points, ends exclusive. Patterns have no nested choice and take each run of characters at once, so the
time for a text is linear in its length.

Defined cases. A null text counts as empty and has no spans. Base spans always stay; an added span that
overlaps one is dropped. Equal starts are ordered by kind: email, ip, card, phone, secret. Without candidates nothing is added. Rows are
handled one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialise

KINDS = ("email", "ip", "card", "phone", "secret")
#: A match begins where the last one ended or where no character of its first run stands before it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Code points before a candidate that labelers see.
BEFORE = 24
GAZETTEER = ("token", "secret", "password", "passwd", "pwd", "api", "key", "auth", "bearer", "credential")
#: Rounds of expectation-maximisation, and of the classifier's Newton steps.
ROUNDS, STEPS = 100, 50
CLASSES = ("other", "secret")


def _spans(text: Column, pattern: str, before: int = 0) -> Column:
    """[(s, e, m, before)] of the pattern's matches: what stands between matches gives the offsets."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    items = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("gap"), (F.right(g, F.lit(before)) if before else F.lit("")).alias("before")))
    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
    step = lambda a, x: F.struct(
        (a["at"] + x["gap"] + F.length(x["m"])).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["before"].alias("before")))).alias("out"),
    )
    return F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """[(s, k, e)] of the fixed kinds, k the kind's place in :data:`KINDS`, by start and kind."""
    checks = (
        (EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        (IP, text.rlike("[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        (CARD, text.rlike("[0-9]"), lambda m: F.length(_digits(m)).between(14, 19) & _luhn(_digits(m))),
        (PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15)),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = []

    def kept(pattern: str, ok, k: int) -> Column:
        passing = F.filter(_spans(text, pattern), lambda x: ok(x["m"]))
        return F.transform(passing, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    for k, (pattern, may, ok) in enumerate(checks):
        found.append(F.when(may, kept(pattern, ok, k)).otherwise(none))
    return F.array_sort(F.concat(*found))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.when(no, F.lit(-1)).otherwise(F.lit(0)) if no is not None else F.lit(0))


def labelers(x: Column) -> list[Column]:
    """Votes on a candidate: 1 for a secret, -1 against, 0 for none."""
    m, before = x["m"], F.lower(x["before"])
    digits = F.length(_digits(m))
    return [
        _vote(m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), m.rlike("[g-zG-Z]{4}")),
        _vote((F.length(m) >= 20) & m.rlike("[A-Za-z]") & (digits * 8 >= F.length(m)), m.rlike("^[0-9/+_-]+$")),
        _vote(before.rlike(r"[=:]\s*[\"']?$"), ~before.rlike(r"[=:\"'(\[]")),
        _vote(before.rlike(r"(?:" + "|".join(GAZETTEER) + r")[\"']?\s*(?:is|=|:)?\s*[\"']?$")),
        _vote(F.length(m) >= 24, F.length(m) < 16),
    ]


LABELERS = 5


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[str, dict[int, float]]], dict[tuple[int, ...], float]]:
    """(share of secrets, each labeler's vote probabilities by class, each pattern's probability of a secret).

    Votes are independent given the class. The start takes the majority of votes; each round re-estimates with one count
    added to each cell, which also keeps the two classes in their places.
    """
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in counts}
    share, reliable = 0.5, []
    for _ in range(ROUNDS):
        total = sum(counts.values())
        mass = {"secret": sum(n * post[v] for v, n in counts.items())}
        mass["other"] = total - mass["secret"]
        share = (mass["secret"] + 1) / (total + 2)
        reliable = []
        for i in range(LABELERS):
            table = {c: {x: 1.0 for x in (-1, 0, 1)} for c in CLASSES}
            for v, n in counts.items():
                table["secret"][v[i]] += n * post[v]
                table["other"][v[i]] += n * (1 - post[v])
            reliable.append({c: {x: y / (mass[c] + 3) for x, y in t.items()} for c, t in table.items()})
        new = {v: _posterior(v, share, reliable) for v in counts}
        moved = max((abs(new[v] - post[v]) for v in counts), default=0.0)
        post = new
        if moved < 1e-10:
            break
    return share, reliable, post


def _posterior(v: tuple[int, ...], share: float, reliable) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(r["secret"][x] / r["other"][x]) for r, x in zip(reliable, v, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def train(patterns: dict[tuple[int, ...], int], post: dict[tuple[int, ...], float]) -> list[float]:
    """Weights of a log-linear classifier on (1, votes, shape), from counts of (votes..., shape) and pattern probabilities."""
    rows = [([1.0, *map(float, p)], n, post[p[:LABELERS]]) for p, n in sorted(patterns.items())]
    d = LABELERS + 2
    w = [0.0] * d
    for _ in range(STEPS):
        g, h = [-1e-2 * x for x in w], [[1e-2 * (i == j) for j in range(d)] for i in range(d)]
        for x, n, y in rows:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i in range(d):
                g[i] += n * (y - p) * x[i]
                for j in range(d):
                    h[i][j] += n * p * (1 - p) * x[i] * x[j]
        step = _solve(h, g)
        w = [a + max(-2.0, min(2.0, b)) for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-9:
            break
    return w


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination with row exchange."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            for c in range(i, n + 1):
                m[r][c] -= f * m[i][c]
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        x[i] = (m[i][n] - sum(m[i][c] * x[c] for c in range(i + 1, n))) / m[i][i]
    return x


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added), arrays of (s, k, e), a row for each row of docs; k is a place in :data:`KINDS`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shape = lambda x: F.when(F.length(_digits(x["m"])) * 2 >= F.length(x["m"]), 1).otherwise(0)
    found = F.transform(_spans(text, CANDIDATE, BEFORE), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.array(*labelers(x), shape(x)).alias("v")))
    none = F.array().cast("array<struct<s:int,e:int,v:array<int>>>")
    read = materialise(docs.select("doc_id", base_spans(text).alias("base"), F.when(text.rlike("[0-9]"), found).otherwise(none).alias("candidates")), "private-read")
    # At most 3 ** LABELERS * 2 rows, each a vote pattern and its count over all texts.
    rows = read.where(F.size("candidates") > 0).select(F.explode("candidates.v").alias("v")).groupBy("v").count().collect()
    patterns = {tuple(r["v"]): r["count"] for r in rows}
    if patterns:
        votes: dict[tuple[int, ...], int] = {}
        for p, n in patterns.items():
            votes[p[:LABELERS]] = votes.get(p[:LABELERS], 0) + n
        w = train(patterns, estimate(votes)[2])
    else:
        w = [-1.0] + [0.0] * (LABELERS + 1)
    odds = lambda v: sum((F.lit(x) * v[i] for i, x in enumerate(w[1:])), F.lit(w[0]))
    free = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    added = F.transform(F.filter("candidates", lambda x: (odds(x["v"]) > 0) & free(x)), lambda x: F.struct(x["s"].alias("s"), F.lit(4).alias("k"), x["e"].alias("e")))
    return read.select("doc_id", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(number, range(4)), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find_private(spark.read.parquet(f"{sf_dir}/documents.parquet")))
