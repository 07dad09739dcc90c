import hashlib
import random
import re

from nearfield.llm import private
from tests.llm.helpers import EDGES, documents


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def check(spark, rows):
    got = {r["doc_id"]: r for r in private.digest(private.find_private(documents(spark, rows))).collect()}
    for d, t, *_ in rows:
        want = brute(t)
        line = ",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[d]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t, got[d]["spans"])
        assert [got[d][f"n_{k}"] for k in private.KINDS[:4]] == [sum(x == i for _, x, _ in want) for i in range(4)]
        kept = [x for x in got[d]["spans"].split(",") if not x.startswith("secret")]
        assert ",".join(kept) == line
    return got


def test_edges(spark):
    check(spark, EDGES)
    assert private.find_private(documents(spark, [])).collect() == []


def test_random_texts(spark):
    g = random.Random(3)
    letters = "a1+.@- ()0259bé%_漢😀/x\n"
    check(spark, [(i, "".join(g.choice(letters) for _ in range(g.randint(0, 60))), "en", "s") for i in range(1500)])


def test_planted_values(spark):
    rows = [
        (1, "écrire à jo.e+x@mail.example.com, 10.0.0.1 et 256.1.1.1 ou 1.2.3.4.5", "en", "s"),
        (2, "card 4111 1111-1111 1111 and 4111111111111112 and +1 (555) 555-5555.", "en", "s"),
        (3, "000255.001.1.1 a@b a@b.c_d@e.f +12 +1234567890123456", "en", "s"),
    ]
    check(spark, rows)


def test_long_runs_take_linear_time(spark):
    n = 200_000
    rows = [(1, "a" * n + "@", "en", "s"), (2, "1" * n, "en", "s"), (3, "1 " * n, "en", "s"), (4, "+1" + "(" * n, "en", "s"), (5, "x1" * n, "en", "s")]
    got = private.digest(private.find_private(documents(spark, rows))).collect()
    assert all(r["n_email"] == r["n_ip"] == r["n_card"] == r["n_phone"] == 0 for r in got)


def test_secrets_are_added_and_numbers_are_not(spark):
    g = random.Random(1)
    hexes = ["".join(g.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'some words token = "{h}" more', "en", "s") for i, h in enumerate(hexes)]
    rows += [(100 + i, f"order {g.randrange(10**9, 10**11)} of part abc-{i}-0000 ships", "en", "s") for i in range(60)]
    got = check(spark, rows)
    assert all(got[i]["spans"] == f"secret:20:60" for i in range(30))
    assert not any("secret" in got[100 + i]["spans"] for i in range(60))


def test_estimation_finds_reliable_labelers():
    counts = {(1, 1, 1, 1, 1): 90, (1, 1, -1, 0, 1): 10, (0, -1, -1, 0, -1): 300, (0, -1, 1, 0, -1): 20}
    share, reliable, post = private.estimate(counts)
    assert 0.15 < share < 0.35
    assert post[1, 1, 1, 1, 1] > 0.99 and post[0, -1, -1, 0, -1] < 0.01
    w = private.train({(*v, 0): n for v, n in counts.items()}, post)
    assert sum(a * b for a, b in zip(w, (1, 1, 1, 1, 1, 1, 0))) > 0 > sum(a * b for a, b in zip(w, (1, 0, -1, -1, 0, -1, 0)))
