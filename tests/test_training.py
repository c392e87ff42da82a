"""Training and decision operators against step-by-step versions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveloom.operators import ngrams, training


def admitted(groups, budget):
    out, used = [], 0
    for key, size in groups:
        if used + size <= budget:
            out.append(key)
            used += size
    return out



def choose(entries, size):
    """The shortlist, one step after the other."""
    out, cheap = [], {e["cand"]: e["cheap_rank"] for e in entries}

    def add(e):
        if e is not None and len(out) < size and e not in out:
            out.append(e)

    by_cheap = sorted(entries, key=lambda e: e["cheap_rank"])
    same = sorted((e for e in entries if e["same"]), key=lambda e: (cheap[e["cand"]], -e["freq"], e["dist"]))
    dist = sorted(entries, key=lambda e: (e["dist"], cheap[e["cand"]]))
    att = sorted((e for e in entries if e["attested"]), key=lambda e: cheap[e["cand"]])
    rec = sorted((e for e in entries if e["recall"] is not None), key=lambda e: (-e["recall"], cheap[e["cand"]]))
    freq = sorted(entries, key=lambda e: (-e["freq"], cheap[e["cand"]]))
    for e in by_cheap[:2] + same[: 3 if size >= 8 else 2] + dist[: 2 if size >= 6 else 1] + att[: 2 if size >= 8 else 1] + rec[:1] + freq[:1] + by_cheap:
        add(e)
    if rec and rec[0] not in out:
        heads = by_cheap[:2] + same[:1] + dist[:1] + att[:1]
        rest = sorted((e for e in out if e not in heads), key=lambda e: (-cheap[e["cand"]], e["freq"], out.index(e)))
        if rest and (rest[0]["recall"] is None or rec[0]["recall"] > rest[0]["recall"]):
            out[out.index(rest[0])] = rec[0]
    return [e["cand"] for e in out]


def test_shortlist(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for size in (4, 8):
        for g in range(60):
            n = rng.randrange(1, 15)
            ranks = rng.sample(range(1, n + 1), n)
            freqs = rng.sample(range(1, 100), n)
            own = [{"cand": f"c{i}", "dist": float(rng.randrange(3)), "freq": freqs[i], "same": rng.random() < 0.3, "attested": rng.random() < 0.3, "recall": rng.random() if rng.random() < 0.7 else None, "cheap_rank": ranks[i]} for i in range(n)]
            rows += [(size, g, *e.values()) for e in own]
            want |= {(size, g, c) for c in choose(own, size)}
    df = spark.createDataFrame(rows, "size int, g int, cand string, dist double, freq long, same boolean, attested boolean, recall double, cheap_rank int")
    got = {(s, r["g"], r["cand"]) for s in (4, 8) for r in training.shortlist(df.filter(F.col("size") == s), ["g"], s).collect()}
    assert got == want


def test_admission(spark):
    rng = random.Random(2)
    for budget in (0, 1, 7, 40, 41, 42, 43, 44, 500):
        rows = [(f"k{i:03}", rng.random() < 0.5, rng.randrange(1, 9), rng.randrange(1, 7)) for i in range(60)]
        df = spark.createDataFrame(rows, "key string, first boolean, strongest long, size int")
        order = sorted(rows, key=lambda r: (not r[1], -r[2], r[0]))
        assert {r["key"] for r in training.admit(df, budget).collect()} == set(admitted([(r[0], r[3]) for r in order], budget))


@settings(max_examples=300, deadline=None)
@given(st.text("aàĐđ bơễ1.,xyZ", max_size=60), st.sampled_from(["ALL_UNACCENTED", "SOME_UNACCENTED", "TELEX", "TYPO", "BOUNDARY"]), st.integers(0, 99))
def test_damage_is_repaired(text, kind, seed):
    import unicodedata

    text = unicodedata.normalize("NFC", text)
    new, labels = training.damage(text, kind, str(seed))
    assert training.repair(new, labels) == text and all(new[s:e] == x for x, _, s, e in labels) and training.damage(text, kind, str(seed)) == (new, labels)


def test_logistic_fit_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 3] + [0, 2]
    y = x @ [1.0, -0.5] + rng.logistic(size=400) > 0.4
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y)], "a double, b double, y boolean")
    got = {r["feature"]: r["weight"] for r in training.fit_logistic(df, ["a", "b"], "y").collect()}
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(400)]
    w = np.where(y, 400 / (2 * y.sum()), 400 / (2 * (~y).sum()))
    beta, penal = np.zeros(3), np.array([0.4, 0.4, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penal), z.T @ (w * (p - y)) + penal * beta)
    assert np.allclose([got["a"], got["b"], got["bias"]], beta, atol=1e-6)
    assert training.fit_logistic(df.limit(0), ["a"], "y").count() == 0


def test_small_functions(spark):
    assert training.char_hashes("a") == [training.fnv1a(g) % 4096 for g in ("<a", "a>", "<a>")] and len(training.char_hashes("x" * 5 + "abcdefghijklmnopq")) == 32
    assert training.telex_typo("giá") == "gias" and training.telex_typo("an") == "an"
    t = "Một. Hai ba\nbốn năm! sáu"
    assert [t[slice(*training.sentence_around(t, t.index(w)))] for w in ("Một", "ba", "năm", "sáu")] == ["Một.", "Hai ba", "bốn năm!", "sáu"]
    g = training.gates(spark.createDataFrame([(0.5, None)], "p double, r double"), [("p", ">=", 0.4), ("r", ">=", 0.1)]).collect()
    assert [r["pass"] for r in g] == [True, False, False]
    r = spark.createDataFrame([("MÃ", "mả"), ("Mã", "mả"), ("mã", "mả"), ("M", "mả"), ("", "x")], "p string, w string").select(training.match_case(F.col("p"), F.col("w")).alias("x")).collect()
    assert [x["x"] for x in r] == ["MẢ", "Mả", "mả", "Mả", "x"]
