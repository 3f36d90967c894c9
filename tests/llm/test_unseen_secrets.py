"""The secret field on shapes of secrets that training does not make, and on texts without secrets."""

import random

import numpy as np

from fundamentals_spark.llm import secret_scan as S

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_recall_and_precision_on_unseen_shapes(spark):
    rng = random.Random(11)
    pick = lambda n, a=ALNUM: "".join(rng.choice(a) for _ in range(n))
    word = lambda: "".join(rng.choice("aeiou") if k % 2 else rng.choice("bcdlmnrst") for k in range(rng.randrange(2, 9)))
    prose = lambda: " ".join(word() + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(150))
    shapes = {
        "github": lambda: "ghp_" + pick(36), "jwt": lambda: "eyJhbGciOiJIUzI1NiJ9.eyJ" + pick(60) + "." + pick(43, ALNUM + "-_"), "slack": lambda: f"xoxb-{pick(11, ALNUM[-10:])}-{pick(12, ALNUM[-10:])}-{pick(24)}",
        "stripe": lambda: "sk_live_" + pick(24), "google": lambda: "AIza" + pick(35, ALNUM + "-_"),
    }
    around = ["the value is {} and more", "{}", 'db_pwd = "{}"', "client_key={}", "Authorization: Bearer {}"]
    model = S.train_secrets(spark.createDataFrame([(k, prose()) for k in range(600)], "doc_id long, text string"))
    hidden = []
    for name, shape in shapes.items():
        for k in range(40):
            secret, text = shape(), prose()
            at = text.index(" ", rng.randrange(len(text) // 2))
            hidden.append((len(hidden), f"{text[:at]} {around[k % 5].format(secret)} {text[at:]}", name, secret))
    clean = [(10_000 + k, prose() + f" see https://{word()}.example/{word()}/{k}?p={k} or {word()}@{word()}.example on 2024-01-{10 + k % 20}, v1.{k}.2, " + " ".join([word()] * 20)) for k in range(200)]
    rows = spark.createDataFrame([h[:2] for h in hidden] + clean, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in S.scan_secrets(rows, model).collect()}
    hit = {name: 0 for name in shapes}
    false = sum(bool(got[k]) for k, _ in clean)
    for k, text, name, secret in hidden:
        assert not any(s["kind"] != "secret" for s in got[k])  # no pattern matches these
        a = text.index(secret)
        inside = sum(min(s["end"], a + len(secret)) - max(s["start"], a) for s in got[k] if s["start"] < a + len(secret) and s["end"] > a)
        hit[name] += inside >= 0.8 * len(secret)
        false += sum(s["start"] >= a + len(secret) or s["end"] <= a for s in got[k])
    assert all(n >= 36 for n in hit.values()), hit
    assert sum(hit.values()) / (sum(hit.values()) + false) >= 0.9, false


def test_all_paths_at_once_equal_one_by_one():
    rng = np.random.default_rng(8)
    crf = S.Crf(np.zeros((1, 3)), rng.normal(size=(3, 3)))
    e = rng.normal(size=(400, 3)) * 2
    e[rng.random(400) < 0.4] = [-40.0, -40.0, 10.0]
    first = rng.random(400) < 0.05
    first[0] = True
    tags = crf.decode(e, first)
    for a, b in zip(np.flatnonzero(first), np.append(np.flatnonzero(first)[1:], 400)):
        score, back = e[a], []
        for k in range(a + 1, b):
            come = score[:, None] + crf.moves
            back.append(come.argmax(axis=0))
            score = come.max(axis=0) + e[k]
        want = [int(score.argmax())]
        for step in reversed(back):
            want.append(int(step[want[-1]]))
        assert tags[a:b].tolist() == want[::-1]
