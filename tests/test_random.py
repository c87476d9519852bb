"""Random programs against a naive evaluator."""

import itertools
import random

import pytest

from stratalog import Database

RULES = ["P(x, y) <- E(x, y)", "P(x, z) <- P(x, y) & E(y, z)", "P(y, x) <- E(x, y) & Q(x)", "Q(x) <- P(x, x)", "Q(y) <- E(~(1), y)", "P(x, z) <- P(x, y) & P(y, z)", "Q(x) <- P(x, _) & Q(_)", "P(x, y) <- Q(x) & Q(y)"]


def naive(rules, facts):
    """Every rule over every assignment of its variables, until nothing is new."""
    facts = {k: set(v) for k, v in facts.items()}
    parsed = []
    for r in rules:
        head, body = r.split(" <- ")
        clause = lambda t: (t[0], t[t.index("(") + 1 : -1].split(", ") if "~" not in t else [x.replace("~(1)", "1") for x in t[2:-1].split(", ")])
        parsed.append((clause(head), [clause(c) for c in body.split(" & ")]))
    while True:
        fresh = set()
        for (hp, hv), body in parsed:
            for rows in itertools.product(*(facts[p] for p, _ in body)):
                env, ok = {}, True
                for (_, vs), row in zip(body, rows):
                    for v, x in zip(vs, row):
                        if v != "_" and (x != int(v) if v.isdigit() else env.setdefault(v, x) != x):
                            ok = False
                if ok:
                    t = (hp, tuple(env[v] for v in hv))
                    if t[1] not in facts[hp]:
                        fresh.add(t)
        if not fresh:
            return facts
        for p, t in fresh:
            facts[p].add(t)


@pytest.mark.parametrize("seed", range(3))
def test_random_programs(spark, seed):
    r = random.Random(seed)
    rules = r.sample(RULES, 4)
    facts = {"E": {(r.randint(0, 4), r.randint(0, 4)) for _ in range(5)}, "P": set(), "Q": {(r.randint(0, 4),)}}
    db = Database(spark, "E(i64, i64)\nP(i64, i64)\nQ(i64)\n" + "\n".join(f"r{k}: {t}" for k, t in enumerate(rules)))
    rows = sorted(facts["E"])
    db.insert("E", rows[:3])
    db.insert("Q", sorted(facts["Q"]))
    db.run_rules()
    db.insert("E", rows[3:] or rows)
    db.run_rules()
    want = naive(rules, facts)
    for p in "PQ":
        assert {tuple(x) for x in db.rows(p).collect()} == want[p]
