from glosswork.operators import graph
from glosswork.plans.roster import FACTS


def facts(spark, rows):
    return spark.createDataFrame(rows, "relation string, subject string, object string")


CHAIN = [("related_to", a, b) for a, b in zip("abcde", "bcdef")]


def expand(spark, rows, depth, most=50):
    seeds = spark.createDataFrame([(1, "a")], "query_id long, token string")
    return [r["token"] for r in graph.expand(facts(spark, rows), seeds, depth, most).orderBy("confidence", ascending=False).collect()]


def test_expansion(spark):
    assert expand(spark, CHAIN, 1) == ["b"]
    assert sorted(expand(spark, CHAIN, 2)) == ["b", "c"]
    assert sorted(expand(spark, CHAIN, 10)) == ["b", "c", "d"]
    assert expand(spark, [("is_a", "b", "a")], 2) == ["b"]
    assert expand(spark, CHAIN, 2, 1) == ["b"]


def test_closure_with_a_cycle(spark):
    got = {tuple(r) for r in graph.closure(facts(spark, [*CHAIN, ("related_to", "f", "a"), ("used_for", "a", "x"), ("used_for", "x", "y")])).collect()}
    assert {(a, b) for r, a, b in got if r == "related_to"} == {(a, b) for a in "abcdef" for b in "abcdef"}
    assert ("used_for", "a", "y") not in got
    asked = facts(spark, [("used_for", "a", "y"), ("related_to", "c", "a")])
    assert {r["relation"]: r["holds"] for r in graph.provable(facts(spark, [*CHAIN, ("related_to", "f", "a")]), asked).collect()} == {"used_for": False, "related_to": True}


def test_proofs():
    p = graph.Proofs(FACTS)
    steps = p.path("gpt", "model")
    assert [(s["source"], s["target"]) for s in steps] == [("gpt", "transformer"), ("transformer", "neural-network"), ("neural-network", "model")]
    assert p.path("gpt", "search")[0]["relation"] == "used_for"
    assert p.path("model", "gpt") == []
    assert p.explain("is_a", "gpt", "neural-network") == "is_a(gpt, transformer)\nis_a(transformer, neural-network)"
    assert p.explain("used_for", "gpt", "search").startswith("Cannot prove")
    assert p.explain("is_a", "x", "y") == "Cannot prove is_a(x, y)"


def test_proof_query_agrees_with_closure(spark, sf):
    from glosswork.plans import roster

    steps = [r.asDict() for r in roster.proof_path(spark, sf).collect()]
    known = {tuple(r) for r in roster._facts(spark, sf).collect()}
    closed = {(r["relation"], r["subject"], r["object"]) for r in roster.fact_closure(spark, sf).collect()}
    by = {}
    for x in steps:
        assert (x["relation"], x["source"], x["target"]) in known
        by.setdefault((x["relation"], x["subject"], x["object"]), {})[x["depth"]] = (x["source"], x["target"])
    for (_, subject, object_), hops in by.items():
        chain = [hops[k] for k in range(len(hops))]
        assert chain[0][0] == subject and chain[-1][1] == object_ and all(a[1] == b[0] for a, b in zip(chain, chain[1:]))
    # every pair that the closure proves has a proof, by the first relation that has one
    assert {(s, o) for _, s, o in closed} <= {(s, o) for _, s, o in by}
    assert {k for k in by if k[0] == "is_a"} == {k for k in closed if k[0] == "is_a"}


def test_components(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "z"), ("p", "q"), ("s", "s")], "a string, b string")
    got = {r["token"]: r["root"] for r in graph.components(e).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["z"] == "x" and got["q"] == "p" and "s" not in got
    assert sorted(r["size"] for r in graph.clusters(e).collect()) == [3, 61]


def test_synonym_groups(spark):
    e = spark.createDataFrame([("car", "auto", 2.0, 5), ("auto", "vehicle", 1.8, 4)], "a string, b string, score double, n long")
    r = graph.synonym_groups(e, 10).collect()
    assert len(r) == 1 and r[0]["canonical"] == "auto" and r[0]["variants"] == ["car", "vehicle"] and r[0]["support"] == 18 and r[0]["score"] == 2.0
